"""Splits, effects, sources and weights against hand-made cases and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions.motif import IUPAC, Motif, scan_scores
from seqloom.operators import attribution, near_duplicates, splits, weights
from seqloom.sources import readers, validators

RNG = np.random.default_rng(3)


def rna(n):
    return "".join(RNG.choice(list("ACGU"), n))


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, f"g{i}", rna(201), "chr1", 1000 * i, 1000 * i + 201, i % 2) for i in range(60)]
    base = made[0][2]
    made += [
        (100, "g1", rna(201), "chr2", 0, 201, 1),  # shares the gene of 1
        (101, "h1", made[2][2], "chr2", 5000, 5201, 1),  # the sequence of 2
        (102, "h2", rna(201), "chr1", 3100, 3301, 0),  # overlaps 3
        (103, "h3", base[:50] + "A" + base[50:140] + base[141:], "chr2", 9000, 9201, 0),  # a shifted, edited copy of 0
    ]
    return spark.createDataFrame(made, "id long, gene string, seq string, chrom string, start long, end long, label int")


def test_four_rules_make_components(rows):
    edges = {(r.a, r.b) for r in splits.join_edges(rows).collect()}
    assert edges == {(1, 100), (2, 101), (3, 102), (0, 103)}


def test_assignment_and_audit(rows):
    made = splits.assign(rows, splits.join_edges(rows)).withColumn("locus", F.col("id"))
    kinds = {"gene": "gene", "component": "component", "sequence": "seq", "locus": "locus"}
    report = splits.audit(made, kinds, {"train": (1, 1), "validation": (0, 0), "test": (0, 0)})
    assert made.count() == 64 and report["passed"] and len(report["overlaps"]) == 12
    # Leakage that is put in is found, kind by kind.
    for kind, column in kinds.items():
        leaked = made.withColumn(column, F.when(F.col("id") < 64, F.lit(7).cast(made.schema[column].dataType)).otherwise(F.col(column)))
        found = splits.audit(leaked, kinds, {})["overlaps"]
        assert any(n for k, n in found.items() if k.startswith(kind)) and not any(n for k, n in found.items() if not k.startswith(kind))
    assert not splits.audit(made, kinds)["passed"]


def test_giant_components_go_or_stop(rows):
    hub = rows.select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).filter("b > 0 AND b < 6")
    assert splits.assign(rows, hub).count() == 58
    with pytest.raises(ValueError):
        splits.assign(rows, hub, most_lost=0.05)


def test_near_duplicates_on_the_other_strand(spark):
    s = rna(201)
    minus = s.translate(str.maketrans("ACGU", "UGCA"))[::-1]
    df = spark.createDataFrame([(1, s), (2, minus), (3, rna(201))], "id long, seq string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [tuple(r) for r in near_duplicates.verified(pairs, df, "id", "seq").collect()] == [(1, 2, "-", 1.0)]


MOTIF = Motif(((0.1, 0.6, 0.1, 0.2), (0.05, 0.1, 0.05, 0.8), (0.4, 0.3, 0.2, 0.1)))


def test_every_substitution(spark):
    rows = [(i, rna(25)) for i in range(4)] + [(9, "AC"), (10, None)]
    got = attribution.substitutions(spark.createDataFrame(rows, "id long, seq string"), "id", "seq", MOTIF).collect()
    best = lambda s: scan_scores([s], MOTIF)[0].max()
    want = {(i, p, b): best(s[:p] + b + s[p + 1 :]) - best(s) for i, s in rows[:4] for p in range(25) for b in "ACGU" if b != s[p]}
    made = {(r.id, r.pos, r.base): r.exact for r in got if r.id < 9}
    assert made.keys() == want.keys() and all(abs(made[k] - want[k]) < 1e-9 for k in want)
    assert all(r.exact == 0 for r in got if r.id >= 9)


def test_agreement_guards(spark):
    rows = [(1, p, "A", float(p % 7), float(p % 7) * 2) for p in range(30)] + [(2, p, "A", 1.0, float(p)) for p in range(30)] + [(3, 0, "A", 1.0, 2.0)]
    got = {r.id: r for r in attribution.agreement(spark.createDataFrame(rows, "id long, pos long, base string, exact double, first_order double"), "id").collect()}
    assert got[1].status == "ok" and got[1].spearman == pytest.approx(1.0) and got[1].sign_agreement == 1.0
    assert got[2].status == "constant" and got[2].spearman is None and got[3].status == "too few"


def test_motif_file_decoys_and_letters(tmp_path):
    (tmp_path / "m.txt").write_text("Pos\tA\tC\tG\tU\n1\t0.1\t0.6\t0.1\t0.2\n2\t0.4\t0.3\t0.2\t0.1\n")
    m = readers.motif(str(tmp_path / "m.txt"))
    assert m.consensus() == "CA" and m.iupac() == "CM" and m.fingerprint("x") == "x:2:CA:unknown" and set(m.iupac()) <= set(IUPAC.values())
    decoys = m.decoys()
    assert decoys[0].probabilities == m.probabilities[::-1] and len(decoys) == 3
    assert all(sorted(p for r in x.probabilities for p in r) == sorted(p for r in m.probabilities for p in r) for x in decoys) and m.decoys() == decoys
    (tmp_path / "bad.txt").write_text("Pos\tA\tC\tG\tT\n1\t0.1\t0.6\t0.1\t0.2\n")
    with pytest.raises(ValueError):
        readers.motif(str(tmp_path / "bad.txt"))


def test_chunks_and_ranges(spark):
    s = rna(50)
    chunks = readers.fasta_chunks(spark.createDataFrame([("c", s), ("d", "")], "contig string, sequence string"), 16)
    wanted = [(1, "c", 0, 50), (2, "c", 10, 40), (3, "c", -1, 5), (4, "c", 45, 51), (5, "x", 0, 1), (6, "c", 7, 7), (7, "c", 16, 32)]
    got = {r.id: r.sequence for r in readers.fetch(chunks, spark.createDataFrame(wanted, "id long, contig string, start long, end long"), 16).collect()}
    assert got == {1: s, 2: s[10:40], 3: None, 4: None, 5: None, 6: None, 7: s[16:32]}


def test_sources_are_checked_one_by_one(spark, tmp_path):
    files = {
        "p": ("bed", "chr1\t1\t9\tx\t0\t+\t2.0\n"), "q": ("bed", "chr1\t1\t9\n"), "m": ("pwm", "Pos\tA\tC\tG\tU\n1\t0.1\t0.6\t0.1\t0.2\n"), "n": ("pwm", "Pos\tA\tC\tG\tU\n1\t0.9\t0.6\t0.1\t0.2\n"),
        "g": ("gtf", '#c\nchr1\ts\tgene\t1\t9\t.\t+\t.\tgene_id "a.1"; transcript_id "t.2";\n'), "e": ("tsv", "transcript_id\tlength\tTPM\nt.1\t9\t2.5\nu.1\t9\t1\n"), "f": ("fasta", ">c\nACGU\n"),
    }
    for name, (_, text) in files.items():
        (tmp_path / name).write_text(text)
    got = {r.name: r for r in validators.manifest(spark, {n: (k, str(tmp_path / n)) for n, (k, _) in files.items()}).collect()}
    assert {n for n, r in got.items() if r.status == "ok"} == {"p", "m", "g", "e"} and got["p"].bytes == len(files["p"][1]) and len(got["m"].sha256) == 64 and got["q"].sha256 is None
    table, unmapped = readers.expression_by_gene(readers.expression(spark, str(tmp_path / "e")), readers.transcript_genes(spark, str(tmp_path / "g")))
    assert unmapped == 1 and [tuple(r) for r in table.collect()] == [("a", 2.5, 1)]


def test_standard_weights_need_both_classes(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label int")
    assert sorted(r.w for r in weights.standard(df).collect()) == pytest.approx([2 / 3] * 3 + [2.0])
    with pytest.raises(ValueError):
        weights.standard(df.filter("label = 0"))


def test_windows_cover_the_whole_text(spark):
    """Consecutive windows, the last one up to the end; short texts fill one, empty and null ones have none."""
    from seqloom.plans import fixtures

    long, short, even = "abcdefghij" * 50, "a, B!", "acgu" * 201
    texts = [(1, long), (2, short), (3, "12 ."), (4, None), (5, even), (6, ""), (7, long)]
    got = {}
    for r in fixtures._cut(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id // fixtures.PLACES, {})[r.doc_id % fixtures.PLACES] = r.seq
    spelled = long.translate(str.maketrans(fixtures.LETTERS, fixtures.CYCLE))
    assert sorted(got) == [1, 2, 5, 7]
    assert got[1] == got[7] == {0: spelled[:201], 1: spelled[201:402], 2: spelled[-201:]}
    assert got[2] == {0: ("AC" * 101)[:201]}
    assert "".join(got[5][i] for i in range(4)) == even.translate(str.maketrans(fixtures.LETTERS, fixtures.CYCLE))
    assert fixtures._cut(spark.createDataFrame([], "doc_id long, text string")).count() == 0
