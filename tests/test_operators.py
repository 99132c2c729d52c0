"""Hand-computed cases, guards and invariants."""

import random

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions import motif as mo
from seqloom.functions import sequence as sq
from seqloom.operators import controls, graph, intervals, metrics, weights
from seqloom.sources import readers, sinks

IDENTITY = mo.Motif(tuple(tuple(float(b == c) for c in "ACGU") for b in "ACGU"), pseudocount=0.0)


def test_scan_identity(spark):
    scores = mo.scan_scores(["GGGGACGUAAAA"], IDENTITY)[0]
    assert (scores.argmax(), scores.max(), len(scores)) == (4, 8.0, 9)
    row = spark.createDataFrame([("GGGGACGUAAAA",), ("ACG",)], "s string").select(mo.scan(F.col("s"), IDENTITY).alias("v")).collect()
    assert np.allclose(row[0].v, scores) and row[1].v == []


def test_reverse_complement(spark):
    got = spark.createDataFrame([("AAAAC",), ("UUUUG",), ("GGACGUAA",)], "s string").select(sq.reverse_complement(F.col("s")).alias("r")).collect()
    assert [r.r for r in got] == ["GTTTT", "CAAAA", "UUACGUCC"]


def test_slice_is_null_outside(spark):
    rows = spark.createDataFrame([(0, 3), (-1, 3), (2, 9), (3, 3)], "a int, b int")
    got = rows.select(sq.slice_checked(F.lit("acgu"), F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == ["ACG", None, None, None]


def test_best_hits_do_not_overlap():
    assert mo.best_hits(np.array([1.0, 5.0, 4.0, 1.0, 4.0]), 3, 3.0) == [1, 4]


def test_iupac_and_consensus():
    assert (IDENTITY.consensus(), IDENTITY.iupac()) == ("ACGU", "ACGU")


def test_merge_touching(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 9), ("a", 10, 12), ("b", 1, 2)], "chrom string, st long, en long")
    assert sorted(map(tuple, intervals.merge(df).collect())) == [("a", 0, 9), ("a", 10, 12), ("b", 1, 2)]


def test_overlaps_against_brute_force(spark):
    random.seed(3)
    made = [[(i, "c", a := random.randrange(500), a + random.randrange(1, 200)) for i in range(60)] for _ in range(2)]
    left = spark.createDataFrame(made[0], "id long, chrom string, st long, en long")
    right = spark.createDataFrame(made[1], "r_id long, r_chrom string, r_st long, r_en long")
    got = sorted((r.id, r.r_id) for r in intervals.overlaps(left, right).collect())
    assert got == sorted((x[0], y[0]) for x in made[0] for y in made[1] if x[2] < y[3] and x[3] > y[2])


def test_subtract(spark):
    spans = spark.createDataFrame([(1, "c", 0, 100)], "span long, chrom string, st long, en long")
    cut = spark.createDataFrame([("c", 10, 20), ("c", 50, 60)], "r_chrom string, r_st long, r_en long")
    assert sorted((r.st, r.en) for r in intervals.subtract(spans, cut, "span").collect()) == [(0, 10), (20, 50), (60, 100)]


def test_collapse_hangs_on_kept_rows(spark):
    df = spark.createDataFrame([(1, "c", 0, 10), (2, "c", 5, 15), (3, "c", 10, 20)], "id long, chrom string, st long, en long")
    assert sorted(r.id for r in intervals.collapse(df, "chrom", "id").collect()) == [1, 3]


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(30)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(25, 26)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[26] == 25 and got[24] == 24


def test_perfect_ranking_and_one_class(spark):
    df = spark.createDataFrame([("p", y, s) for y, s in zip((0, 0, 1, 1, 1), (0.01, 0.02, 0.5, 0.6, 0.7))] + [("q", 1, 0.5)] * 10, "k string, label int, score double")
    ap = {r.k: r.ap for r in metrics.average_precision(df, ["k"]).collect()}
    auc = {r.k: r.auroc for r in metrics.auroc(df, ["k"]).collect()}
    assert ap == {"p": 1.0, "q": None} and auc == {"p": 1.0, "q": None}


def test_bootstrap_draws_as_many_as_there_are(spark):
    comp = spark.createDataFrame([(f"C{i}",) for i in range(60)], "component string")
    got = metrics.multiplicities(comp, 20).groupBy("rep").agg(F.sum("times").alias("n")).collect()
    assert len(got) == 20 and all(r.n == 60 for r in got)


def test_balanced_weights_have_mean_one(spark):
    rows = [("A", y) for y in (0, 0, 0, 1)] + [("B", y) for y in (0, 1, 1, 1)]
    got = weights.balanced(spark.createDataFrame(rows, "stratum string, label int")).collect()
    by = {(r.stratum, r.label): r.w for r in got}
    assert abs(sum(r.w for r in got) / 8 - 1) < 1e-12 and abs(by["A", 1] / by["A", 0] - 3) < 1e-12


def test_merge_sparse_never_leaves_context():
    goes = weights.merge_sparse([("x", 0, 0, 9, 9), ("x", 1, 0, 1, 9), ("y", 0, 0, 0, 9)], 5)
    assert goes == {("x", 0, 0): ("x", 0, 0), ("x", 1, 0): ("x", 0, 0), ("y", 0, 0): None}


def test_controls_keep_composition():
    motif = mo.Motif(tuple(tuple(0.91 if b == c else 0.03 for c in "ACGU") for b in "CUCUCU"))
    random.seed(5)
    s = "".join(random.choices("AG", k=60)) + "CUCUCU" + "".join(random.choices("AG", k=60))
    before = mo.scan_scores([s], motif)[0]
    for made in controls.order_controls(1, s, motif, 5.0):
        assert sorted(made) == sorted(s) and mo.scan_scores([made], motif)[0][60] < before[60]
    assert controls.outside_controls(1, s, motif, 5.0) and controls.order_controls(1, s, motif, 5.0) == controls.order_controls(1, s, motif, 5.0)


def test_readers(spark, tmp_path):
    (tmp_path / "p.bed").write_text("track x\nchr1\t1\t5\tn\t0\t+\t1\t2\t3\t4\nscaf\t1\t5\tn\t0\t+\t1\t2\t3\t4\n")
    assert [(r.chrom, r.start) for r in readers.peaks(spark, str(tmp_path / "p.bed")).collect()] == [("chr1", 1)]
    (tmp_path / "g.gtf").write_text('#c\nchr1\tx\tgene\t10\t20\t.\t+\t.\tgene_id "G1"; gene_name "N";\n')
    row = readers.genes(spark, str(tmp_path / "g.gtf")).first()
    assert (row.start, row.end, row.gene_id, row.gene_name) == (9, 20, "G1", "N")
    (tmp_path / "f.fa").write_text(">toy one\nacg\nt\n>b\nAA\n")
    assert sorted(map(tuple, readers.fasta(spark, str(tmp_path / "f.fa")).collect())) == [("b", "AA"), ("toy", "ACGT")]


def test_content_hash_ignores_order(spark):
    df = spark.range(10)
    assert sinks.content_hash(df).first() == sinks.content_hash(df.orderBy(F.desc("id"))).first()


def test_control_panel_fills_to_twenty_and_asks_for_five(spark):
    motif = mo.Motif(tuple((0.05, 0.85, 0.05, 0.05) if b == "C" else (0.05, 0.05, 0.05, 0.85) for b in "CUUUUCU"))
    rng = np.random.default_rng(4)
    varied = "".join(rng.choice(list("AG"), 97)) + "CUUUUCU" + "".join(rng.choice(list("AG"), 97))
    rows = spark.createDataFrame([(1, varied), (2, "AAACUUUUCUAAA"), (3, "A" * 97 + "G" * 104)], "doc_id long, seq string")
    got = {}
    for r in controls.control_panel(rows, motif, 5.0).collect():
        got.setdefault((r.doc_id, r.kind), []).append(r)
    assert len(got[1, "outside"]) == 20 and all(r.informative for r in got[1, "outside"])
    assert len(got[1, "order"]) > 5 and all(r.informative for r in got[1, "order"])
    assert all(not r.informative and r.exclusion_reason for r in got[2, "outside"] + got[3, "order"] + got[3, "outside"])
    few = controls.control_panel(rows.filter("doc_id = 1"), motif, 5.0, most=4).collect()
    assert len(few) == 8 and not any(r.informative for r in few) and {r.exclusion_reason for r in few} == {"fewer than 5 controls"}


def test_logistic_grid_takes_the_best_validation_precision(spark):
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import Vectors

    from seqloom.plans import catalog

    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] + 2 * rng.normal(size=240) > 0).astype(int)
    frame = lambda a, b: spark.createDataFrame([(Vectors.dense(v), int(k), 1.0) for v, k in zip(x[a:b], y[a:b])], ["features", "label", "w"])
    train, held = frame(0, 24), frame(24, 240)
    aps = {}
    for c in (0.01, 0.1, 1.0, 10.0, 100.0):
        with_one = catalog.GRID
        catalog.GRID = (c,)
        model, _ = catalog.best_logistic(train, held)
        catalog.GRID = with_one
        rows = sorted(((r.p, r.label) for r in model.transform(held).select(vector_to_array("probability")[1].alias("p"), "label").collect()), reverse=True)
        tops = np.cumsum([k for _, k in rows])
        aps[c] = sum(t / (i + 1) for i, (t, (_, k)) in enumerate(zip(tops, rows)) if k) / tops[-1]
    _, chosen = catalog.best_logistic(train, held)
    assert chosen == max(aps, key=aps.get) != 1.0
