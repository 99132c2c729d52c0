"""Columns of any name, nulls, empty tables, long texts and repeated rows; rates and groups against brute force."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import LEXICON, bags, corpus, prose

from seqloom.llm import _shared, chat, decontaminate, html, mixing, near, quality, scoring, substring, tokens, topk

NAMES = ["_K", "_row", "_key", "key", "held", "a.b", "te`xt", "copies"]


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, LEXICON[0]), (None, None), (3, " ".join(LEXICON[:20]))], "item_id long, text string")


def test_columns_of_any_name_are_kept(spark, docs, bench):
    rows = corpus()[20:30]
    df = docs(rows)
    for name in NAMES:
        df = df.withColumn(name, F.col("doc_id") * 2 + 1)
    for out in (near.one_of_each(df), substring.rows_with_repeats_removed(df), decontaminate.clean(df, bench), quality.accepted(df, quality.learn(df, spark.createDataFrame([], "doc_id long, quality int")), 0.0)):
        assert out.columns == df.columns
        assert all(set(r[4:]) == {None if r[0] is None else 2 * r[0] + 1} for r in out.collect())
    made = mixing.mixed(df)
    assert made.columns == [*df.columns[:-1], "copies", "taken"] and all(set(r[4:-2]) == {2 * r[0] + 1} for r in made.collect())


def test_operators_ignore_other_columns_and_take_empty_tables(spark, docs, bench):
    rows = corpus()[20:30]
    df = docs(rows)
    for name in NAMES:
        df = df.withColumn(name, F.lit(1))
    made = lambda d: [near.classes(d), substring.remove_repeats(d), decontaminate.contaminated(d, bench), tokens.token_counts(d), mixing.mix(d), scoring.scores(d)]
    for out, n in zip(made(df), (10, 10, None, 10, 10, 10)):
        assert n in (None, out.count())
    assert all(out.count() == 0 for out in made(df.limit(0)))
    vectors = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (1, None, 1)], "vec_id long, embedding array<double>, _k int")
    assert [tuple(r) for r in topk.search(vectors.withColumn("rank", F.lit(1))).collect()] == [(0, 1, 1, 65536 + 4 * 65536)]


def test_pages_as_a_table(spark):
    page = "<body><main><p>Long text, with marks. More, here.</p></main></body>"
    deep = "<div>x" * 20_000 + "<article><p>" + "Deep text, it goes on. " * 20 + "</p></article>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", deep)], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("_k", F.lit(1))
    got = html.extracted(df).collect()
    assert [r.text for r in got[:4]] == ["Long text, with marks. More, here."] * 2 + [""] * 2 and [r.n_chars for r in got[:4]] == [34, 34, 0, 0]
    assert got[4].text == ("Deep text, it goes on. " * 20).strip()
    assert html.extracted(df.limit(0)).count() == 0


def test_a_megabyte_of_open_elements():
    assert html.main_text(b"<div>x" * 170_000).startswith("x x")
    assert html.main_text(b"<p><div><b>x</p></i>" * 40_000)


def test_a_word_of_any_length():
    v = tokens.Vocabulary([("▁", -1.0), ("ab", -1.0), ("a", -2.0)], False)
    n, score = v.count("▁" + "ab" * 300_000)
    assert n == 300_001 and score == pytest.approx(-300_001.0)


def test_texts_over_a_piece(docs):
    old = _shared.PIECE, scoring.CHUNK, scoring.SEGMENT
    text = prose(3000, random.Random(1))
    rows = [(1, text, "s"), (2, text + " end", "s"), (3, "x", "s")]
    try:
        whole = [sorted(map(tuple, f(docs(rows)).collect())) for f in (near.classes, substring.remove_repeats, tokens.token_counts)]
        _shared.PIECE = 500
        cut = list(_shared.words_of(text.encode()))
        assert len(cut) > 10 and [w for p in cut for w in p] == text.encode().split()
    finally:
        _shared.PIECE, scoring.CHUNK, scoring.SEGMENT = old
    assert [r[1] for r in whole[0]] == [1, 1, 3] and whole[1][2][1:3] == (1, 0) and whole[1][0][1:3] == (3000, 3000)


def test_near_groups_around_the_threshold(docs, monkeypatch):
    """A group of near copies whose pairs lie on both sides of 0.8, over several blocks, against all pairs."""
    monkeypatch.setattr(near, "BLOCK", 40)
    rng = random.Random(12)
    base = prose(400, rng).split()
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(400), rng.randint(4, 16)):
            w[at] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w), "s"))
    # Shingles occur once each, so that probability Jaccard is the share of common ones.
    sets = [set(bags(t)) for _, t, _ in rows]
    assert all(len(x) == 396 for x in sets)
    root, links = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links += 1
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert 1 < len(set(root)) < 140 and links < 150 * 149 / 4
    assert {r.doc_id: r.class_id for r in near.classes(docs(rows)).collect()} == dict(enumerate(root))


def test_mixing_rates_against_the_dual_by_bisection(docs):
    rng = random.Random(13)
    rows = [(i, prose(rng.choice([0, 1, 5, 20, 60, 300, 900]), rng), f"s{i % 5}") for i in range(400)] + [(900 + i, "one", "s9") for i in range(3)]
    rows += [(7, "same words", "s1")] * 30
    made = [mixing.mix(d) for d in (docs(rows), docs(rows).repartition(5, "text"), docs(rows[::-1]))]
    got = [sorted((r.doc_id, r.source, r.size, r.taken, r.target) for r in x.collect()) for x in made]
    assert got[0] == got[1] == got[2]
    sizes, want, taken, copies = collections.defaultdict(list), {}, collections.Counter(), collections.defaultdict(list)
    for doc_id, source, size, n, target in got[0]:
        sizes[source].append(size)
        want[source] = target
        taken[source] += n
        assert n <= 3 * size and (size == 0 or n % size == 0)
        copies[source].append((size, n // max(size, 1)))
    for s, all_ in sizes.items():
        all_ = [x for x in all_ if x]
        if want[s] >= 3 * sum(all_) * (1 - 1e-9):
            assert taken[s] == 3 * sum(all_)
            continue
        assert abs(taken[s] - want[s]) <= max(1, 0.01 * want[s])
        lo, hi = -50.0, 50.0
        for _ in range(200):
            u = (lo + hi) / 2
            words = sum(x * min(3, math.exp(min(u * x, 5))) for x in all_)
            lo, hi = (u, hi) if words < want[s] else (lo, u)
        # Rates are rounded up or down, but for what the last rounds move: less than the words of the largest document.
        moved = sum(x * int(abs(n - min(3, math.exp(min(u * x, 5))))) for x, n in copies[s] if x)
        assert moved <= max(all_)


def test_balance_meets_every_target(spark):
    groups = spark.createDataFrame([("a", 1, 1000), ("a", 10_000, 3), ("b", 7, 10), (None, 3, 5), (None, 400, 5)], "source string, size long, n long")
    wanted = spark.createDataFrame([("a", 31_000, 500.0), ("b", 70, 210.0), (None, 2015, 4000.0)], "source string, source_size long, target double")
    rates = mixing.balance(groups, wanted, _shared.Shelf(spark, "test")).collect()
    sums = collections.Counter()
    for r in rates:
        sums[r.source] += r.size * r.n * r.rate
    assert sums["a"] == pytest.approx(500, rel=1e-8) and sums["b"] == pytest.approx(210) and sums[None] == pytest.approx(4000, rel=1e-8)
    by = {(r.source, r.size): r.rate for r in rates}
    # One multiplier a source: the logarithm of a rate is in proportion to the size, up to the cap.
    assert math.log(by[None, 400]) / 400 == pytest.approx(math.log(by[None, 3]) / 3) and by["a", 10_000] == pytest.approx(by["a", 1] ** 10_000)


def test_pipeline_on_odd_rows(spark, docs, bench, tmp_path):
    import corpus_pipeline

    rows = corpus() + [(28, "one", "s0"), (None, None, None)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 30, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, df in (("some", docs(rows, True).withColumn("_k", F.lit(1)).withColumn("a.b", F.lit(2))),):
        kept = df
        for title, stage in corpus_pipeline.STAGES:
            kept = _shared.Shelf(spark, "test").put(stage(spark, kept, str(tmp_path)), "stage")
            assert kept.columns == df.columns + (["copies", "taken"] if title == "source mixing" else [])
        assert kept.count() <= df.count()


def test_conversations_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    for name in ("_k", "parts", "formatted", "mask"):
        df = df.withColumn(name, F.lit(1))
    assert [(r.conv_id, r.n_turns) for r in chat.digests(chat.formatted(df)).collect()] == [(1, 2)]
