"""Work done in the row: matching blocks, k-mers, scans, exact quantiles."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import blocks, kmers
from seqloom.functions import motif as mo
from seqloom.operators import near_duplicates, quantiles

RNG = random.Random(3)


def letters(n, alphabet="ACGU"):
    return "".join(RNG.choice(alphabet) for _ in range(n))


def edited(s):
    out = list(s)
    for _ in range(RNG.randrange(25)):
        i = RNG.randrange(len(out) + 1)
        out[i : i + RNG.randrange(3)] = letters(RNG.randrange(4))
    return "".join(out)


def test_blocks_of_a_thousand_pairs(monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 200_000)
    left = [letters(RNG.choice([0, 1, 5, 40, 201]), RNG.choice(["ACGU", "AC", "A"])) for _ in range(1000)]
    right = [edited(s) if i % 3 else letters(RNG.choice([0, 3, 60, 201])) for i, s in enumerate(left)]
    want = [sum(b.size for b in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for a, b in zip(left, right)]
    assert blocks.matched(left, right) == want
    assert blocks.matched([], []) == []


def test_verification_by_blocks(spark):
    one = letters(201)
    close = one[:50] + "A" + one[50:120] + one[123:]
    turned = close[::-1].translate(str.maketrans("ACGU", "UGCA"))
    df = spark.createDataFrame([(1, one), (2, close), (3, turned), (4, letters(201)), (5, one[:100])], "id long, seq string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5)], "a long, b long")
    got = {r.b: r for r in near_duplicates.verified_by_blocks(pairs, df, "id", "seq").collect()}
    assert set(got) == {2, 3} and (got[2].strand, got[3].strand) == ("+", "-")
    assert got[2].identity == pytest.approx(198 / 201) and got[2].coverage == pytest.approx(198 / 199)


def test_kmers(spark):
    texts = ["ACGUACGU", "AC", "", "NNACGUNACG", letters(300)]
    for k in (1, 3, 5):
        owner, kmer, n, starts = kmers.counts(texts, k)
        got = {(int(o), kmers.names(k)[m]): int(c) for o, m, c in zip(owner, kmer, n)}
        want = {}
        for i, t in enumerate(texts):
            for j in range(len(t) - k + 1):
                if set(t[j : j + k]) <= set("ACGU"):
                    want[i, t[j : j + k]] = want.get((i, t[j : j + k]), 0) + 1
        assert got == want and starts.tolist() == [max(len(t) - k + 1, 0) for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id long, seq string")
    rows = {(r.id, r.kmer): r.freq for r in kmers.frequencies(df, "id", "seq", (2,)).collect()}
    assert rows[0, "AC"] == pytest.approx(2 / 7) and rows[3, "NN" if (3, "NN") in rows else "AC"] == pytest.approx(2 / 9)
    made = kmers.vectors(texts)
    assert made.shape == (5, 64 + 256 + 1024) and made[4].sum() == pytest.approx(3) and not made[1].any()


MOTIF = mo.Motif(((0.7, 0.1, 0.1, 0.1), (0.1, 0.1, 0.2, 0.6), (0.25, 0.25, 0.25, 0.25)))


def test_scans_agree(spark):
    texts = ["ACGUACGU", "AC", "", "AUNAUG", letters(201)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, seq string")
    whole = {(r.id, p): v for r in df.select("id", mo.scan(F.col("seq"), MOTIF).alias("v")).collect() for p, v in enumerate(r.v)}
    rows = {(r.id, r.pos): r.score for r in mo.scanned(df, "id", "seq", MOTIF).collect()}
    assert rows == pytest.approx(whole) and len(rows) == 6 + 4 + 199


@pytest.mark.parametrize("kind", ["spread", "ties", "close", "one"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(2)
    x = {"spread": rng.lognormal(0, 4, 3000), "ties": rng.integers(0, 7, 3000).astype(float), "close": 1 + rng.integers(0, 50, 3000) * 2.0**-52, "one": np.array([-3.5])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4)
    shares = [0.0, 0.1, 0.5, 0.99, 0.999, 1.0]
    got, n = quantiles.quantiles(df, lambda b: b.column(0).to_numpy(), shares, cells=8, few=5)
    assert n == len(x) and got == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-15, abs=0)
    assert got == pytest.approx(df.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0], rel=1e-12)


def test_no_values(spark):
    assert quantiles.quantiles(spark.createDataFrame([], "v double"), lambda b: b.column(0).to_numpy(), [0.5]) == ([None], 0)
