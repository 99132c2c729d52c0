"""Merges, greedy choices and loci over ranges of one chromosome, against one-process versions."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import intervals, order, splits


def made(seed, n=400, wide=9):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randrange(0, 2 * n)
        out.append((i, "big" if rng.random() < 0.9 else rng.choice("ab"), a, a + rng.randrange(0, wide)))
    return out + [(n, "big", 5, 5), (n + 1, "big", 5, 5)]


def plain(rows, touching):
    number, out, chrom, reach = 0, {}, None, None
    for c, a, b in sorted({r[1:] for r in rows}):
        if c != chrom or not (a <= reach if touching else a < reach):
            number, reach = number + 1, b
        chrom, reach = c, max(reach, b)
        out[c, a, b] = number
    return out


@pytest.mark.parametrize("touching", [False, True])
def test_islands(spark, touching):
    rows = made(3)
    got = {tuple(r)[:3]: r.island for r in intervals.islands(spark.createDataFrame(rows, "id long, chrom string, st long, en long").repartition(5), touching=touching).collect()}
    assert got == plain(rows, touching)


def test_merge_and_collapse(spark):
    rows = made(4)
    df = spark.createDataFrame(rows, "id long, chrom string, st long, en long").repartition(3)
    spans = {}
    for (c, a, b), i in plain(rows, True).items():
        lo, hi = spans.get((c, i), (a, b))
        spans[c, i] = min(lo, a), max(hi, b)
    assert sorted(map(tuple, intervals.merge(df).collect())) == sorted((c, *s) for (c, _), s in spans.items())
    want, last = [], {}
    for i, c, a, b in sorted(rows, key=lambda r: (r[1], r[2], r[3], r[0])):
        if a >= last.get(c, -1):
            want.append(i)
            last[c] = b
    assert sorted(r.id for r in intervals.collapse(df, "chrom", "id").collect()) == sorted(want)


def test_loci(spark):
    rows = made(5, wide=4)
    got = {r.id: r.locus for r in splits.locus_groups(spark.createDataFrame(rows, "id long, chrom string, st long, en long"), "id", "chrom", "st", "en").collect()}
    want = plain(rows, False)
    assert len(got) == len(rows)
    assert len({(got[i], want[c, a, b]) for i, c, a, b in rows}) == len(set(got.values())) == len(set(want.values()))


def test_one_chromosome_is_in_several_tasks(spark):
    df = spark.range(1000).select(F.lit("c").alias("chrom"), F.col("id").alias("st"), (F.col("id") + 1).alias("en"))
    assert order.ranges(df, [F.col("chrom"), F.col("st"), F.col("en")]).groupBy(order.RANGE).count().count() > 1
    assert intervals.merge(df).count() == 1 and intervals.islands(df).select("island").distinct().count() == 1000
    assert intervals.merge(df.limit(0)).count() == 0
