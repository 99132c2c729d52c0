"""Background samples and cluster bootstraps against one-process versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import background, bootstrap, order


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(6), i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(5)
    got = {r.b: (r.before, r.top, r.n) for r in order.ordinals(order.running(order.running(df, [F.col("a"), F.col("b")], {"before": F.col("v")}), [F.col("a"), F.col("b")], {"top": F.col("v")}, how=F.max, start=F.lit(-1)), [F.desc("a"), F.col("b")], "n").collect()}
    total, top, want = 0, -1, {}
    for _, b, v in sorted(rows):
        want[b] = (total, top)
        total, top = total + v, max(top, v)
    down = {b: i for i, (_, b) in enumerate(sorted((-a, b) for a, b, _ in rows))}
    assert got == {b: (*x, down[b]) for b, x in want.items()}


def test_permutation_has_every_number_once(spark):
    for half in (1, 3, 5):
        got = [r[0] for r in spark.range(1 << 2 * half).select(background.permuted(F.col("id"), half, "s")).collect()]
        assert sorted(got) == list(range(1 << 2 * half)) and (half == 1 or got != sorted(got))


SEGMENTS = [("c1", 0, 30), ("c1", 50, 53), ("c1", 100, 104), ("c2", 7, 400), ("c3", 0, 4), ("c3", 9, 9)]


def starts():
    return [(c, s) for c, a, b in SEGMENTS for s in range(a, b - 4 + 1)]


def test_background_is_without_replacement_and_whole(spark):
    df = spark.createDataFrame(SEGMENTS, "chrom string, st long, en long")
    taken = spark.createDataFrame([("c2", 7), ("c2", 8), ("c1", 0)], "chrom string, start int")
    even = lambda x: x.filter("start % 2 = 0")
    all_ = {(r.chrom, r.start) for r in background.sample(df, 10_000, 4).collect()}
    assert all_ == set(starts())
    some = [(r.chrom, r.start) for r in background.sample(df, 120, 4, positives=taken, accept=even).collect()]
    fit = {x for x in starts() if x[1] % 2 == 0} - {("c2", 8), ("c1", 0)}
    assert len(set(some)) == len(some) == 120 and set(some) <= fit
    few = [(r.chrom, r.start) for r in background.sample(df, 60, 4, positives=taken, accept=even).collect()]
    assert few == some[:60]
    assert background.sample(df.filter("en < 0"), 5, 4).count() == 0


def test_each_start_has_the_same_chance(spark):
    df = spark.createDataFrame(SEGMENTS, "chrom string, st long, en long")
    seen, quota, seeds = dict.fromkeys(starts(), 0), 100, 60
    places, n = background.usable(df, 4).collect(), len(starts())
    half = background.half_bits(n)
    for seed in range(seeds):
        # The draws as sample makes them, in one query for all seeds' sake.
        drawn = spark.range(1 << 2 * half).select("id", background.permuted(F.col("id"), half, f"s{seed}").alias("x")).filter(F.col("x") < n).orderBy("id").limit(quota).collect()
        for r in drawn:
            p = next(p for p in places if p.before <= r.x < p.before + p.starts)
            seen[p.chrom, p.st + r.x - p.before] += 1
    expected = quota * seeds / n
    # Without replacement the spread is smaller by the share that is left over.
    chi = sum((v - expected) ** 2 / (expected * (1 - quota / n)) for v in seen.values())
    assert abs(chi - (n - 1)) < 5 * (2 * n) ** 0.5


def test_counts_of_draws(spark):
    n, reps = 37, 400
    whole = bootstrap.draw_counts(np.arange(n), n, reps, "x")
    assert (whole.sum(axis=0) == n).all()
    assert (bootstrap.draw_counts(np.array([3, 17, 36]), n, reps, "x") == whole[[3, 17, 36]]).all()
    assert whole.mean() == 1 and abs(whole.var() - (1 - 1 / n)) < 0.05
    assert abs(np.corrcoef(whole[0], whole[30])[0, 1] + 1 / (n - 1)) < 0.2


def step_ap(rows):
    """Rows: score, label, weight."""
    total, seen, hits, ap = sum(w for _, y, w in rows if y == 1), 0.0, 0.0, 0.0
    if not total or total == sum(w for *_, w in rows):
        return None
    for _, tie in itertools.groupby(sorted(rows, key=lambda r: -r[0]), key=lambda r: r[0]):
        tie = list(tie)
        new = sum(w for _, y, w in tie if y == 1)
        hits, seen = hits + new, seen + sum(w for *_, w in tie)
        ap += new * hits / seen if seen else 0.0
    return ap / total


@pytest.fixture
def scored():
    rng = random.Random(7)
    names = [f"c{i}" for i in range(12)]
    base = [(rng.choice(names), int(rng.random() < 0.25)) for _ in range(160)] + [("alone", 1)]
    return [(cond, seed, c, y, round(rng.random() + 0.3 * y * (1 + (cond == "C1")), 1)) for c, y in base for cond in ("C0", "C1") for seed in (1, 2)]


def test_paired_bootstrap_is_that_of_one_process(spark, scored):
    df = spark.createDataFrame(scored, "condition string, seed int, component string, label int, score double").repartition(5)
    reps = 60
    got = {(r.seed, r.replicate): r.delta for r in bootstrap.paired_ap(df, "condition", "C0", "C1", "seed", replicates=reps, size=16).collect()}
    names = sorted({r[2] for r in scored})
    counts = bootstrap.draw_counts(np.arange(len(names)), len(names), reps, "bootstrap")
    assert len(got) == 2 * reps
    for seed in (1, 2):
        for rep in range(reps):
            a, b = (step_ap([(s, y, counts[names.index(c), rep]) for k, z, c, y, s in scored if (k, z) == (cond, seed)]) for cond in ("C0", "C1"))
            assert got[seed, rep] == (None if a is None or b is None else pytest.approx(b - a, abs=1e-12))
    row = bootstrap.interval(spark.createDataFrame([(1, 0.5), (1, None), (1, 0.7)], "seed int, delta double"), "delta", ["seed"]).first()
    assert (row["mean"], row.lo, row.hi, row.valid, row.invalid) == (pytest.approx(0.6), pytest.approx(0.505), pytest.approx(0.695), 2, 1)


def test_one_class_replicates_are_null(spark):
    rows = [("a", 1, 0.9), ("b", 0, 0.1), ("c", 0, 0.5)]
    df = spark.createDataFrame(rows, "component string, label int, score double")
    got = {r.replicate: r.ap for r in bootstrap.replicated_ap(df, [], replicates=50).collect()}
    counts = bootstrap.draw_counts(np.arange(3), 3, 50, "bootstrap")
    assert {r: x is None for r, x in got.items()} == {r: counts[0, r] in (0, 3) for r in range(50)} and all(x in (None, 1.0) for x in got.values())


def test_paired_means_over_seeds(spark, scored):
    rows = [r for r in scored if not (r[2] == "c3" and r[0] == "C1" and r[1] == 2)]
    df = spark.createDataFrame(rows, "condition string, seed int, component string, label int, score double").repartition(3)
    reps = 40
    got = {r.replicate: r.delta for r in bootstrap.paired_means(df, "condition", "C0", "C1", "seed", "score", replicates=reps).collect()}
    names = sorted({r[2] for r in rows})
    counts = bootstrap.draw_counts(np.arange(len(names)), len(names), reps, "bootstrap")
    mean = lambda cond, seed, c: (lambda v: sum(v) / len(v) if v else None)([s for k, z, n, _, s in rows if (k, z, n) == (cond, seed, c)])
    for rep in range(reps):
        per_seed = []
        for seed in (1, 2):
            both = [(counts[i, rep], mean("C1", seed, c) - mean("C0", seed, c)) for i, c in enumerate(names) if mean("C0", seed, c) is not None and mean("C1", seed, c) is not None]
            if sum(w for w, _ in both):
                per_seed.append(sum(w * g for w, g in both) / sum(w for w, _ in both))
        assert got[rep] == pytest.approx(sum(per_seed) / len(per_seed))
