"""Vectors: exact products, top-k, clusters and hard negatives, against Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from seqloom.llm import clusters, negatives, products, topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def floors(v, scale):
    return [math.floor(scale * x) for x in v]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def table(rng, n, dims, wide=1.0, ties=False):
    value = (lambda: float(rng.randrange(-2, 3)) / 4) if ties else (lambda: rng.gauss(0, wide))
    rows = [(i, [value() for _ in range(dims)], rng.randrange(4) if rng.random() > 0.05 else None) for i in range(n)]
    rows += [(50, rows[0][1], 1), (100, rows[0][1], 1), (7, None, 2), (8, [None] * dims, 1), (9, [math.nan] * dims, 1), (10, [math.inf] * dims, 0), ((1 << 63) - 1, rows[1][1], 3), (None, rows[1][1], 3)]
    return rows


def last(i):
    return (i is None, i or 0)


@pytest.mark.parametrize("wide", [1.0, 1e6, 1e8, 1e12])
def test_exact_products(wide):
    rng = np.random.default_rng(3)
    a, b = np.floor(rng.normal(0, wide, (7, 5)) * 256), np.floor(rng.normal(0, wide, (6, 5)) * 256)
    want = [[min(max(sum(int(x) * int(y) for x, y in zip(u, v)), products.LEAST), products.MOST) for v in b] for u in a]
    assert products.exact(a, b).tolist() == want


def mined(rows, positives=5, wanted=3):
    rows = [(i, floors(v, 256), y) for i, v, y in rows if y is not None and usable(v)]
    out = []
    for at, (i, v, y) in enumerate(rows):
        if i is None or i % 50:
            continue
        scored = sorted(((-dot(v, w), last(j), z) for k, (j, w, z) in enumerate(rows) if k != at), key=lambda x: x[:2])
        name = lambda x: None if x[0] else x[1]
        for place, (s, j, _) in enumerate([x for x in scored if x[2] == y][:positives], 1):
            fit = [x for x in scored if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:wanted]
            out += [(i, name(j), r, name(n), -s, -t, place) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("wide", "ties"), [(1.0, False), (1e6, False), (1.0, True)])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, wide, ties):
    for name, size in (("ANCHORS", 2), ("CANDIDATES", 37), ("TOGETHER", 2), ("STRETCH", 5)):
        monkeypatch.setattr(negatives, name, size)
    rows = table(random.Random(1), 300, 6, wide, ties)
    got = negatives.mined(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == mined(rows) and len(got) > 20


def test_negatives_of_odd_tables(spark):
    assert negatives.mined(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [0.5, 1.0, 9.0], 2), (0, [1.0, 2.0], 1), (3, [-1.0, 0.0], None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "kind").selectExpr("*", "1 AS _k", "2 AS rank", "3 AS cluster")
    assert sorted(map(tuple, negatives.mined(df, label="kind").collect()), key=str) == mined(rows)


@pytest.mark.parametrize("wide", [1.0, 1e6])
def test_search_is_exact_beyond_doubles(spark, wide):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, wide) for _ in range(2)], 0) for i in range(120)] + [(200, [1e6 + 0.25, 1.0], 0), (201, [1e6 + 0.5, 3.0], 0), ((1 << 63) - 1, [3e6, 9.0], 0), (None, [3e6, 9.0], 0), (202, [math.inf, 1.0], 0)]
    got = topk.search(spark.createDataFrame(rows, SCHEMA)).collect()
    want, whole = [], [(i, floors(v, 256)) for i, v, _ in rows if usable(v)]
    for i, v in whole:
        if i is not None and i % 50 == 0:
            scored = sorted((-dot(v, w), last(j)) for j, w in whole if (j, w) != (i, v))
            want += [(i, r, None if j[0] else j[1], -s) for r, (s, j) in enumerate(scored[:5], 1)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r.vec_id == (1 << 63) - 1 for r in got) and any(r.vec_id is None for r in got)


def k_means(rows, k, rounds, dims):
    rows = [(i, floors(v, 1024)) for i, v, *_ in rows if usable(v) and len(v) == dims]
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in rows]
        for n in range(len(centroids)):
            if members := [v for (_, v), o in zip(rows, own) if o == n]:
                centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *near(v)[::-1]) for i, v in rows]
    sums = {n: sum(d for _, o, d in found if o == n) for n in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, n, fit(d), fit(sums[n]), fit(sum(sums.values())), digest[n]) for i, n, d in found), key=str)


@pytest.mark.parametrize(("wide", "ties", "k"), [(1.0, False, 8), (1.0, True, 8), (1e5, False, 3), (1e9, False, 2)])
def test_clusters_are_those_of_brute_force(spark, wide, ties, k):
    rows = [r[:2] for r in table(random.Random(4), 150, 4, wide, ties)] + [(3, [1.0]), (4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cluster", "2 AS distance", "3 AS number")
    got = clusters.clustered(df, k=k, rounds=5, dims=4)
    assert sorted(map(tuple, got.collect()), key=str) == k_means(rows, k, 5, 4)


def test_clusters_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert clusters.clustered(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [0.5] * 4), (1, [0.5] * 4), (2, [1.5] * 4), (5, None), (6, [1e300] * 4)]
    got = clusters.clustered(spark.createDataFrame(rows, schema), dims=4).collect()
    assert sorted(map(tuple, got)) == k_means(rows[:3], 8, 10, 4)


@pytest.mark.parametrize("k", [1, 2, 9, 200])
def test_tree_finds_the_nearest_with_ties(k):
    rng = np.random.default_rng(k)
    centroids = np.floor(rng.normal(0, 3, (k, 3)))
    vectors = np.floor(rng.normal(0, 3, (500, 3)))
    number, gap = clusters.Tree(centroids).nearest(vectors)
    all_ = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (number == all_.argmin(axis=1)).all() and (gap == all_.min(axis=1)).all()


def test_ranges_do_not_grow_with_the_rows(spark, monkeypatch):
    """Buckets are many more than partitions; results are those of all products."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)]
    monkeypatch.setattr(topk, "BUCKET", 16)
    seen = []
    frame = type(spark.range(1))
    plain = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *by: seen.append(n) or plain(self, n, *by))
    got = sorted(map(tuple, topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    whole = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    wanted = [(q, rank, v, s) for q in range(0, 700, 50) for rank, (s, v) in enumerate(sorted(((-int(whole[q] @ whole[v]), v) for v in range(700) if v != q))[:5], 1)]
    assert got == sorted((q, r, v, -s) for q, r, v, s in wanted)
    assert max(seen) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_blocks_meet_buckets_without_a_broadcast(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 1) for i in range(300)]
    found = topk.search(spark.createDataFrame(rows, SCHEMA))
    # Blocks are copied to groups after the scan, so the size of their files says nothing of what a broadcast would hold.
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 30


def test_vectors_are_packed_in_two_bytes_where_they_fit():
    small, large = np.array([[-32767.0, 32767.0]]), np.array([[-32768.0, 1.0]])
    assert topk._narrow(small).dtype == np.int16 and topk._narrow(large).dtype == np.float64
    for x in (small, large):
        block = topk.Block(1, 2, np.zeros(1, np.int64).tobytes(), np.ones(1, bool).tobytes(), np.zeros(1, np.int64).tobytes(), topk._narrow(x).tobytes())
        assert block.vectors.tolist() == x.tolist()
