"""What the findings of round 3 asked for, on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import kmers
from seqloom.functions import motif as mo
from seqloom.operators import baselines, bootstrap, graph, networks, quantiles, weights
from seqloom.plans import studies

RNG = random.Random(3)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "".join(RNG.choices("ACGU", (1, 1, 1, 4 if i % 2 else 1), k=60)), i % 2, ("train", "validation", "test")[i // 2 % 3]) for i in range(120)]
    return spark.createDataFrame(rows, "id long, seq string, label int, split string")


def test_baselines_hold_few_values_and_leave_no_cache(spark, labelled):
    cached = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = cached()
    baselines.evaluated(labelled.selectExpr("seq", "'in' AS context", "0.0 AS log1p_tpm", "label", "split"), ("B3",), ["in"], mo.Motif(((0.05, 0.05, 0.05, 0.85),) * 4), 2.0, grid=(1.0,)).collect()
    assert cached() == before
    rows = baselines.features(labelled, "B3", ["id"])
    held = baselines._compact(rows, 1344)
    dense = {r.id: np.array(r.features) for r in rows.collect()}
    for r in held.collect():
        assert len(getattr(r.features, "indices", range(1344))) < 200 and (r.features.toArray() == dense[r.id]).all()
    for got, want in zip(baselines.moments(held, 1344), (np.mean(list(dense.values()), 0), np.std(list(dense.values()), 0))):
        assert np.allclose(got, np.where(want < 1e-12, got, want))


def test_draws_are_made_once(monkeypatch):
    wanted = np.array([0, 3, 255, 256, 699])
    want = bootstrap.draw_counts(wanted, 700, 40, "here")
    calls = []
    monkeypatch.setattr(bootstrap, "draw_counts", lambda at, *rest, own=bootstrap.draw_counts: calls.append(len(at)) or own(at, *rest))
    for _ in range(3):
        assert (bootstrap.held_counts(wanted, 700, 40, "here") == want).all()
    assert calls == [256, 256, 188]
    # More draws of one component than a byte holds.
    assert (bootstrap.held_counts(np.array([0]), 1, 5, "one") == 1).all()
    monkeypatch.setattr(bootstrap, "draw_counts", lambda at, *rest: np.full((len(at), 5), 300))
    assert (bootstrap.held_counts(np.array([2]), 9, 5, "many") == 300).all()


def test_cells_of_one_score_are_added_up():
    weights, times = np.arange(60.0).reshape(20, 3), np.arange(20.0)
    for first in ([0], [0, 4, 9], range(20)):
        want = [(weights[a:b] * times[a:b, None]).sum(0) for a, b in zip(first, [*first[1:], 20])]
        assert np.allclose(bootstrap._added(weights, times, np.array(first)), want)


def test_rows_in_one_file_are_dealt(spark):
    rows = spark.createDataFrame([(i, "".join(RNG.choices("ACGUN", (4, 4, 4, 4, 0.05), k=30 + i % 3))) for i in range(64)], "id long, seq string").coalesce(1)
    network = networks.Network.drawn(2, ((4, 8, 3, 1),), 4)
    for made in (kmers.frequencies(rows, "id", "seq", (3,)), networks.predicted(rows, "id", "seq", network)):
        assert made.select(F.spark_partition_id()).distinct().count() > 1
    plain = {(r.id, r.kmer): r.freq for r in kmers.frequencies(rows, "id", "seq", (3,)).selectExpr("id", "kmer", "round(freq, 6) AS freq").collect()}
    texts = {r.id: r.seq for r in rows.collect()}
    assert plain == {(r.id, r.kmer): r.freq for r in kmers.frequencies(rows, "id", "seq", (3,), places=6).collect()}
    for (i, kmer), freq in plain.items():
        places = len(texts[i]) - 2
        assert freq == round(sum(texts[i][j : j + 3] == kmer for j in range(places)) / places, 6)


def test_cells_are_those_of_the_edges():
    for low, high in ((-1.5, 7.25), (0.1, 0.1 + 1e-15), (3.0, 3.0)):
        edges = quantiles._edges(low, high, 64)
        x = np.unique(np.concatenate([edges, np.nextafter(edges, high), np.random.default_rng(1).uniform(low, high, 999)]).clip(low, high))
        want = np.clip(np.searchsorted(edges, x, side="right") - 1, 0, max(len(edges) - 2, 0))
        assert (quantiles._cells_of(x, edges) == want).all()


def test_network_in_small_parts():
    network, x = networks.Network.drawn(5), networks.one_hot(["".join(RNG.choices("ACGU", k=50)) for _ in range(9)])
    assert np.allclose(network.logits(x), network._forward(x)[0], atol=1e-13)
    grid = np.linspace(-7, 7, 5001)
    assert max(abs(networks.erf(grid) - [math.erf(v) for v in grid])) < 2e-14


def test_components_run_over_groups(spark, monkeypatch):
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "b", "z"), (5, "c", "w"), (6, None, "v"), (7, None, "u"), (8, "d", "u"), (9, "e", "z"), (10, "c", "t")]
    seen = []
    monkeypatch.setattr(graph, "connected_components", lambda nodes, edges, own=graph.connected_components: seen.append(nodes.count()) or own(nodes, edges))
    got = {r.node: r.component for r in graph.grouped_components(spark.createDataFrame(rows, "id long, g string, k string"), "id", "g", "k").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 5: 5, 10: 5, 6: 6, 7: 6, 8: 6} and seen == [6]


def test_balanced_weights_sort_no_stratum(spark):
    rows = [("a", 1)] * 2 + [("a", 0)] * 6 + [("b", 1)] * 30 + [("b", 0)] + [(None, 1)] * 3 + [(None, 0)]
    made = weights.balanced(spark.createDataFrame(rows, "stratum string, label int"), clip=5.0)
    raw = {(s, y): min(sum(r[0] == s for r in rows) / (2 * rows.count((s, y))), 5.0) for s, y in set(rows)}
    mean = sum(raw[r] for r in rows) / len(rows)
    got = made.collect()
    assert len(got) == len(rows) and all(abs(r.w - raw[r.stratum, r.label] / mean) < 1e-12 for r in got)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [count" not in plan


def test_contigs_are_spelled_once(spark):
    made = studies._contigs(spark, "/root/testdata/sf0.001")
    assert "regexp_replace" not in made._jdf.queryExecution().optimizedPlan().toString() and made.rdd.getNumPartitions() > 1
