"""Baselines, the network and the balanced weights, against hand-made and one-process versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import kmers
from seqloom.functions import motif as mo
from seqloom.operators import balancing, baselines, networks

RNG = random.Random(8)
MOTIF = mo.Motif(((0.05, 0.05, 0.05, 0.85),) * 4)


def sequence(n=60, rich=False):
    return "".join(RNG.choices("ACGU", (1, 1, 1, 4 if rich else 1), k=n))


@pytest.fixture(scope="module")
def windows(spark):
    rows = []
    for i in range(240):
        y = i % 2
        rows.append((i, sequence(rich=y), RNG.choice(["in", "ex"]), RNG.random(), y, ("train", "validation", "test")[i // 2 % 3]))
    return spark.createDataFrame([*rows, (999, None, None, 0.0, 1, "test")], "id long, seq string, context string, log1p_tpm double, label int, split string")


def test_feature_sets(windows):
    for which, size in (("B0", 0), ("B1", 4), ("B1d", 20), ("B2", 23), ("B3", 1344), ("B4", 2)):
        assert len(baselines.names(which, ["in", "ex"])) == size
        got = {r.id: r.features for r in baselines.features(windows, which, ["id"], ["in", "ex"], MOTIF, 2.0).collect()}
        assert all(len(v) == size for v in got.values()) and len(got) == (240 if which == "B4" else 241)
    one = windows.filter("id = 5").first()
    made = dict(zip(baselines.names("B3"), baselines.features(windows.filter("id = 5"), "B3", ["id"]).first().features))
    assert made["ACG"] == pytest.approx(sum(one.seq[i : i + 3] == "ACG" for i in range(58)) / 58)
    b2 = dict(zip(baselines.names("B2", ["in", "ex"]), baselines.features(windows.filter("id = 5"), "B2", ["id"], ["in", "ex"]).first().features))
    assert b2["ctx_in"] == float(one.context == "in") and b2["log1p_tpm"] == one.log1p_tpm and b2["d_UU"] == pytest.approx(sum(one.seq[i : i + 2] == "UU" for i in range(59)) / 59)
    with pytest.raises(ValueError):
        baselines.features(windows, "B9", ["id"])


def test_moments_are_those_of_the_population(windows):
    rows = baselines.features(windows.filter("seq IS NOT NULL"), "B1d", ["id"])
    mean, spread = baselines.moments(rows, 20)
    x = kmers.vectors([r.seq for r in windows.filter("seq IS NOT NULL").collect()], (1, 2))
    assert mean == pytest.approx(x.mean(axis=0)) and spread == pytest.approx(x.std(axis=0))


def test_baselines_learn(windows):
    got = {(r.baseline, r.split): r for r in baselines.evaluated(windows.filter("seq IS NOT NULL"), ("B0", "B1", "B4"), ["in", "ex"], MOTIF, 2.0, grid=(0.1, 10.0)).collect()}
    assert len(got) == 9 and all(r.n == 80 for r in got.values())
    assert got["B0", "test"].auroc == pytest.approx(0.5) and got["B0", "test"].ap == pytest.approx(0.5) and got["B0", "test"].c is None
    assert got["B1", "test"].auroc > 0.9 and got["B1", "validation"].c in (0.1, 10.0) and got["B1", "test"].brier < 0.2


def plain_logit(net, x):
    """One sequence (4 x letters), loop by loop."""
    for kernel, bias, d in zip(net.kernels, net.biases, net.dilations):
        out = np.zeros((len(kernel), x.shape[1]))
        pad = (kernel.shape[2] - 1) * d // 2
        for o in range(len(kernel)):
            for n in range(x.shape[1]):
                total = bias[o]
                for i in range(kernel.shape[1]):
                    for j in range(kernel.shape[2]):
                        p = n + j * d - pad
                        total += kernel[o, i, j] * x[i, p] if 0 <= p < x.shape[1] else 0.0
                out[o, n] = 0.5 * total * (1 + math.erf(total / math.sqrt(2)))
        x = out
    hidden = net.head @ np.concatenate([x.mean(axis=1), x.max(axis=1)]) + net.head_bias
    return sum(w * 0.5 * h * (1 + math.erf(h / math.sqrt(2))) for w, h in zip(net.out, hidden)) + net.out_bias


SMALL = networks.Network.drawn(3, ((4, 5, 5, 1), (5, 6, 3, 2)), 4)


def test_error_function():
    x = np.concatenate([np.linspace(-7, 7, 20_001), [0.0, 6.0, -6.0, 40.0]])
    assert np.abs(networks.erf(x) - [math.erf(v) for v in x]).max() < 1e-13


def test_size_of_the_network():
    net = networks.Network.drawn(1)
    assert (net.parameters, net.reach) == (13857, 35)


def test_a_hand_computed_network():
    one = np.zeros((1, 4, 1))
    one[0, 3, 0] = 2.0
    net = networks.Network((one,), (np.array([0.5]),), (1,), np.array([[1.0, 0.0], [0.0, 1.0]]), np.zeros(2), np.array([1.0, 1.0]), 0.25)
    high, low = networks.gelu(np.array([2.5]))[0], networks.gelu(np.array([0.5]))[0]
    mean, top = (high + 3 * low) / 4, high
    assert net.logits(networks.one_hot(["ACUG"]))[0] == pytest.approx(networks.gelu(np.array([mean]))[0] + networks.gelu(np.array([top]))[0] + 0.25)


def test_forward_and_gradient():
    texts = [sequence(17) for _ in range(4)]
    x = networks.one_hot(texts)
    assert SMALL.logits(x) == pytest.approx([plain_logit(SMALL, v) for v in x])
    slope, step = SMALL.gradients(x), 1e-6
    for _ in range(20):
        b, c, n = RNG.randrange(4), RNG.randrange(4), RNG.randrange(17)
        up, down = x.copy(), x.copy()
        up[b, c, n] += step
        down[b, c, n] -= step
        assert slope[b, c, n] == pytest.approx((SMALL.logits(up)[b] - SMALL.logits(down)[b]) / (2 * step), abs=1e-6)
    for bad in (["AC", "ACG"], ["ACN"]):
        with pytest.raises(ValueError):
            networks.one_hot(bad)


def test_inference_and_effects_as_tables(spark):
    texts = [*(sequence(20) for _ in range(6)), "ACGU", "ACGN", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, seq string")
    got = {r.id: r.logit for r in networks.predicted(df, "id", "seq", SMALL, batch=3).collect()}
    assert got == {i: pytest.approx(plain_logit(SMALL, networks.one_hot([t])[0])) if t and "N" not in t else None for i, t in enumerate(texts)}
    rows = networks.substitutions(df.filter("id IN (0, 7, 8)"), "id", "seq", SMALL).collect()
    assert len(rows) == 60
    for r in RNG.sample(rows, 8):
        made = texts[0][: r.pos] + r.base + texts[0][r.pos + 1 :]
        assert r.exact == pytest.approx(plain_logit(SMALL, networks.one_hot([made])[0]) - got[0])


def test_merges():
    plan = balancing.merge_plan({("a", 0, 0): (9, 9), ("a", 1, 0): (9, 9), ("a", 3, 0): (1, 9), ("a", 0, 1): (2, 2), ("b", 0, 0): (1, 1), ("c", 0, 0): (4, 9), ("c", 1, 0): (9, 9)}, 5, 5)
    # a|3 goes to the empty a|2, which is as poor and goes on to a|1.
    assert plan == {("a", 0, 0): ("a", 0, 0), ("a", 1, 0): ("a", 1, 0), ("a", 3, 0): ("a", 1, 0), ("a", 0, 1): ("a", 0, 0), ("b", 0, 0): None, ("c", 0, 0): None, ("c", 1, 0): ("c", 1, 0)}
    assert balancing.merge_plan({("a", 4, 2): (0, 0)}, 0, 0) == {("a", 4, 2): ("a", 4, 2)}


def test_weights_are_those_of_one_process(spark):
    rng = random.Random(2)
    rows = [(i, int(rng.random() < 0.4), rng.random(), rng.random(), rng.choice(["x", "y", "z"]), rng.randrange(9)) for i in range(400)]
    rows += [(500 + i, i % 2, 0.95 if i % 2 else 0.85, 0.2, "w", 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, gc double, log1p_tpm double, context string, n_A int")
    limits = balancing.Limits(positives=10, backgrounds=10)
    out, fate, qc = balancing.weighted(df, [0.3, 0.6], [0.5], ["x", "y", "w"], limits, ("n_A",))
    got = {r.id: r for r in out.collect()}
    place = lambda c, g, t: (c if c in "xyw" else "other", sum(g > e for e in (0.3, 0.6)), int(t > 0.5))
    key = {r[0]: place(r[4], r[2], r[3]) for r in rows}
    counts = {k: tuple(sum(1 for r in rows if key[r[0]] == k and r[1] == y) for y in (1, 0)) for k in set(key.values())}
    plan = balancing.merge_plan(counts, 10, 10)
    members = {}
    for r in rows:
        if plan[key[r[0]]]:
            members.setdefault(plan[key[r[0]]], []).append(r)
    apart = {k for k, m in members.items() for c in (2, 3) if max(r[c] for r in m if r[1]) < min(r[c] for r in m if not r[1]) or max(r[c] for r in m if not r[1]) < min(r[c] for r in m if r[1])}
    raw = {r[0]: min(5.0, len(m) / (2 * sum(x[1] == r[1] for x in m))) for k, m in members.items() if k not in apart for r in m}
    mean = sum(raw.values()) / len(raw)
    assert apart and len(got) == len(rows)
    for r in rows:
        assert got[r[0]].kept == (r[0] in raw) and got[r[0]].w1 == pytest.approx(raw[r[0]] / mean if r[0] in raw else 1.0)
    assert sum(r.w0 for r in got.values()) == pytest.approx(len(rows))
    assert qc["rows"] == len(raw) and qc["ess"] == pytest.approx(sum(raw.values()) ** 2 / sum(v * v for v in raw.values()) / len(raw))

    def smd(c):
        sides = []
        for y in (1, 0):
            w = np.array([raw[r[0]] / mean for r in rows if r[0] in raw and r[1] == y])
            x = np.array([r[c] for r in rows if r[0] in raw and r[1] == y], float)
            m = (w @ x) / w.sum()
            sides.append((m, (w @ (x - m) ** 2) / w.sum() * w.sum() / (w.sum() - 1)))
        return (sides[0][0] - sides[1][0]) / math.sqrt((sides[0][1] + sides[1][1]) / 2)

    assert qc["smd"]["gc"] == pytest.approx(smd(2)) and qc["residual"]["n_A"] == pytest.approx(smd(5)) and isinstance(qc["all_passed"], bool)
    assert {r.stratum: r.no_common_support for r in fate.collect() if r.becomes} == {f"{k[0]}|q{k[1]}|t{k[2]}": v in apart for k, v in plan.items() if v}
