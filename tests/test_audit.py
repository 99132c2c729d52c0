"""The audit of a network against one-process versions."""

import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest

from seqloom.functions import motif as mo
from seqloom.operators import attribution, audit, networks

MOTIF = mo.Motif(tuple(tuple(0.85 if b == c else 0.05 for b in "ACGU") for c in "GAUCG"))
HIT = 5.0
RULES = audit.Rules(windows=40, components=4, per=3, most=6, least=3)
NETWORK = networks.Network.drawn(5)


def _rows():
    rng, rows = random.Random(3), []
    for i in range(60):
        s = "".join(rng.choice("ACU") for _ in range(60))
        if i % 3:
            s = s[:20] + "GAUCG" + s[25:]
        if i % 15 == 1:
            s = s[:40] + "GAUCG" + s[45:]
        rows.append([f"w{i}", f"c{i % 6}", i % 2, s])
    rows += [["short", "c0", 1, "GA"], ["none", "c1", 0, None], ["again", "c2", 1, rows[1][3]], ["odd", "c3", 0, "GAUCG" + "N" * 30], ["just", "c4", 1, "GAUCG"], ["unlabelled", "c5", None, rows[1][3]]]
    score = lambda s: float(mo.scan_scores([s], MOTIF)[0].max()) if s and len(s) >= 5 else None
    return [(*r, score(r[3])) for r in rows]


@pytest.fixture(scope="module")
def made(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "window_id string, component string, label int, seq string, score double").repartition(3)
    return {r[0]: r for r in rows}, audit.run(df, MOTIF, HIT, NETWORK, RULES)


def test_edits_keep_what_they_must(made):
    rows, done = made
    edits = done.edits.collect()
    hits = {k for k, r in rows.items() if r[4] is not None and r[4] >= HIT}
    by = Counter((e.window_id, e.kind) for e in edits)
    assert {e.window_id for e in edits} <= hits and max(by.values()) == RULES.most
    for e in edits:
        natural = rows[e.window_id][3]
        assert e.natural == natural and e.sequence != natural and Counter(e.sequence) == Counter(natural)
        assert natural[: e.start] == e.sequence[: e.start] and natural[e.end :] == e.sequence[e.end :] and e.end - e.start == 5
        before, after = (mo.scan_scores([x], MOTIF)[0] for x in (natural, e.sequence))
        assert set(np.flatnonzero(after >= HIT)) <= set(np.flatnonzero(before >= HIT)) and e.new_hits == 0
        best = int(before.argmax())
        assert e.score == pytest.approx(before.max()) and e.same_bases and e.same_length
        if e.kind == "target":
            assert e.start == best and e.edited_score == pytest.approx(after[best]) and e.edited_score < e.score
        else:
            assert e.edited_score is None and abs(e.start - best) >= 5
        pairs = [Counter(a + b for a, b in zip(x, x[1:]) if set(a + b) <= set("ACGU")) for x in (natural, e.sequence)]
        assert e.pair_change == sum(abs(pairs[0][k] - pairs[1][k]) for k in pairs[0] | pairs[1])


def test_controls_are_counted(made):
    rows, done = made
    edits, row = done.edits.collect(), done.controls.first()
    info = done.panel.first()
    by = Counter(e.kind for e in edits)
    assert (row.windows, row.instances, row.target, row.outside) == (info.windows, info.windows, by["target"], by["outside"])
    assert row.with_edits == len({e.window_id for e in edits}) and row.uninformative == row.instances - row.with_edits
    assert row.all_kept and row.most_new_hits == 0
    assert row.most_pair_change == max(e.pair_change for e in edits) and row.mean_pair_change == pytest.approx(statistics.mean(e.pair_change for e in edits))


def test_windows_with_few_orders_give_no_edits(spark):
    df = spark.createDataFrame([("a", "ACAC" + "GAUCG" + "ACACAC"), ("b", "ACACACACA"), ("c", None), ("d", "")], "window_id string, seq string")
    got = {r.window_id: r for r in audit.edited(df, MOTIF, HIT, audit.Rules(least=10_000), keep=()).collect()}
    assert {k: (r.instance, r.informative, r.edits) for k, r in got.items()} == {"a": (True, False, []), "b": (False, False, []), "c": (False, False, []), "d": (False, False, [])}
    row = audit.controls_summary(audit.edited(df, MOTIF, HIT, audit.Rules(least=10_000), keep=())).first()
    assert (row.windows, row.instances, row.with_edits, row.uninformative, row.target, row.all_kept) == (4, 1, 0, 1, 0, None)


def test_preferences_are_component_means(made):
    rows, done = made
    logit = lambda s: NETWORK.logits(networks.one_hot([s]))[0] if s and not set(s) - set("ACGU") else None
    want = defaultdict(list)
    for e in done.edits.collect():
        x, y = logit(e.natural), logit(e.sequence)
        if x is not None and y is not None:
            want[e.kind, e.component].append(1.0 if x - y > RULES.tie else 0.5 if x - y >= -RULES.tie else 0.0)
    got = {(r.kind, r.component): (r.edits, r.value) for r in done.preferences.collect()}
    assert got.keys() == want.keys() and len(want) > 6
    for k, v in want.items():
        assert got[k] == (len(v), pytest.approx(statistics.mean(v)))


def test_substitutions_agree_or_not(made, spark):
    rows, done = made
    strata = {(r.label, r.present): (r.available, r.selected, r.short) for r in done.strata.collect()}
    here = Counter((r[2], (r[4] or 0) >= HIT) for r in rows.values() if r[2] is not None)
    assert strata == {(y, p): (here[y, p], min(3, here[y, p]), 3 - min(3, here[y, p])) for y in (0, 1) for p in (True, False)}
    checks = done.checks.collect()
    assert len(checks) == sum(x[1] for x in strata.values()) == len({c.window_id for c in checks})

    def ranks(x):
        return (x[:, None] > x).sum(1) + ((x[:, None] == x).sum(1) - 1) / 2

    defined = [c for c in checks if c.status == "ok"]
    assert defined
    for c in defined:
        s = rows[c.window_id][3]
        exact, first = NETWORK.effects(s)
        other = np.array([[b != x for b in "ACGU"] for x in s])
        x, y = exact[other], first[other]
        assert c.spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-9)
        top = np.argsort(-np.abs(x), kind="stable")[: max(1, int(len(x) * 0.1))]
        assert c.sign_agreement == pytest.approx(np.mean(np.sign(x[top]) == np.sign(y[top])))
    row = done.decision.first()
    assert (row.windows, row.defined) == (len(checks), len(defined))
    assert row.spearman == pytest.approx(statistics.median(c.spearman for c in defined)) and row.sign_agreement == pytest.approx(statistics.median(c.sign_agreement for c in defined))
    assert row.usable == (row.spearman >= 0.8 and row.sign_agreement >= 0.8) and row.decision == ("first order" if row.usable else "exact")
    for low, usable in ((-1.0, True), (1.1, False)):
        assert audit.decided(done.checks, audit.Rules(correlation=low, signs=low)).first().usable is usable


def test_an_empty_table_stays_exact(spark):
    df = spark.createDataFrame([], "window_id string, component string, label int, seq string, score double")
    done = audit.run(df, MOTIF, HIT, NETWORK, RULES)
    assert not done.edits.count() and not done.preferences.count() and not done.checks.count()
    assert sorted(r.short for r in done.strata.collect()) == [3, 3, 3, 3]
    row = done.decision.first()
    assert (row.windows, row.defined, row.spearman, row.usable, row.decision) == (0, 0, None, False, "exact")
    assert (done.controls.first().windows, done.panel.first().windows) == (0, 0)
    flat = spark.createDataFrame([(1, i, b, 0.0, 0.1) for i in range(3) for b in "ACG"], "place long, pos long, base string, exact double, first_order double")
    assert attribution.agreement(flat, "place").first().status == "constant"
