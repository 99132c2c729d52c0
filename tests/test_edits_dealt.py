"""Controls and substitutions are dealt to several tasks, and scores near an edit are those of a whole scan."""

import random

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions.motif import scan_scores
from seqloom.operators import attribution, controls
from seqloom.plans.catalog import HIT, MOTIF


def _rows():
    rng = random.Random(8)
    return [(i, "".join(rng.choice("CCUUUUGA") for _ in range(rng.choice((5, 7, 30, 90))))) for i in range(40)]


def test_scores_near_an_edit():
    rng = random.Random(9)
    for _, text in _rows():
        if len(text) < len(MOTIF):
            continue
        start = rng.randrange(len(text) - len(MOTIF) + 1)
        made = controls._shuffled(text, start, len(MOTIF), np.random.default_rng(start))
        before, after, near = (*(scan_scores([t], MOTIF)[0] for t in (text, made)), controls._about(made, start, controls._odds(MOTIF)))
        assert all(after[i] == near[i] if i in near else after[i] == before[i] for i in range(len(after)))


def test_one_scan_becomes_several_tasks(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, seq string").coalesce(1)
    panel = controls.control_panel(df, MOTIF, HIT)
    effects = attribution.substitutions(df, "doc_id", "seq", MOTIF, size=3)
    for made in (panel, effects):
        assert made.select(F.spark_partition_id()).distinct().count() > 1
    got = {(r.doc_id, r.pos, r.base): (r.exact, r.first_order) for r in effects.collect()}
    wanted = {}
    for k, s in _rows():
        exact, first = attribution.effects_of(s, MOTIF)
        wanted |= {(k, p, b): (exact[p, j], first[p, j]) for p in range(len(s)) for j, b in enumerate("ACGU") if s[p] != b}
    assert got == wanted
    own = controls.control_panel(df, MOTIF, HIT, kinds=("order",))
    assert sorted(map(str, own.collect())) == sorted(map(str, panel.filter("kind = 'order'").collect()))
