"""The audit of a network on one split: edits of motif hits, preference for the natural sequence, and whether first-order effects may stand for exact ones.

Panels are chosen by score, label and hash before any model is asked. Edits of a window are made where its
row is; each distinct sequence is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.motif import Motif, best_hits, scan_scores
from ..functions.sequence import BASES
from . import attribution, networks, order, panels
from .controls import order_controls, outside_edits
from .lineage import cut


@dataclass(frozen=True)
class Rules:
    """Windows of the edited panel and components it should have; edits of a hit, at most and at least; windows of a stratum of the panel of
    substitutions; the gap of logits that counts as none; least medians of correlation and of equal signs."""

    windows: int = 500
    components: int = 100
    most: int = 20
    least: int = 5
    per: int = 16
    tie: float = 1e-6
    correlation: float = 0.8
    signs: float = 0.8


@dataclass(frozen=True)
class Audit:
    """panel: one row on the panel. edits: a row an edit. controls: one row on the edits. preferences: component means by kind.
    strata: the panel of substitutions by label and motif. checks: agreement of each of its windows. decision: one row."""

    panel: DataFrame
    edits: DataFrame
    controls: DataFrame
    preferences: DataFrame
    strata: DataFrame
    checks: DataFrame
    decision: DataFrame


def pair_counts(sequence: str) -> np.ndarray:
    """How often each of the 16 pairs of neighbouring bases stands in a sequence; pairs with other letters count for none."""
    codes = np.array([BASES.find(b) for b in sequence], np.int64)
    good = (codes[:-1] >= 0) & (codes[1:] >= 0)
    return np.bincount((codes[:-1] * 4 + codes[1:])[good], minlength=16)


def _edit(kind: str, i: int, natural: str, made: str, start: int, hit: int, motif: Motif, threshold: float, before: set[int]) -> dict[str, object]:
    both, width = scan_scores([natural, made], motif), len(motif)
    return {
        "kind": kind, "edit": i, "sequence": made, "start": start, "end": start + width, "score": float(both[0][hit]),
        # An edit elsewhere leaves the hit as it is.
        "edited_score": float(both[1][hit]) if kind == "target" else None,
        "new_hits": sum(h not in before for h in best_hits(both[1], width, threshold)),
        "same_bases": sorted(natural) == sorted(made), "same_length": len(natural) == len(made),
        "pair_change": int(np.abs(pair_counts(made) - pair_counts(natural)).sum()),
    }


_EDIT = pa.struct([("kind", pa.string()), ("edit", pa.int32()), ("sequence", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("edited_score", pa.float64()), ("new_hits", pa.int64()), ("same_bases", pa.bool_()), ("same_length", pa.bool_()), ("pair_change", pa.int64())])
_EDIT_SQL = "struct<kind: string, edit: int, sequence: string, start: bigint, end: bigint, score: double, edited_score: double, new_hits: bigint, same_bases: boolean, same_length: boolean, pair_change: bigint>"


def edited(df: DataFrame, motif: Motif, threshold: float, rules: Rules = Rules(), key: str = "window_id", sequence: str = "seq", keep: tuple[str, ...] = ("component", "label")) -> DataFrame:
    """The key, ``keep`` and the sequence of each window, with instance (it has a hit), informative, and its edits.

    A window whose best hit allows fewer than ``least`` other orders is not informative and gives no edits of either
    kind. Sequences that are null or shorter than the motif have no hit. Edits hang on the key and the sequence only.
    """
    names = [key, *keep, "natural"]
    inputs = df.select(key, *keep, F.coalesce(F.col(sequence), F.lit("")).alias("natural"))

    def one(k: object, s: str) -> tuple[bool, list[dict[str, object]]]:
        scores = scan_scores([s], motif)[0]
        hits = best_hits(scores, len(motif), threshold)
        if not hits:
            return False, []
        orders = order_controls(k, s, motif, threshold, rules.most)
        if len(orders) < rules.least:
            return True, []
        # A start that overlaps a better hit reached the threshold before the edit too.
        before = set(np.flatnonzero(scores >= threshold).tolist())
        made = [_edit("target", i, s, x, hits[0], hits[0], motif, threshold, before) for i, x in enumerate(orders)]
        return True, made + [_edit("outside", i, s, x, at, hits[0], motif, threshold, before) for i, (at, x) in enumerate(outside_edits(k, s, motif, threshold, rules.most))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [one(k, s) for k, s in zip(part.column(0).to_pylist(), part.column(len(names) - 1).to_pylist())]
                columns = [pa.array([x for x, _ in made], pa.bool_()), pa.array([bool(x) for _, x in made], pa.bool_()), pa.array([x for _, x in made], pa.list_(_EDIT))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*names, "instance", "informative", "edits"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema)
    return inputs.mapInArrow(run, f"{kept}, instance boolean, informative boolean, edits array<{_EDIT_SQL}>")


def controls_summary(windows: DataFrame) -> DataFrame:
    """One row on ``edited``: windows, instances, those with edits, those that are not informative, edits by kind, and what the edits keep and change."""
    one = windows.select("instance", "informative", F.explode_outer("edits").alias("e"), F.col("edits").alias("all"))
    counts = windows.agg(F.count("*").alias("windows"), F.count_if("instance").alias("instances"), F.count_if("informative").alias("with_edits"), F.count_if(F.col("instance") & ~F.col("informative")).alias("uninformative"))
    made = one.filter("e IS NOT NULL").agg(
        F.count_if(F.col("e.kind") == "target").alias("target"), F.count_if(F.col("e.kind") == "outside").alias("outside"),
        F.bool_and(F.col("e.same_bases") & F.col("e.same_length")).alias("all_kept"), F.max("e.new_hits").alias("most_new_hits"),
        F.max("e.pair_change").alias("most_pair_change"), F.avg("e.pair_change").alias("mean_pair_change"),
    )
    return counts.join(F.broadcast(made))


def _numbered(sequences: DataFrame) -> DataFrame:
    """_place, seq: each distinct sequence with a number."""
    return cut(order.ordinals(sequences.distinct(), [F.col("seq")], "_place"))


def preferences(edits: DataFrame, network: networks.Network, tie: float = 1e-6, keep: tuple[str, ...] = ("window_id", "component")) -> DataFrame:
    """keep, kind, edit, value of edits (kind, edit, natural, sequence): 1 where the network scores the natural sequence higher, 0.5 for a gap within ``tie``, else 0.

    Each distinct sequence is scored once. Edits of sequences without a score are left out.
    """
    numbered = _numbered(edits.select(F.explode(F.array("natural", "sequence")).alias("seq")))
    logits = cut(numbered.join(networks.predicted(numbered, "_place", "seq", network), "_place").filter("logit IS NOT NULL").select("seq", "logit"))
    both = edits.join(logits.select(F.col("seq").alias("natural"), F.col("logit").alias("_x")), "natural").join(logits.select(F.col("seq").alias("sequence"), F.col("logit").alias("_y")), "sequence")
    gap = F.col("_x") - F.col("_y")
    return both.select(*keep, "kind", "edit", F.when(gap > tie, 1.0).when(gap >= -tie, 0.5).otherwise(0.0).alias("value"))


def by_component(values: DataFrame, component: str = "component") -> DataFrame:
    """kind, component, edits, value: the mean over a component's edits."""
    return values.groupBy("kind", component).agg(F.count("*").alias("edits"), F.avg("value").alias("value"))


def decided(checks: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row: windows, those whose agreement is defined, its medians, and whether first-order effects are near enough; without a defined one they are not."""
    ok = F.col("status") == "ok"
    row = checks.agg(F.count("*").alias("windows"), F.count_if(ok).alias("defined"), F.median(F.when(ok, F.col("spearman"))).alias("spearman"), F.median(F.when(ok, F.col("sign_agreement"))).alias("sign_agreement"))
    usable = F.coalesce((F.col("spearman") >= rules.correlation) & (F.col("sign_agreement") >= rules.signs), F.lit(False))
    return row.withColumn("usable", usable).withColumn("decision", F.when(usable, "first order").otherwise("exact"))


def panel_edits(df: DataFrame, motif: Motif, threshold: float, rules: Rules = Rules(), key: str = "window_id", seed: str = "") -> tuple[DataFrame, DataFrame]:
    """One row on the panel of ``panels.audit``, and its windows as ``edited`` gives them."""
    panel, about = panels.audit(df, threshold, rules.windows, rules.components, key, seed=seed)
    # The panel is cut off in one task; its windows are dealt again before they are edited.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return about, cut(edited(panel.repartition(parts, key), motif, threshold, rules, key))


def substitution_checks(df: DataFrame, threshold: float, network: networks.Network, rules: Rules = Rules(), key: str = "window_id", seed: str = "") -> tuple[DataFrame, DataFrame]:
    """The strata of the panel of substitutions, and key, status, spearman, sign_agreement of each of its windows."""
    present = df.filter("label IN (0, 1)").withColumn("label", F.col("label").cast("long")).withColumn("present", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    wanted = df.sparkSession.createDataFrame([(y, p) for y in (1, 0) for p in (True, False)], "label long, present boolean")
    chosen, strata = panels.by_stratum(present, ["label", "present"], rules.per, key=key, seed=seed, wanted=wanted)
    chosen = cut(chosen.select(key, "seq"))
    numbered = _numbered(chosen.select("seq").dropna())
    agreed = numbered.join(attribution.agreement(networks.substitutions(numbered, "_place", "seq", network), "_place"), "_place").drop("_place")
    return strata, chosen.join(agreed, "seq", "left").select(key, F.coalesce("status", F.lit("no sequence")).alias("status"), "spearman", "sign_agreement")


def run(df: DataFrame, motif: Motif, threshold: float, network: networks.Network, rules: Rules = Rules(), key: str = "window_id", seed: str = "") -> Audit:
    """The audit of rows (key, component, label, seq, score) of one split; score is the best of the motif, null for sequences too short for it.

    ``key`` must tell rows apart. Rows without a label are in no stratum of the panel of substitutions. An empty table has
    empty tables of edits, preferences and checks, strata that are all short, and the decision to stay exact.
    """
    about, windows = panel_edits(df, motif, threshold, rules, key, seed)
    edits = edits_of(windows, key)
    values = by_component(preferences(edits, network, rules.tie, (key, "component")))
    strata, checks = substitution_checks(df, threshold, network, rules, key, seed)
    checks = cut(checks)
    return Audit(about, edits, controls_summary(windows), values, strata, checks, decided(checks, rules))


def edits_of(windows: DataFrame, key: str = "window_id") -> DataFrame:
    """The edits of ``panel_edits``, a row each."""
    return windows.select(key, "component", "label", "natural", F.inline("edits"))
