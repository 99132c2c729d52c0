"""The comparison of two conditions: predictive non-inferiority, improved preference, specificity, and the claim that follows.

Each requirement is a row with its estimate, its interval and whether it passes; the claim is a rule over these rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bootstrap
from .lineage import cut


@dataclass(frozen=True)
class Rules:
    """Margin of the difference in average precision, least difference in preference, seeds that must agree, components that the guard needs."""

    margin: float = -0.02
    least: float = 0.10
    agreeing: int = 4
    components: int = 50


_ROW = ("requirement", "estimate", "lo", "hi", "n", "agreeing", "passes")


def predictive(scores: DataFrame, first: object, second: object, rules: Rules = Rules(), within: bool = False, **options) -> DataFrame:
    """Of rows (condition, seed, component, label, score): the mean over seeds of the difference in average precision.

    The interval spans those of all seeds; with ``within`` differences are averaged over seeds in each
    replicate first, and the interval is that of the averages.
    """
    deltas = bootstrap.paired_ap(scores, "condition", first, second, "seed", **options)
    seeds = bootstrap.interval(deltas, "delta", ["seed"])
    spans = seeds.agg(F.avg("mean").alias("estimate"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.count_if(F.col("mean") > 0).alias("agreeing"))
    if within:
        means = deltas.groupBy("replicate").agg(F.avg("delta").alias("delta")).withColumn("all", F.lit(0))
        whole = bootstrap.interval(means, "delta", ["all"]).select(F.col("mean").alias("estimate"), "lo", "hi")
        spans = whole.join(F.broadcast(spans.select("n", "agreeing")))
    return spans.withColumn("requirement", F.lit("predictive")).withColumn("passes", F.coalesce(F.col("lo") > rules.margin, F.lit(False))).select(*_ROW)


def _difference(preferences: DataFrame, first: object, second: object, by: list[str]) -> DataFrame:
    """by, x, y: means under the first and the second condition, where both have any."""
    one = lambda v: F.avg(F.when(F.col("condition") == F.lit(v), F.col("value")))
    return preferences.groupBy(*by).agg(one(first).alias("x"), one(second).alias("y")).dropna(subset=["x", "y"])


def preference(preferences: DataFrame, first: object, second: object, rules: Rules = Rules(), **options) -> DataFrame:
    """Of rows (condition, seed, component, kind, value): the difference of component means, of kind target."""
    target = preferences.filter("kind = 'target'")
    per = target.groupBy("condition", "seed", "component").agg(F.avg("value").alias("value"))
    # A component's value under a condition is its mean over seeds; a condition's, the mean over its components.
    of = per.groupBy("condition", "component").agg(F.avg("value").alias("value"))
    mean = lambda v: F.avg(F.when(F.col("condition") == F.lit(v), F.col("value")))
    point = of.agg((mean(second) - mean(first)).alias("estimate"), F.countDistinct(F.when(F.col("condition") == F.lit(first), F.col("component"))).alias("n"))
    seeds = _difference(per, first, second, ["seed", "component"]).groupBy("seed").agg((F.avg("y") - F.avg("x")).alias("d")).agg(F.count_if(F.col("d") > 0).alias("agreeing"))
    draws = bootstrap.paired_means(target, "condition", first, second, "seed", "value", **options).withColumn("all", F.lit(0))
    span = bootstrap.interval(draws, "delta", ["all"]).select("lo", "hi")
    passes = (F.col("estimate") >= rules.least) & (F.col("lo") > 0) & (F.col("agreeing") >= rules.agreeing)
    return point.join(F.broadcast(seeds)).join(F.broadcast(span)).withColumn("requirement", F.lit("preference")).withColumn("passes", F.coalesce(passes, F.lit(False))).select(*_ROW)


def specificity(preferences: DataFrame, first: object, second: object, rules: Rules = Rules(), **options) -> DataFrame:
    """The difference in what target edits have over outside ones, of components that have both under both conditions."""
    per = preferences.groupBy("condition", "seed", "component", "kind").agg(F.avg("value").alias("value")).groupBy("condition", "component", "kind").agg(F.avg("value").alias("value"))
    kind = lambda k: F.max(F.when(F.col("kind") == k, F.col("value")))
    gap = per.groupBy("condition", "component").agg((kind("target") - kind("outside")).alias("value")).dropna().withColumn("seed", F.lit(0))
    point = _difference(gap, first, second, ["component"]).agg((F.avg("y") - F.avg("x")).alias("estimate"), F.count("*").alias("n"))
    draws = bootstrap.paired_means(gap, "condition", first, second, "seed", "value", **options).withColumn("all", F.lit(0))
    span = bootstrap.interval(draws, "delta", ["all"]).select("lo", "hi")
    passes = (F.col("lo") > 0) & (F.col("n") >= rules.components)
    return point.join(F.broadcast(span)).withColumn("requirement", F.lit("specificity")).withColumn("agreeing", F.lit(None).cast("long")).withColumn("passes", F.coalesce(passes, F.lit(False))).select(*_ROW)


def primary(scores: DataFrame, preferences: DataFrame, first: object = "C0", second: object = "C1", rules: Rules = Rules(), **options) -> DataFrame:
    """requirement, estimate, lo, hi, n, agreeing, passes: three rows."""
    # A row for each condition, seed, component and kind: means of these are all that is asked for.
    preferences = cut(preferences.groupBy("condition", "seed", "component", "kind").agg(F.avg("value").alias("value")))
    made = predictive(scores, first, second, rules, **options).unionByName(preference(preferences, first, second, rules, **options))
    return made.unionByName(specificity(preferences, first, second, rules, **options))


def claim(requirements: DataFrame, technical: Column | None = None, instantiated: Column | None = None) -> DataFrame:
    """level, capped, failed: what may be claimed.

    Without the technical gates nothing is; an intervention is supported if all three requirements pass and
    it came about; else it is a valid demonstration. failed: the requirements that did not pass.
    """
    technical, instantiated = technical if technical is not None else F.lit(True), instantiated if instantiated is not None else F.lit(True)
    row = requirements.agg(F.bool_and("passes").alias("all"), F.array_sort(F.collect_list(F.when(~F.col("passes"), F.col("requirement")))).alias("failed"))
    level = F.when(~technical, "inconclusive").when(F.col("all") & instantiated, "intervention_supported").otherwise("valid_demo")
    return row.select(level.alias("level"), (technical & F.col("all") & ~instantiated).alias("capped"), "failed")
