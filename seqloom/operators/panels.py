"""Panels of windows, chosen without models: by label, annotation, motif score and a hash of the window's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_unit


def _first(df: DataFrame, by: list[str], order: list[Column], most: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def matched(df: DataFrame, by: list[str], key: str = "window_id", label: str = "label", seed: str = "") -> tuple[DataFrame, DataFrame]:
    """As many rows of either label in each bin (``by``), by hash; and for each bin how many there were, were taken, and stayed without a partner."""
    counts = df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("backgrounds"))
    counts = counts.withColumn("taken", F.least("positives", "backgrounds")).withColumn("unmatched", F.greatest("positives", "backgrounds") - F.col("taken"))
    small = counts.filter("taken > 0").select(*[F.col(c).alias(f"_{c}") for c in by], F.col("taken").alias("_taken"))
    same = [df[c].eqNullSafe(F.col(f"_{c}")) for c in by]
    kept = _first(df.join(small, same), [*by, label], [hash_unit(F.lit(seed), F.col(key)), F.col(key)], F.col("_taken"))
    return kept.select(*df.columns), counts


def audit(df: DataFrame, threshold: float, most: int, components: int, key: str = "window_id", component: str = "component", score: str = "score", seed: str = "") -> tuple[DataFrame, DataFrame]:
    """Windows whose score reaches the threshold, spread over components; and one row that says what was taken.

    A component gives at most ceil(most / components) windows, by hash; of these the first ``most``, in the order of component and hash, are
    the panel. It is exploratory with fewer components than wanted, or fewer than two windows for each.
    """
    cap = max(1, -(-most // max(components, 1)))
    hashed = df.filter(F.col(score) >= threshold).withColumn("_h", hash_unit(F.lit(seed), F.col(key)))
    order = [F.col("_h"), F.col(key)]
    # No more than the cap of each component can be taken, and no more than ``most`` of all.
    panel = _first(hashed, [component], order, F.lit(cap)).orderBy(component, *order).limit(most).drop("_h")
    row = panel.agg(F.count("*").alias("windows"), F.countDistinct(component).alias("components"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("backgrounds"))
    return panel, row.withColumn("cap", F.lit(cap)).withColumn("exploratory", (F.col("components") < components) | (F.col("windows") < 2 * components))


def by_stratum(df: DataFrame, strata: list[str], per: int, component: str = "component", key: str = "window_id", seed: str = "", wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``per`` windows of each stratum in the order of component and hash; and for each stratum how many there are, were selected, and are short.

    ``wanted`` lists strata that must be reported though no row has them.
    """
    order = [F.col(component), hash_unit(F.lit(seed), F.col(key)), F.col(key)]
    panel = _first(df, strata, order, F.lit(per))
    counts = df.groupBy(*strata).agg(F.count("*").alias("available"))
    if wanted is not None:
        counts = wanted.join(counts, strata, "left")
    counts = counts.withColumn("available", F.coalesce("available", F.lit(0))).withColumn("selected", F.least("available", F.lit(per)).cast("long"))
    return panel, counts.withColumn("short", F.lit(per) - F.col("selected"))
