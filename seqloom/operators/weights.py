"""Strata, class weights and their balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(x: Column, edges: list[Column]) -> Column:
    """Right-closed bins: how many edges lie below x."""
    return sum(((x > e).cast("int") for e in edges), F.lit(0))


def balanced(df: DataFrame, stratum: str = "stratum", label: str = "label", clip: float = 5.0) -> DataFrame:
    """Adds w: rows of the stratum over twice the rows of its class in it, clipped, with mean one."""
    # A row for each class of each stratum, so no stratum is sorted in one task.
    counts = df.groupBy(F.col(stratum).alias("_s"), F.col(label).alias("_y")).agg(F.count("*").alias("ny")).withColumn("n", F.sum("ny").over(Window.partitionBy("_s")))
    raw = counts.withColumn("raw", F.least(F.col("n") / (2 * F.col("ny")), F.lit(clip)))
    mean = raw.agg((F.sum(F.col("raw") * F.col("ny")) / F.sum("ny")).alias("mean_raw"))
    told = raw.join(F.broadcast(mean)).select("_s", "_y", (F.col("raw") / F.col("mean_raw")).alias("w"))
    return df.join(F.broadcast(told), F.col(stratum).eqNullSafe(F.col("_s")) & F.col(label).eqNullSafe(F.col("_y"))).drop("_s", "_y")


def standard(df: DataFrame, label: str = "label", classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Adds w: all rows over twice the rows of the class, with mean one. An error where a class is absent."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # a row for each class
    if missing := [y for y in classes if not counts.get(y)]:
        raise ValueError(f"class {missing[0]} is absent")
    # The mean of N / (2 n_y) over all rows is half the number of classes.
    w = F.lit(float(sum(counts.values()))) / (len(classes) * F.element_at(F.create_map(*[x for y in classes for x in (F.lit(y), F.lit(float(counts[y])))]), F.col(label).cast("int")))
    return df.withColumn("w", w)


def known_or_other(value: Column, known: Column) -> Column:
    """The value where it is known, else 'other'."""
    return F.when(known & value.isNotNull(), value).otherwise("other")


def merge_sparse(counts: list[tuple[str, int, int, int, int]], least: int, steps: int = 12) -> dict[tuple[str, int, int], tuple[str, int, int] | None]:
    """Where strata (context, q, t, positives, backgrounds) go, so that each has enough of both: to the next lower q, else the next lower t, else out.

    The table has one row for each stratum, a few dozen, and so is worked on by the driver.
    """
    goes = {(c, q, t): (c, q, t) for c, q, t, _, _ in counts}
    held = {(c, q, t): [p, b] for c, q, t, p, b in counts}
    for _ in range(steps):
        poor = [(min(v), v[0], v[1], k) for k, v in held.items() if min(v) < least]
        if not poor:
            break
        key = min(poor)[3]
        c, q, t = key
        lower = [k for k in ((c, q - 1, t), (c, q, t - 1)) if k in held]
        to = lower[0] if lower else None
        p, b = held.pop(key)
        if to:
            held[to] = [held[to][0] + p, held[to][1] + b]
        goes = {k: (to if v == key else v) for k, v in goes.items()}
    for key in [k for k, v in held.items() if min(v) < least]:
        goes = {k: (None if v == key else v) for k, v in goes.items()}
    return goes
