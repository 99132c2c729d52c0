"""Running sums over a whole table in order, without one task that sees all rows.

Rows are dealt by ranges of the order; each range is summed up in a task of its own, and
starts from the total of the ranges before it. Rows of one order key spread over
several ranges if the order ends in a column that tells them apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

RANGE = "_range"


def ranges(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Adds ``_range``: ranges of the order, numbered in its direction. Cut from its lineage, as ranges are drawn from a sample of the rows."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn(RANGE, F.spark_partition_id()))


def running(df: DataFrame, order: list[Column], terms: dict[str, Column], parts: int | None = None, how: Callable[[Column], Column] = F.sum, start: Column | None = None) -> DataFrame:
    """Adds, for each name in ``terms``, its aggregate (a sum, or another that combines in any grouping, as max) over all rows before.

    Where there is none before, it is ``start`` (0 for sums). ``order`` must tell rows apart.
    """
    start = F.lit(0) if how is F.sum else start
    given = (lambda x: F.coalesce(x, start)) if start is not None else (lambda x: x)
    both = (lambda x, y: x + y) if how is F.sum else (lambda x, y: F.greatest(x, y))
    if how is not F.sum and how is not F.max:
        raise ValueError("sums and maxima only")
    ranged = ranges(df, order, parts)
    local = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range: as many as there are partitions.
    totals = ranged.groupBy(RANGE).agg(*[how(x).alias(n) for n, x in terms.items()])
    above = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(RANGE).alias("_r"), *[given(how(n).over(above)).alias(f"_{n}") for n in terms])
    inside = ranged.select("*", *[given(how(x).over(local)).alias(n) for n, x in terms.items()])
    joined = inside.join(F.broadcast(offsets), F.col(RANGE) == F.col("_r"))
    return joined.select(*df.columns, *[both(F.col(n), F.col(f"_{n}")).alias(n) for n in terms])


def ordinals(df: DataFrame, order: list[Column], name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """Adds each row's number in the order, from 0."""
    return running(df, order, {name: F.lit(1).cast("long")}, parts)
