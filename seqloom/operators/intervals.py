"""Half-open intervals by chromosome: merge, overlap, subtract, collapse.

Overlap joins are equi-joins on (chromosome, bin). A pair is found in the bin in
which its overlap begins, which is one bin only, so nothing has to be removed
afterwards, and a chromosome's rows are spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order as ordered

BIN = 64


def islands(df: DataFrame, chrom: str = "chrom", start: str = "st", end: str = "en", touching: bool = False) -> DataFrame:
    """The distinct (chrom, start, end) with ``island``, a number that intervals share which overlap, directly or through others (with ``touching``, also those that only touch).

    Both the reach of all intervals before and the number are running values over ranges of the order,
    so a chromosome is dealt to as many tasks as its rows need.
    """
    places = df.select(chrom, start, end).distinct()
    by = [F.col(chrom), F.col(start), F.col(end)]
    # The greatest pair before is that of the latest chromosome, so the reach of another chromosome tells itself apart.
    reached = ordered.running(places, by, {"reach": F.struct(F.col(chrom).alias("chrom"), F.col(end).alias("end"))}, how=F.max)
    met = F.col(start) <= F.col("reach.end") if touching else F.col(start) < F.col("reach.end")
    fresh = F.when(F.col("reach.chrom").eqNullSafe(F.col(chrom)) & met, 0).otherwise(1).cast("long")
    counted = ordered.running(reached.withColumn("fresh", fresh).drop("reach"), by, {"before": F.col("fresh")})
    return counted.select(chrom, start, end, (F.col("before") + F.col("fresh")).alias("island"))


def merge(df: DataFrame, chrom: str = "chrom", start: str = "st", end: str = "en") -> DataFrame:
    """The union of intervals; those that touch are one."""
    return islands(df, chrom, start, end, touching=True).groupBy(chrom, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def _binned(df: DataFrame, start: Column, end: Column, width: int, name: str) -> DataFrame:
    low, high = F.floor(start / width), F.floor((end - 1) / width)
    return df.filter(end > start).withColumn(name, F.explode(F.sequence(low, high)))


def overlaps(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs that share a position. Columns: left as (chrom, st, en, ...), right as (r_chrom, r_st, r_en, ...)."""
    l = _binned(left, F.col("st"), F.col("en"), width, "l_bin")
    r = _binned(right, F.col("r_st"), F.col("r_en"), width, "r_bin")
    first = F.floor(F.greatest("st", "r_st") / width)
    on = (F.col("chrom") == F.col("r_chrom")) & (F.col("l_bin") == F.col("r_bin")) & (F.col("st") < F.col("r_en")) & (F.col("en") > F.col("r_st")) & (F.col("l_bin") == first)
    return l.join(r, on).drop("l_bin", "r_bin")


def places_hit(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """The distinct (chrom, st, en) of the left that overlap any of the right."""
    return overlaps(left.select("chrom", "st", "en").distinct(), right, width).select("chrom", "st", "en").distinct()


def hits(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Rows of the left that overlap any of the right; whether one does hangs on its place alone, so ids may repeat."""
    return left.join(places_hit(left, right, width), ["chrom", "st", "en"], "left_semi")


def subtract(spans: DataFrame, blockers: DataFrame, key: str = "span", width: int = BIN) -> DataFrame:
    """What is left of each span (key, chrom, st, en): gaps between merged blockers (r_chrom, r_st, r_en), with both ends."""
    cut = overlaps(spans, blockers, width).select(key, "chrom", F.greatest("st", "r_st").alias("b"), F.least("en", "r_en").alias("e"))
    ends = cut.unionByName(spans.select(key, "chrom", F.col("en").alias("b"), F.col("en").alias("e")))
    order = Window.partitionBy(key).orderBy("b", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = spans.select(key, F.col("st").alias("s0"))
    gaps = ends.withColumn("before", before).join(starts, key).select(key, "chrom", F.coalesce("before", "s0").alias("st"), F.col("b").alias("en"))
    return gaps.filter("en > st")


def expand(df: DataFrame, by: int) -> DataFrame:
    return df.withColumn("st", F.greatest(F.col("st") - by, F.lit(0))).withColumn("en", F.col("en") + by)


def collapse(df: DataFrame, group: str, key: str) -> DataFrame:
    """Greedy: in order of (start, end, key), a row stays iff it starts at or after the end of the last that stayed.

    A row that starts at or after all ends before it stays whatever was chosen before, so each island of overlaps is
    decided by itself: along its sorted array, without leaving the JVM.
    """
    rows = F.sort_array(F.collect_list(F.struct("st", "en", key)))
    kept = F.aggregate(
        "rows",
        F.struct(F.lit(-(1 << 62)).alias("last"), F.array().cast(f"array<struct<st:bigint,en:bigint,{key}:bigint>>").alias("kept")),
        lambda a, x: F.when(x["st"] >= a["last"], F.struct(x["en"].alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a),
        lambda a: a["kept"],
    )
    typed = df.select(group, F.col("st").cast("long").alias("st"), F.col("en").cast("long").alias("en"), F.col(key).cast("long").alias(key))
    places = islands(typed, group).select(F.col(group).alias("_g"), F.col("st").alias("_st"), F.col("en").alias("_en"), "island")
    same = typed[group].eqNullSafe(F.col("_g")) & typed["st"].eqNullSafe(F.col("_st")) & typed["en"].eqNullSafe(F.col("_en"))
    return typed.join(places, same).groupBy(group, "island").agg(rows.alias("rows")).select(group, F.inline(kept))


def previous_links(df: DataFrame, group: str, key: str) -> DataFrame:
    """Each row that overlaps the row before it in its group."""
    order = Window.partitionBy(group).orderBy("st", "en", key)
    linked = df.withColumn("prev", F.lag(key).over(order)).withColumn("prev_en", F.lag("en").over(order))
    return linked.filter(F.col("st") < F.col("prev_en")).select(group, F.col("prev").alias("a"), F.col(key).alias("b"))


def in_genes(windows: DataFrame, genes: DataFrame, exons: DataFrame, width: int = BIN) -> DataFrame:
    """The windows with gene and context: those that lie over exactly one gene's span, exonic where one of that gene's own exons overlaps, else intronic.

    windows (chrom, st, en, ...), genes and exons (gene, chrom, st, en). An exon of another gene does not count. What a
    window is hangs on its place alone, so ids may repeat.
    """
    place = ["chrom", "st", "en"]
    spans = genes.select(F.col("gene").alias("r_gene"), F.col("chrom").alias("r_chrom"), F.col("st").alias("r_st"), F.col("en").alias("r_en"))
    one = overlaps(windows.select(*place).distinct(), spans, width).groupBy(*place).agg(F.count("*").alias("n"), F.min("r_gene").alias("gene")).filter("n = 1").drop("n")
    # Within the gene, so the equi-join is by gene and bin.
    own = exons.select(F.col("gene").alias("r_chrom"), F.col("st").alias("r_st"), F.col("en").alias("r_en"))
    exonic = overlaps(one.select(F.col("chrom").alias("contig"), F.col("gene").alias("chrom"), "st", "en"), own, width).select(F.col("contig").alias("chrom"), "st", "en").distinct().withColumn("exonic", F.lit(True))
    context = F.when(F.col("exonic"), "exonic").otherwise("intronic")
    return windows.join(one.join(exonic, place, "left").select(*place, "gene", context.alias("context")), place)
