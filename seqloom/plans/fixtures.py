"""Views over the driver's tables in the roles that the operators need, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..functions.hashing import hash_split, hash_unit, window_id

LETTERS, CYCLE, LENGTH = "abcdefghijklmnopqrstuvwxyz", "ACGUACGUACGUACGUACGUACGUAC", 201
#: A window's doc_id is its document's id times this, plus its place in the text.
PLACES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cut(docs: DataFrame) -> DataFrame:
    """All windows of each whole text, one after the other.

    The last one ends with the text, so it overlaps the one before; a text shorter than a
    window is repeated until it fills one. Texts without letters have none.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    spelled = docs.select("doc_id", *others, F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), LETTERS, CYCLE).alias("letters"))
    pieces = spelled.select("doc_id", *others, "letters", F.regexp_extract_all("letters", F.lit(f".{{1,{LENGTH}}}"), F.lit(0)).alias("pieces"))
    last = F.rpad(F.right("letters", F.lit(LENGTH)), LENGTH, F.col("letters"))
    whole = pieces.select("doc_id", *others, F.concat(F.slice("pieces", F.lit(1), F.greatest(F.size("pieces") - 1, F.lit(0))), F.array(last)).alias("pieces"))
    # Outer, as Spark would else filter the scan by the size of the array and spell each text many times for it.
    placed = whole.select("doc_id", *others, F.posexplode_outer("pieces").alias("place", "seq")).filter(F.length("seq") == LENGTH)
    return placed.withColumn("doc_id", F.col("doc_id") * PLACES + F.col("place")).drop("place")


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(table(spark, sf_dir, "documents").select("doc_id", "text"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the labelled documents with their document's columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    joined = _cut(docs.join(table(spark, sf_dir, "labels"), "doc_id"))
    gene = F.concat("source", F.lit(":"), F.floor(F.col("doc_id") / (200 * PLACES)).cast("string"))
    return joined.select(
        "doc_id", window_id(F.col("doc_id")).alias("window_id"), gene.alias("gene"), F.col("lang").alias("context"), "source", F.col("quality").cast("long").alias("label"), F.col("toxic").cast("long").alias("toxic"),
        "n_chars", F.log1p("n_chars").alias("tpm"), "seq", sq.gc(F.col("seq")).alias("gc"), hash_split(gene).alias("split"), hash_unit(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("score"),
    )


def intervals(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    rows = rows.filter(F.col("l_returnflag") == flag) if flag else rows
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("chrom"), start.alias("st"), (start + F.col("l_quantity").cast("long")).alias("en"))


def unit(x: str) -> str:
    return f"(CAST('0x' || substr(md5({x}), 1, 13) AS BIGINT) / 4503599627370496.0)"


SEQS = f"""seqs AS (SELECT doc, doc * {PLACES} + i AS doc_id, rpad(substr(letters, greatest(least(i * {LENGTH}, length(letters) - {LENGTH}), 0) + 1, {LENGTH}), {LENGTH}, letters) AS seq FROM (
  SELECT doc_id AS doc, letters, unnest(range(0, (length(letters) + {LENGTH - 1}) // {LENGTH})) AS i FROM (SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{LETTERS}', '{CYCLE}') AS letters FROM documents)))"""
_U = unit("gene")
WINDOWS = SEQS + f""",
windows AS (SELECT *, CASE WHEN {_U} < 0.7 THEN 'train' WHEN {_U} < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (
  SELECT s.doc_id, 'W_' || md5(CAST(s.doc_id AS VARCHAR)) AS window_id, source || ':' || CAST(s.doc // 200 AS VARCHAR) AS gene, lang AS context, source, CAST(quality AS BIGINT) AS label, CAST(toxic AS BIGINT) AS toxic,
         n_chars, ln(1 + n_chars) AS tpm, seq, (402 - length(replace(seq, 'G', '')) - length(replace(seq, 'C', ''))) / 201.0 AS gc, {unit("'s' || CAST(s.doc_id AS VARCHAR)")} AS score
  FROM seqs s JOIN documents d ON d.doc_id = s.doc JOIN labels l ON l.doc_id = s.doc))"""


def interval_sql(name: str, flag: str | None = None) -> str:
    where = f" WHERE l_returnflag = '{flag}'" if flag else ""
    return f"{name} AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS chrom, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS st, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS BIGINT) AS en FROM lineitem{where})"


def merged_sql(source: str, name: str) -> str:
    return f"""{name} AS (SELECT chrom, min(st) AS st, max(en) AS en FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY st, en ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN st > max(en) OVER (PARTITION BY chrom ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY chrom ORDER BY st, en) = 1 THEN 1 ELSE 0 END AS fresh FROM {source})) GROUP BY chrom, island)"""
