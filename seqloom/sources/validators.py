"""What a source must look like before it is used: each check is an aggregation, and an error where the schema is not the one expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import attribute, fasta


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))


def peaks(spark: SparkSession, path: str, least: int = 6) -> dict[str, int]:
    """Strand and signal are needed, so rows have six columns or more."""
    row = _fields(spark, path).filter(~F.col("f")[0].startswith("track")).agg(F.count("*").alias("n"), F.min(F.size("f")).alias("columns")).first()
    if (row["columns"] or 0) < least:
        raise ValueError(f"{path}: {row['columns']} columns, {least} are needed")
    return {"peaks": row["n"], "columns": row["columns"]}


def matrix(spark: SparkSession, path: str, tolerance: float = 1e-2) -> dict[str, float]:
    """Columns A, C, G, U; each position's frequencies sum to one, which a transposed file does not."""
    rows = _fields(spark, path)
    header = [x.strip().upper() for x in rows.first()["f"][1:]]
    if header != list("ACGU"):
        raise ValueError(f"{path}: columns {header}")
    values = rows.select(F.transform(F.slice("f", 2, 4), lambda x: x.try_cast("double")).alias("v")).filter(F.get("v", F.lit(0)).isNotNull())
    row = values.agg(F.count("*").alias("n"), F.max(F.abs(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) - 1)).alias("off")).first()
    if not row["n"] or row["off"] > tolerance:
        raise ValueError(f"{path}: a position is off one by {row['off']}")
    return {"positions": row["n"], "off": row["off"]}


def annotation(spark: SparkSession, path: str) -> dict[str, int]:
    f = F.col("f")
    rows = _fields(spark, path).filter(F.size("f") >= 9)
    row = rows.agg(F.count("*").alias("features"), F.countDistinct(F.when(f[2] == "gene", attribute(f[8], "gene_id"))).alias("genes"), F.countDistinct(f[0]).alias("contigs"), F.coalesce(F.bool_or(f[0] == "chr1"), F.lit(False)).alias("named_like_peaks")).first()
    return row.asDict()


def expression(spark: SparkSession, path: str) -> dict[str, object]:
    header = spark.read.text(path).first()["value"].split("\t")
    if not {"transcript_id", "length"} <= set(header):
        raise ValueError(f"{path}: no transcript_id and length among {header}")
    return {"columns": header, "tpm": "TPM" in header}


def genome(spark: SparkSession, path: str, least: int = 20) -> dict[str, int]:
    n = fasta(spark, path).select("contig").distinct().count()
    if n < least:
        raise ValueError(f"{path}: {n} contigs")
    return {"contigs": n}


CHECKS = {"bed": peaks, "pwm": matrix, "gtf": annotation, "tsv": expression, "fasta": genome}


def manifest(spark: SparkSession, sources: dict[str, tuple[str, str]]) -> DataFrame:
    """name, kind, path, bytes, sha256, status, detail for each source (kind, path). A source that fails leaves the others alone.

    Files are hashed where they are read, one task a file, so a source should be cut into files of a size that a task holds.
    """
    rows = []
    for name, (kind, path) in sources.items():
        try:
            rows.append((name, kind, path, "ok", str(CHECKS[kind](spark, path))))
        except Exception as error:  # noqa: BLE001  any fault of one source is its record
            rows.append((name, kind, path, "failed", f"{type(error).__name__}: {str(error)[:200]}"))
    made = spark.createDataFrame(rows, "name string, kind string, path string, status string, detail string")
    fit = [r[2] for r in rows if r[3] == "ok"]
    if not fit:
        return made.select("name", "kind", "path", F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("sha256"), "status", "detail")
    files = spark.read.format("binaryFile").load(fit).select(F.regexp_replace("path", "^file:/*", "/").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return made.join(files, F.regexp_replace(made["path"], "^file:/*", "/") == files["file"], "left").select("name", "kind", "path", "bytes", "sha256", "status", "detail")
