"""Writers: tables as Parquet, CSV or appended JSON lines, and the hash of what was written."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def content_hash(df: DataFrame) -> DataFrame:
    """n_rows, digest: independent of the order of rows and of partitions."""
    each = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.coalesce(F.sum(each), F.lit(0)).cast("string"), 256).alias("digest"))
