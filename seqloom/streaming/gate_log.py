"""The latest state of each gate from an append-only JSON log, read as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "gate string, status string, at_utc timestamp"


def latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path).groupBy("gate").agg(F.max_by("status", "at_utc").alias("status"), F.max("at_utc").alias("at_utc"))
