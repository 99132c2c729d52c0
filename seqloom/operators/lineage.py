"""Cuts plans from their lineage into the folder that all executors share, so that a lost executor costs the step in hand only."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, written by checkpoint(). The folder is the session's spark.checkpoint.dir; a temporary one only in one local process."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = context.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not (context.master.startswith("local") and "cluster" not in context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="seqloom-"))
    return df.checkpoint()
