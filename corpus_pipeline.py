"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read again for the next.

It belongs to the subpackage ``seqloom.llm``.

Defined cases: null and empty texts are scored like others by the classifier, are alone
among near copies, lose no words, hold no benchmark item, and are not taken by the mix, as
they have no words; null ids and repeated rows are rows of their own, of which near-dedup
leaves one of each group of copies; very long texts stay one row throughout; other columns,
of any name, are kept (``copies`` and ``taken`` are replaced by the last stage); an empty
table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import decontaminate, mixing, near, quality, substring
from seqloom.llm._shared import Shelf


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    forest = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, forest)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words and more that stand elsewhere go; documents of which nothing is left go too."""
    return substring.rows_with_repeats_removed(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, with how many copies it takes and the words they hold."""
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("source mixing", mix_sources),
]

#: Near copies, and trees fitted to labels, are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shelf = Shelf(spark, "pipeline")
    for name, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir), name.replace(" ", "-"), free=True)
    return docs
