"""Row keys that hang on files alone: the same when a scan is split anew, and so are the results of what joins by them."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import LEXICON, prose

from seqloom.llm import _shared, decontaminate, mixing, near, scoring, substring

CORES = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def files(spark, tmp_path):
    """Twelve files of uneven sizes, under a folder whose name needs escapes."""
    rng = random.Random(5)
    texts = [prose(rng.randrange(5, 400), rng) for _ in range(150)]
    texts += [texts[i] for i in range(0, 30, 3)] + [" ".join(t.split()[:60] + ["other"] + t.split()[60:]) for t in texts[:20]]
    rows = [(i if i % 17 else None, t if i % 23 else None, f"s{i % 3}") for i, t in enumerate(texts)]
    where = f"{tmp_path}/a b%20=ü"
    for n in range(12):
        spark.createDataFrame(rows[n * n : (n + 1) * (n + 1)] if n < 11 else rows[121:], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(where)
    yield where
    spark.conf.unset(CORES)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_keys_do_not_hang_on_cores(spark, files):
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    made = []
    for cores in ("4", "3", "1", "8"):
        spark.conf.set(CORES, cores)
        rows = _shared.keyed(_shared.boxed(spark.read.parquet(files), "doc_id", "text").filter("text IS NOT NULL")).select(_shared.KEY, "doc_id", F.md5("text").alias("h"))
        made.append(sorted(map(str, rows.collect())))
        assert len({r[0] for r in rows.collect()}) == len(made[0])
    assert all(m == made[0] for m in made)


def test_other_plans_are_written(spark, files):
    df = spark.read.parquet(files)
    for other in (df.union(df), df.groupBy("source").agg(F.first("text").alias("text")), spark.createDataFrame([(1,), (1,)], "a long"), df.limit(0), spark.read.parquet(files, files), _shared.boxed(df.withColumnRenamed("source", "_metadata"), "doc_id")):
        keys = [r[0] for r in _shared.keyed(other).select(_shared.KEY).collect()]
        assert len(set(keys)) == len(keys) == other.count()


def test_results_do_not_hang_on_cores(spark, files, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(LEXICON[:30]))], "item_id long, text string")
    df = spark.read.parquet(files)
    bench = bench.union(df.filter("doc_id = 5").select("doc_id", "text"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    made = lambda: [sorted(map(str, f.collect())) for f in (decontaminate.contaminated(df, bench), substring.remove_repeats(df), near.classes(df), scoring.scores(df, segment=4000), mixing.mixed(df))]
    spark.conf.set(CORES, "4")
    steady = made()
    put, turn = _shared.Shelf.put, itertools.cycle(("3", "1", "8"))

    def changing(self, *a, **k):
        out = put(self, *a, **k)
        spark.conf.set(CORES, next(turn))
        return out

    monkeypatch.setattr(_shared.Shelf, "put", changing)
    changed = made()
    assert [a == b for a, b in zip(steady, changed)] == [True] * 5
    assert all(steady)
