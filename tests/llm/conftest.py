import pytest

from seqloom.llm import _shared


@pytest.fixture(autouse=True)
def no_waiting(monkeypatch):
    """Small tables leave no shuffle files worth waiting for."""
    monkeypatch.setattr(_shared, "release", lambda spark: None)


@pytest.fixture
def docs(spark):
    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
        return df.withColumn("key", df.doc_id).withColumn("size", df.doc_id).withColumn("label", df.text) if extra else df

    return make
