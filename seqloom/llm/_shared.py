"""Helpers that the corpus operators have in common."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than space, tab, LF, VT, FF and CR; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
KEY, BOX = "_k", "_row"
#: Texts longer than this are cut into words piece by piece, so that one text never becomes one huge list.
PIECE = 1 << 22
#: Bits of a row key for the row's place in its file; the rest, but the sign, tell files apart.
ROW_BITS = 27
_GAPS = b" \t\n\r\x0b\x0c"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where unset (tests, local mode), a temporary one is made and set."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "local-cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir is not set")
        conf = f"file://{tempfile.mkdtemp(prefix='seqloom-')}"
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone; the cluster's cleaner owns what is left
        pass


class Shelf:
    """Tables that one run of an operator writes to the shared folder.

    They cut lineage: a lost executor costs the step in hand only. ``drop`` frees
    what no later step reads; the rest goes when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def put(self, df: DataFrame, name: str, free: bool = False) -> DataFrame:
        """free: after a large step, let Spark delete its shuffle files at once."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        del df
        if free:
            release(self.spark)
        return out

    def get(self, name: str) -> DataFrame:
        """A table put before, read anew: for plans in which it stands twice."""
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are finished: it does so once the driver has collected them, in the background."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def boxed(df: DataFrame, *names: str) -> DataFrame:
    """The columns named, and all columns of each row in one struct, where no name of theirs can clash with one of ours.

    ``select(f"{BOX}.*")`` gives the rows back as they came.
    """
    return df.select(F.struct(*(quoted(c) for c in df.columns)).alias(BOX), *(quoted(n) for n in names))


def quoted(name: str) -> Column:
    """A column by its whole name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _row_places(df: DataFrame) -> Column | None:
    """A number for each row from its file and its place in the file; None where the plan is not projections and filters of one Parquet scan.

    Files are told apart by a hash of their path, under the first seed that gives no two of
    them the same one. The driver holds the list of files anyway, as it plans the scan.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    if not node.nodeName().startswith("LogicalRelation"):
        return None
    relation = node.relation()
    if "HadoopFsRelation" not in relation.getClass().getName() or relation.fileFormat().toString() != "Parquet":
        return None
    listed = list(relation.inputFiles())
    if len(set(listed)) < len(listed) or "_metadata" in (c.lower() for c in [*df.columns, *relation.schema().fieldNames()]):
        return None
    bits = ROW_BITS if len(listed) <= 100_000 else ROW_BITS - 4
    # As the scan spells them: one slash after the scheme of local files.
    paths = [re.sub(r"^file:/+", "file:/", p) for p in listed]
    seed = next((n for n in range(64) if len({xxhash.xxh64_intdigest(f"{p}#{n}".encode(), seed=42) >> bits + 1 for p in paths}) == len(paths)), None)
    if seed is None:
        return None
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    hashed = F.shiftrightunsigned(F.xxhash64(F.concat(file, F.lit(f"#{seed}"))), bits + 1)
    return F.when(row < 1 << bits, F.shiftleft(hashed, bits) + row).otherwise(F.raise_error(F.lit(f"a file of over {1 << bits} rows")).cast("long"))


def keyed(df: DataFrame, name: str = "input") -> DataFrame:
    """Adds a row key, that survives null and repeated ids: the row's file and its place in that file.

    It is the same each time that the plan runs, whatever cores there are and however the
    scan is split. Plans that are more than projections and filters of one scan of Parquet
    files are first written to the shared folder.
    """
    places = _row_places(df)
    if places is None:
        df = Shelf(df.sparkSession, name).put(df, "rows")
        places = _row_places(df)
    return df.withColumn(KEY, places)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time."""
    if len(data) <= PIECE:
        yield data.split()
        return
    start = 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and data[end] not in _GAPS:
            end += 1
        yield data[start:end].split()
        start = end


def word_hashes(data: bytes | None) -> np.ndarray:
    """A 64-bit hash for each word of a text."""
    one = xxhash.xxh64_intdigest
    parts = [np.fromiter(map(one, words), np.uint64, len(words)) for words in words_of(data or b"")]
    return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint64)])


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as bytes; texts need not be valid UTF-8."""
    return column.cast(pa.large_binary()).to_pylist()


class Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, as long as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


def rolling(hashes: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Polynomial hash of each run of ``width`` values, in O(n) whatever the width."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers.to(len(hashes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return (total[width:] - total[:n]) * down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
