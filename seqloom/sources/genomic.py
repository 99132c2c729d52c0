"""A source of its own for the text formats of genomics, plain or gzip under any name.

Files are told apart by their first two bytes. A plain file is cut into byte ranges, each a partition: a range has the lines that
begin in it. A gzip file is one partition, as it cannot be entered in the middle. Files are opened where the
task runs, by any file system that the path's scheme names.

* ``table``: lines of tab-separated fields as an array, for peaks and annotations. Equality filters on ``chrom`` and ``feature``
  (fields 1 and 3) reach the source, so other lines are never turned into rows.
* ``sequence``: FASTA as pieces of bounded length with the place of each in its file; a header is a piece of its own. The
  places are the index: no contig is ever one row, and reading is linear in the file.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators import order

NAME = "seqloom"
RANGE, PIECE = 64 << 20, 1 << 16
_MAGIC = b"\x1f\x8b"
_SCHEMAS = {"table": "path string, at long, chrom string, feature string, fields array<string>", "sequence": "path string, at long, contig string, letters string"}
_BATCH = 4096


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int
    packed: bool


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def is_gzip(path: str) -> bool:
    system, name = _opened(path)
    with system.open_input_file(name) as f:
        return f.read(2) == _MAGIC


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.kind, self.paths = options.get("kind", "table"), options["path"].split(",")
        self.range, self.piece = int(options.get("range", RANGE)), int(options.get("piece", PIECE))
        self.wanted: dict[str, frozenset[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if self.kind == "table" and name in ("chrom", "feature"):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        made: list[InputPartition] = []
        for path in self.paths:
            system, name = _opened(path)
            info = system.get_file_info(name)
            files = [info] if info.type == pafs.FileType.File else sorted((x for x in system.get_file_info(pafs.FileSelector(name)) if x.type == pafs.FileType.File and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
            scheme = path.split(name)[0] if "://" in path and name in path else ""
            for x in files:
                own = scheme + x.path
                if is_gzip(own):
                    made.append(_Range(own, 0, x.size, True))
                else:
                    made += [_Range(own, s, min(s + self.range, x.size), False) for s in range(0, x.size, self.range)]
        return made or [_Range("", 0, 0, False)]

    def _lines(self, part: _Range) -> Iterator[tuple[int, bytes]]:
        """Place and bytes of the lines that begin in the range; of a gzip file, places are those of its content."""
        system, name = _opened(part.path)
        raw = system.open_input_file(name)
        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if part.packed else io.BufferedReader(raw, 1 << 20)
        with stream:
            at = 0
            if part.start:
                # A line begins behind a line end: read on from the byte before the range.
                stream.seek(part.start - 1)
                at = part.start - 1 + len(stream.readline())
            for line in stream:
                if not part.packed and at >= part.end:
                    return
                yield at, line
                at += len(line)

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.path:
            yield from self._table(part) if self.kind == "table" else self._sequence(part)

    def _table(self, part: _Range) -> Iterator[pa.RecordBatch]:
        chroms, features = self.wanted.get("chrom"), self.wanted.get("feature")
        rows: list[tuple[int, list[str]]] = []

        def batch() -> pa.RecordBatch:
            fields = [f for _, f in rows]
            third = [f[2] if len(f) > 2 else None for f in fields]
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows)), pa.array([a for a, _ in rows], pa.int64()), pa.array([f[0] for f in fields]), pa.array(third, pa.string()), pa.array(fields, pa.list_(pa.string()))], names=["path", "at", "chrom", "feature", "fields"])

        for at, line in self._lines(part):
            text = line.rstrip(b"\r\n")
            if not text or text[:1] == b"#":
                continue
            fields = text.decode("utf-8", "replace").split("\t")
            if (chroms is not None and fields[0] not in chroms) or (features is not None and (len(fields) < 3 or fields[2] not in features)):
                continue
            rows.append((at, fields))
            if len(rows) >= _BATCH:
                yield batch()
                rows.clear()
        if rows:
            yield batch()

    def _sequence(self, part: _Range) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, first, rows = 0, 0, []

        def batch() -> pa.RecordBatch:
            at, contig, letters = (list(x) for x in zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(at)), pa.array(at, pa.int64()), pa.array(contig, pa.string()), pa.array(letters, pa.string())], names=["path", "at", "contig", "letters"])

        for at, line in self._lines(part):
            head = line[:1] == b">"
            if held and (head or size >= self.piece):
                rows.append((first, None, b"".join(held).upper().decode("latin-1")))
                held, size = [], 0
            if head:
                rows.append((at, (line[1:].split() or [b""])[0].decode("utf-8", "replace"), ""))
            elif text := b"".join(line.split()):
                first = first if held else at
                held.append(text)
                size += len(text)
            if len(rows) >= 64:
                yield batch()
                rows = []
        if held:
            rows.append((first, None, b"".join(held).upper().decode("latin-1")))
        if rows:
            yield batch()


class Genomic(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("kind", "table")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def _load(spark: SparkSession, kind: str, path: str, **options: int) -> DataFrame:
    spark.dataSource.register(Genomic)
    # Off by default in Spark; without it the filters are applied above the source.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).option("kind", kind).options(**options).load(path)


def table(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """path, at, chrom, feature, fields of each line that is neither empty nor a comment."""
    return _load(spark, "table", path, **options)


def peaks(spark: SparkSession, path: str, contigs: list[str] | None = None, **options: int) -> DataFrame:
    """narrowPeak: track lines, malformed lines and other contigs than chr* are left out."""
    rows = table(spark, path, **options)
    rows = rows.filter(F.col("chrom").isin(contigs)) if contigs else rows
    f = F.col("fields")
    number = lambda i, kind: F.get(f, F.lit(i)).try_cast(kind)
    made = rows.filter(F.size("fields") >= 3).select("chrom", number(1, "long").alias("start"), number(2, "long").alias("end"), F.get(f, F.lit(3)).alias("name"), number(4, "double").alias("score"), F.get(f, F.lit(5)).alias("strand"), number(6, "double").alias("signal"), number(7, "double").alias("p"), number(8, "double").alias("q"), number(9, "long").alias("summit_offset"))
    return made.dropna(subset=["start", "end"]).filter(F.col("chrom").startswith("chr"))


def genes(spark: SparkSession, path: str, gene_types: list[str] | None = None, features: tuple[str, ...] = ("gene", "exon"), **options: int) -> DataFrame:
    """GTF genes and exons, with 1-based inclusive starts made 0-based half-open; of ``gene_types`` only, if given."""
    from .readers import attribute

    rows = table(spark, path, **options).filter(F.col("feature").isin(*features))
    f = F.col("fields")
    made = rows.filter(F.size("fields") >= 9).select("chrom", "feature", (f[3].try_cast("long") - 1).alias("start"), f[4].try_cast("long").alias("end"), f[6].alias("strand"), *[attribute(f[8], n).alias(n) for n in ("gene_id", "transcript_id", "gene_type", "gene_name")])
    return made.filter(F.col("gene_type").isin(*gene_types)) if gene_types else made


def contig_chunks(spark: SparkSession, path: str, size: int = 1 << 16, **options: int) -> DataFrame:
    """contig, bin, start, sequence: the contigs of a FASTA file in upper case, cut at multiples of ``size``.

    Where a piece stands in its contig follows from running sums over the places of pieces in their
    files: of headers, which number the contigs, and of letters. Letters before the first header are left out.
    """
    pieces = _load(spark, "sequence", path, **options).withColumn("head", F.col("contig").isNotNull().cast("long")).withColumn("n", F.length("letters").cast("long"))
    places = order.running(pieces.select("path", "at", "contig", "head", "n"), [F.col("path"), F.col("at")], {"heads": F.col("head"), "before": F.col("n")})
    # A row for each contig.
    named = places.filter("head = 1").select((F.col("heads") + 1).alias("number"), F.col("contig").alias("name"), F.col("path").alias("file"), F.col("before").alias("first"))
    placed = places.filter("head = 0").join(named, (F.col("heads") == F.col("number")) & (F.col("path") == F.col("file"))).select("path", "at", F.col("name").alias("contig"), (F.col("before") - F.col("first")).alias("start"))
    held = pieces.filter("head = 0").select("path", "at", "letters", "n").join(placed, ["path", "at"])
    low, high = F.expr(f"start div {size}"), F.expr(f"(start + n - 1) div {size}")
    cut = held.withColumn("bin", F.explode(F.sequence(low, high)))
    begin = F.greatest(F.col("bin") * size - F.col("start"), F.lit(0))
    end = F.least((F.col("bin") + 1) * size - F.col("start"), F.col("n"))
    parts = cut.select("contig", "bin", (F.col("start") + begin).alias("place"), F.substr("letters", (begin + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    joined = parts.groupBy("contig", "bin").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), "").alias("sequence"))
    return joined.select("contig", "bin", (F.col("bin") * size).alias("start"), "sequence")
