"""Substring deduplication with difference-cover anchors.

A window is ``width`` consecutive words of one document. Every word is removed
that lies in a window whose words also start anywhere else.

Two positions i and j always have an offset d below the period with both i + d and
j + d at cover positions. So two equal windows share the hash of the shorter run
(``width`` - period + 1 words) at an aligned cover position, and hashing only
there, about a quarter of all positions, loses no match. Anchors that occur twice
are extended to the windows around them, and those are compared by 96 bits of
two independent polynomial hashes.

Scale. Anchors and windows are grouped by hash in one shuffle each. Before it,
each task folds equal hashes: a hash seen twice within one segment is a repeat
already, and only a single marker row goes on for it. A passage that stands in a
third of all documents therefore sends one row per segment to the reducer. No
pair is ever built.

Defined cases: null and empty texts have no words and keep the hash of the empty
string; documents shorter than a window lose nothing; repeated rows, also of one
doc_id, are separate documents and remove each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ._shared import BOX, KEY, Powers, Shelf, binary, keyed, mix, quoted, rolling, word_hashes, words_of

#: Perfect difference sets: each non-zero residue is a difference of just one pair. Fixed values.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
_ONE, _TWO = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Rows that a task folds at a time.
SEGMENT = 1 << 20


def cover(width: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves an anchor of at least two fifths of the window."""
    fit = [v for v in COVERS if 5 * (width - v + 1) >= 2 * width]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def _fold(h1: np.ndarray, h2: np.ndarray, key: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows that go to the shuffle. Even h1: a hash, once per segment. Odd h1: a place known to repeat, dealt out evenly."""
    order = np.lexsort((h2, h1))
    h1, h2, key, pos = h1[order], h2[order], key[order], pos[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(h1)))
    many = np.repeat(size > 1, size)
    lone, heads = ~many, new & many
    odd = mix(key[many] * np.uint64(_ONE) + pos[many].astype(np.uint64)) | np.uint64(1)
    n1, n2, n3 = int(lone.sum()), int(heads.sum()), int(many.sum())
    clear = ~np.uint64(1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([h1[lone] & clear, h1[heads] & clear, odd]).view(np.int64)),
            pa.array((np.concatenate([h2[lone], h2[heads], np.zeros(n3, np.uint64)]) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
            pa.array(np.concatenate([key[lone], np.zeros(n2, np.uint64), key[many]]).view(np.int64)),
            pa.array(np.concatenate([pos[lone], np.full(n2, -1), pos[many]]).astype(np.int32)),
            pa.array(np.concatenate([np.ones(n1, np.int8), np.full(n2, 2, np.int8), np.full(n3, 2, np.int8)])),
        ],
        names=["h1", "h2", "key", "pos", "n"],
    )


_ROWS = "h1 long, h2 int, key long, pos int, n byte"


class _Segments:
    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.size += len(columns[0])
        return self.size >= SEGMENT

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            folded = _fold(*(np.concatenate(x) for x in zip(*self.parts)))
            for start in range(0, folded.num_rows, 1 << 17):
                yield folded.slice(start, 1 << 17)
        self.parts, self.size = [], 0


def _anchors(width: int):
    period, residues = cover(width)
    length, chosen = width - period + 1, np.isin(np.arange(period), residues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, segments = Powers(_ONE), _Segments()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
                hashes = word_hashes(text)
                if len(hashes) < width:
                    continue
                at = np.flatnonzero(np.resize(chosen, len(hashes) - length + 1))
                h1 = mix(rolling(hashes, length, powers)[at])
                if segments.add(h1, np.zeros(len(at), np.uint64), np.full(len(at), key, np.uint64), at):
                    yield from segments.flush()
        yield from segments.flush()

    return run


def _windows(width: int):
    period, _ = cover(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, segments = Powers(_ONE), Powers(_TWO), _Segments()
        for batch in batches:
            for key, text, anchors in zip(batch.column(0).to_pylist(), binary(batch.column(1)), batch.column(2)):
                hashes, at = word_hashes(text), np.asarray(anchors.values, np.int64)
                n = len(hashes) - width + 1
                edge = np.zeros(len(hashes) + 1, np.int32)
                np.add.at(edge, np.maximum(at - period + 1, 0), 1)
                np.add.at(edge, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                h1, h2 = mix(rolling(hashes, width, one)[starts]), mix(rolling(hashes, width, two)[starts])
                if segments.add(h1, h2, np.full(len(starts), key, np.uint64), starts):
                    yield from segments.flush()
        yield from segments.flush()

    return run


def _repeats(rows: DataFrame, two: bool) -> DataFrame:
    """Places whose hash occurs twice; a key's places come as one array."""
    from pyspark.sql import Window

    hashes = ["h1", "h2"] if two else ["h1"]
    if not two:
        rows = rows.drop("h2")
    total = F.sum("n").over(Window.partitionBy(*hashes))
    return rows.withColumn("total", total).filter("total > 1 AND pos >= 0").groupBy("key").agg(F.collect_list("pos").alias("at"))


def repeated_starts(docs: DataFrame, shelf: Shelf, width: int = 35) -> DataFrame:
    """key, at: the starts of windows that occur again. ``docs`` has the row key and text."""
    rows = docs.select(KEY, "text")
    # A window holds its anchor, so an anchor's places are sent for each document as one row.
    anchors = shelf.put(_repeats(rows.mapInArrow(_anchors(width), _ROWS), two=False), "anchors", free=True)
    near = rows.join(anchors.hint("shuffle_hash"), rows[KEY] == anchors["key"]).select(KEY, "text", "at")
    starts = shelf.put(_repeats(near.mapInArrow(_windows(width), _ROWS), two=True), "starts", free=True)
    shelf.drop("anchors")
    return starts


def _cut(width: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, digests, kept = [], [], [], []
            for text, starts in zip(binary(batch.column("text")), batch.column("at")):
                pieces = list(words_of(text or b""))
                words = pieces[0] if len(pieces) == 1 else [w for p in pieces for w in p]
                totals.append(len(words))
                if starts.is_valid and len(starts.values):
                    at = np.asarray(starts.values, np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                    changed = True
                else:
                    changed = False
                removed.append(totals[-1] - len(words))
                joined = b" ".join(words)
                digests.append(hashlib.sha256(joined).hexdigest())
                if texts:
                    kept.append(joined if changed else text)
            data = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] not in ("text", "at")]
            names = [x for x in batch.schema.names if x not in ("text", "at")]
            data += [pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            names += ["n_words", "n_removed", "kept_sha256"]
            if texts:
                data.append(pa.array(kept, pa.large_binary()).cast(pa.binary()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(data, names=names)

    return run


def remove_repeats(docs: DataFrame, width: int = 35, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row and, if asked for, kept_text.

    kept_text is the text as it was where nothing is removed, else the words kept,
    joined by one space; null stays null.
    """
    shelf = Shelf(docs.sparkSession, "substring")
    rows = keyed(docs.select("doc_id", "text"), "substring")
    starts = repeated_starts(rows, shelf, width)
    both = rows.join(starts.hint("shuffle_hash"), rows[KEY] == starts["key"], "left").select("doc_id", "text", "at")
    out = both.mapInArrow(_cut(width, texts), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text binary" * texts)
    return out.withColumn("kept_text", F.expr("cast(kept_text AS string)")) if texts else out


def rows_with_repeats_removed(docs: DataFrame, width: int = 35) -> DataFrame:
    """The rows and columns given, with shortened texts; rows of which no word is left go."""
    shelf = Shelf(docs.sparkSession, "substring")
    # The rows' own columns are packed: they may have any names.
    rest = [c for c in docs.columns if c.lower() != "text"]
    rows = keyed(docs.select(F.struct(*(quoted(c) for c in rest), F.lit(0)).alias(BOX), "text"), "substring")
    starts = repeated_starts(rows.select(KEY, "text"), shelf, width)
    packed = rows.join(starts.hint("shuffle_hash"), rows[KEY] == starts["key"], "left").select(BOX, "text", "at")
    schema = StructType([packed.schema[BOX], *(StructField(n, t()) for n, t in (("n_words", LongType), ("n_removed", LongType), ("kept_sha256", StringType), ("kept_text", BinaryType)))])
    out = packed.mapInArrow(_cut(width, True), schema).filter("NOT (n_removed > 0 AND n_removed = n_words)")
    return out.select(*[(F.expr("cast(kept_text AS string)") if c.lower() == "text" else F.col(BOX).getField(c)).alias(c) for c in docs.columns])
