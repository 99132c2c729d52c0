"""Language-model scores by context-tree weighting of bytes.

A text is modelled as its words in lower case (A-Z only), joined by one space,
and an end byte. Each byte is eight binary decisions, and each decision has a
context tree over the five bytes before it. Every node holds the
Krichevsky-Trofimov estimate of its counts, weighted half and half with what its
children say, from the deepest contexts to the root; the posterior of these
weights mixes the predictions of all depths. Where a context was never seen in
training, the mixture ends at the deepest one that was.

All that training needs are the counts of six-byte sequences. They grow with the
corpus and are counted over all of it, like the words of the base model. Texts are
folded by segments of some 16 MB: a segment sends each of its sequences and words once,
packed by parts, and gets the value of each back the same way. Parts are dealt by the
latest three bytes of the context, so a part holds whole subtrees of depth three; the
levels above are sums over a part's nodes, and sums of these.

Scale. One plan at every size; scores do not depend on how texts are dealt, to the last
bit. What is sent grows with the distinct sequences of the segments, not with their
bytes. A context of three bytes has at most 2**24 sequences, which bounds what cannot be
split; segments that meet in a part are dealt to salts by what they hold. Only the
depth-one nodes, at most 65,280, come to the driver.

Defined cases: null texts are empty and score their end alone; a very long text is a
segment of its own, worked through in pieces; repeated rows are texts of their own; null
doc_ids count as training rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import KEY, Shelf, binary, keyed, mix, words_of

DEPTH, END = 5, b"\n"
#: Bytes of text in a segment, and in the pieces that it is worked through in.
SEGMENT, CHUNK = 16 << 20, 2 << 20
#: Parts: one for so many bytes of text, within bounds.
PART_BYTES, PARTS = 4 << 20, (64, 4096)
#: Sequences of different segments that meet in one task.
TOGETHER = 2_000_000
WORD, GRAM = 0, 1
#: Sequences of a segment's chunks that are held beside those folded, at least.
FOLD = 1 << 19
_U8, _255 = np.uint64(8), np.uint64(255)
_END_HASH = xxhash.xxh64_intdigest(END)


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series; exact to double precision from 12 on."""
    i = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + i / 12 - i**3 / 360 + i**5 / 1260 - i**7 / 1680


def _small(start: float, n: int = 4096) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(n - 1) + start))])


#: log Gamma(n + 1/2) - log Gamma(1/2), and log Gamma(n + 1), for small n.
_HALVES, _WHOLES = _small(0.5), _small(1.0)


def _rising(table: np.ndarray, start: float, shift: float, n: np.ndarray) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = n >= len(table)
    if large.any():
        out = out.copy()
        out[large] = _log_gamma(n[large] + start) - shift
    return out


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    half = 0.5723649429247001  # log Gamma(1/2)
    return _rising(_HALVES, 0.5, half, a) + _rising(_HALVES, 0.5, half, b) - _rising(_WHOLES, 1.0, 0.0, a + b)


class Level:
    """Nodes of one depth, by (context << 8 | bits so far, with a leading one). Contexts have the latest byte first."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray, stop: np.ndarray) -> None:
        self.node, self.zeros, self.ones, self.weighted, self.stop = node, zeros, ones, weighted, stop

    def sums(self) -> tuple[np.ndarray, ...]:
        """Nodes of the depth above, their zeros, ones and what their children weigh, and where each node's parent is among them."""
        above = ((self.node >> np.uint64(16)) << _U8) | (self.node & _255)
        node, at = np.unique(above, return_inverse=True)
        return node, *(np.bincount(at, x, len(node)) for x in (self.zeros, self.ones, self.weighted)), at

    def parent(self) -> tuple[Level, np.ndarray]:
        """The depth above, and where each node's parent is in it."""
        *sums, at = self.sums()
        return Level.over(*sums), at

    @classmethod
    def over(cls, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> Level:
        own = kt(zeros, ones)
        weighted = np.logaddexp(own, children) - np.log(2)
        return cls(node, zeros, ones, weighted, np.exp(own - np.log(2) - weighted))

    def mixed(self, above: tuple[np.ndarray, ...] | None, at: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Probability of a one mixed so far, weight that is left, last prediction: passed down from the depth above."""
        one = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        if above is None:
            return self.stop * one, 1 - self.stop, one
        done, left, last = (x[at] for x in above)
        seen = self.zeros + self.ones > 0
        return np.where(seen, done + left * self.stop * one, done), np.where(seen, left * (1 - self.stop), left), np.where(seen, one, last)


def bottom(keys: np.ndarray, counts: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The deepest nodes of six-byte sequences (context << 8 | byte): the level, and for 8 decisions of each sequence its node and bit."""
    context, byte = keys >> _U8, keys & _255
    nodes = np.concatenate([(context << _U8) | np.uint64(1 << b) | (byte >> np.uint64(8 - b)) for b in range(8)])
    bits = np.concatenate([(byte >> np.uint64(7 - b)) & np.uint64(1) for b in range(8)]).astype(bool)
    node, at = np.unique(nodes, return_inverse=True)
    each = np.tile(counts.astype(np.float64), 8)
    zeros, ones = np.bincount(at, np.where(bits, 0, each), len(node)), np.bincount(at, np.where(bits, each, 0), len(node))
    return Level(node, zeros, ones, kt(zeros, ones), np.ones(len(node))), at, bits


def modelled(text: bytes | None) -> tuple[bytes, np.ndarray]:
    """The byte string that is scored, and a hash of each token."""
    one, parts, hashes = xxhash.xxh64_intdigest, [], []
    for words in words_of((text or b"").lower()):
        if words:
            parts.append(b" ".join(words))
            hashes.append(np.fromiter(map(one, words), np.uint64, len(words)))
    return b" ".join(parts) + END, np.concatenate([*hashes, np.array([_END_HASH], np.uint64)])


def sequences(data: np.ndarray) -> np.ndarray:
    """Each byte from the sixth on with the five before it, latest first."""
    n = len(data) - DEPTH
    out = np.zeros(n, np.uint64)
    for d in range(1, DEPTH + 1):
        out = (out << _U8) | data[DEPTH - d : DEPTH - d + n]
    return (out << _U8) | data[DEPTH:]


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sequences of the texts in order, a bounded number at a time: which text, and the sequence. Zeros stand before a text.

    Only texts above the bound are cut, at the same places wherever they stand.
    """
    held: list[bytes] = []
    owners: list[tuple[int, int]] = []

    def made() -> tuple[np.ndarray, np.ndarray]:
        index, sizes = np.array(owners, np.int64).T
        all_ = sequences(np.frombuffer(b"".join(held), np.uint8).astype(np.uint64))
        fit = np.ones(len(all_) + DEPTH, bool)
        first = np.cumsum(sizes + DEPTH) - sizes - DEPTH
        fit[(first[:, None] + np.arange(DEPTH)).ravel()] = False
        held.clear()
        owners.clear()
        return np.repeat(index, sizes), all_[fit[DEPTH:]]

    size = 0
    for i, data in enumerate(texts):
        for s in range(0, len(data), CHUNK):
            before, piece = data[max(0, s - DEPTH) : s], data[s : s + CHUNK]
            held.append(before.rjust(DEPTH, b"\0") + piece)
            owners.append((i, len(piece)))
            size += len(piece)
            if size >= CHUNK:
                yield made()
                size = 0
    if held:
        yield made()


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _segments(segment: int):
    """Texts with their segment, the key of its first row, and their place in it. Written once: how a scan is cut hangs on the cores of the moment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place, size = None, 0, 0
        for batch in batches:
            keys, texts = batch.column(KEY).to_pylist(), binary(batch.column("text"))
            segs, places = [], []
            for k, text in zip(keys, texts):
                if size >= segment:
                    key, place, size = None, 0, 0
                key = k if key is None else key
                segs.append(key)
                places.append(place)
                place += 1
                size += len(text or b"") + 1
            for s in range(0, len(keys), 256):
                part = slice(s, s + 256)
                yield pa.RecordBatch.from_arrays([pa.array(segs[part], pa.int64()), pa.array(places[part], pa.int64()), batch.column("doc_id").slice(s, 256), pa.array(texts[part], pa.binary())], names=["seg", "place", "doc_id", "text"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[int | None], list[bytes | None]]]:
    """Rows of one segment that a scan reads one after the other: segment, first place, doc_ids, texts."""
    at, ids, texts = None, [], []
    for batch in batches:
        for seg, place, doc_id, text in zip(batch.column("seg").to_pylist(), batch.column("place").to_pylist(), batch.column("doc_id").to_pylist(), binary(batch.column("text"))):
            if at is not None and (seg, place) != (at[0], at[1] + len(ids)):
                yield *at, ids, texts
                at, ids, texts = None, [], []
            at = at or (seg, place)
            ids.append(doc_id)
            texts.append(text)
    if ids:
        yield *at, ids, texts


def _fold(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts added up."""
    keys, at = np.unique(np.concatenate([k for k, _ in found] or [np.zeros(0, np.uint64)]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in found] or [np.zeros(0)]), len(keys)).astype(np.int64)


def _keys(ids: list[int | None], made: list[tuple[bytes, np.ndarray]]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The distinct words and sequences of a segment with their counts in its training texts."""
    learnt = np.array([not held_out(i) for i in ids])
    words = [np.unique(hashes, return_counts=True) for _, hashes in made]
    words = _fold([(k, n * learn) for (k, n), learn in zip(words, learnt)])
    grams = [_fold([])]
    for owner, keys in _chunks([data for data, _ in made]):
        fit = learnt[owner]
        grams.append(np.unique(keys[fit], return_counts=True))
        if not fit.all():
            others = np.unique(keys[~fit])
            grams.append((others, np.zeros(len(others), np.int64)))
        # What chunks add is folded in once it is as much as is held, so that memory follows the distinct sequences.
        if sum(len(k) for k, _ in grams[1:]) > max(len(grams[0][0]), FOLD):
            grams = [_fold(grams)]
    return words, _fold(grams)


def _dealt(kind: int, keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the keys of each part that has any, in the order of the keys."""
    part = mix(keys if kind == WORD else keys >> np.uint64(24)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(ends)):
        yield int(p), order[ends[p] : ends[p + 1]]


_PIECES = "seg long, first long, kind int, part int, n long, keys binary, counts binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _pieces(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, first, ids, texts in _runs(batches):
            for kind, (keys, counts) in enumerate(_keys(ids, [modelled(t) for t in texts])):
                yield _rows(_PIECES, [(seg, first, kind, part, len(at), keys[at].tobytes(), counts[at].astype(np.uint32).tobytes()) for part, at in _dealt(kind, keys, parts)])

    return run


def _packed(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


_COUNTS = "kind int, part int, tokens long, distinct long, n long, keys binary, counts binary"


def _added(wide: bool):
    """One row for each group: its keys in order, and their counts added up."""

    def run(rows: pa.Table) -> pa.Table:
        keys, counts = _fold([(_packed(rows["keys"], np.uint64), _packed(rows["counts"], np.int64 if wide else np.uint32))])
        made = (rows["kind"][0].as_py(), rows["part"][0].as_py(), int(counts.sum()), int((counts > 0).sum()), len(keys), keys.tobytes(), counts.tobytes())
        return pa.Table.from_batches([_rows(_COUNTS, [made])])

    return run


_NODES = "part int, node long, zeros double, ones double, children double"


def _levels(keys: bytes, counts: bytes) -> tuple[list[Level], list[np.ndarray], np.ndarray, np.ndarray]:
    """The depths 5, 4 and 3 of a part, the links between them, and each decision's node of depth 5 and bit."""
    level, at, bits = bottom(np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64))
    levels, links = [level], []
    for _ in range(DEPTH - 3):
        level, link = level.parent()
        levels.append(level)
        links.append(link)
    return levels, links, at, bits


def _table(schema: str, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in schema.split(", ")]
    for s in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[s : s + (1 << 16)]) for c in columns], names=names)


def _sums(level: Level) -> list[np.ndarray]:
    """What a level adds to the one above. Weights in steps of 2**-20: their sums are exact, so their order does not matter."""
    level.weighted = np.round(level.weighted * 2.0**20) / 2.0**20
    node, *sums, _ = level.sums()
    return [node.view(np.int64), *sums]


def _lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the sequences of each part to what it adds to the nodes of depth 2."""
    for batch in batches:
        for part, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "counts"))):
            node, *sums = _sums(_levels(keys, counts)[0][-1])
            yield from _table(_NODES, np.full(len(node), part, np.int32), node, *sums)


def _numpy(batch: pa.RecordBatch | pa.Table, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy() for n in names]


def _second(batch: pa.RecordBatch) -> Level:
    node, *sums = _numpy(batch, "node", "zeros", "ones", "children")
    return Level.over(node.view(np.uint64), *sums)


def _upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From depth 2 to what it adds to depth 1."""
    for batch in batches:
        if batch.num_rows:
            yield from _table("node long, zeros double, ones double, children double", *_sums(_second(batch)))


_STATE = "node long, done double, left double, last double"


def _downward(shared):
    """Depth 2's states from those of depth 1, which are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *state = shared.value
        for batch in batches:
            if batch.num_rows:
                level = _second(batch)
                above = ((level.node >> np.uint64(16)) << _U8) | (level.node & _255)
                yield from _table(_STATE, level.node.view(np.int64), *level.mixed(tuple(state), np.searchsorted(known, above)))

    return run


def _probabilities(rows: pa.Table, states: pa.Table) -> pa.Table:
    """Adds, for each sequence of a part, log10 of its byte's probability after its context."""
    made = []
    for kind, part, n, keys, counts in zip(*(rows[c].to_pylist() for c in ("kind", "part", "n", "keys", "counts"))):
        levels, links, at, bits = _levels(keys, counts)
        known, *state = _numpy(states, "node", "done", "left", "last")
        order = np.argsort(known.view(np.uint64))
        known, state = known.view(np.uint64)[order], tuple(x[order] for x in state)
        node, *_, link = levels[-1].sums()
        above = levels[-1].mixed(tuple(x[np.searchsorted(known, node)] for x in state), link)
        for level, link in zip(levels[-2::-1], links[::-1]):
            above = level.mixed(above, link)
        done, left, last = above
        one = (done + left * last)[at]
        logs = np.log10(np.where(bits, one, 1 - one)).reshape(8, -1).sum(axis=0)
        made.append((kind, part, n, keys, logs.tobytes()))
    return pa.Table.from_batches([_rows(_VALUES, made)])


_VALUES = "kind int, part int, n long, keys binary, vals binary"


def tree(counts: DataFrame, shelf: Shelf) -> DataFrame:
    """kind, part, n, keys and their values (log10 of the byte's probability after its context) of the parts counted."""
    spark = counts.sparkSession
    third = shelf.put(counts.mapInArrow(_lower, _NODES), "third")
    names = ("zeros", "ones", "children")
    second = shelf.put(third.groupBy("node").agg(*(F.sum(c).alias(c) for c in names)), "second")
    up = second.mapInArrow(_upper, "node long, zeros double, ones double, children double")
    # At most 256 contexts of one byte, with 255 nodes each.
    first = up.groupBy("node").agg(*(F.sum(c).alias(c) for c in names)).toArrow().sort_by("node")
    level = _second(first)
    root, to_root = level.parent()
    shared = spark.sparkContext.broadcast((level.node, *level.mixed(root.mixed(None, None), to_root)))
    states = third.select("part", "node").join(second.mapInArrow(_downward(shared), _STATE), "node")
    return shelf.put(counts.groupBy("part").cogroup(states.groupBy("part")).applyInArrow(_probabilities, _VALUES), "tree", free=True)


_ANSWERS = "seg long, first long, kind int, part int, vals binary"


def _answers(pieces: pa.Table, values: pa.Table) -> pa.Table:
    """For each segment's keys of a part their values."""
    known, found = _packed(values["keys"], np.uint64), _packed(values["vals"], np.float64)
    rows = zip(*(pieces[c].to_pylist() for c in ("seg", "first", "kind", "part", "keys")))
    return pa.Table.from_batches([_rows(_ANSWERS, [(*at, found[np.searchsorted(known, np.frombuffer(keys, np.uint64))].tobytes()) for *at, keys in rows])])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, n_bytes long, base_score double, score double, bits_per_byte double"


def _looked_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The value of each key, all of which are known. Sorted first, as look-ups in order are much faster."""
    order = np.argsort(keys)
    at = keys[order]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    out = np.empty(len(keys))
    out[order] = values[np.searchsorted(known, at[new])][np.cumsum(new) - 1]
    return out


def _scored(tokens: int, distinct: int, parts: int):
    zero = np.log10(tokens + distinct + 1)

    def scored(ids: list[int | None], texts: list[bytes | None], got: dict[tuple[int, int], bytes]) -> list[tuple]:
        made, tables = [modelled(t) for t in texts], []
        for kind, (keys, _) in enumerate(_keys(ids, made)):
            values = np.empty(len(keys))
            for part, at in _dealt(kind, keys, parts):
                values[at] = np.frombuffer(got[kind, part], np.float64)
            tables.append((keys, values))
        score = np.zeros(len(ids))
        for owner, keys in _chunks([data for data, _ in made]):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            score[owner[starts]] += np.add.reduceat(_looked_up(keys, *tables[GRAM]), starts)
        rows = []
        for doc_id, (data, hashes), logs in zip(ids, made, score):
            counts = _looked_up(hashes, *tables[WORD])
            base = float((np.log10(counts + 1) - zero).sum())
            rows.append((doc_id, held_out(doc_id), len(hashes), int((counts > 0).sum()), tokens, len(data), base, float(logs), float(-logs / np.log10(2) / len(data))))
        return rows

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """The rows of a segment, run by run as its pieces were made."""
        places = texts["place"].to_numpy()
        if (np.diff(places) < 0).any():
            texts = texts.sort_by("place")
            places = texts["place"].to_numpy()
        got: dict[int, dict[tuple[int, int], bytes]] = {}
        for first, kind, part, vals in zip(*(answers[c].to_pylist() for c in ("first", "kind", "part", "vals"))):
            got.setdefault(first, {})[kind, part] = vals
        del answers
        firsts, rows = sorted(got), []
        for first, end in zip(firsts, [*firsts[1:], len(places)]):
            own = texts.slice(np.searchsorted(places, first), end - first)
            rows += scored(own["doc_id"].to_pylist(), binary(own["text"]), got[first])
        return pa.Table.from_batches([_rows(_SCORES, rows)])

    return run


def _salted(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pieces with a salt, so that no task gets many more entries than ``room``. ``sizes`` has a row for each kind and part."""
    return pieces.join(F.broadcast(sizes.select("kind", "part", "salts")), ["kind", "part"]).withColumn("salt", F.pmod(F.xxhash64("seg"), "salts")).drop("salts")


def scores(docs: DataFrame, parts: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, n_bytes, base_score, score, bits_per_byte for each row.

    parts and segment say how the work is dealt; they change no score.
    """
    shelf = Shelf(docs.sparkSession, "scoring")
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "scoring").select(KEY, "doc_id", "text")
    texts = shelf.put(rows.mapInArrow(_segments(segment), "seg long, place long, doc_id long, text binary"), "texts")
    if parts is None:
        least, most = PARTS
        parts = min(most, max(least, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    pieces = shelf.put(texts.mapInArrow(_pieces(parts), _PIECES), "pieces")
    # A row for each kind and part: at most 8,192.
    sizes = shelf.put(pieces.groupBy("kind", "part").agg(F.sum("n").alias("all"), F.ceil(F.sum("n") / TOGETHER).alias("salts")), "sizes")
    some = _salted(pieces, sizes).groupBy("kind", "part", "salt").applyInArrow(_added(False), _COUNTS)
    counts = shelf.put(some.groupBy("kind", "part").applyInArrow(_added(True), _COUNTS), "counts", free=True)
    sums = counts.filter(F.col("kind") == WORD).agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    tokens, distinct = int(sums["tokens"] or 0), int(sums["distinct"] or 0)
    words = counts.filter(F.col("kind") == WORD).mapInArrow(_as_values, _VALUES)
    values = tree(counts.filter(F.col("kind") == GRAM), shelf).union(words)
    sizes = shelf.put(sizes.join(counts.select("kind", "part", "n"), ["kind", "part"]).select("kind", "part", F.ceil(F.col("all") / F.greatest("n", F.lit(TOGETHER))).alias("salts")), "salts")
    copies = values.join(F.broadcast(shelf.get("salts")), ["kind", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    by = ("kind", "part", "salt")
    asked = _salted(pieces.select("seg", "first", "kind", "part", "keys"), sizes)
    answers = shelf.put(asked.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(_answers, _ANSWERS), "answers", free=True)
    for name in ("pieces", "third", "second"):
        shelf.drop(name)
    return texts.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(_scored(tokens, distinct, parts), _SCORES)


def _as_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words as values."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "n", "keys", "counts")))
        yield _rows(_VALUES, [(*x, np.frombuffer(c, np.int64).astype(np.float64).tobytes()) for *x, c in rows])
