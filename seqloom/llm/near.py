"""Near-duplicate documents by ProbMinHash.

Each document is a bag of five-word shingles, weighted by how often they occur.
Each shingle starts a Poisson process whose rate is its weight; arrivals fall on
signature registers at random and the first arrival at a register stays. The
chance that two documents agree at a register is their probability Jaccard
similarity. A document's processes end as soon as their next arrival comes after
the latest first arrival of all registers.

Registers are banded. Documents with the same words fold into one class before
the banding. Each bucket links its members to one leader: the member that shares
buckets with most others, as a group's middle reaches more of it than its rim does.
Links are verified on whole texts by the exact probability Jaccard similarity, and
classes are the connected components.

Buckets whose members are then in several components go on: their members gather by
leader, so that a group that shares forty buckets with one leader gathers once, and
get longer signatures, one each. Every two members of different components are
compared by these, in blocks of a bounded size, and likely pairs are verified on
texts: each member's best partner first, as this joins most of what belongs together
and leaves few pairs for the last pass, which takes all that is left. No member and
no partner is capped.

Scale. Signatures are made in the scan; only representatives of classes are
banded. Buckets are counted with map-side combination, members join their leader
(Spark splits skewed joins), and gathered groups are cut into blocks, of which every
two meet in a task of their own. The chance to miss a pair at similarity 0.8 is
(1 - 0.8**7)**40, below 9 in 100,000, and less above it; 4.2 standard deviations of
the signatures' estimate add 13 in a million. The comparison of signatures within a
group of many components grows with the square of the group; pairs that are verified
grow so only where most pairs of a large group lie between 0.75 and 0.8.

Defined cases: a text of fewer than five words is one shingle of all its words;
null texts and texts without words are alone; a very long text is one row of any
length, its words are hashed piece by piece; repeated rows are copies; other columns,
of any name, are ignored by ``classes`` and kept by ``one_of_each``; the class id is
the least doc_id of the class, null where all are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import BOX, KEY, Powers, Shelf, binary, boxed, keyed, mix, rolling, word_hashes
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 7, 40
REGISTERS = ROWS * BANDS
#: Pairs whose signatures agree less than this are not verified: over four standard deviations below the threshold.
LIKELY = THRESHOLD - 4.2 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
#: Members in a block of a group that is compared.
BLOCK = 2048
#: Partners, best first, that the passes over the groups verify for each member and block; the last takes all.
PASSES = (1, None)
#: Registers, of a byte each, of the longer signatures made for members of buckets that the first leaders leave in several components.
LONG = 1280
LIKELY_LONG = THRESHOLD - 4.2 * (THRESHOLD * (1 - THRESHOLD) / LONG) ** 0.5
_BASE = 0x9E3779B97F4A7C15


def shingles(text: bytes | None, powers: Powers, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order and their counts; the words' hashes."""
    words = word_hashes(text)
    ids = mix(rolling(words, min(width, len(words)), powers)) if len(words) else words
    distinct, counts = np.unique(ids, return_counts=True)
    return distinct, counts, words


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures of weighted sets, all sets advancing together by one arrival a round.

    A set's processes run up to a time by which its registers are nearly always full, and
    end there; only sets that still have an empty register run on, to twice that time.
    """
    sizes = np.array([len(x) for x, _ in sets])
    element = np.concatenate([x for x, _ in sets])
    weight = np.concatenate([w for _, w in sets]).astype(np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    until = registers * (np.log(registers) + 2) / np.bincount(owner, weight, len(sets))
    first = np.full(len(sets) * registers, np.inf)
    winner = np.zeros(len(sets) * registers, np.uint64)
    state, time = element.copy(), np.zeros(len(element))
    due = np.zeros(len(element), bool)
    live = np.arange(len(element))
    while len(live):
        slots, times, places = [], [], []
        # Arrivals drawn before, whose time has come now, are placed first.
        placed = live[due[live]]
        index = live
        while True:
            if len(placed):
                slot = (mix(state[placed] ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(registers)).astype(np.int64)
                slots.append(owner[placed] * registers + slot)
                times.append(time[placed])
                places.append(placed)
            if not len(index):
                break
            drawn = mix(state[index] + np.uint64(_BASE))
            moment = time[index] - np.log(_uniform(drawn)) / weight[index]
            state[index], time[index] = drawn, moment
            index = placed = index[moment <= until[owner[index]]]
        slot, moment, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (slots, times, places))
        np.minimum.at(first, slot, moment)
        best = moment == first[slot]
        winner[slot[best]] = element[place[best]]
        open_ = np.isinf(first.reshape(len(sets), registers)).any(axis=1)
        until[open_] *= 2
        due[:] = True
        live = np.flatnonzero(open_[owner] & (time <= until[owner]))
        while open_.any() and not len(live):
            until[open_] *= 2
            live = np.flatnonzero(open_[owner] & (time <= until[owner]))
    return winner.reshape(len(sets), registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact: the sum over shared elements d of 1 / sum_z max(a_z / a_d, b_z / b_d)."""
    (xs, x), (ys, y) = a, b
    both, i, j = np.intersect1d(xs, ys, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = x.astype(np.float64), y.astype(np.float64)
    xi, yj = x[i], y[j]
    only_x, only_y = x.sum() - xi.sum(), y.sum() - yj.sum()
    score = 0.0
    ratios, group = np.unique(xi / yj, return_inverse=True)
    shares = np.bincount(group, xi)
    # For the ratio r the denominator is sum_z max(x_z, r y_z); over shared elements those with ratio above r count as x, the rest as r y.
    by_x, by_y = np.bincount(group, xi), np.bincount(group, yj)
    above, upto = by_x.sum() - np.cumsum(by_x), np.cumsum(by_y)
    score = float((shares / (only_x + ratios * only_y + above + ratios * upto)).sum())
    return score


_SIGNED = "key long, d1 long, d2 long, bands array<long>, sig binary"


def _weighted(batch: pa.RecordBatch, powers: Powers) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]], list[int]]]:
    """Keys, weighted sets and word digests of a batch's texts with words, a bounded number of shingles at a time."""
    keys, texts = batch.column(0).to_pylist(), binary(batch.column(1))
    start = 0
    while start < len(keys):
        end, size, sets, own, digests = start, 0, [], [], []
        while end < len(keys) and size < 1 << 15 and end - start < 256:
            ids, counts, words = shingles(texts[end], powers)
            if len(ids):
                sets.append((ids, counts))
                own.append(keys[end])
                digests.append(xxhash.xxh3_128_intdigest(words.tobytes()))
                size += len(ids)
            end += 1
        start = end
        if sets:
            yield own, sets, digests


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers(_BASE)
    for batch in batches:
        for own, sets, digests in _weighted(batch, powers):
            sig = signatures(sets)
            bands = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands * np.uint64(31) + sig[:, r::ROWS][:, :BANDS])
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE))
            short = (sig & np.uint64(0xFFFF)).astype(np.uint16)
            d = np.array([[x >> 64, x & (1 << 64) - 1] for x in digests], np.uint64).view(np.int64)
            flat = pa.array(bands.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), flat), pa.array([x.tobytes() for x in short], pa.binary())],
                names=["key", "d1", "d2", "bands", "sig"],
            )


def _sign_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers(_BASE)
    for batch in batches:
        for own, sets, _ in _weighted(batch, powers):
            sig = (signatures(sets, LONG) & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary())], names=["key", "sig"])


def _likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in batches:
        if len(part):
            x, y = (np.frombuffer(b"".join(part[c]), np.uint16).reshape(len(part), -1) for c in ("sig_a", "sig_b"))
            part = part[(x == y).mean(axis=1) >= LIKELY]
        yield part[["a", "b"]]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, last = Powers(_BASE), (None, None)
        for batch in batches:
            left, right, rows = binary(batch.column("text_a")), binary(batch.column("text_b")), []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), left, right):
                if last[0] != a:
                    last = (a, shingles(x, powers)[:2])
                score = probability_jaccard(last[1], shingles(y, powers)[:2])
                if score >= threshold - 1e-12:
                    rows.append((a, b, score))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["a", "b", "similarity"])

    return run


def _agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Registers at which each row of x agrees with each row of y."""
    out = np.zeros((len(x), len(y)), np.int16)
    for i, sig in enumerate(x):
        out[i] = np.count_nonzero(y == sig, axis=1)
    return out


def _pairs(most: int | None):
    """Likely pairs of different labels in a block, or between two blocks: for each member its best partners.

    Members of the commonest label are not compared with each other.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key")
        key, label, block = (part[c].to_numpy(np.int64) for c in ("key", "label", "block"))
        sig = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(len(part), -1)
        labels, counts = np.unique(label, return_counts=True)
        common = label == labels[counts.argmax()]
        lo, hi = block.min(), int(part["hi"].iloc[0])
        if part["lo"].iloc[0] == hi:
            turns = [(np.flatnonzero(~common), np.arange(len(part)))]
        else:
            turns = [(np.flatnonzero(~common & (block == hi)), np.flatnonzero(block == lo)), (np.flatnonzero(common & (block == hi)), np.flatnonzero(~common & (block == lo)))]
        found = []
        for rows, columns in turns:
            if len(rows) and len(columns):
                agree = _agreement(sig[rows], sig[columns])
                agree[(label[rows][:, None] == label[columns]) | (agree < LIKELY_LONG * LONG)] = 0
                if len(turns) == 1:
                    # Two members of uncommon labels are met from both sides.
                    agree[~common[columns] & (columns >= rows[:, None])] = 0
                if most is not None and most < len(columns):
                    least = np.partition(agree, len(columns) - most, axis=1)[:, len(columns) - most]
                    agree[agree < least[:, None]] = 0
                i, j = np.nonzero(agree)
                found.append((key[rows[i]], key[columns[j]]))
        a, b = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _verified(pairs: DataFrame, texts: DataFrame, shelf: Shelf, name: str, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. The side that repeats is joined last and split where skewed."""
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return shelf.put(joined.mapInArrow(_verify(threshold), "a long, b long, similarity double"), name, free=True)


def _mixed(members: DataFrame, labels: DataFrame, by: str, shelf: Shelf, name: str) -> DataFrame:
    """The members, with labels, of groups that hold more than one label."""
    rest = members.join(labels, members["key"] == labels["node"], "left").select(*members.columns, F.coalesce("label", "key").alias("label"))
    bounds = rest.groupBy(by).agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    # Written, so that the join is planned by its size and not dealt by the group.
    mixed = shelf.put(bounds.filter("lo != hi").select(by), f"{name}-mixed")
    return rest.join(mixed, by, "left_semi")


def _gathered(members: DataFrame, labels: DataFrame, sigs: DataFrame, shelf: Shelf, name: str) -> DataFrame | None:
    """lead, lo, hi, block, key, label, sig: each member once for each two blocks of its group that include its own. None where nothing is left."""
    left = shelf.put(_mixed(members, labels, "lead", shelf, name), f"{name}-left")
    sizes = shelf.put(left.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), f"{name}-sizes")
    if not sizes.limit(1).count():
        return None
    placed = left.join(sizes, "lead").withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).join(sigs, "key")
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return spread.select("lead", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "label", "sig")


def _classes(rows: DataFrame, shelf: Shelf, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(key, label) of each row with words, where label is the least key of its class; verified links of representatives."""
    signed = shelf.put(rows.select(KEY, "text").mapInArrow(_sign, _SIGNED), "signed")
    # Written, so that the join is not dealt by the grouping: a large group of copies can be split.
    copies = shelf.put(signed.groupBy("d1", "d2").agg(F.min("key").alias("rep")), "copies")
    same = shelf.put(signed.select("key", "d1", "d2").join(copies, ["d1", "d2"]).select("key", "rep"), "same")
    reps = signed.join(same.filter("key = rep").select("key"), "key", "left_semi")
    member = reps.select("key", F.posexplode("bands").alias("band", "hash")).select("key", F.xxhash64("band", "hash").alias("bucket"))
    sizes = member.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = shelf.put(member.join(sizes, "bucket").select("bucket", "key", "n"), "shared")
    central = shared.groupBy("key").agg(F.sum("n").alias("weight"))
    first = shared.join(central, "key").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("key")).alias("minus"))).alias("top"))
    members = shelf.put(shared.join(first.select("bucket", (-F.col("top.minus")).alias("lead")), "bucket").filter("key != lead").select("bucket", "lead", "key"), "members")
    star = shelf.put(members.select(F.col("lead").alias("a"), F.col("key").alias("b")).distinct(), "star")
    some = shelf.put(star.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "some")
    shelf.drop("shared")
    sigs = shelf.put(reps.join(some, "key", "left_semi").select("key", "sig"), "sigs")
    shelf.drop("signed")
    texts = shelf.put(rows.select(F.col(KEY).alias("key"), "text").join(some.hint("shuffle_hash"), "key", "left_semi"), "texts", free=True)
    near = star.join(sigs.select(F.col("key").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), "a")
    pairs = shelf.put(near.select("a", "b", "sig_a", "sig_b").mapInPandas(_likely, "a long, b long"), "pairs-0")
    links = _verified(pairs, texts, shelf, "links-0", threshold)
    labels = components(links, shelf, "labels-0")
    compared = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    groups = shelf.put(_mixed(members, labels, "bucket", shelf, "first").select("lead", "key").distinct(), "groups")
    shelf.drop("sigs")
    long = None
    for turn, most in enumerate(PASSES, 1):
        if long is None:
            asked = groups.select("key").distinct()
            long = shelf.put(texts.join(asked, "key", "left_semi").select("key", "text").mapInArrow(_sign_long, "key long, sig binary"), "long")
        spread = _gathered(groups, labels, long, shelf, f"pass-{turn}")
        if spread is None:
            break
        found = spread.groupBy("lead", "lo", "hi").applyInPandas(_pairs(most), "a long, b long").distinct()
        pairs = shelf.put(found.join(compared, ["a", "b"], "left_anti"), f"pairs-{turn}")
        compared = compared.union(pairs)
        links = links.union(_verified(pairs, texts, shelf, f"links-{turn}", threshold))
        labels = components(links, shelf, f"labels-{turn}")
    for name in ("texts", "long", "members", "some"):
        shelf.drop(name)
    return same.join(labels, same["rep"] == labels["node"], "left").select("key", F.coalesce("label", "rep").alias("label")), links


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, class_size for each row."""
    shelf = Shelf(docs.sparkSession, "near")
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "near")
    labels, _ = _classes(rows, shelf, threshold)
    ids = rows.select(KEY, "doc_id").join(labels, rows[KEY] == labels["key"], "left").select("doc_id", F.coalesce("label", KEY).alias("label"))
    ids = shelf.put(ids, "ids")
    groups = ids.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return ids.join(groups, "label").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns given, one row of each class: that of the least doc_id, then the first in the scan."""
    shelf = Shelf(docs.sparkSession, "near")
    rows = keyed(boxed(docs, "doc_id", "text"), "near")
    labels, _ = _classes(rows.select(KEY, "text"), shelf, threshold)
    ids = rows.select(KEY, "doc_id").join(labels, rows[KEY] == labels["key"], "inner").select(KEY, "doc_id", "label")
    stay = ids.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(KEY))).alias("first")).select(F.col(f"first.{KEY}").alias("stays"))
    gone = shelf.put(ids.join(stay, ids[KEY] == stay["stays"], "left_anti").select(F.col(KEY).alias("gone")), "gone")
    return rows.join(gone.hint("shuffle_hash"), rows[KEY] == gone["gone"], "left_anti").select(f"{BOX}.*")
