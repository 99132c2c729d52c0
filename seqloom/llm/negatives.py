"""Hard-negative mining with shared candidate lists of anchor clusters (as MAXIMUS has them).

Anchors are clustered by direction: each joins the nearest of a bounded number of pivots, and
clusters are cut into blocks of bounded size. All anchors of a block share one list of each block of
candidates: with c the block's mean direction, b the widest angle of a member to c, and t
a candidate's angle to c, no member's angle to the candidate is below t - b, so
|candidate| cos(max(0, t - b)) times a member's own length bounds their product. Candidates are sorted by that bound
once for the block, and the members walk the list together, a stretch at a time; a member leaves as
soon as the bound of what is left is below the worst of its results so far (an equal one may still win by
its id, so it goes on). Products are exact whole numbers.

Two walks: an anchor's positives are the best candidates of its label; then, for each
of its positives, the negatives are the best candidates of other labels between two shares of the positive's score. A
negative above the upper share is passed over, and a walk ends at the lower share too.

Scale. Blocks of anchors and of candidates are rows; groups of them, of bounded size, meet cell by cell
of a grid, so a task holds one group of each, whatever label or vector is frequent; each cell hands on at
most as many rows as are asked for, and a window ranks those of all cells. Anchors times candidates
is the work of an exact search where bounds do not tell vectors apart, as in many dimensions.

Defined cases: rows with a null label, a null or empty vector, or a null or non-finite component take no part; shorter
vectors are filled up with zeros; repeated rows are rows of their own, also for each other; null vec_ids
are never anchors, come last among equal scores and are given as null; equal scores go to the smaller vec_id, then to the row that comes first;
products beyond a long count as the nearest long; an anchor without positives, or a positive without
negatives, has no row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import KEY, Shelf, keyed
from .products import exact, lengths

POSITIVES, NEGATIVES, EVERY, SCALE = 5, 3, 50, 256
#: Shares of the positive's score, in hundredths, between which a negative lies.
LOW, HIGH = 50, 95
#: Rows of a block; blocks of a group, which a task holds; pivots of the anchors' clusters; candidates of a stretch.
ANCHORS, CANDIDATES, TOGETHER, PIVOTS, STRETCH = 512, 4096, 16, 256, 512
_LAST = np.iinfo(np.int64).max
_BLOCK = "n int, dims int, ids binary, named binary, keys binary, labels binary, vectors binary, scores binary"


@dataclass
class Block:
    """Rows side by side. scores: for anchors in the second walk, those of their positives (best first, the least long where there are fewer)."""

    ids: np.ndarray
    named: np.ndarray
    keys: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    scores: np.ndarray

    @classmethod
    def read(cls, r) -> Block:
        one = lambda x, kind: np.frombuffer(x, kind)
        return cls(one(r.ids, np.int64), one(r.named, bool), one(r.keys, np.int64), one(r.labels, np.int64), one(r.vectors, np.float64).reshape(r.n, r.dims), one(r.scores, np.int64).reshape(r.n, -1))

    def row(self) -> dict:
        return {"n": len(self.ids), "dims": self.vectors.shape[1]} | {c: np.ascontiguousarray(getattr(self, c)).tobytes() for c in ("ids", "named", "keys", "labels", "vectors", "scores")}


def _packed(size: int, slots: int):
    """Blocks of a task's rows, in the order in which they come; a new cluster starts a new block."""

    def block(rows: pd.DataFrame) -> dict:
        vectors = np.zeros((len(rows), int(rows["vector"].map(len).max())))
        for i, v in enumerate(rows["vector"]):
            vectors[i, : len(v)] = v
        scores = np.full((len(rows), slots), np.iinfo(np.int64).min, np.int64)
        for i, v in enumerate(rows["scores"]):
            scores[i, : len(v)] = v
        return Block(rows["vec_id"].to_numpy(np.int64), rows["named"].to_numpy(bool), rows[KEY].to_numpy(np.int64), rows["label"].to_numpy(np.int64), vectors, scores).row()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for batch in batches:
            held = pd.concat([held, batch]) if len(held) else batch
            starts = np.flatnonzero(np.diff(held["cluster"].to_numpy(), prepend=np.nan) != 0) if len(held) else []
            cuts = sorted({*starts, *(i for a, b in zip(starts, [*starts[1:], len(held)]) for i in range(a, b, size)), len(held)})
            made = [block(held.iloc[a:b]) for a, b in zip(cuts[:-2], cuts[1:-1])]
            if made:
                yield pd.DataFrame(made)
                held = held.iloc[cuts[-2] :]
        if len(held):
            yield pd.DataFrame([block(held)])

    return run


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros that only one side has add nothing."""
    dims = min(a.shape[1], b.shape[1])
    return a[:, :dims], b[:, :dims]


def _order(anchors: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates by falling bound on their product with any anchor of length one, and these bounds."""
    la, lc = lengths(anchors), lengths(candidates)
    unit = anchors / np.where(la > 0, la, 1)[:, None]
    centre = unit.mean(axis=0)
    size = lengths(centre[None])[0]
    if not size:
        bound = lc
    else:
        angle = lambda x, l: np.where(l > 0, np.arccos(np.clip(x @ (centre / size) / np.where(l > 0, l, 1), -1, 1)), 0.0)
        # An anchor of length zero has product zero with all, so bounds stay above that.
        wide = angle(anchors, la).max()
        bound = lc * np.cos(np.maximum(0.0, angle(candidates, lc) - wide - 1e-7))
        if (la == 0).any():
            bound = np.maximum(bound, 0.0)
    order = np.argsort(-bound, kind="stable")
    return order, bound[order]


class _Best:
    """The best rows so far of each of n lists: score, named last, vec_id and key decide in this order."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.rows = k, [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
        self.worst = np.full(n, -np.inf)

    def offer(self, i: int, score: np.ndarray, named: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        joined = [np.concatenate(x) for x in zip(self.rows[i], (score, named, ids, keys))]
        # Longs are negated bit by bit, so that the least one does not overflow.
        order = np.lexsort((joined[3], joined[2], ~joined[1], ~joined[0]))[: self.k]
        self.rows[i] = tuple(x[order] for x in joined)
        if len(order) == self.k:
            self.worst[i] = float(joined[0][order[-1]])


def _walk(a: Block, c: Block, same: bool, best: _Best, offset: int, slots: int, low: int, high: int, stretch: int) -> None:
    """The anchors' walk of their shared list of a block of candidates. Lists of ``best``: one for each anchor, or each of its positives."""
    if same:
        rows = np.isin(a.labels, c.labels)
        columns = np.isin(c.labels, a.labels)
    else:
        rows = (a.scores[:, 0] > np.iinfo(np.int64).min) if slots else np.zeros(len(a.ids), bool)
        columns = np.ones(len(c.ids), bool)
    rows, columns = np.flatnonzero(rows), np.flatnonzero(columns)
    if not len(rows) or not len(columns):
        return
    va, vc = _same_width(a.vectors[rows], c.vectors[columns])
    la = lengths(a.vectors[rows])
    # Cutting a vector to the other's width only shortens it, so the lengths of whole anchors are safe.
    order, bound = _order(va, vc)
    live = np.arange(len(rows))
    for start in range(0, len(order), stretch):
        top = bound[start] * la[live] + 1e-9 * np.abs(bound[start] * la[live]) + 1e-6
        if same:
            need = best.worst[offset + rows[live]]
        else:
            # A positive needs what beats its worst negative, and no less than the lower share.
            lists = (offset + rows[live])[:, None] * slots + np.arange(slots)
            wanted = a.scores[rows[live]]
            known = wanted > np.iinfo(np.int64).min
            need = np.where(known, np.maximum(best.worst[lists], wanted.astype(np.float64) * low / 100 * (1 - 1e-12)), np.inf).min(axis=1)
        live = live[top >= need]
        if not len(live):
            return
        at = columns[order[start : start + stretch]]
        scores = exact(va[live], vc[order[start : start + stretch]])
        for i, score in zip(rows[live], scores):
            if same:
                fit = np.flatnonzero((c.labels[at] == a.labels[i]) & (c.keys[at] != a.keys[i]) & (score >= best.worst[offset + i]))
                if len(fit):
                    best.offer(offset + i, score[fit], c.named[at[fit]], c.ids[at[fit]], c.keys[at[fit]])
                continue
            other = c.labels[at] != a.labels[i]
            for j, positive in enumerate(a.scores[i].tolist()):
                if positive == np.iinfo(np.int64).min:
                    break
                # low * positive <= 100 * score <= high * positive in whole numbers.
                least, most = max(-(-low * positive // 100), -(1 << 63)), min(high * positive // 100, (1 << 63) - 1)
                spot = (offset + i) * slots + j
                fit = np.flatnonzero(other & (score >= least) & (score <= most) & (score >= best.worst[spot]))
                if len(fit):
                    best.offer(spot, score[fit], c.named[at[fit]], c.ids[at[fit]], c.keys[at[fit]])


_FOUND = "anchor long, slot int, score long, vec_named boolean, vec_id long, vec_key long"


def _met(k: int, slots: int, low: int, high: int, stretch: int):
    """The walks of one group of anchor blocks over one group of candidate blocks. slots: 0 for positives."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        anchors = [Block.read(r) for r in left.itertuples(index=False)]
        lists = max(slots, 1)
        offsets = np.cumsum([0, *(len(a.ids) for a in anchors)])
        best = _Best(int(offsets[-1]) * lists, k)
        for r in right.itertuples(index=False):
            candidates = Block.read(r)
            for a, offset in zip(anchors, offsets):
                _walk(a, candidates, not slots, best, int(offset), lists, low, high, stretch)
        keys = np.repeat(np.concatenate([a.keys for a in anchors]) if anchors else np.zeros(0, np.int64), lists)
        sizes = [len(x[0]) for x in best.rows]
        score, named, ids, at = (np.concatenate(x) for x in zip(*best.rows)) if best.rows else (np.zeros(0, np.int64),) * 4
        return pd.DataFrame({"anchor": np.repeat(keys, sizes), "slot": np.repeat(np.tile(np.arange(lists), len(keys) // lists), sizes).astype(np.int32), "score": score, "vec_named": named.astype(bool), "vec_id": ids, "vec_key": at})

    return run


def _clustered(pivots: np.ndarray):
    """Each anchor with the nearest pivot by direction."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nearest = np.zeros(len(batch), np.int32)
            for i, v in enumerate(batch["vector"]):
                dims = min(len(v), pivots.shape[1])
                nearest[i] = int((pivots[:, :dims] @ np.asarray(v[:dims])).argmax()) if len(pivots) else 0
            yield batch.assign(cluster=nearest)

    return run


def _grid(anchors: DataFrame, candidates: DataFrame, groups: tuple[int, int], walk) -> DataFrame:
    """Each group of anchor blocks with each group of candidate blocks, in a task's turn of its own."""
    tall, wide = groups
    dealt = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("keys"), F.lit(n)))
    spread = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    left, right = spread(dealt(anchors, "h", tall), "g", wide), spread(dealt(candidates, "g", wide), "h", tall)
    return left.groupBy("h", "g").cogroup(right.groupBy("h", "g")).applyInPandas(lambda a, b: walk(a, b), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.desc("vec_named"), "vec_id", "vec_key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mined(vectors: DataFrame, label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    The first ``negatives`` rows of another label, for each of the first ``positives`` rows of the anchor's label, whose score
    is between ``low`` and ``high`` hundredths of the positive's. Anchors are the rows whose vec_id is divisible by ``every``.
    """
    spark = vectors.sparkSession
    shelf = Shelf(spark, "negatives")
    rows = keyed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), "embedding"), "negatives")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    fit = rows.filter(F.col("label").isNotNull() & (F.size("embedding") > 0) & ~odd).select(KEY, "vec_id", "label", F.transform("embedding", lambda x: whole(x.cast("double") * scale)).alias("vector"))
    fit = fit.filter(~F.exists("vector", lambda x: F.abs(x) == float("inf")))
    ready = shelf.put(fit.select(KEY, F.coalesce("vec_id", F.lit(_LAST)).alias("vec_id"), F.col("vec_id").isNotNull().alias("named"), "label", "vector", F.array().cast("array<long>").alias("scores")), "ready")
    asked = ready.filter(F.col("named") & (F.col("vec_id") % every == 0))
    n, m = ready.count(), asked.count()
    parts = lambda count, size: max(1, min(-(-count // size), 20_000))
    tall, wide = (max(1, -(-count // (size * TOGETHER))) for count, size in ((m, ANCHORS), (n, CANDIDATES)))
    # Enough groups of candidates for all tasks; no more than there are blocks.
    wide = max(wide, min(-(-n // CANDIDATES), -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // tall)))
    # By label, so that most blocks have few; the key parts a frequent label.
    ordered = ready.withColumn("cluster", F.lit(0)).repartitionByRange(parts(n, CANDIDATES), "label", KEY).sortWithinPartitions("label", KEY)
    blocks = shelf.put(ordered.mapInPandas(_packed(CANDIDATES, 0), _BLOCK), "candidates")
    # At most PIVOTS rows: they say which anchors share a list, not what is found.
    chosen = [r.vector for r in asked.orderBy(F.xxhash64(KEY)).limit(max(1, min(PIVOTS, m // 64))).select("vector").collect()]
    pivots = np.zeros((len(chosen), max(map(len, chosen), default=1)))
    for i, v in enumerate(chosen):
        pivots[i, : len(v)] = v
    pivots /= np.maximum(lengths(pivots), 1e-300)[:, None]
    named = shelf.put(asked.mapInPandas(_clustered(pivots), asked._jdf.schema().toDDL() + ", cluster int"), "anchors")

    def blocked(df: DataFrame, slots: int, name: str) -> DataFrame:
        dealt = df.repartitionByRange(parts(m, ANCHORS), "label", "cluster", KEY).sortWithinPartitions("label", "cluster", KEY)
        return shelf.put(dealt.mapInPandas(_packed(ANCHORS, slots), _BLOCK), name)

    first = shelf.put(_ranked(_grid(blocked(named, 1, "blocks-1"), blocks, (tall, wide), _met(positives, 0, low, high, STRETCH)), positives), "positives")
    listed = first.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    again = named.drop("scores").join(listed, F.col(KEY) == F.col("anchor")).select(*named.columns)
    second = shelf.put(_ranked(_grid(blocked(again, positives, "blocks-2"), blocks, (tall, wide), _met(negatives, positives, low, high, STRETCH)), negatives), "found")
    own = lambda df, names: df.select(*[F.when(F.col("vec_named"), F.col("vec_id")).alias(b) if a == "vec_id" else F.col(a).alias(b) for a, b in names.items()])
    x = own(first, {"anchor": "anchor", "rank": "positive_rank", "vec_id": "positive_id", "score": "positive_score"})
    y = own(second.withColumn("positive_rank", F.col("slot") + 1), {"anchor": "anchor", "positive_rank": "positive_rank", "rank": "rank", "vec_id": "negative_id", "score": "negative_score"})
    ids = named.select(F.col(KEY).alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return y.join(x, ["anchor", "positive_rank"]).join(ids, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", F.col("positive_rank").cast("int").alias("positive_rank"))
