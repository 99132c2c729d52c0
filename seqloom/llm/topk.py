"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are sorted by length into buckets of bounded size, kept as matrices. A
first pass over the bucket of the longest vectors gives each query a lower bound
on its k-th score. For a bucket whose longest vector is l, a query of length |q|
with bound b needs a cosine of b / (|q| l): above one, the bucket is skipped; high,
vectors are pruned by their feasible range in the query's largest coordinates; low
or negative, they are pruned by length. What is left is verified by its exact
product, and the bound rises as products come in.

Queries are a set of rows, cut into blocks; blocks of queries meet buckets cell by
cell of a grid, so no task holds more than a cell's share of either, and each task
hands on at most k rows for each query and cell.

Components are floor(256 x). Products are exact whole numbers, whatever the components; those beyond a
long count as the nearest long. Bounds are doubles and let out by a margin.

Groups of buckets are cut in the order of length, four cells of the grid for each core. A block of queries is
copied to the groups only whose longest vector can reach what one of its queries still needs. Blocks and buckets
meet by a shuffle, never by a broadcast: the copies of a block are as many as groups, which no size of a file tells.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part; shorter vectors are filled up with zeros; equal scores go to the
smaller vec_id, null ones last, then to the row that comes first; repeated rows are candidates of
their own, also for each other; a query with fewer candidates than k gets all;
null vec_ids are candidates and never queries; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import KEY, Shelf, keyed
from .products import exact, lengths

K, EVERY, SCALE = 5, 50, 256
BUCKET, BLOCK, CELL = 4096, 1024, 64
#: A local cosine threshold from which coordinates prune better than lengths, and how many coordinates.
STEEP, FOCUS, SLACK = 0.5, 3, 1e-9
_LAST = np.iinfo(np.int64).max

_PACKED = "n int, dims int, longest double, ids binary, named binary, keys binary, vectors binary"


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in two bytes each where they fit, else as doubles."""
    return x.astype(np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.float64)


def _pack(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(rows: pd.DataFrame) -> pd.DataFrame:
            dims = int(rows["vector"].map(len).max())
            made = np.zeros((len(rows), dims))
            for i, v in enumerate(rows["vector"]):
                made[i, : len(v)] = v
            length = lengths(made)
            order = np.lexsort((rows[KEY].to_numpy(), -length))
            ids, keys = rows["vec_id"].to_numpy(np.int64)[order], rows[KEY].to_numpy(np.int64)[order]
            return pd.DataFrame({"n": [len(rows)], "dims": [dims], "longest": [float(length.max())], "ids": [ids.tobytes()], "named": [rows["named"].to_numpy(bool)[order].tobytes()], "keys": [keys.tobytes()], "vectors": [_narrow(made[order]).tobytes()]})

        held: list[pd.DataFrame] = []
        for batch in batches:
            for start in range(0, len(batch), size):
                held.append(batch.iloc[start : start + size])
                if sum(map(len, held)) >= size:
                    rows = pd.concat(held)
                    yield emit(rows.iloc[:size])
                    held = [rows.iloc[size:]] if len(rows) > size else []
        if held:
            yield emit(pd.concat(held))

    return run


class Block:
    """Vectors of a packed row."""

    def __init__(self, n: int, dims: int, ids: bytes, named: bytes, keys: bytes, vectors: bytes) -> None:
        self.ids, self.named, self.keys = np.frombuffer(ids, np.int64), np.frombuffer(named, bool), np.frombuffer(keys, np.int64)
        kind = np.int16 if len(vectors) == 2 * n * dims else np.float64
        self.vectors = np.frombuffer(vectors, kind).reshape(n, dims).astype(np.float64)
        self.length = lengths(self.vectors)


class Best:
    """The best k candidates so far of each query in a block."""

    def __init__(self, queries: Block, bound: np.ndarray, k: int) -> None:
        self.queries, self.k, self.bound = queries, k, bound.copy()
        self.rows: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(bound)

    def offer(self, i: int, scores: np.ndarray, bucket: Block, at: np.ndarray | slice) -> None:
        # A bound is a double, no more than half a step of it from the score it stands for.
        fit = np.flatnonzero((scores >= self.bound[i] - np.abs(self.bound[i]) * 2.0**-52) & (bucket.keys[at] != self.queries.keys[i]))
        if not len(fit):
            return
        s, n, d, k = (np.concatenate(x) for x in zip(self.rows[i], (scores[fit], bucket.named[at][fit], bucket.ids[at][fit], bucket.keys[at][fit])))
        # Longs are negated bit by bit, so that the least one does not overflow.
        order = np.lexsort((k, d, ~n, ~s))[: self.k]
        self.rows[i] = (s[order], n[order], d[order], k[order])
        if len(order) == self.k:
            self.bound[i] = max(self.bound[i], float(s[order[-1]]))

    def meet(self, bucket: Block) -> None:
        q, p = self.queries, bucket
        dims = min(q.vectors.shape[1], p.vectors.shape[1])
        qv, pv, longest = q.vectors[:, :dims], p.vectors[:, :dims], float(p.length[0]) if len(p.length) else 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(self.bound > 0, self.bound / (q.length * longest), -1.0)
        local[np.isnan(local)] = np.inf
        steep = np.flatnonzero((local >= STEEP) & (local <= 1 + SLACK))
        flat = np.flatnonzero(local < STEEP)
        if len(flat):
            # By length: vectors are in falling order, so what can still reach the bound is a prefix.
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(self.bound[flat] > 0, self.bound[flat] / q.length[flat] * (1 - SLACK), 0.0)
            upto = int(np.searchsorted(-p.length, -need.min(), side="right"))
            scores = exact(qv[flat], pv[:upto])
            for row, i in enumerate(flat):
                self.offer(i, scores[row], p, slice(0, upto))
        if len(steep):
            unit = pv / np.maximum(p.length, 1e-300)[:, None]
            for i in steep:
                t, direction = min(local[i], 1.0), qv[i] / q.length[i]
                fit = np.ones(len(unit), bool)
                for f in np.argsort(-np.abs(direction), kind="stable")[:FOCUS]:
                    centre, reach = direction[f] * t, np.sqrt(max(0.0, (1 - direction[f] ** 2) * (1 - t * t)))
                    low = -1.0 if direction[f] <= -t else centre - reach
                    high = 1.0 if direction[f] >= t else centre + reach
                    fit &= (unit[:, f] >= low - SLACK) & (unit[:, f] <= high + SLACK)
                fit = np.flatnonzero(fit)
                if len(fit):
                    self.offer(i, exact(qv[i : i + 1], pv[fit])[0], p, fit)

    def table(self) -> pd.DataFrame:
        sizes = [len(x[0]) for x in self.rows]
        s, n, d, k = (np.concatenate(x) for x in zip(*self.rows)) if self.rows else (np.zeros(0, np.int64),) * 4
        return pd.DataFrame({"query_id": np.repeat(self.queries.ids, sizes), "query_key": np.repeat(self.queries.keys, sizes), "vec_named": n.astype(bool), "vec_id": d, "vec_key": k, "score": s})


def _seed(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bounds, needs = [], []
            for r in batch.itertuples(index=False):
                best = Best(Block(r.n, r.dims, r.ids, r.named, r.keys, r.vectors), np.full(r.n, -np.inf), k)
                best.meet(Block(r.top_n, r.top_dims, r.top_ids, r.top_named, r.top_keys, r.top_vectors))
                bounds.append(best.bound.tobytes())
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(best.bound > 0, best.bound / best.queries.length * (1 - SLACK), 0.0)
                needs.append(float(np.nan_to_num(need, nan=0.0).min(initial=np.inf)))
            yield batch[["n", "dims", "longest", "ids", "named", "keys", "vectors", "block"]].assign(bound=bounds, need=needs)

    return run


def _search(k: int, most: int = 256):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, Best] = {}
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.block not in state:
                    if len(state) >= most:
                        yield from (b.table() for b in state.values())
                        state = {}
                    state[r.block] = Best(Block(r.n, r.dims, r.ids, r.named, r.keys, r.vectors), np.frombuffer(r.bound, np.float64), k)
                state[r.block].meet(Block(r.b_n, r.b_dims, r.b_ids, r.b_named, r.b_keys, r.b_vectors))
        yield from (b.table() for b in state.values())

    return run


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    shelf = Shelf(spark, "topk")
    rows = keyed(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "topk")
    # A double this large is whole already, and no long holds it for sure.
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.filter(F.col("embedding").isNotNull() & ~odd).withColumn("vector", F.transform("embedding", lambda x: whole(x.cast("double") * scale))).filter(~F.exists("vector", lambda x: F.abs(x) == float("inf")))
    ready = shelf.put(good.select(KEY, F.coalesce("vec_id", F.lit(_LAST)).alias("vec_id"), F.col("vec_id").isNotNull().alias("named"), "vector", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x).alias("square")), "ready")
    asked = ready.filter(F.col("named") & (F.col("vec_id") % every == 0))
    n, m = ready.count(), asked.count()
    # A partition holds several buckets: its rows stream through, and what the driver keeps of ranges and tasks stays as it is, whatever the rows.
    most = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda count, size: max(1, min(-(-count // size), most))
    # The key splits runs of equal lengths, so one vector in very many copies still fills buckets evenly.
    sorted_ = ready.select(KEY, "vec_id", "named", "vector", "square").repartitionByRange(parts(n, BUCKET), F.desc("square"), KEY).sortWithinPartitions(F.desc("square"), KEY)
    buckets = shelf.put(sorted_.drop("square").mapInPandas(_pack(BUCKET), _PACKED).withColumn("slot", F.spark_partition_id()), "buckets")
    blocks = shelf.put(asked.select(KEY, "vec_id", "named", "vector", "square").repartitionByRange(parts(m, BLOCK), F.desc("square"), KEY).drop("square").mapInPandas(_pack(BLOCK), _PACKED), "blocks")
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("n", "dims", "ids", "named", "keys", "vectors", *(["g"] if "g" in df.columns else []))])
    # One bucket, at most 4,096 vectors: the first of the longest vectors' range. It is chosen by its length alone, so no others' vectors move.
    first = buckets.agg(F.max(F.struct("longest", -F.col("slot"))).alias("x")).first()["x"]
    here = (F.col("slot") == -first[1]) & (F.col("longest") == first[0]) if first else F.lit(False)
    top = named(buckets.filter(here).limit(1), "top").withColumn("one", F.lit(1))
    seeded = blocks.withColumn("block", F.monotonically_increasing_id()).withColumn("one", F.lit(1)).join(F.broadcast(top), "one").drop("one")
    seeds = shelf.put(seeded.mapInPandas(_seed(k), f"{_PACKED}, block long, bound binary, need double"), "seeds")
    tall = max(1, -(-(-(-m // BLOCK)) // CELL))
    # Partitions of buckets are ranges of length; some that follow each other make a group.
    wide, slots = max(1, 4 * spark.sparkContext.defaultParallelism // tall), parts(n, BUCKET)
    placed = buckets.select("n", "dims", "longest", "ids", "named", "keys", "vectors", F.floor(F.col("slot") * min(wide, slots) / slots).alias("g"))
    # A row for each group: at most four for each core.
    reach = F.array(*[F.struct(F.lit(r.g).alias("g"), F.lit(r.longest).alias("longest")) for r in placed.groupBy("g").agg(F.max("longest").alias("longest")).collect()] or [F.struct(F.lit(0).cast("long").alias("g"), F.lit(0.0).alias("longest"))])
    left = seeds.withColumn("h", F.pmod(F.xxhash64("block"), F.lit(tall))).withColumn("g", F.explode(F.transform(F.filter(reach, lambda x: x["longest"] * (1 + SLACK) >= F.col("need")), lambda x: x["g"]))).drop("need")
    right = named(placed, "b").withColumn("g", F.col("b_g")).drop("b_g").withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tall - 1).cast("long"))))
    met = right.hint("merge").join(left, ["g", "h"]).drop("g", "h")
    found = met.mapInPandas(_search(k), "query_id long, query_key long, vec_named boolean, vec_id long, vec_key long, score long")
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), F.desc("vec_named"), "vec_id", "vec_key")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_named"), F.col("vec_id")).alias("vec_id"), "score")
