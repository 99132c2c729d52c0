"""Centroid clustering (k-means in whole numbers) with a vantage-point tree over the centroids.

Each round the driver builds the tree over the centroids (their number is a parameter) and
broadcasts it. A node holds a vantage centroid and, for each of its two children, the least
and greatest distance of the child's centroids from it; so the triangle inequality bounds
from below how near a child's centroids can be to a vector. Each vector opens the node with
the least bound first and ends when that bound is above the best distance found. Bounds are
doubles and are let out by a margin, and equality goes on, so that a node with a tie is
opened; the distances that decide are whole numbers, compared exactly, ties to the smaller
number. A batch of vectors takes its steps together: those that open the same node meet its
vantage centroid in one pass of numpy.

Sums of a round are whole numbers too (decimals of 38 digits in the shuffle, one row for each task,
centroid and component before it), so centroids do not hang on the order of rows.

Scale. A round is one scan and a sum of (centroids x components) rows; the vectors are written once,
as integers. Nothing grows with the data but the scan. A lost executor repeats its tasks.

Defined cases: vectors that are null, of another length than ``dims``, or hold a null or non-finite
component, or one whose whole number is no long, take no part and have no row; repeated rows are vectors of their own; of equal hashes
(repeated or null ids) the one with the smaller components starts; with fewer vectors than centroids there
are as many centroids as vectors; large components are compared exactly too, and a distance
or an inertia beyond a long is null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Shelf
from .products import lengths

K, ROUNDS, DIMS, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Vectors that take their steps together.
BATCH = 8192

@dataclass
class Node:
    """A vantage centroid, and the numbers of both children with the range of their distances from it."""

    number: int
    children: list[tuple[int, float, float]]


class Tree:
    """A vantage-point tree over the rows of ``centroids`` (whole numbers held as doubles)."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.nodes: list[Node] = []
        if len(centroids):
            self._grow(np.arange(len(centroids)))

    def _grow(self, numbers: np.ndarray) -> int:
        """The node of these centroids: the first is the vantage point, the rest are parted at the middle distance."""
        at, node = len(self.nodes), Node(int(numbers[0]), [])
        self.nodes.append(node)
        rest = numbers[1:]
        if len(rest):
            far = lengths(self.centroids[rest] - self.centroids[numbers[0]])
            order = np.argsort(far, kind="stable")
            for part in np.array_split(order, 2):
                if len(part):
                    node.children.append((self._grow(rest[part]), float(far[part].min()), float(far[part].max())))
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each vector and the squared distance, an object array where longs do not hold it."""
        wide = max(np.abs(vectors).max(initial=0), np.abs(self.centroids).max(initial=0)) >= 1 << 27
        if wide:
            whole = np.frompyfunc(int, 1, 1)
            exact_v, exact_c = whole(vectors), whole(self.centroids)
        else:
            exact_v, exact_c = vectors.astype(np.int64), self.centroids.astype(np.int64)
        n = len(vectors)
        best = np.full(n, None, object) if wide else np.full(n, np.iinfo(np.int64).max, np.int64)
        number = np.full(n, len(self.centroids), np.int64)
        reach = np.full(n, np.inf)
        # Bounds of the nodes that each vector has met and not opened; infinite for all others.
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, :1] = 0.0
        live = np.arange(n)
        while len(live):
            turn = bound[live].argmin(axis=1)
            least = bound[live, turn]
            # The margin makes up for the rounding of distances; equality goes on, as a tie may lie there.
            go = np.isfinite(least) & (least <= reach[live] * (1 + 1e-9) + 1e-6)
            live, turn = live[go], turn[go]
            for i in np.unique(turn):
                node, rows = self.nodes[i], live[turn == i]
                bound[rows, i] = np.inf
                gap = exact_v[rows] - exact_c[node.number]
                squared = (gap * gap).sum(axis=1)
                away = lengths(vectors[rows] - self.centroids[node.number])
                held = best[rows]
                if wide:
                    better = np.array([h is None or s < h or (s == h and node.number < c) for s, h, c in zip(squared, held, number[rows])], bool)
                else:
                    better = (squared < held) | ((squared == held) & (node.number < number[rows]))
                best[rows[better]], number[rows[better]] = squared[better], node.number
                reach[rows] = np.minimum(reach[rows], away)
                for child, low, high in node.children:
                    bound[rows, child] = np.maximum(np.maximum(low - away, away - high), 0.0) * (1 - 1e-9)
        return number, best


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(shared, dims: int):
    """cluster, pos, total, n: what the vectors of a task add to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        k = len(tree.centroids)
        total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                vectors = _vectors(batch.column("vector").slice(start, BATCH), dims)
                number, _ = tree.nearest(vectors)
                # So that the sum of a batch is a long.
                whole = np.frompyfunc(int, 1, 1)(vectors) if np.abs(vectors).max(initial=0) >= 1 << 48 else vectors.astype(np.int64)
                for c in np.unique(number):
                    total[c] += whole[number == c].sum(axis=0).astype(object)
                    count[c] += int((number == c).sum())
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_pydict({"cluster": [int(c)] * dims, "pos": list(range(dims)), "total": [str(x) for x in total[c]], "n": [int(count[c])] * dims})

    return run


def _assigned(shared, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: Tree = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                number, squared = tree.nearest(_vectors(part.column("vector"), dims))
                fit = [int(x) if x < 1 << 63 else None for x in squared] if squared.dtype == object else squared
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(fit, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def _floor(total: str, n: int) -> float:
    return float(int(total) // n)


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector that takes part."""
    spark = vectors.sparkSession
    shelf = Shelf(spark, "clusters")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter((F.size("embedding") == dims) & ~odd)
    small = ~F.exists("embedding", lambda x: F.abs(x.cast("double")) >= 2.0**63 / scale)
    held = shelf.put(fit.filter(small).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector")), "vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    # k rows.
    firsts = held.select(hashed.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    centroids = np.array([r.vector for r in firsts], np.float64).reshape(len(firsts), dims)
    for _ in range(rounds if len(firsts) else 0):
        shared = spark.sparkContext.broadcast(Tree(centroids))
        summed = held.mapInArrow(_sums(shared, dims), "cluster long, pos long, total string, n long")
        # A row for each centroid and component.
        after = centroids.copy()
        for r in summed.groupBy("cluster", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"), F.sum("n").alias("n")).collect():
            after[r.cluster, r.pos] = _floor(r.total, r.n)
        shared.unpersist()
        if (after == centroids).all():
            break
        centroids = after
    shared = spark.sparkContext.broadcast(Tree(centroids))
    found = shelf.put(held.mapInArrow(_assigned(shared, dims), "vec_id long, cluster int, distance long"), "assigned")
    wide = lambda x: F.try_sum(x.cast("decimal(38,0)"))
    long = lambda x: F.when(F.abs(x) < F.lit(1 << 62).cast("decimal(38,0)") * 2, x).cast("long")
    # A row for each centroid.
    per = found.groupBy("cluster").agg(wide(F.col("distance")).alias("of"), F.count_if(F.col("distance").isNull()).alias("beyond"))
    every = per.agg(F.try_sum("of").alias("all"), F.sum("beyond").alias("any"))
    digests = spark.createDataFrame([(i, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for i, c in enumerate(centroids)], "number int, centroid_sha256 string")
    named = per.join(F.broadcast(every)).join(F.broadcast(digests), F.col("cluster") == F.col("number"))
    ready = named.select("cluster", F.when(F.col("beyond") == 0, long(F.col("of"))).alias("cluster_inertia"), F.when(F.col("any") == 0, long(F.col("all"))).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(ready), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
