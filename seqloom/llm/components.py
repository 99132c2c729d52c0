"""Connected components of an edge table, as label propagation with pointer jumping.

Everything stays distributed; each round is written to the shared folder. The
number of rounds is logarithmic in the diameter, because each round also halves
the depth of the label trees. A component of any size is fine: labels are joined
on the node, and only the far side of a pointer can be a hot key, which Spark's
skew join splits. Edge tables that were counted and have few rows skip the rounds:
one task holds a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Shelf


#: Edges, of 16 bytes each, that one task may hold.
FEW = 1_000_000


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels of all edges of the iterator, by halving paths to the least node."""
    edges = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype=np.int64), *batches])
    nodes, at = np.unique(edges[["a", "b"]].to_numpy(np.int64).ravel(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    yield pd.DataFrame({"node": nodes, "label": nodes[root]})


def components(edges: DataFrame, shelf: Shelf, name: str, few: int = FEW) -> DataFrame:
    """node, label for each end of edges (a, b): label is the least node of its component. Null ends are left out."""
    pairs = edges.select("a", "b").filter("a != b")
    if pairs.count() <= few:
        return shelf.put(pairs.repartition(1).mapInPandas(_together, "node long, label long"), name)
    both = shelf.put(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = shelf.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        seen = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        least = labels.union(seen).groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("higher"))
        jumped = least.join(up, F.col("label") == F.col("at"), "left").select("node", F.coalesce(F.least("label", "higher"), "label").alias("label"))
        after = shelf.put(jumped, f"{name}-{step}")
        changed = after.join(labels.withColumnRenamed("label", "was"), "node").filter("label != was").limit(1).count()
        shelf.drop(f"{name}-{step - 1}")
        labels = after
        if not changed:
            return labels
