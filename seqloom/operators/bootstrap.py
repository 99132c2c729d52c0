"""Paired cluster bootstrap of average precision: all replicates, conditions and seeds in one pass.

A replicate draws as many components as there are, with replacement. How often it draws each is a
multinomial vector, which is parted along the order of components: of a range's draws, a
binomial number falls in its first half. Each node of these halvings has its own generator, seeded by its
place, which gives the numbers of all replicates at once; so any task can tell the counts of
the components in its rows, by halving down to them, without draws or counts being shuffled. A process makes each once.

Rows of one condition, seed, score, component and label are counted first. These cells are dealt by ranges of
falling score. A first pass sums up each range's positives and rows, weighted by each replicate's
counts (two vectors a range); with the sums of the ranges before as a start, a second pass adds up each range's part of
the average precision, rows of equal score entering together. No row exists for a replicate and a component.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import order
from .lineage import cut

REPLICATES = 2000
#: Cells that meet all replicates at once, as a matrix.
CELLS = 512


def draw_counts(wanted: np.ndarray, n: int, replicates: int, seed: str) -> np.ndarray:
    """How often each replicate draws the components ``wanted`` (distinct ordinals, in order) of n. Rows: components; columns: replicates."""
    out = np.zeros((len(wanted), replicates), np.int32)
    todo = [(0, n, 0, len(wanted), np.full(replicates, n, np.int64))]
    while todo:
        low, high, first, end, draws = todo.pop()
        if first == end:
            continue
        if high - low == 1:
            out[first] = draws
            continue
        middle = (low + high) // 2
        place = hashlib.blake2b(f"{seed}:{n}:{low}:{high}".encode(), digest_size=8).digest()
        left = np.random.Generator(np.random.PCG64(int.from_bytes(place, "big"))).binomial(draws, (middle - low) / (high - low))
        at = first + int(np.searchsorted(wanted[first:end], middle))
        todo += [(low, middle, first, at, left), (middle, high, at, end, draws - left)]
    return out


#: Of one table's draws (components, replicates, seed): the counts made so far, and the steps of components that are.
_HELD: dict[tuple[int, int, str], tuple[np.ndarray, np.ndarray]] = {}
STEP = 256


def held_counts(wanted: np.ndarray, n: int, replicates: int, seed: str) -> np.ndarray:
    """``draw_counts``, each made once in a process: they stay in a file without a name, as bytes, which the system holds in memory as far as it can."""
    key = (n, replicates, seed)
    if key not in _HELD:
        _HELD.clear()
        with tempfile.TemporaryFile() as file:
            _HELD[key] = np.memmap(file, np.uint8, "w+", shape=(n, replicates)), np.zeros(-(-n // STEP), bool)
    counts, ready = _HELD[key]
    for step in np.unique(wanted // STEP):
        if not ready[step]:
            made = draw_counts(np.arange(step * STEP, min(n, (step + 1) * STEP)), n, replicates, seed)
            if made.max() > 255:
                return draw_counts(wanted, n, replicates, seed)
            counts[step * STEP : (step + 1) * STEP] = made
            ready[step] = True
    return np.asarray(counts[wanted])


def _cells(batches: Iterator[pa.RecordBatch], n: int, replicates: int, seed: str, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Group, range, scores, positives and rows (scores x replicates) of consecutive cells of one group."""
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", order.RANGE, "score", "label", "ordinal", "n")]
        for start in range(0, batch.num_rows, size):
            g, range_, score, label, ordinal, count = (c[start : start + size] for c in columns)
            wanted, at = np.unique(ordinal, return_inverse=True)
            counts = held_counts(wanted, n, replicates, seed)
            # Whole numbers below 2**24 add up exactly in four bytes.
            number = np.float32 if int(counts.max()) * int(count.sum()) < 1 << 24 else np.float64
            weights = counts.astype(number)[at]
            first = np.flatnonzero(np.r_[True, (np.diff(g) != 0) | (np.diff(score) != 0)])
            hits, seen = _added(weights, np.where(label == 1, count, 0).astype(number), first), _added(weights, count.astype(number), first)
            for own in np.split(np.arange(len(first)), np.flatnonzero(np.diff(g[first])) + 1):
                yield int(g[first[own[0]]]), int(range_[first[own[0]]]), score[first[own]], hits[own].astype(np.float64), seen[own].astype(np.float64)


def _added(weights: np.ndarray, times: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The rows times their numbers, added up from each first row to the next."""
    if len(first) > 16:
        return np.add.reduceat(weights * times[:, None], first, axis=0)
    terms = np.zeros((len(first), len(times)), times.dtype)
    terms[np.searchsorted(first, np.arange(len(times)), side="right") - 1, np.arange(len(times))] = times
    return terms @ weights


_VECTORS = "g long, range long, a binary, b binary"


def _totals(n: int, replicates: int, seed: str, size: int):
    """What each range adds to the positives and to all rows of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for g, range_, _, hits, seen in _cells(batches, n, replicates, seed, size):
            held = sums.setdefault((g, range_), [np.zeros(replicates), np.zeros(replicates)])
            held[0] += hits.sum(axis=0)
            held[1] += seen.sum(axis=0)
        for (g, range_), (a, b) in sums.items():
            yield pa.RecordBatch.from_pydict({"g": [g], "range": [range_], "a": [a.tobytes()], "b": [b.tobytes()]})

    return run


def _parts(shared, n: int, replicates: int, seed: str, size: int):
    """Each range's part of the sum of positives times precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, int], list] = {}

        def close(held: list) -> None:
            """Rows of the open score have all come."""
            _, hits, seen, new_hits, new_seen, total = held
            hits += new_hits
            seen += new_seen
            total += np.divide(new_hits * hits, seen, out=np.zeros(replicates), where=seen > 0)
            new_hits[:], new_seen[:] = 0, 0

        for g, range_, score, hits, seen in _cells(batches, n, replicates, seed, size):
            if (g, range_) not in state:
                state[g, range_] = [score[0], *(x.copy() for x in shared.value[g, range_]), *(np.zeros(replicates) for _ in range(3))]
            held = state[g, range_]
            for tie in range(len(score)):
                if score[tie] != held[0]:
                    close(held)
                    held[0] = score[tie]
                held[3] += hits[tie]
                held[4] += seen[tie]
        for (g, range_), held in state.items():
            close(held)
            yield pa.RecordBatch.from_pydict({"g": [g], "range": [range_], "a": [held[5].tobytes()], "b": [b""]})

    return run


def replicated_ap(df: DataFrame, by: list[str], component: str = "component", score: str = "score", label: str = "label", replicates: int = REPLICATES, seed: str = "bootstrap", size: int = CELLS) -> DataFrame:
    """by, replicate, ap: average precision of each group of ``by`` in each replicate; null where a replicate has one class only.

    All groups resample the same components: those of the whole table. Rows without a component, score or label are left out.
    """
    spark = df.sparkSession
    rows = df.select(*by, F.col(component).alias("component"), F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label")).dropna(subset=["component", "score", "label"])
    rows = cut(rows.groupBy(*by, "component", "score", "label").agg(F.count("*").alias("n")))
    numbered = cut(order.ordinals(rows.select("component").distinct(), [F.col("component")], "ordinal"))
    n = numbered.count()
    # Conditions and seeds: as many as models were trained.
    groups = cut(rows.select(*by).distinct().withColumn("g", F.monotonically_increasing_id()))
    same = [rows[c].eqNullSafe(groups[c]) for c in by]
    named = rows.join(F.broadcast(groups), same).select("g", "component", "score", "label", "n") if by else rows.withColumn("g", F.lit(0).cast("long"))
    counted = named.join(numbered, "component").drop("component")
    ranked = [F.col("g"), F.desc("score")]
    cells = order.ranges(counted, ranked).sortWithinPartitions(*ranked)
    # Two vectors a range and group that it has: bounded by partitions and groups, whatever the rows.
    totals = cells.mapInArrow(_totals(n, replicates, seed, size), _VECTORS).toPandas().sort_values(["g", "range"])
    before, ends = {}, {}
    for g, part in totals.groupby("g"):
        held = [np.zeros(replicates), np.zeros(replicates)]
        for range_, a, b in zip(part["range"], part["a"], part["b"]):
            before[g, range_] = [x.copy() for x in held]
            held[0] += np.frombuffer(a)
            held[1] += np.frombuffer(b)
        ends[g] = held
    shared = spark.sparkContext.broadcast(before)

    def summed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        hits, seen = ends[key[0]]
        total = sum(np.frombuffer(x) for x in part["a"])
        both = (hits > 0) & (hits < seen)
        ap = np.where(both, total / np.where(both, hits, 1), np.nan)
        return pd.DataFrame({"g": key[0], "replicate": np.arange(replicates, dtype=np.int32), "ap": [x if ok else None for x, ok in zip(ap, both)]})

    made = cells.mapInArrow(_parts(shared, n, replicates, seed, size), _VECTORS).groupBy("g").applyInPandas(summed, "g long, replicate int, ap double")
    return made.join(F.broadcast(groups), "g").select(*by, "replicate", "ap")


def interval(df: DataFrame, value: str, by: list[str], level: float = 0.95) -> DataFrame:
    """by, mean, lo, hi, valid, invalid over replicates."""
    half = (1 - level) / 2
    made = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.array(F.lit(half), F.lit(1 - half))).alias("q"), F.count(value).alias("valid"), F.count_if(F.col(value).isNull()).alias("invalid"))
    return made.select(*by, "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "valid", "invalid")


def paired_ap(df: DataFrame, condition: str, first: object, second: object, seed_column: str, **options) -> DataFrame:
    """seed, replicate, delta: ``second`` minus ``first`` of the condition on the same components; null where either has one class only."""
    ap = replicated_ap(df.filter(F.col(condition).isin(first, second)), [condition, seed_column], **options)
    one = lambda v: F.max(F.when(F.col(condition) == F.lit(v), F.col("ap")))
    return ap.groupBy(F.col(seed_column).alias("seed"), "replicate").agg((one(second) - one(first)).alias("delta"))


def paired_means(df: DataFrame, condition: str, first: object, second: object, seed_column: str, value: str, component: str = "component", replicates: int = REPLICATES, seed: str = "bootstrap") -> DataFrame:
    """replicate, delta: the mean over seeds of the difference of component means, each replicate on the same components.

    A component counts for a seed where it has a value under both conditions; a replicate without any is null. Values of
    a component are summed where their row is: a vector for each seed and task reaches the sum.
    """
    means = df.groupBy(F.col(component).alias("component"), F.col(seed_column).alias("seed")).agg(F.avg(F.when(F.col(condition) == F.lit(first), F.col(value))).alias("x"), F.avg(F.when(F.col(condition) == F.lit(second), F.col(value))).alias("y"))
    numbered = cut(order.ordinals(means.select("component").distinct(), [F.col("component")], "ordinal"))
    n = numbered.count()
    both = means.join(numbered, "component").filter("x IS NOT NULL AND y IS NOT NULL").select(F.col("seed").cast("string").alias("seed"), "ordinal", (F.col("y") - F.col("x")).alias("gap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, CELLS):
                part = batch.slice(start, CELLS)
                wanted, at = np.unique(part.column("ordinal").to_numpy(), return_inverse=True)
                counts, seeds = held_counts(wanted, n, replicates, seed)[at].astype(np.float64), np.array(part.column("seed").to_pylist(), object)
                gaps = part.column("gap").to_numpy()
                for s in set(seeds):
                    held, own = sums.setdefault(s, [np.zeros(replicates), np.zeros(replicates)]), seeds == s
                    held[0] += gaps[own] @ counts[own]
                    held[1] += counts[own].sum(axis=0)
        for s, (a, b) in sums.items():
            yield pa.RecordBatch.from_pydict({"seed": pa.array([s] * replicates, pa.string()), "replicate": pa.array(range(replicates), pa.int32()), "total": a, "n": b})

    parts = both.mapInArrow(run, "seed string, replicate int, total double, n double")
    per_seed = parts.groupBy("seed", "replicate").agg((F.try_divide(F.sum("total"), F.sum("n"))).alias("delta"))
    every = df.sparkSession.range(replicates).select(F.col("id").cast("int").alias("replicate"))
    return every.join(per_seed.groupBy("replicate").agg(F.avg("delta").alias("delta")), "replicate", "left")
