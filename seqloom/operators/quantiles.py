"""Exact quantiles of values that are made from rows in batches, without a row for each value and without a sort.

Each pass is one scan. Tasks count their values by cells of a grid between two bounds and send the counts; the
cells that hold the wanted order statistics become the grids of the next pass. Once a cell holds few enough values, its
distinct values are counted themselves, which ends the search. Counts add up in any order, so
results are exact. The driver holds the grid's counts and at most ``few`` values for each wanted place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS, FEW = 4096, 10_000

Values = Callable[[pa.RecordBatch], np.ndarray]


def _edges(low: float, high: float, cells: int) -> np.ndarray:
    """Bounds of the cells (the last one takes ``high``); fewer where doubles do not tell them apart."""
    return np.unique(low + (high - low) * (np.arange(cells + 1) / cells))


#: Rows whose values are made at once.
ROWS = 512


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _cells_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each value: the last edge that is not above it. Reckoned, then set right by the edges themselves."""
    last = max(len(edges) - 2, 0)
    if len(edges) < 2:
        return np.zeros(len(x), np.int64)
    at = np.clip((x - edges[0]) * (last + 1) / (edges[-1] - edges[0]), 0, last).astype(np.int64)
    at -= (x < edges.take(at)) & (at > 0)
    at += (x >= edges.take(at + 1)) & (at < last)
    off = (x < edges.take(at)) | ((x >= edges.take(at + 1)) & (at < last))
    # Edges that doubles hardly tell apart are not evenly spaced.
    if off.any():
        at[off] = np.clip(np.searchsorted(edges, x[off], side="right") - 1, 0, last)
    return at


def _extent(values: Values):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = math.inf, -math.inf, 0
        for batch in _slices(batches):
            x = values(batch)
            if len(x):
                low, high, n = min(low, float(x.min())), max(high, float(x.max())), n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"low": [low], "high": [high], "n": [n]})

    return run


def _counted(values: Values, grids: list[tuple[float, float, bool]], cells: int):
    """grid, cell (or value), n of the values within each grid; the last field says whether the values themselves are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [None if distinct else _edges(low, high, cells) for low, high, distinct in grids]
        totals = [None if e is None else np.zeros(max(len(e) - 1, 1), np.int64) for e in edges]
        sums: dict[tuple[int, float], int] = {}
        for batch in _slices(batches):
            x = values(batch)
            for g, (low, high, _) in enumerate(grids):
                inside = x[(x >= low) & (x <= high)]
                if edges[g] is not None:
                    totals[g] += np.bincount(_cells_of(inside, edges[g]), minlength=len(totals[g]))
                    continue
                for v, n in zip(*(c.tolist() for c in np.unique(inside, return_counts=True))):
                    sums[g, v] = sums.get((g, v), 0) + n
        for g, total in enumerate(totals):
            if total is not None:
                sums |= {(g, float(c)): int(total[c]) for c in np.flatnonzero(total)}
        if sums:
            yield pa.RecordBatch.from_pydict({"grid": [g for g, _ in sums], "cell": [v for _, v in sums], "n": list(sums.values())})

    return run


def order_statistics(df: DataFrame, values: Values, places: list[int], extent: tuple[float, float], cells: int = CELLS, few: int = FEW) -> dict[int, float]:
    """The values at these places (from 0) in rising order. ``extent`` is the least and the greatest value."""
    found: dict[int, float] = {}
    # Places still sought: the grid that holds them, and how many values lie below it.
    todo = {p: (*extent, 0, False) for p in places}
    while todo:
        grids = sorted({(low, high, distinct) for low, high, _, distinct in todo.values()})
        counted = df.mapInArrow(_counted(values, grids, cells), "grid long, cell double, n long").groupBy("grid", "cell").agg(F.sum("n").alias("n")).toPandas().sort_values(["grid", "cell"])
        after = {}
        for p, (low, high, below, distinct) in todo.items():
            own = counted[counted["grid"] == grids.index((low, high, distinct))]
            upto = below + own["n"].cumsum().to_numpy()
            at = int(np.searchsorted(upto, p, side="right"))
            cell, n = float(own["cell"].iloc[at]), int(own["n"].iloc[at])
            if distinct:
                found[p] = cell
                continue
            edges = _edges(low, high, cells)
            a, b = (edges[int(cell)], edges[min(int(cell) + 1, len(edges) - 1)])
            # The next cell's first value is not this one's.
            b = b if b == high else np.nextafter(b, -math.inf)
            after[p] = (float(a), float(b), int(upto[at]) - n, n <= few or len(_edges(a, b, cells)) <= 2)
        todo = after
    return found


def quantiles(df: DataFrame, values: Values, shares: list[float], bounds: tuple[float, float] | None = None, cells: int = CELLS, few: int = FEW) -> tuple[list[float | None], int]:
    """The quantiles, between two values in proportion, and the number of values. ``bounds`` spares a pass; values must lie within."""
    row = df.mapInArrow(_extent(values), "low double, high double, n long").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).first()
    n = row["n"] or 0
    if not n:
        return [None] * len(shares), 0
    at = [(n - 1) * q for q in shares]
    places = sorted({p for x in at for p in (math.floor(x), math.ceil(x))})
    found = order_statistics(df, values, places, bounds or (row["low"], row["high"]), cells, few)
    return [found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)]) for x in at], n
