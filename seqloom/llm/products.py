"""Exact inner products of vectors of whole numbers that are held as doubles, at the least cost that is safe."""

from __future__ import annotations

import numpy as np

#: Results are longs; what lies beyond is given as the nearest one.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _whole(x: np.ndarray) -> np.ndarray:
    """As Python integers, of any size."""
    return np.frompyfunc(int, 1, 1)(x)


def _reach(x: np.ndarray) -> float:
    """No less than any row's length."""
    return float(np.sqrt((x * x).sum(axis=1).max(initial=0.0))) * (1 + 1e-12)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T as longs. No sum in it is beyond the product of two lengths, so that says how wide the arithmetic must be."""
    with np.errstate(over="ignore"):
        reach = _reach(a) * _reach(b)
    if reach < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if reach < 1 << 63 and max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return np.clip(_whole(a) @ _whole(b).T, LEAST, MOST).astype(np.int64)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths that do not overflow."""
    top = np.abs(x).max(axis=1, initial=0.0)
    unit = x / np.where(top > 0, top, 1.0)[:, None]
    return top * np.sqrt((unit * unit).sum(axis=1))
