"""Edited control sequences: motif hits shuffled away, and as many edits outside of hits.

A row's edits come from a generator seeded by the row's id, so they do not hang on
partitioning; rows are edited in Arrow batches. Edits are drawn some at a time, and the scores near them are worked out together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.motif import Motif, scan_scores, score_table
from ..functions.sequence import BASES


def _generator(*parts: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest(), "big"))


def _shuffled(sequence: str, start: int, width: int, rng: np.random.Generator) -> str:
    part = list(sequence[start : start + width])
    rng.shuffle(part)
    return sequence[:start] + "".join(part) + sequence[start + width :]


def _about(made: str, start: int, odds: list[dict[str, float]]) -> dict[int, float]:
    """Scores of the starts whose window meets the motif-wide segment at ``start``: no others change when it is edited. Added up in the order of the scan."""
    width = len(odds)
    out = {}
    for i in range(max(0, start - width + 1), min(len(made) - width, start + width - 1) + 1):
        total = 0.0
        for j in range(width):
            total += odds[j].get(made[i + j], 0.0)
        out[i] = total
    return out


def _odds(motif: Motif) -> list[dict[str, float]]:
    return [dict(zip(BASES, row)) for row in motif.log_odds()]


@lru_cache
def _columns(motif: Motif) -> list[np.ndarray]:
    """What each letter, and a place that is none, adds at each position."""
    return [np.append(x, -np.inf) for x in score_table(motif).T]


class _Near:
    """Scores of the starts whose window meets an edited segment, for many edits of one sequence at once, and the rule that they make no hit but those allowed.

    The letters stand between places that no window may hold: these score minus infinity.
    """

    def __init__(self, sequence: str, motif: Motif, threshold: float) -> None:
        self.width, self.threshold, self.columns = len(motif), threshold, _columns(motif)
        edge = np.full(self.width - 1, 256, np.int64)
        self.codes = np.concatenate([edge, np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8), edge])

    def scores(self, starts: list[int], parts: list[str]) -> np.ndarray:
        """Edit x start, the segment's own start in the middle; added up in the order of the scan."""
        width = self.width
        made = self.codes[np.array(starts)[:, None] + np.arange(3 * width - 2)]
        made[:, width - 1 : 2 * width - 1] = np.frombuffer("".join(parts).encode("latin-1", "replace"), np.uint8).reshape(len(parts), width)
        out = np.zeros((len(parts), 2 * width - 1))
        for j, column in enumerate(self.columns):
            out += column.take(made[:, j : j + 2 * width - 1])
        return out

    def clean(self, starts: list[int], after: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Whether all starts that reach the threshold are allowed; ``allowed`` has a place for each start of the sequence."""
        edge = np.zeros(self.width - 1, bool)
        near = np.concatenate([edge, allowed, edge])[np.array(starts)[:, None] + np.arange(2 * self.width - 1)]
        return ~((after >= self.threshold) & ~near).any(axis=1)


def _orders(part: str, n: int, rng: np.random.Generator) -> list[str]:
    """As many shuffles one after the other: ``permuted`` draws for a row as ``shuffle`` does for a list."""
    letters = np.frombuffer(part.encode("utf-32-le"), np.uint32)
    made = rng.permuted(np.tile(letters, (n, 1)), axis=1).tobytes().decode("utf-32-le")
    return [made[i : i + len(part)] for i in range(0, len(made), len(part))]


def order_controls(key: object, sequence: str, motif: Motif, threshold: float, most: int = 20, scores: np.ndarray | None = None) -> list[str]:
    """The best hit's bases in other orders: same composition, a lower score, and no hit that was not there. ``scores``: of the sequence, where known."""
    scores = scan_scores([sequence], motif)[0] if scores is None else scores
    if not len(scores) or scores.max() < threshold:
        return []
    # Of equal scores the first.
    start, width = int(scores.argmax()), len(motif)
    rng, out, near = _generator(key, "order"), [], _Near(sequence, motif, threshold)
    allowed = scores >= threshold
    allowed[start] = False
    # Once every distinct order was drawn, no further draw can add one.
    part = sequence[start : start + width]
    orders, seen, left = math.factorial(width) // math.prod(math.factorial(part.count(b)) for b in set(part)), {part}, max(200 * most, 2000)
    some = 4 * orders if orders <= 2 * most else 2 * most
    while left > 0 and len(out) < most and len(seen) < orders:
        # Distinct ones that were not drawn before, in the order of the draws.
        fresh = list(dict.fromkeys(x for x in _orders(part, min(left, some), rng) if x not in seen))
        # Twice as many the next time: with many orders of which few will do, nearly all get drawn.
        left, some = left - some, 2 * some
        if fresh:
            at = [start] * len(fresh)
            after = near.scores(at, fresh)
            good = (after[:, width - 1] < scores[start]) & near.clean(at, after, allowed)
            out += [sequence[:start] + x + sequence[start + width :] for x, ok in zip(fresh, good) if ok]
            seen.update(fresh)
    return out[:most]


def outside_controls(key: object, sequence: str, motif: Motif, threshold: float, most: int = 20, scores: np.ndarray | None = None) -> list[str]:
    """Segments as wide as the motif, clear of all hits, in other orders, that make no hit."""
    return [made for _, made in outside_edits(key, sequence, motif, threshold, most, scores)]


def outside_edits(key: object, sequence: str, motif: Motif, threshold: float, most: int = 20, scores: np.ndarray | None = None) -> list[tuple[int, str]]:
    """The controls of ``outside_controls``, each with the start of its segment."""
    scores = scan_scores([sequence], motif)[0] if scores is None else scores
    width = len(motif)
    held = scores >= threshold
    hits = np.flatnonzero(held)
    if not len(hits):
        return []
    free = np.ones(len(held), bool)
    for h in hits.tolist():
        free[max(0, h - width + 1) : h + width] = False
    clear = np.flatnonzero(free).tolist()
    rng, out, seen, near = _generator(key, "outside"), [], {sequence}, _Near(sequence, motif, threshold)
    left = max(200 * most, 2000) if clear else 0
    while left > 0 and len(out) < most:
        starts, parts = [], []
        n = min(left, most - len(out) + 4)
        for _ in range(n):
            starts.append(clear[int(rng.integers(0, len(clear)))])
            segment = list(sequence[starts[-1] : starts[-1] + width])
            rng.shuffle(segment)
            parts.append("".join(segment))
        left -= n
        for start, part, ok in zip(starts, parts, near.clean(starts, near.scores(starts, parts), held)):
            made = sequence[:start] + part + sequence[start + width :]
            if ok and made not in seen:
                out.append((start, made))
                seen.add(made)
    return out[:most]


def control_panel(df: DataFrame, motif: Motif, threshold: float, most: int = 20, least: int = 5, kinds: tuple[str, ...] = ("order", "outside")) -> DataFrame:
    """doc_id, kind, edit, sequence, informative: controls of the kinds of each row; rows with too few say why.

    Rows are dealt to as many tasks as the session shuffles to, as a scan of a large row group is one task.
    """
    make_of = {"order": order_controls, "outside": outside_controls}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                owner, kind_, edit, made_, enough, reason = [], [], [], [], [], []
                for i, (key, sequence, scores) in enumerate(zip(part.column(0).to_pylist(), texts, scan_scores(texts, motif))):
                    for kind in kinds:
                        made = make_of[kind](key, sequence, motif, threshold, most, scores)
                        n, good = len(made) or 1, len(made) >= least
                        owner += [i] * n
                        kind_ += [kind] * n
                        edit += range(n) if made else [-1]
                        made_ += made or [None]
                        enough += [bool(made) and good] * n
                        reason += [(None if good else f"fewer than {least} controls") if made else "no control"] * n
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(kind_, pa.string()), pa.array(edit, pa.int32()), pa.array(made_, pa.string()), pa.array(enough, pa.bool_()), pa.array(reason, pa.string())], names=["doc_id", "kind", "edit", "sequence", "informative", "exclusion_reason"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select("doc_id", "seq").repartition(parts, "doc_id").mapInArrow(run, "doc_id long, kind string, edit int, sequence string, informative boolean, exclusion_reason string")
