"""Effects of every substitution of a sequence on its best motif score: exact, and to first order at the best site."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.motif import Motif, scan_flat
from ..functions.sequence import BASES


def effects_of(sequence: str, motif: Motif) -> tuple[np.ndarray, np.ndarray]:
    """Exact and first-order effects, length x 4; nothing for sequences shorter than the motif."""
    _, _, exact, first = next(_grouped([sequence], motif))
    return exact[0], first[0]


def _grouped(texts: list[str], motif: Motif) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Which of the texts have one length, their letters as numbers (-1 for others than bases), and the effects of their substitutions, text x length x 4."""
    sizes = np.array([len(x) for x in texts], np.int64)
    letters = np.full(256, -1)
    letters[[ord(b) for b in BASES]] = np.arange(4)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        same = [texts[i] for i in rows]
        codes = letters[np.frombuffer("".join(same).encode("latin-1", "replace"), np.uint8)].reshape(len(rows), n)
        scores, _, counts = scan_flat(same, motif)
        yield rows, codes, *_effects(codes, scores.reshape(len(rows), counts[0]), motif)


def _effects(codes: np.ndarray, scores: np.ndarray, motif: Motif) -> tuple[np.ndarray, np.ndarray]:
    """Exact and first-order effects of texts of one length."""
    table, width = np.array(motif.log_odds()), len(motif)
    m, n = codes.shape
    first = np.zeros((m, n, 4))
    if not scores.shape[1]:
        return np.zeros((m, n, 4)), first
    # old[text, p, o]: what position p adds to the window that has it at offset o.
    old = np.where(codes[:, :, None] >= 0, table.T[codes], 0.0)
    place, last = np.arange(n), scores.shape[1] - 1
    exact = np.full((m, n, 4), -np.inf)
    for o in range(width):
        start = place - o
        inside = (start >= 0) & (start <= last)
        np.maximum(exact, np.where(inside, scores[:, start.clip(0, last)] - old[:, :, o], -np.inf)[:, :, None] + table[o], out=exact)
    # Best score of the windows before and behind those that hold a position.
    before, behind = np.maximum.accumulate(scores, axis=1), np.maximum.accumulate(scores[:, ::-1], axis=1)[:, ::-1]
    ahead = np.where(place >= width, before[:, (place - width).clip(0, last)], -np.inf)
    rest = np.maximum(ahead, np.where(place < last, behind[:, (place + 1).clip(0, last)], -np.inf))
    np.maximum(exact, rest[:, :, None], out=exact)
    exact -= scores.max(axis=1)[:, None, None]
    site, text = np.arange(width), np.arange(m)[:, None]
    best = scores.argmax(axis=1)[:, None] + site
    first[text, best] = table - old[text, best, site][:, :, None]
    return exact, first


def substitutions(df: DataFrame, key: str, sequence: str, motif: Motif, size: int = 64) -> DataFrame:
    """key, pos, base, exact, first_order: three rows for each position of each sequence, ``size`` sequences of one length worked out together.

    Sequences are dealt to as many tasks as the session shuffles to, as a scan of a large row group is one task.
    """
    spelled = np.frombuffer(BASES.encode(), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                for rows, codes, exact, first in _grouped([x or "" for x in part.column(1).to_pylist()], motif):
                    at = np.flatnonzero(codes[:, :, None] != np.arange(4))
                    owner, within = np.divmod(at, max(4 * codes.shape[1], 1))
                    # A letter a row: the ends of the letters are the numbers of the rows.
                    base = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.arange(len(at) + 1, dtype=np.int32)), pa.py_buffer(spelled[within & 3].tobytes()))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[owner])), pa.array(within >> 2), base, pa.array(exact.ravel()[at]), pa.array(first.ravel()[at])], names=[key, "pos", "base", "exact", "first_order"])

    return _dealt(df, key, sequence).mapInArrow(run, f"{key} long, pos long, base string, exact double, first_order double")


def _dealt(df: DataFrame, key: str, sequence: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(key), sequence).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _ranks(x: np.ndarray) -> np.ndarray:
    """Of each row's values, from 1; equal ones share the mean of their places."""
    m, n = x.shape
    order = np.argsort(x, axis=1)
    inner = np.diff(np.take_along_axis(x, order, 1), axis=1) != 0
    edge = np.ones((m, 1), bool)
    place = np.arange(n)
    low = np.maximum.accumulate(np.where(np.hstack([edge, inner]), place, 0), axis=1)
    high = np.minimum.accumulate(np.where(np.hstack([inner, edge]), place, n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty((m, n))
    np.put_along_axis(out, order, (low + high) / 2 + 1, 1)
    return out


def _agreed(exact: np.ndarray, first: np.ndarray, least: int, flat: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Status, correlation of ranks and agreement of signs for each row of effects, in the order of position and base."""
    n = exact.shape[1]
    x, y = _ranks(exact) - (n + 1) / 2, _ranks(first) - (n + 1) / 2
    spread = np.sqrt((x * x).mean(axis=1)) * np.sqrt((y * y).mean(axis=1))
    status = np.where(n < least, "too few", np.where(exact.std(axis=1) < flat, "constant", np.where(spread < 1e-12, "undefined", "ok")))
    upper = np.argsort(-np.abs(exact), axis=1, kind="stable")[:, : max(1, n // 10)]
    same = (np.sign(np.take_along_axis(exact, upper, 1)) == np.sign(np.take_along_axis(first, upper, 1))).mean(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return status, (x * y).mean(axis=1) / spread, same


def agreements(df: DataFrame, key: str, sequence: str, motif: Motif, least: int = 3, flat: float = 1e-8, size: int = 64) -> DataFrame:
    """``agreement`` of the ``substitutions`` of rows with distinct keys, told where the sequence is: no row for each substitution, no shuffle or sort of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                for rows, codes, exact, first in _grouped([x or "" for x in part.column(1).to_pylist()], motif):
                    other = (codes[:, :, None] != np.arange(4)).reshape(len(rows), -1)
                    kept = other.sum(axis=1)
                    for n in np.unique(kept[kept > 0]):
                        some = np.flatnonzero(kept == n)
                        one = lambda x: x.reshape(len(rows), -1)[some][other[some]].reshape(len(some), n)  # noqa: B023, E731
                        status, spearman, same = _agreed(one(exact), one(first), least, flat)
                        bad = status != "ok"
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[some])), pa.array(status.tolist(), pa.string()), pa.array(spearman, mask=bad), pa.array(same, mask=bad)], names=[key, "status", "spearman", "sign_agreement"])

    return _dealt(df, key, sequence).mapInArrow(run, f"{key} long, status string, spearman double, sign_agreement double")


def agreement(effects: DataFrame, key: str, least: int = 3, flat: float = 1e-8) -> DataFrame:
    """key, status, spearman, sign_agreement: undefined for too few substitutions or effects that do not vary, else tie-aware."""
    rank = lambda c: F.rank().over(Window.partitionBy(key).orderBy(c)) + (F.count("*").over(Window.partitionBy(key, c)) - 1) / 2
    top = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.abs("exact")), "pos", "base"))
    ranked = effects.withColumn("x", rank("exact")).withColumn("y", rank("first_order")).withColumn("top", top)
    n = F.count("*").over(Window.partitionBy(key))
    ranked = ranked.withColumn("upper", F.col("top") <= F.greatest(F.lit(1), F.floor(n * 0.1)))
    same = F.signum("exact") == F.signum("first_order")
    # The correlation is of moments, so that ranks of one value give none instead of an error.
    made = ranked.groupBy(key).agg(
        F.count("*").alias("n"), F.stddev_pop("exact").alias("sd"), F.covar_pop("x", "y").alias("xy"), (F.stddev_pop("x") * F.stddev_pop("y")).alias("spread"),
        F.avg(F.when(F.col("upper"), same.cast("double"))).alias("sign_agreement"),
    )
    status = F.when(F.col("n") < least, "too few").when(F.col("sd") < flat, "constant").when(F.col("spread") < 1e-12, "undefined").otherwise("ok")
    ok = F.col("status") == "ok"
    return made.withColumn("status", status).select(key, "status", F.when(ok, F.col("xy") / F.col("spread")).alias("spearman"), F.when(ok, F.col("sign_agreement")).alias("sign_agreement"))
