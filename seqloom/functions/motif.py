"""Position weight matrices: log odds, scan, best hits."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequence import BASES

#: Two-letter and larger groups of bases and their letters. Fixed values.
IUPAC = {"A": "A", "C": "C", "G": "G", "U": "U", "AG": "R", "CU": "Y", "CG": "S", "AU": "W", "GU": "K", "AC": "M", "CGU": "B", "AGU": "D", "ACU": "H", "ACG": "V", "ACGU": "N"}


@dataclass(frozen=True)
class Motif:
    probabilities: tuple[tuple[float, float, float, float], ...]
    pseudocount: float = 0.25
    background: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)

    def __len__(self) -> int:
        return len(self.probabilities)

    def log_odds(self) -> list[list[float]]:
        return [[math.log2(max(p + self.pseudocount, 1e-12) / (b + self.pseudocount)) for p, b in zip(row, self.background)] for row in self.probabilities]

    def consensus(self) -> str:
        return "".join(BASES[row.index(max(row))] for row in self.probabilities)

    def iupac(self, share: float = 0.6) -> str:
        """At each position the letter of the bases that reach this share of the most probable one."""
        return "".join(IUPAC["".join(sorted(b for p, b in zip(row, BASES) if p >= share * max(row)))] for row in self.probabilities)

    def fingerprint(self, name: str, kind: str = "unknown") -> str:
        return f"{name}:{len(self)}:{self.consensus()}:{kind}"

    def decoys(self, seed: str = "decoys", shuffles: int = 2) -> list[Motif]:
        """Motifs of the same values: the positions in reverse, and all values shuffled."""
        made = [replace(self, probabilities=self.probabilities[::-1])]
        rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=8).digest(), "big"))
        for _ in range(shuffles):
            values = rng.permutation([p for row in self.probabilities for p in row]).reshape(-1, 4)
            made.append(replace(self, probabilities=tuple(tuple(map(float, row)) for row in values)))
        return made

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, b, float(p)) for i, row in enumerate(self.probabilities) for b, p in zip(BASES, row)]
        return spark.createDataFrame(rows, "pos int, base string, p double")


def scan(s: Column, motif: Motif) -> Column:
    """The score at each start; an unknown base scores nothing. One array expression, no exploded rows."""
    odds = F.array(*[F.create_map(*[x for b, v in zip(BASES, row) for x in (F.lit(b), F.lit(v))]) for row in motif.log_odds()])
    width = len(motif)

    def at(i: Column) -> Column:
        terms = [F.coalesce(F.element_at(F.element_at(odds, j + 1), F.substr(s, i + (j + 1), F.lit(1))), F.lit(0.0)) for j in range(width)]
        return sum(terms[1:], terms[0])

    return F.when(F.length(s) >= width, F.transform(F.sequence(F.lit(0), F.length(s) - width), at)).otherwise(F.array().cast("array<double>"))


def scan_scores(sequences: Sequence[str], motif: Motif) -> list[np.ndarray]:
    """The same for a batch, with numpy: sequences are laid end to end, and each gets the scores of its own starts."""
    scores, first, counts = scan_flat(sequences, motif)
    return [scores[i : i + n] for i, n in zip(first, counts)]


@lru_cache
def score_table(motif: Motif) -> np.ndarray:
    """What each letter adds at each position."""
    table = np.zeros((256, len(motif)), order="F")
    for j, row in enumerate(motif.log_odds()):
        for b, v in zip(BASES, row):
            table[ord(b), j] = v
    return table


def scan_flat(sequences: Sequence[str], motif: Motif) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all starts, those of a sequence next to each other; where each sequence's begin, and how many it has."""
    table = score_table(motif)
    data = [s.encode("latin-1", "replace") for s in sequences]
    sizes = np.array([len(x) for x in data], np.int64)
    codes = np.frombuffer(b"".join(data), np.uint8)
    counts = np.maximum(sizes - len(motif) + 1, 0)
    first = np.cumsum(counts) - counts
    # Starts in the joined codes: each sequence's own, without those whose window runs over its end.
    at = np.repeat(np.cumsum(sizes) - sizes - first, counts) + np.arange(counts.sum())
    # Of every place in the joined codes, then of the starts.
    size = max(len(codes) - len(motif) + 1, 0)
    scores = np.zeros(size)
    for j in range(len(motif)):
        scores += table[:, j].take(codes[j : j + size])
    return scores[at], first, counts


def scanned(df: DataFrame, key: str, sequence: str, motif: Motif) -> DataFrame:
    """key, pos, score: a row for each start of each sequence, made in Arrow batches where the sequence is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                scores, first, counts = scan_flat([x or "" for x in part.column(1).to_pylist()], motif)
                pos = np.arange(len(scores)) - np.repeat(first, counts)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(pos), pa.array(scores)], names=[key, "pos", "score"])

    return df.select(F.col(key).cast("long").alias(key), sequence).mapInArrow(run, f"{key} long, pos long, score double")


def with_best(df: DataFrame, key: str, sequence: str, motif: Motif, threshold: float) -> DataFrame:
    """key, best, best_start, over: the best score, where it first stands, and how many starts reach the threshold; nulls and 0 for sequences that are too short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                scores, first, counts = scan_flat([x or "" for x in part.column(1).to_pylist()], motif)
                some = counts > 0
                best, at, over = np.full(len(counts), np.nan), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
                if some.any():
                    owner = np.repeat(np.arange(len(counts)), counts)
                    best[some] = np.maximum.reduceat(scores, first[some])
                    top = np.flatnonzero(scores == best[owner])
                    _, earliest = np.unique(owner[top], return_index=True)
                    at[some] = top[earliest] - first[some]
                    over[some] = np.add.reduceat((scores >= threshold).astype(np.int64), first[some])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, mask=~some), pa.array(at, mask=~some), pa.array(over)], names=[key, "best", "best_start", "over"])

    return df.select(F.col(key).cast("long").alias(key), sequence).mapInArrow(run, f"{key} long, best double, best_start long, over long")


def best_hits(scores: np.ndarray, width: int, threshold: float) -> list[int]:
    """Starts that reach the threshold, best first, none overlapping one taken before; ties to the left."""
    taken: list[int] = []
    for i in np.lexsort((np.arange(len(scores)), -scores)):
        if scores[i] < threshold:
            break
        if all(abs(i - t) >= width for t in taken):
            taken.append(int(i))
    return taken


def with_hits(df: DataFrame, id_column: str, sequence: str, motif: Motif, threshold: float) -> DataFrame:
    """id, max_score, best_start, n_hits for each row, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = scan_scores(batch[sequence].fillna(""), motif)
            yield pd.DataFrame({id_column: batch[id_column], "max_score": [float(x.max()) if len(x) else np.nan for x in rows], "best_start": [int(x.argmax()) if len(x) else -1 for x in rows], "n_hits": [len(best_hits(x, len(motif), threshold)) for x in rows]})

    return df.select(F.col(id_column).cast("long").alias(id_column), sequence).mapInPandas(run, f"{id_column} long, max_score double, best_start long, n_hits long")
