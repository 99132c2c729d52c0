"""Quality classification: histogram gradient-boosted trees over document statistics.

Statistics are taken of the whole text in one scan. The trees are fitted on the
driver, on at most ``sample`` labels, those with the least hash of their id, and
where repeated ids make more rows of them, on at most so many distinct rows, those
with the least hash of the row, each with its count; there is no other bound. A fitted forest is a handful of flat arrays of
fixed size, in which all documents of a batch go down all trees together.

Defined cases: null texts score as empty ones; empty texts have statistics of
zero and a score; labels that are null, or name no document, are not learnt
from; documents with repeated labels count once for each; without any label, or
with labels of one kind, the score is the smoothed share of label 1; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import binary, words_of

SAMPLE, REJECT_BELOW = 20_000, 0.7
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 4, 64, 0.15, 8, 1.0
FEATURES = (
    "log_words", "mean_word", "word_spread", "distinct", "top_word", "repeats", "upper", "digits", "other_ascii", "periods",
    "symbols", "pipes", "high_bytes", "log_lines", "same_lines", "mean_line", "ends", "entropy", "long_words", "capital_words",
)
_CLASS = {
    "upper": range(65, 91), "digits": range(48, 58), "periods": (33, 44, 46, 58, 59, 63), "symbols": (35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 126), "pipes": (124,), "high_bytes": range(128, 256),
}
_LETTERS = set(range(65, 91)) | set(range(97, 123)) | set(range(48, 58)) | {32, 10, 33, 44, 46, 58, 59, 63} | set(range(128, 256))
_TABLE = np.array([[i in members for i in range(256)] for members in (*_CLASS.values(), set(range(256)) - _LETTERS)], np.float64)


def statistics(text: bytes | None) -> list[float]:
    """The features of one text. Long texts are counted piece by piece."""
    text = text or b""
    size = len(text)
    counts: Counter[bytes] = Counter()
    total = length = square = repeats = capital = long_ = 0
    last = None
    for words in words_of(text):
        counts.update(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        total += len(words)
        length += int(lengths.sum())
        square += int((lengths * lengths).sum())
        long_ += int((lengths > 14).sum())
        repeats += sum(map(bytes.__eq__, words, words[1:])) + (bool(words) and words[0] == last)
        capital += sum(map(bytes.isupper, (w[:1] for w in words)))
        last = words[-1] if words else last
    histogram = np.zeros(256)
    for start in range(0, size, 1 << 24):
        histogram += np.bincount(np.frombuffer(text, np.uint8, min(1 << 24, size - start), start), minlength=256)
    upper, digits, periods, symbols, pipes, high, other = _TABLE @ histogram / max(size, 1)
    share = histogram[histogram > 0] / max(size, 1)
    lines = text.split(b"\n") if size else []
    mean = length / max(total, 1)
    ends = sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?"))
    return [
        np.log1p(total), mean, max(square / max(total, 1) - mean * mean, 0) ** 0.5, len(counts) / max(total, 1), max(counts.values(), default=0) / max(total, 1), repeats / max(total, 1), upper, digits, other, periods,
        symbols, pipes, high, np.log1p(len(lines)), 1 - len(set(lines)) / max(len(lines), 1), size / max(len(lines), 1), ends / max(len(lines), 1), float(-(share * np.log2(share)).sum()), long_ / max(total, 1), capital / max(total, 1),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in flat arrays: node k of a tree has its children at 2k + 1 and 2k + 2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees, rows = np.arange(len(self.feature))[:, None], np.arange(len(x))[None, :]
        node = np.zeros((len(self.feature), len(x)), np.int64)
        for _ in range(DEPTH if len(self.feature) else 0):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        margin = self.start + (self.leaf[trees, node - inner].sum(axis=0) if len(self.feature) else np.zeros(len(x)))
        return 1 / (1 + np.exp(-margin))


def _quantiles(sorted_: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The lower quantiles of sorted values that each stand for so many."""
    return sorted_[np.searchsorted(counts.cumsum(), np.floor(q * (counts.sum() - 1)), side="right")]


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> Forest:
    """Newton boosting of the logistic loss with histograms of at most ``BINS`` bins; the same rows give the same trees in any order.

    A row with a count ``n`` stands for so many equal rows.
    """
    n = np.ones(len(y)) if n is None else n.astype(np.float64)
    share = ((n * y).sum() + 1) / (n.sum() + 2)
    start = float(np.log(share / (1 - share)))
    inner = 2**DEPTH - 1
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    if n.sum() < 2 * LEAST or y.min() == y.max():
        return none
    order = np.lexsort((*x.T, y))
    x, y, n = x[order], y[order].astype(np.float64), n[order]
    ranks = [np.argsort(x[:, j], kind="stable") for j in range(x.shape[1])]
    edges = [np.unique(_quantiles(x[r, j], n[r], np.linspace(0, 1, BINS + 1)[1:-1])) for j, r in enumerate(ranks)]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    flat = bins + np.arange(x.shape[1]) * BINS
    margin = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = n * (p - y), n * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            if n[rows].sum() < 2 * LEAST:
                node[rows] = 2 * k + 1
                continue
            cells = flat[rows].ravel()
            width = x.shape[1]
            sums = [np.bincount(cells, np.repeat(v, width), width * BINS).reshape(width, BINS).cumsum(axis=1) for v in (g[rows], h[rows], n[rows])]
            gl, hl, nl = sums
            gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAST) | (nt - nl < LEAST)] = -1
            j, b = np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape)
            if gain[j, b] > 1e-6 and b < len(edges[j]):
                feature[k], threshold[k] = j, edges[j][b]
                node[rows] = 2 * k + 1 + (bins[rows, j] > b)
            else:
                node[rows] = 2 * k + 1
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + RIDGE)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(value)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), start)


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of the CRC-32 of the id as text; null ids have none."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(t) for t in binary(batch.column("text"))], np.float64).reshape(-1, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("quality"), *(pa.array(rows[:, j]) for j in range(len(FEATURES)))], names=["quality", *FEATURES])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_fold: int = 2, folds: int = 4) -> Forest:
    """Fits on labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    chosen = known.filter(fold(F.col("doc_id"), folds) != held_fold).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")
    measured = rows.mapInArrow(_measured, "quality int, " + ", ".join(f"{c} double" for c in FEATURES))
    # Repeated ids may make more rows of the chosen labels: equal ones are counted, and the same bound holds for distinct ones, by hash.
    distinct = measured.groupBy(*FEATURES, "quality").agg(F.count("*").alias("n"))
    table = distinct.orderBy(F.xxhash64(*FEATURES, "quality"), *FEATURES, "quality").limit(sample).toArrow()
    x = np.stack([table[c].to_numpy() for c in FEATURES], axis=1).astype(np.float64)
    return fit(x, (table["quality"].to_numpy() == 1).astype(np.int64), table["n"].to_numpy())


def _scored(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in binary(batch.column("text"))], np.float64).reshape(-1, len(FEATURES))
            names = [*(n for n in batch.schema.names if n != "text"), "score"]
            data = [*(batch.column(n) for n in names[:-1]), pa.array(forest.scores(rows) if len(rows) else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(data, names=names)

    return run


def scored(docs: DataFrame, forest: Forest, threshold: float = REJECT_BELOW, held_fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(forest), "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _passing(forest: Forest, threshold: float, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in binary(batch.column(text))], np.float64).reshape(-1, len(FEATURES))
            if len(rows):
                yield batch.filter(pa.array(forest.scores(rows) >= threshold))

    return run


def accepted(docs: DataFrame, forest: Forest, threshold: float = REJECT_BELOW) -> DataFrame:
    """The rows and columns given, of any names, without those that score below the threshold."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = [c.lower() for c in docs.columns].index("text")
    return plain.mapInArrow(_passing(forest, threshold, text), plain.schema).toDF(*docs.columns)
