"""A small convolutional network over RNA, forward and backward in numpy over Arrow batches; training is not part of it.

Three dilated convolutions with GELU, mean and maximum over the positions side by side, and two linear layers give one
logit a sequence. Weights are arrays, handed to the tasks as a broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES

#: Channels in, channels out, kernel, dilation of each convolution; width of the hidden layer. Fixed values.
LAYERS = ((4, 32, 11, 1), (32, 32, 5, 2), (32, 32, 5, 4))
HIDDEN = 32
FEW = 4
#: The error function from 0 to 6 at steps of 2**-10, with its slope; cubics about the nearest step are within 2e-14 of it.
_STEP = 2.0**-10
_GRID = np.arange(6 * 1024 + 2) * _STEP
_VALUE = np.array([math.erf(x) for x in _GRID])
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-_GRID * _GRID)


_CODE = np.full(256, -1, np.int64)
_CODE[[ord(b) for b in BASES]] = np.arange(len(BASES))


def one_hot(sequences: list[str]) -> np.ndarray:
    """Sequences of one length as sequences x 4 x letters. Other letters than A, C, G, U are an error."""
    if len({len(s) for s in sequences}) > 1:
        raise ValueError("sequences of several lengths")
    codes = _CODE[np.frombuffer("".join(sequences).encode("latin-1", "replace"), np.uint8)].reshape(len(sequences), len(sequences[0]) if sequences else 0)
    if (codes < 0).any():
        raise ValueError("a letter that is not A, C, G or U")
    return (codes[:, None, :] == np.arange(4)[None, :, None]).astype(np.float64)


def erf(x: np.ndarray) -> np.ndarray:
    size = np.minimum(np.abs(x), 6.0)
    at = (size * (1 / _STEP) + 0.5).astype(np.int32)
    near = at * _STEP
    t = size - near
    # The series about the nearest point of the grid, to the third power.
    made = t * (1 + t * (t * ((2 * near * near - 1) / 3) - near))
    made *= _SLOPE.take(at)
    made += _VALUE.take(at)
    return np.copysign(made, x)


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def _gelu_slope(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(x / math.sqrt(2))) + x * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)


@dataclass(frozen=True)
class Network:
    """Kernels (out x in x width) and biases of the convolutions, then weights and biases of the linear layers."""

    kernels: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    dilations: tuple[int, ...]
    head: np.ndarray
    head_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @classmethod
    def drawn(cls, seed: int, layers=LAYERS, hidden: int = HIDDEN) -> Network:
        """Uniform weights within one over the root of the inputs."""
        rng = np.random.default_rng(seed)
        uniform = lambda shape, fan: rng.uniform(-1, 1, shape) / math.sqrt(fan)
        last = layers[-1][1]
        return cls(
            tuple(uniform((o, i, k), i * k) for i, o, k, _ in layers), tuple(uniform(o, i * k) for i, o, k, _ in layers), tuple(d for *_, d in layers),
            uniform((hidden, 2 * last), 2 * last), uniform(hidden, 2 * last), uniform(hidden, hidden), float(uniform((), hidden)),
        )

    @property
    def parameters(self) -> int:
        return sum(x.size for x in (*self.kernels, *self.biases, self.head, self.head_bias, self.out)) + 1

    @property
    def reach(self) -> int:
        """Letters that one position of the last convolution sees."""
        return 1 + sum((k.shape[2] - 1) * d for k, d in zip(self.kernels, self.dilations))

    def _convolved(self, x: np.ndarray, i: int) -> np.ndarray:
        kernel, dilation = self.kernels[i], self.dilations[i]
        width, n = kernel.shape[2], x.shape[2]
        pad = (width - 1) * dilation // 2
        padded = np.pad(x, ((0, 0), (0, 0), (pad, (width - 1) * dilation - pad)))
        # All that a position sees, side by side: one product for each sequence.
        seen = np.empty((len(x), width, x.shape[1], n))
        for j in range(width):
            seen[:, j] = padded[:, :, j * dilation : j * dilation + n]
        made = kernel.transpose(0, 2, 1).reshape(len(kernel), -1) @ seen.reshape(len(x), -1, n)
        made += self.biases[i][None, :, None]
        return made

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        before = []
        for i in range(len(self.kernels)):
            before.append(self._convolved(x, i))
            x = gelu(before[-1])
        pooled = np.concatenate([x.mean(axis=2), x.max(axis=2)], axis=1)
        hidden = pooled @ self.head.T + self.head_bias
        return gelu(hidden) @ self.out + self.out_bias, before, x, hidden

    def logits(self, x: np.ndarray) -> np.ndarray:
        # Few sequences at once, so that what lies between the layers stays in the processor's cache.
        return np.concatenate([np.zeros(0), *[self._forward(x[i : i + FEW])[0] for i in range(0, len(x), FEW)]])

    def gradients(self, x: np.ndarray) -> np.ndarray:
        """Of each logit by its own input."""
        _, before, last, hidden = self._forward(x)
        n = last.shape[2]
        pooled = (self.out * _gelu_slope(hidden)) @ self.head
        mean, top = np.split(pooled, 2, axis=1)
        grad = np.repeat(mean[:, :, None] / n, n, axis=2)
        np.put_along_axis(grad, (at := last.argmax(axis=2)[:, :, None]), np.take_along_axis(grad, at, 2) + top[:, :, None], 2)
        for i in reversed(range(len(self.kernels))):
            grad = grad * _gelu_slope(before[i])
            kernel, dilation = self.kernels[i], self.dilations[i]
            width = kernel.shape[2]
            pad = (width - 1) * dilation // 2
            wide = np.zeros((len(grad), kernel.shape[1], n + (width - 1) * dilation))
            for j in range(width):
                wide[:, :, j * dilation : j * dilation + n] += kernel[:, :, j].T @ grad
            grad = wide[:, :, pad : pad + n]
        return grad

    def effects(self, sequence: str, batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Of every base at every position (letters x 4): the exact change of the logit, and that to first order."""
        x = one_hot([sequence])
        n = x.shape[2]
        exact, own = np.zeros((n, 4)), x[0].argmax(axis=0)
        base = self.logits(x)[0]
        changes = [(p, b) for p in range(n) for b in range(4) if b != own[p]]
        for start in range(0, len(changes), batch):
            part = changes[start : start + batch]
            made = np.repeat(x, len(part), axis=0)
            for i, (p, b) in enumerate(part):
                made[i, :, p] = 0
                made[i, b, p] = 1
            exact[tuple(np.array(part).T)] = self.logits(made) - base
        slope = self.gradients(x)[0].T
        return exact, slope - slope[np.arange(n), own][:, None]


def _by_length(texts: list[str]) -> Iterator[np.ndarray]:
    """Places of the texts of each length."""
    sizes = np.array([len(t) for t in texts])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def predicted(df: DataFrame, key: str, sequence: str, network: Network, batch: int = 512) -> DataFrame:
    """key, logit, probability of each sequence; null where it is empty or has other letters. Rows are dealt to as many tasks as the session shuffles to."""
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), batch):
                part = rows.iloc[start : start + batch]
                texts = part[sequence].fillna("").tolist()
                good = np.array([bool(t) and not set(t) - set(BASES) for t in texts], bool)
                logit = np.full(len(part), np.nan)
                for at in _by_length(texts):
                    at = at[good[at]]
                    if len(at):
                        logit[at] = shared.value.logits(one_hot([texts[i] for i in at]))
                made = pd.Series(logit).astype(object).where(np.isfinite(logit), None)
                yield pd.DataFrame({key: part[key].to_numpy(), "logit": made})

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(F.col(key).cast("long").alias(key), sequence).repartition(parts, key)
    out = dealt.mapInPandas(run, f"{key} long, logit double")
    return out.withColumn("probability", 1 / (1 + F.exp(-F.col("logit"))))


def substitutions(df: DataFrame, key: str, sequence: str, network: Network) -> DataFrame:
    """key, pos, base, exact, first_order of every substitution. Sequences that are empty or have other letters give no rows.

    A row takes hundreds of passes, so even few rows are dealt to as many tasks as the session shuffles to.
    """
    shared = df.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k, s in zip(rows[key], rows[sequence].fillna("")):
                if not s or set(s) - set(BASES):
                    continue
                exact, first = shared.value.effects(s)
                pos, base = np.divmod(np.arange(exact.size), 4)
                other = np.array([BASES.find(b) for b in s])[pos] != base
                yield pd.DataFrame({key: k, "pos": pos[other], "base": np.array(list(BASES))[base[other]], "exact": exact.ravel()[other], "first_order": first.ravel()[other]})

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(F.col(key).cast("long").alias(key), sequence).repartition(parts, key)
    return dealt.mapInPandas(run, f"{key} long, pos long, base string, exact double, first_order double")
