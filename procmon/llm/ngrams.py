"""Hashed character n-grams, a bounded labelled sample, and a follow-the-regularised-leader learner."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xD6E8FEB86659FD93)


def short_batches(spark: SparkSession) -> None:
    """Python workers get few rows at a time, so that long texts do not add up in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


def hashed(texts: list[str], sizes: range, bits: int) -> Iterator[np.ndarray]:
    """For each text the hashes, in [0, 2**bits), of its n-grams of all sizes; repeats included.

    Texts are lower-cased and framed by a blank on both sides. An empty text has no n-grams.
    """
    framed = [f" {t.lower()} " if t else "" for t in texts]
    points = np.frombuffer("".join(framed).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in framed])
    grams, rolled = {}, np.zeros(len(points), np.uint64)
    for n in range(1, max(sizes) + 1):
        # rolled[i] covers points[i : i + n]; positions near the end of all texts are cut below.
        rolled = (rolled[: len(points) - n + 1] + points[n - 1 :]) * _STEP if len(points) >= n else rolled[:0]
        if n in sizes:
            grams[n] = ((rolled ^ (rolled >> np.uint64(29))) * _LAST >> np.uint64(64 - bits)).astype(np.int32)
    start = 0
    for end in ends:
        yield np.concatenate([g[start : max(start, end - n + 1)] for n, g in grams.items()])
        start = end


def slices(texts: list[str], limit: int = 1 << 19) -> Iterator[list[str]]:
    """The texts in lists of about `limit` characters; a longer text comes alone."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int) -> DataFrame:
    """About `per_label` rows of each label, or all where there are fewer, chosen by the hash of the key."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows
    rate = F.coalesce(*[F.when(F.col(label) == F.lit(k), F.lit(min(1.0, per_label / n))) for k, n in counts.items()])
    return rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < rate * float(1 << 30))


class Ftrl:
    """Multinomial logistic regression by FTRL-Proximal, with L1 and L2 penalties on each weight."""

    def __init__(self, features: int, classes: int, rate: float, beta: float = 1.0, l1: float = 0.0, l2: float = 0.0):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.rate + self.l2)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        """One example; the last feature is the intercept and always 1."""
        rows, values = np.append(rows, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(rows)
        p = softmax(values @ w)
        p[label] -= 1.0
        g = values[:, None] * p[None, :]
        seen = self.n[rows]
        self.z[rows] += g - (np.sqrt(seen + g * g) - np.sqrt(seen)) / self.rate * w
        self.n[rows] = seen + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
