"""Tall-skinny QR: each task reduces its rows to a triangular factor, and factors merge in a tree.

A part stands for rows that were seen: how many, their mean, and a factor r with r'r equal to the sum of squares and products
about that mean. Parts merge by stacking their factors with the weighted shifts of their means; the factor of the stack is the
merged one. Nothing is ever squared, so small singular values keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.functions.columns import col

# Numbers a Python task holds for all its keys before it hands its parts on.
HELD_NUMBERS = 4_000_000
# Ways the factors of one key are dealt in the first merge.
FAN = 32

PART_FIELDS = "n long, bad long, mean array<double>, r array<double>"


@dataclass
class Part:
    """`n` good rows, `bad` rows with a missing or non-finite value (left out of mean and factor)."""

    n: int
    bad: int
    mean: np.ndarray
    r: np.ndarray

    @classmethod
    def of_rows(cls, x: np.ndarray) -> Part:
        good = np.isfinite(x).all(axis=1)
        kept = x[good]
        if not len(kept):
            return cls(0, len(x), np.zeros(x.shape[1]), np.zeros((0, x.shape[1])))
        mean = kept.mean(axis=0)
        return cls(len(kept), len(x) - len(kept), mean, kept - mean)

    @property
    def scale(self) -> np.ndarray:
        """Population deviations."""
        return np.sqrt((self.r**2).sum(axis=0) / max(self.n, 1))


def merged(parts: Sequence[Part]) -> Part:
    n, bad = sum(p.n for p in parts), sum(p.bad for p in parts)
    if n == 0:
        return Part(0, bad, parts[0].mean, parts[0].r[:0])
    seen = [p for p in parts if p.n]
    # Means are averaged about the first one, so that equal means stay as they are.
    first = seen[0].mean
    mean = first + sum((p.mean - first) * (p.n / n) for p in seen)
    shifts = np.array([np.sqrt(p.n) * (p.mean - mean) for p in seen])
    stack = np.vstack([*[p.r for p in seen], shifts])
    r = np.linalg.qr(stack, mode="r") if len(stack) > stack.shape[1] else stack
    return Part(n, bad, mean, r)


class _Held:
    """Parts of one key, merged once their rows outnumber a few factors."""

    def __init__(self, p: int):
        self.parts, self.rows, self.limit = [], 0, max(4 * p, 256)

    def add(self, part: Part) -> None:
        self.parts.append(part)
        self.rows += len(part.r) + 1
        if self.rows > self.limit:
            self.merge()

    def merge(self) -> Part:
        whole = merged(self.parts)
        self.parts, self.rows = [whole], len(whole.r) + 1
        return whole


def _frame(found: list[tuple[tuple, Part]], names: Sequence[str]) -> pd.DataFrame:
    rows = [(*key, p.n, p.bad, p.mean.tolist(), p.r.ravel().tolist()) for key, p in found]
    return pd.DataFrame(rows, columns=[*names, "n", "bad", "mean", "r"])


def _key(values: tuple) -> tuple:
    return tuple(None if pd.isna(v) else v for v in values)


def part_of(row, p: int) -> Part:
    """The part in a row of `factors`."""
    return Part(int(row.n), int(row.bad), np.asarray(row.mean, float), np.asarray(row.r, float).reshape(-1, p))


def factors(rows: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One part per key (one for all rows without keys; none for an empty input), in one reading of the input.

    Each task streams its rows and holds one small part per key; what it hands on is dealt FAN ways, merged, and merged again per
    key. Both merges read rows sorted by key and hold one part, so neither many keys nor one dominant key fill a task.
    """
    p = len(features)
    names, inputs = [f"k{i}" for i in range(len(keys))], [f"f{i}" for i in range(p)]
    rows = rows.select(
        *[col(k).alias(n) for k, n in zip(keys, names)], *[col(f).cast("double").alias(n) for f, n in zip(features, inputs)]
    )

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, _Held] = {}
        for batch in batches:
            groups = batch.groupby(names, sort=False, dropna=False) if names else [((), batch)]
            for key, group in groups:
                part = Part.of_rows(group[inputs].to_numpy(dtype=float))
                held.setdefault(_key(key), _Held(p)).add(part)
            if sum(h.rows for h in held.values()) * p > HELD_NUMBERS:
                ready = [(key, h.merge()) for key, h in held.items()]
                if sum(h.rows for h in held.values()) * p > HELD_NUMBERS // 2:
                    yield _frame(ready, names)
                    held = {}
        if held:
            yield _frame([(key, h.merge()) for key, h in held.items()], names)

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                key = _key(tuple(row[: len(names)]))
                if key != now:
                    if held:
                        done.append((now, held.merge()))
                    now, held = key, _Held(p)
                held.add(part_of(row, p))
            if done:
                yield _frame(done, names)
        if held:
            yield _frame([(now, held.merge())], names)

    schema = T.StructType([rows.schema[n] for n in names] + T._parse_datatype_string(PART_FIELDS).fields)
    parts = rows.mapInPandas(reduced, schema)
    deal = F.pmod(F.spark_partition_id(), F.lit(FAN)).alias("_salt")
    parts = parts.select("*", deal)
    parts = parts.repartition(*names, "_salt").drop("_salt")
    parts = (parts.sortWithinPartitions(*names) if names else parts).mapInPandas(gathered, schema)
    parts = parts.repartition(*names).sortWithinPartitions(*names) if names else parts.repartition(1)
    parts = parts.mapInPandas(gathered, schema)
    return parts.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n", "bad", "mean", "r")
