"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts meet their labels compressed, in one merge join whose result is written to the shared folder. Features are hashed n-grams of SIZES
characters. Over all labelled rows, the toxic training texts that hold each feature are counted; of those in at least LEAST of them, the clean ones
too. The logarithm of the smoothed ratio scales the feature, and features below RATIO are left out: what is as frequent in clean texts, such as the common words of
a language, says nothing. On top a logistic regression learns from a bounded sample (`PER_LABEL` texts of each label, chosen by the
hash of the key), and its intercept is moved from the sample's share of toxic texts to the one of all labelled rows.
The driver and each task hold at most 2**BITS counts, the driver also the sample's features, nothing of the other documents. Counts travel as
compressed blocks, one a task and range of features. Features that no text of the sample holds have no weight and are not kept.

Defined cases: a document labelled twice counts with the higher label. A null text counts as empty; an empty text has no n-grams and gets the score of the
intercept. Rows without a label teach nothing; without rows of both labels every score is the share of
toxic rows (0 without any). Repeated rows score alike. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import stored
from procmon.llm.ngrams import Ftrl, bounded_sample, hashed, short_batches, slices

BITS = 22
SIZES = range(5, 10)
PER_LABEL = 1500
EPOCHS = 4
#: Toxic training texts that a feature must stand in, and the least size of its logarithmic ratio.
LEAST = 4
RATIO = 1.0
#: Texts counted in one task: a task names nearly every feature once it has seen some thousands of texts, so few large ones send less.
TOXIC_TEXTS, CLEAN_TEXTS = 1 << 13, 1 << 14
#: Added to the counts of both labels before the ratio is taken.
SMOOTHING = 1.0
#: Counts sent in one compressed block.
BLOCK = 1 << 12


@dataclass(frozen=True)
class ToxicityModel:
    """features: those of the learned sample, rising; ratio: of each; weights: ratio and learned weight multiplied."""

    features: np.ndarray
    ratio: np.ndarray
    weights: np.ndarray
    intercept: float

    @cached_property
    def _weight(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.features] = self.weights
        return out

    @cached_property
    def _known(self) -> np.ndarray:
        return mask(self.features)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        margins = [
            self._weight[present(grams, self._known)].sum()
            for part in slices([t or "" for t in texts])
            for grams in hashed(part, SIZES, BITS)
        ]
        return 1.0 / (1.0 + np.exp(-np.clip(np.array(margins, float) + self.intercept, -500.0, 500.0)))


def mask(features: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS, bool)
    out[features] = True
    return out


def present(grams: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The known features of a text, each once, rising."""
    held = np.sort(grams[known[grams]])
    first = np.ones(len(held), bool)
    np.not_equal(held[1:], held[:-1], out=first[1:])
    return held[first]


def _packed(batches):
    for batch in batches:
        small = [zstandard.compress(t.encode(), 3) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("h"), pa.array(small, pa.binary())], ["key", "h", "packed"])


def _texts(batch) -> list[str]:
    return [zstandard.decompress(p).decode() for p in batch.column("packed").to_pylist()]


def _counts(known):
    """Function that counts, per task, the texts with each known feature; `known` is a broadcast mask, or None for all features."""

    def counted(batches):
        total, every = np.zeros(1 << BITS, np.int64), np.ones(1 << BITS, bool) if known is None else known.value
        for batch in batches:
            for part in slices(_texts(batch)):
                for grams in hashed(part, SIZES, BITS):
                    total[present(grams, every)] += 1
        blocks = total.reshape(-1, BLOCK)
        found = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([_small(blocks[i]) for i in found], pa.binary())], ["block", "counts"])

    return counted


def _small(counts: np.ndarray) -> bytes:
    return zstandard.compress(counts.tobytes(), 1)


def _block(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.int64)


def _added(table: pa.Table) -> pa.Table:
    """The counts of one block, summed over the tasks."""
    total = np.zeros(BLOCK, np.int64)
    for packed in table.column("counts").to_pylist():
        total += _block(packed)
    return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([_small(total)], pa.binary())})


def _features(known):
    def found(batches):
        for batch in batches:
            rows = [present(g, known.value).astype(np.int32) for part in slices(_texts(batch)) for g in hashed(part, SIZES, BITS)]
            at = np.cumsum([0, *map(len, rows)])
            values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("h"), values], ["label", "h", "feature"])

    return found


def _summed(rows: DataFrame, known) -> np.ndarray:
    """The number of texts that hold each of the 2**BITS features."""
    kind = "block long, counts binary"
    summed = rows.select("packed").mapInArrow(_counts(known), kind).groupBy("block").applyInArrow(_added, kind).toArrow()
    total = np.zeros((1 << BITS) // BLOCK * BLOCK, np.int64).reshape(-1, BLOCK)
    for block, packed in zip(summed.column("block").to_pylist(), summed.column("counts").to_pylist()):
        total[block] = _block(packed)
    return total.reshape(-1)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_label: int = PER_LABEL) -> ToxicityModel:
    """Learn from the documents whose label is 0 or 1."""
    spark = docs.sparkSession
    short_batches(spark)
    own = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(key).cast("string"), F.lit(5)).alias("h"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    told = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    # The same join at every size: labels are many, so they are never broadcast.
    packed = own.mapInArrow(_packed, f"key {own.schema['key'].dataType.simpleString()}, h long, packed binary")
    usable = stored(packed.join(told.hint("merge"), "key"), "labelled")
    texts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    clean, toxic = texts.get(0, 0), texts.get(1, 0)
    none = np.zeros(0)
    if not clean or not toxic:
        return ToxicityModel(none.astype(np.int64), none, none, 40.0 if toxic else -40.0)
    # Files are taken together, so that a task counts many texts without sending them through another exchange.
    of = lambda label, n, texts: usable.where(f"label = {label}").coalesce(-(-n // texts))
    counts = _summed(of(1, toxic, TOXIC_TEXTS), None)
    features = np.flatnonzero(counts >= LEAST)
    p = counts[features]
    shared = spark.sparkContext.broadcast(mask(features))
    q = _summed(of(0, clean, CLEAN_TEXTS), shared)[features]
    ratio = np.log((p + SMOOTHING) / (toxic + 2.0 * SMOOTHING)) - np.log((q + SMOOTHING) / (clean + 2.0 * SMOOTHING))
    strong = np.abs(ratio) >= RATIO
    features, ratio = features[strong], ratio[strong]
    del counts, p, q, strong

    shared = spark.sparkContext.broadcast(mask(features))
    sample = bounded_sample(usable, "label", "key", per_label).select("label", "h", "packed")
    found = sample.mapInArrow(_features(shared), "label int, h long, feature array<int>").toArrow()
    labels, h = np.asarray(found.column("label")), np.asarray(found.column("h"))
    lists = found.column("feature").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    flat, at = np.asarray(lists.values), np.asarray(lists.offsets)
    # A feature outside the sample would keep the weight 0.
    used = mask(flat)[features]
    features, ratio = features[used], ratio[used]
    place = np.zeros(1 << BITS, np.int32)
    place[features] = np.arange(len(features), dtype=np.int32)
    learner = Ftrl(len(features), 2, rate=0.1, l1=1e-4, l2=1e-2)
    for _ in range(EPOCHS):
        for i in np.lexsort((labels, h)):
            rows_of = place[flat[at[i] : at[i + 1]]]
            learner.learn(rows_of, ratio[rows_of], int(labels[i]))
    w = learner.weights()
    w = w[:, 1] - w[:, 0]
    picked = max(1, (labels == 1).sum()) / max(1, (labels == 0).sum())
    return ToxicityModel(features, ratio, w[:-1] * ratio, float(w[-1] + np.log(toxic / clean) - np.log(picked)))


def score(model: ToxicityModel, text: Column, spark) -> Column:
    """The score of a text column, between 0 and 1."""
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts.tolist()))

    return scored(F.coalesce(text.cast("string"), F.lit("")))
