"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every training document. The weights are learned by follow-the-
regularised-leader with an elastic-net penalty on a bounded sample (`PER_LABEL` documents of each
language, chosen by the hash of the key), and a temperature is fitted on a fifth of that sample.
Only this step and the frequencies (2**BITS numbers) reach the driver; documents are read and
predicted in tasks, whole, a few at a time.

Defined cases: a null text, or one without any letter, is `und` with score 0. Rows without a language
teach nothing. Without a single training row everything is `und`. A repeated row is predicted like its
twin. On a tie the language that is smaller as text wins. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.llm.ngrams import Ftrl, bounded_sample, hashed, short_batches, slices, softmax

BITS = 15
SIZES = range(1, 4)
PER_LABEL = 600
EPOCHS = 4


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [], np.zeros(len(texts))
        filled = [t if t is not None and any(map(str.isalpha, t)) else "" for t in texts]
        done = 0
        for part in slices(filled):
            for text, grams in zip(part, hashed(part, SIZES, BITS)):
                if not text or not self.languages:
                    names.append("und")
                else:
                    rows, values = tfidf(grams, self.idf)
                    p = softmax((values @ self.weights[rows] + self.weights[-1]) / self.temperature)
                    names.append(self.languages[int(p.argmax())])
                    scores[done] = p.max()
                done += 1
        return names, scores


def tfidf(grams: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features present and their values, with Euclidean length 1."""
    counts = np.bincount(grams, minlength=1 << BITS)
    rows = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[rows])) * idf[rows]
    return rows, values / max(np.sqrt(values @ values), 1e-12)


def _frequencies(batches):
    """Per task: in how many texts each feature occurs; feature -1 counts the texts."""
    total, texts = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for part in slices(batch.column("text").to_pylist()):
            for grams in hashed(part, SIZES, BITS):
                total += np.bincount(grams, minlength=1 << BITS) > 0
                texts += 1
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], texts))], ["feature", "n"])


def _vectors(batches):
    for batch in batches:
        rows = [g for part in slices(batch.column("text").to_pylist()) for g in hashed(part, SIZES, BITS)]
        counts = [np.unique(g, return_counts=True) for g in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("h"), pa.array([c[0].tolist() for c in counts], pa.list_(pa.int32())), pa.array([c[1].tolist() for c in counts], pa.list_(pa.int32()))],
            ["label", "h", "feature", "n"],
        )


def train(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = PER_LABEL) -> LanguageModel:
    """Learn from the rows with a language and at least one letter."""
    spark = rows.sparkSession
    short_batches(spark)
    usable = rows.select(F.col(text).alias("text"), F.col(label).alias("label"), F.col(key).cast("string").alias("key")).where(
        F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    counts = usable.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    n_texts = int(counts.loc[counts.feature < 0, "n"].sum())
    if not n_texts:
        return LanguageModel((), np.zeros(1 << BITS), np.zeros((1, 0)), 1.0)
    counts = counts[counts.feature >= 0]
    seen = np.zeros(1 << BITS)
    seen[counts.feature.to_numpy()] = counts.n.to_numpy()
    idf = np.where(seen > 0, np.log((1.0 + n_texts) / (1.0 + seen)) + 1.0, 0.0)

    sample = bounded_sample(usable, "label", "key", per_label).select("label", F.xxhash64("key", F.lit(5)).alias("h"), "text")
    vectors = sample.mapInArrow(_vectors, "label string, h long, feature array<int>, n array<int>").toPandas().sort_values(["h", "label"])
    languages = tuple(sorted(vectors.label.unique()))
    examples = []
    for label_of, feature, n in zip(vectors.label, vectors.feature, vectors.n):
        rows_of = np.asarray(feature, np.int64)
        values = (1.0 + np.log(np.asarray(n, float))) * idf[rows_of]
        examples.append((rows_of, values / max(np.sqrt(values @ values), 1e-12), languages.index(label_of)))
    held = [e for i, e in enumerate(examples) if i % 5 == 4]
    learner = Ftrl(1 << BITS, len(languages), rate=0.5, l1=0.02, l2=0.02)
    for _ in range(EPOCHS):
        for i, example in enumerate(examples):
            if i % 5 != 4:
                learner.learn(*example)
    weights = learner.weights()
    return LanguageModel(languages, idf, weights, _temperature(held, weights))


def _temperature(examples: list, weights: np.ndarray) -> float:
    """The divisor of the margins under which the held examples are likeliest."""
    if not examples:
        return 1.0
    margins = np.array([v @ weights[r] + weights[-1] for r, v, _ in examples])
    labels = np.array([k for *_, k in examples])
    loss = lambda t: -np.log(np.maximum(softmax(margins / t)[np.arange(len(labels)), labels], 1e-300)).mean()
    grid = np.exp(np.linspace(np.log(0.02), np.log(20.0), 139))
    return float(min(grid, key=loss))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("_text"))
    names = own.columns[:-1]

    def predict(batches):
        for batch in batches:
            found, scores = shared.value.predict(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    schema = ", ".join(f"{n} {own.schema[n].dataType.simpleString()}" for n in names) + ", lang_pred string, score double"
    return own.mapInArrow(predict, schema).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")
