"""Fitting dynamic PCA models from merged triangular factors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.functions.columns import col, require_columns
from procmon.functions.distributions import f_quantile, normal_quantile
from procmon.operators.quantiles import exact_quantiles
from procmon.operators.scoring import EPS, Model, score
from procmon.operators.tsqr import Part, factors, part_of
from procmon.session import ensure_checkpoint_dir

LEVELS = (0.95, 0.99)
NEAR_CONSTANT = 1e-6


class FitError(ValueError):
    """A training matrix no model can be fitted to."""


@dataclass(frozen=True)
class Moments:
    """n, means, population deviations, and a factor z of the standardised rows: z'z is theirs summed."""

    n: int
    mean: np.ndarray
    scale: np.ndarray
    z: np.ndarray

    @property
    def correlation(self) -> np.ndarray:
        return self.z.T @ self.z / self.n

    def decomposed(self) -> tuple[np.ndarray, np.ndarray]:
        """(eigenvalues, loadings by row) of the standardised data, largest first; n - 1 in the denominator."""
        p = len(self.mean)
        tall = self.z if len(self.z) >= p else np.vstack([self.z, np.zeros((p - len(self.z), p))])
        _, singular, loadings = np.linalg.svd(tall, full_matrices=False)
        most = min(self.n - 1, p)
        return singular[:most] ** 2 / (self.n - 1), loadings[:most]


def effective_rank(eigenvalues: np.ndarray) -> int:
    """Eigenvalues above the machine precision."""
    return int((eigenvalues > EPS).sum())


def _standardised(part: Part, features: Sequence[str]) -> Moments:
    if part.bad:
        raise FitError("the training matrix contains non-finite values")
    if part.n < 3 or len(features) < 2:
        raise FitError("a model needs at least three rows and two features")
    scale = part.scale
    flat = [f for f, s in zip(features, scale) if s <= EPS]
    if flat:
        raise FitError(f"constant features cannot be standardised: {', '.join(flat)}")
    return Moments(part.n, part.mean, scale, part.r / scale)


def moments(dynamic: DataFrame, features: Sequence[str]) -> Moments:
    """Count, means, population deviations and the triangular factor of a feature matrix.

    The rows are read once and nothing is kept of them; one p x p factor comes back.
    """
    require_columns(dynamic, features)
    found = factors(dynamic, features).toPandas()
    if found.empty:
        raise FitError("a model needs at least three rows and two features")
    return _standardised(part_of(next(found.itertuples(index=False)), len(features)), features)


def t2_limit(n: int, k: int, level: float) -> float:
    return k * (n - 1) * (n + 1) / (n * (n - k)) * f_quantile(level, k, n - k)


def q_limit(residual: np.ndarray, level: float) -> float | None:
    """SPE limit from the residual spectrum; None where the formula does not apply."""
    if residual.size == 0 or (residual <= 0).all():
        return 0.0
    first, second, third = ((residual**power).sum() for power in (1, 2, 3))
    h = 1.0 - 2.0 * first * third / (3.0 * second**2)
    if h <= 0:
        return None
    root = normal_quantile(level) * sqrt(2.0 * second * h**2) / first
    inner = root + 1.0 + second * h * (h - 1.0) / first**2
    return None if inner <= 0 else float(first * inner ** (1.0 / h))


def solve(
    found: Moments, variance_threshold: float = 0.95, n_components: int | None = None
) -> dict:
    """Eigenpairs, component count and limits of one second-moment matrix.

    Each component is signed so that its largest loading is positive.
    """
    n, p = found.n, len(found.mean)
    if not 0 < variance_threshold < 1:
        raise FitError("the variance threshold must lie strictly between 0 and 1")
    most = min(n - 1, p)
    eigenvalues, loadings = found.decomposed()
    rank = effective_rank(eigenvalues)
    if rank < 3:
        raise FitError("the effective rank must be at least 3 to leave room for SPE")
    explained = eigenvalues / eigenvalues.sum()
    if n_components is None:
        # A share that meets the threshold up to rounding counts as meeting it.
        k = max(2, int(np.searchsorted(np.cumsum(explained), variance_threshold)) + 1)
    else:
        k = int(n_components)
    if not 2 <= k <= most:
        raise FitError(f"the component count must lie between 2 and {most}")
    if k >= rank:
        raise FitError("the retained components leave no residual space for SPE")
    kept = loadings[:k]
    peak = np.abs(kept).argmax(axis=1)
    kept = kept * np.sign(kept[np.arange(k), peak])[:, None]
    return {
        "k": k,
        "components": kept,
        "eigenvalues": eigenvalues,
        "explained": explained,
        "t2_limits": tuple(t2_limit(n, k, level) for level in LEVELS),
        "q_limits": tuple(q_limit(eigenvalues[k:], level) for level in LEVELS),
    }


def fit(
    dynamic: DataFrame,
    features: Sequence[str],
    variance_threshold: float = 0.95,
    n_components: int | None = None,
) -> Model:
    """One model for all rows of a feature matrix."""
    found = moments(dynamic, features)
    solved = solve(found, variance_threshold, n_components)
    limits = solved["q_limits"]
    build = lambda q: Model(
        tuple(features),
        found.mean,
        found.scale,
        solved["components"],
        solved["eigenvalues"],
        solved["explained"],
        solved["t2_limits"],
        q,
        found.n,
    )
    if None not in limits:
        return build(limits)
    # The formula fails: take the limits from the scored training rows.
    spe = score(dynamic.select(*[col(f) for f in features]), build((1.0, 1.0)))
    row = exact_quantiles(spe, [], "spe", {"q95": LEVELS[0], "q99": LEVELS[1]}).collect()[0]
    return build(tuple(v if v is not None else row[n] for v, n in zip(limits, ("q95", "q99"))))


def matrix_report(dynamic: DataFrame, features: Sequence[str]) -> dict:
    """Whether a merged matrix can be trained on, and features that barely vary."""
    try:
        found = moments(dynamic, features)
        if effective_rank(found.decomposed()[0]) < 3:
            raise FitError("the effective rank is too low")
    except FitError as error:
        text = str(error)
        code = (
            "dynamic_matrix_empty"
            if dynamic.isEmpty()
            else "insufficient_effective_rank" if "rank" in text else "dynamic_matrix_invalid"
        )
        return {"can_train": False, "code": code, "message": text, "warnings": []}
    least = np.maximum(np.abs(found.mean), 1.0) * NEAR_CONSTANT
    warnings = [
        {"code": "near_constant_feature", "feature": f, "standard_deviation": s, "threshold": t}
        for f, s, t in zip(features, found.scale.tolist(), least.tolist())
        if s <= t
    ]
    return {"can_train": True, "code": None, "message": None, "warnings": warnings}


# ---- one model per series ------------------------------------------------------------

MODEL_FIELDS = """n long, k int, mean array<double>, scale array<double>,
components array<array<double>>, eigenvalues array<double>, explained array<double>,
t2_95 double, t2_99 double, q_95 double, q_99 double, problem string"""


def fit_series(
    dynamic: DataFrame,
    features: Sequence[str],
    *,
    keys: Sequence[str] = ("series_id",),
    variance_threshold: float = 0.95,
    n_components: int | None = None,
) -> DataFrame:
    """One model per series, as a table; `problem` says why a series has none.

    The rows are read once. Tasks reduce them to one triangular factor per series, and the
    factors merge in a tree, so a dominant series spreads over all tasks.
    """
    key_cols = [col(k) for k in keys]
    p = len(features)
    names = [f"f{i}" for i in range(p)]
    rows = dynamic.select(*key_cols, *[col(f).cast("double").alias(n) for f, n in zip(features, names)])
    key_names = list(keys)

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                part, key = part_of(row, p), row[: len(key_names)]
                head = [*key, part.n + part.bad]
                try:
                    s = solve(_standardised(part, features), variance_threshold, n_components)
                except FitError as error:
                    out.append([*head, None, part.mean.tolist(), part.scale.tolist(), *[None] * 7, str(error)])
                    continue
                out.append(
                    [*head, s["k"], part.mean.tolist(), part.scale.tolist(), s["components"].tolist(),
                     s["eigenvalues"].tolist(), s["explained"].tolist(), *s["t2_limits"], *s["q_limits"], None]
                )
            columns = [*key_names, "n", "k", "mean", "scale", "components", "eigenvalues", "explained",
                       "t2_95", "t2_99", "q_95", "q_99", "problem"]
            yield pd.DataFrame(out, columns=columns)

    fields = T.StructType([rows.schema[k] for k in keys] + T._parse_datatype_string(MODEL_FIELDS).fields)
    # One small row per series, read again below and by every caller; written once.
    ensure_checkpoint_dir(dynamic.sparkSession)
    models = factors(rows, names, keys).mapInPandas(decompose, fields).checkpoint()
    return _fill_q_limits(models, rows, names, keys)


def _fill_q_limits(models: DataFrame, rows: DataFrame, names: Sequence[str], keys) -> DataFrame:
    """SPE quantiles of the training rows for the series whose limit formula fails."""
    missing = F.col("problem").isNull() & (F.col("q_95").isNull() | F.col("q_99").isNull())
    open_models = models.where(missing)
    if open_models.isEmpty():
        return models
    spe = score_series(rows, open_models, names, keys=keys)
    found = exact_quantiles(spe, list(keys), "spe", {"_q95": LEVELS[0], "_q99": LEVELS[1]})
    return (
        models.join(found, list(keys), "left")
        .withColumn("q_95", F.coalesce("q_95", "_q95"))
        .withColumn("q_99", F.coalesce("q_99", "_q99"))
        .drop("_q95", "_q99")
    )


def score_series(
    rows: DataFrame, models: DataFrame, features: Sequence[str], *, keys: Sequence[str] = ("series_id",)
) -> DataFrame:
    """T2, SPE and statuses of each row under the model of its own series."""
    usable = models.where(F.col("problem").isNull()).drop("problem", "n", "explained")
    joined = rows.join(usable, list(keys))
    x = F.array(*[col(f) for f in features])
    scaled = F.zip_with(
        F.zip_with(x, F.col("mean"), lambda a, b: a - b), F.col("scale"), lambda a, b: a / b
    )
    joined = joined.withColumn("_z", scaled)
    product = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v
    )
    joined = joined.withColumn("_t", F.transform("components", lambda c: product(F.col("_z"), c)))
    weighted = F.zip_with(F.col("_t"), F.col("components"), lambda t, c: F.transform(c, lambda v: v * t))
    fitted = F.aggregate(
        weighted,
        F.transform(F.col("_z"), lambda v: F.lit(0.0)),
        lambda s, w: F.zip_with(s, w, lambda a, b: a + b),
    )
    joined = joined.withColumn("_r", F.zip_with(F.col("_z"), fitted, lambda a, b: a - b))
    lead = F.slice("eigenvalues", F.lit(1), F.col("k"))
    t2 = F.aggregate(
        F.zip_with(F.col("_t"), lead, lambda t, e: t * t / e), F.lit(0.0), lambda s, v: s + v
    )
    scored = joined.withColumn("t2", t2).withColumn("spe", product(F.col("_r"), F.col("_r")))
    code = lambda v, low, high: F.when(v >= F.col(high), 2).when(v >= F.col(low), 1).otherwise(0)
    worst = F.greatest(code(F.col("t2"), "t2_95", "t2_99"), code(F.col("spe"), "q_95", "q_99"))
    return scored.withColumn(
        "status", F.element_at(F.array(F.lit("normal"), F.lit("attention"), F.lit("abnormal")), worst + 1)
    ).select(*[col(c) for c in rows.columns], F.col("_t").alias("pc_scores"), "t2", "spe", "status")
