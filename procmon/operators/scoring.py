"""T2 and SPE scores of lagged feature rows under a fixed model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.functions.columns import (
    NOT_SCORED,
    all_finite,
    append_columns,
    col,
    is_finite,
    parse_feature,
    require_columns,
    severity,
    status_of,
)

# Products up to which scores are plain SQL expressions; wider models multiply in NumPy.
EXPRESSION_TERMS = 256

# Machine epsilon of a double: smaller scales and eigenvalues count as zero.
EPS = float(np.finfo(float).eps)


def model_faults(model: Model) -> list[str]:
    """What keeps a model from scoring. Values are looked at only where the shapes fit."""
    p, k, spectrum = len(model.features), len(model.components), len(model.eigenvalues)
    shapes = {
        "feature names must be unique": len(set(model.features)) == p,
        "model arrays do not match the feature names": {model.mean.shape, model.scale.shape, model.components.shape[1:]} == {(p,)},
        "eigenvalues do not match the components": 1 <= k <= spectrum,
    }
    faults = [text for text, holds in shapes.items() if not holds]
    if faults:
        return faults
    used = np.concatenate([model.scale, model.eigenvalues[:k]])
    limits = np.array([model.t2_limits, model.q_limits], float)
    values = {
        "model arrays must be finite": all(np.isfinite(a).all() for a in (model.mean, model.components, model.scale, model.eigenvalues)),
        "scale and retained eigenvalues must be positive": not (used <= 0).any(),
        "control limits are invalid": np.isfinite(limits).all() and (limits[:, 0] >= (EPS, 0.0)).all() and (np.diff(limits) >= 0).all(),
    }
    return [text for text, holds in values.items() if not holds]


@dataclass(frozen=True)
class Model:
    """A fitted model; components are k rows of p loadings, eigenvalues hold the spectrum."""

    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    t2_limits: tuple[float, float]
    q_limits: tuple[float, float]
    n_samples: int

    def __post_init__(self):
        for name in ("mean", "scale", "components", "eigenvalues", "explained"):
            object.__setattr__(self, name, np.asarray(getattr(self, name), dtype=float))
        faults = model_faults(self)
        if faults:
            raise ValueError("; ".join(faults))

    @property
    def k(self) -> int:
        return len(self.components)

    @property
    def pcs(self) -> list[str]:
        return [f"pc{i + 1}" for i in range(self.k)]

    @property
    def tags(self) -> list[str]:
        return list(dict.fromkeys(parse_feature(f)[0] for f in self.features))

    @property
    def is_wide(self) -> bool:
        return self.k * len(self.features) > EXPRESSION_TERMS


def dot(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(columns, weights)])


def standardised(df: DataFrame, model: Model) -> DataFrame:
    """Add z0.. and, from them, the component scores and the residuals r0.."""
    p = len(model.features)
    zs = [f"_z{j}" for j in range(p)]
    df = df.select(
        "*",
        *[
            ((col(f) - F.lit(float(m))) / F.lit(float(s))).alias(z)
            for f, m, s, z in zip(model.features, model.mean, model.scale, zs)
        ],
    )
    df = df.select(
        "*", *[dot([F.col(z) for z in zs], row).alias(f"_t{i}") for i, row in enumerate(model.components)]
    )
    ts = [F.col(f"_t{i}") for i in range(model.k)]
    return df.select(
        "*",
        *[(F.col(z) - dot(ts, model.components[:, j])).alias(f"_r{j}") for j, z in enumerate(zs)],
    )


def fence(df: DataFrame, before: Sequence[str], **values: Column) -> DataFrame:
    """Compute columns behind a one-element generator.

    A filter on a score must not be pushed into these long sums: Catalyst would copy them
    into the filter and into every constraint it derives from it.
    """
    row = F.struct(*[v.alias(n) for n, v in values.items()])
    return df.select(*[col(c) for c in before], F.inline(F.array(row)))


def _statistics_by_expression(df: DataFrame, model: Model) -> DataFrame:
    before = df.columns
    df = standardised(df, model)
    ts = [F.col(f"_t{i}") for i in range(model.k)]
    rs = [F.col(f"_r{j}") for j in range(len(model.features))]
    return fence(
        df,
        before,
        **dict(zip(model.pcs, ts)),
        t2=dot([t * t for t in ts], 1.0 / model.eigenvalues[: model.k]),
        spe=reduce(lambda a, b: a + b, [r * r for r in rs]),
    )


def _statistics_by_matrix(df: DataFrame, model: Model) -> DataFrame:
    """Arrow batches and one matrix product each; the model travels with the function."""
    fields = [T.StructField(n, T.DoubleType()) for n in [*model.pcs, "t2", "spe"]]
    names, features = [f.name for f in fields], list(model.features)

    def multiply(batch: pd.DataFrame) -> dict:
        z = (batch[features].to_numpy(dtype=float) - model.mean) / model.scale
        with np.errstate(all="ignore"):
            t = z @ model.components.T
            r = z - t @ model.components
            t2 = (t**2 / model.eigenvalues[: model.k]).sum(axis=1)
            columns = [*t.T, t2, (r**2).sum(axis=1)]
        return dict(zip(names, columns))

    return append_columns(df, multiply, fields)


def score(df: DataFrame, model: Model, reason: Column | None = None) -> DataFrame:
    """Add component scores, T2, SPE, limit ratios and statuses to feature rows.

    A row with a non-finite feature or result keeps NULL numbers, the status
    `not_scored` and a reason: `reason` where it says something, else `non_finite_input`.
    """
    require_columns(df, model.features)
    before = df.columns
    statistics = _statistics_by_matrix if model.is_wide else _statistics_by_expression
    scored = statistics(df, model)
    ratio = lambda value, limit: value / F.lit(limit) if limit > 0 else F.lit(None).cast("double")
    scored = scored.withColumn("t2_limit_ratio", ratio(F.col("t2"), model.t2_limits[0]))
    scored = scored.withColumn("spe_limit_ratio", ratio(F.col("spe"), model.q_limits[0]))
    numbers = [*model.pcs, "t2", "spe", "t2_limit_ratio", "spe_limit_ratio"]
    valid = all_finite([F.col(n) for n in numbers])
    if reason is not None:
        valid = valid & reason.isNull()
    scored = scored.withColumn("score_valid", valid)
    ok = F.col("score_valid")
    t2_code = severity(F.col("t2"), *model.t2_limits)
    spe_code = severity(F.col("spe"), *model.q_limits)
    say = lambda code: F.when(ok, status_of(code)).otherwise(F.lit(NOT_SCORED))
    why = F.lit("non_finite_input") if reason is None else F.coalesce(reason, F.lit("non_finite_input"))
    return scored.select(
        *[col(c) for c in before],
        *[F.when(ok, F.col(n)).alias(n) for n in numbers],
        say(t2_code).alias("t2_status"),
        say(spe_code).alias("spe_status"),
        say(F.greatest(t2_code, spe_code)).alias("overall_status"),
        ok.alias("score_valid"),
        F.when(~ok, why).alias("invalid_reason"),
        say(F.greatest(t2_code, spe_code)).alias("status"),
    )


def exceeds(model: Model, level: int = 95) -> dict[str, Column]:
    """Flags per statistic for the 95 or 99 percent limits; reaching a limit counts."""
    at = 0 if level == 95 else 1
    t2 = F.coalesce(F.col("t2") >= F.lit(model.t2_limits[at]), F.lit(False))
    spe = F.coalesce(F.col("spe") >= F.lit(model.q_limits[at]), F.lit(False))
    return {"t2": t2, "spe": spe, "overall": t2 | spe}


def focus_row(scores: DataFrame, model: Model, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Per series, the time of the largest statistic relative to its 99 percent limit."""
    share = F.greatest(
        F.col("t2") / F.lit(max(model.t2_limits[1], EPS)),
        F.col("spe") / F.lit(max(model.q_limits[1], EPS)),
    )
    return (
        scores.where(is_finite(share))
        .groupBy(*[col(k) for k in keys])
        .agg(
            F.min_by("ts", F.struct(-share, F.col("ts"))).alias("focus_ts"),
            F.max(share).alias("focus_ratio"),
        )
    )


def status_counts(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per status, zero for absent ones."""
    names = ["normal", "attention", "abnormal", NOT_SCORED]
    return scores.groupBy(*[col(k) for k in keys]).agg(
        *[F.count_if(F.col("status") == n).alias(n) for n in names]
    )
