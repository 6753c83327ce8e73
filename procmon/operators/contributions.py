"""Which tags drive an exceedance, and since which lag."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.functions.columns import append_columns, col, from_micros, is_finite, micros, parse_feature
from procmon.operators.runs import runs
from procmon.operators.scoring import Model, dot, exceeds, fence, standardised
from procmon.session import ensure_checkpoint_dir


def _magnitudes(df: DataFrame, model: Model) -> DataFrame:
    """Add `_c_t2` and `_c_spe`: one non-negative magnitude per feature."""
    before = df.columns
    k, p = model.k, len(model.features)
    if model.is_wide:
        features = list(model.features)
        array = T.ArrayType(T.DoubleType())

        def multiply(batch: pd.DataFrame) -> dict:
            z = (batch[features].to_numpy(dtype=float) - model.mean) / model.scale
            t = z @ model.components.T
            pull = (t / model.eigenvalues[:k]) @ model.components
            rest = z - t @ model.components
            return {"_c_t2": list(np.abs(z * pull)), "_c_spe": list(rest**2)}

        fields = [T.StructField("_c_t2", array), T.StructField("_c_spe", array)]
        return append_columns(df, multiply, fields)
    df = standardised(df, model)
    ts = [F.col(f"_t{i}") for i in range(k)]
    weights = model.components / model.eigenvalues[:k, None]
    pulls = [F.abs(F.col(f"_z{j}") * dot(ts, weights[:, j])) for j in range(p)]
    rests = [F.col(f"_r{j}") * F.col(f"_r{j}") for j in range(p)]
    return df.select(
        *[col(c) for c in before],
        F.array(*pulls).alias("_c_t2"),
        F.array(*rests).alias("_c_spe"),
    )


def tag_shares(
    magnitudes: Column, features: Sequence[str], tag_configs: Mapping[str, Mapping] | None = None
) -> Column:
    """Feature magnitudes to sorted tag shares.

    Array of (tag, description, unit, contribution_pct, lag_start_minutes,
    lag_end_minutes), largest share first, then by name. The lag range is the stretch
    around the tag's peak lag where magnitudes stay at or above half the peak.
    """
    places: dict[str, list[tuple[int, int]]] = {}
    for j, name in enumerate(features):
        tag, lag = parse_feature(name)
        places.setdefault(tag, []).append((lag, j))
    plus = lambda a, v: a + v
    total = F.aggregate(magnitudes, F.lit(0.0), plus)
    entries = []
    for tag, spots in places.items():
        spots.sort()
        meta = (tag_configs or {}).get(tag, {})
        entries.append(
            F.struct(
                F.lit(tag).alias("tag"),
                F.lit(str(meta.get("description", ""))).alias("description"),
                F.lit(str(meta.get("unit", ""))).alias("unit"),
                F.array(*[F.lit(lag) for lag, _ in spots]).alias("lags"),
                F.array(*[F.get(magnitudes, F.lit(j)) for _, j in spots]).alias("values"),
                total.alias("total"),
            )
        )
    # Each step is handed to the next as a field: an expression used twice would be computed twice.
    step = lambda array, names, more: F.transform(
        array, lambda e: F.struct(*[e[n].alias(n) for n in names], *[v.alias(n) for n, v in more(e).items()])
    )
    known = ["tag", "description", "unit", "lags", "values", "total"]
    peaked = step(
        F.array(*entries), known,
        lambda e: {"peak": F.array_max(e["values"]), "sum": F.aggregate(e["values"], F.lit(0.0), plus)},
    )
    below = lambda e: F.transform(e["values"], lambda v, i: F.when(v < e["peak"] * 0.5, i + 1))
    placed = step(
        peaked, known,
        lambda e: {
            "at": F.array_position(e["values"], e["peak"]).cast("int"),
            "below": F.array_compact(below(e)),
            "contribution_pct": F.when(e["total"] == 0, F.lit(0.0)).otherwise(e["sum"] / e["total"] * 100.0),
        },
    )
    found = step(
        placed, ["tag", "description", "unit", "lags", "contribution_pct"],
        lambda e: {
            "first": F.coalesce(F.array_max(F.filter(e["below"], lambda i: i < e["at"])) + 1, F.lit(1)),
            "last": F.coalesce(F.array_min(F.filter(e["below"], lambda i: i > e["at"])) - 1, F.size(e["values"])),
        },
    )
    shaped = F.transform(
        found,
        lambda e: F.struct(
            (-e["contribution_pct"]).alias("order"),
            *[e[n].alias(n) for n in ("tag", "description", "unit", "contribution_pct")],
            F.get(e["lags"], e["first"] - 1).alias("lag_start_minutes"),
            F.get(e["lags"], e["last"] - 1).alias("lag_end_minutes"),
        ),
    )
    return F.transform(F.sort_array(shaped), lambda e: e.dropFields("order"))


def exceedance_contributions(
    scored: DataFrame, model: Model, tag_configs: Mapping[str, Mapping] | None = None
) -> DataFrame:
    """One row per scored row and statistic that reaches its 95 percent limit.

    Rows below both limits are dropped before any contribution is computed.
    """
    flags = exceeds(model)
    kept = [c for c in scored.columns if c not in model.features]
    hit = scored.where(F.col("score_valid") & flags["overall"])
    parts = _magnitudes(hit, model).select(
        *[col(c) for c in kept],
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("statistic"),
                        F.col(name).alias("statistic_value"),
                        F.lit(float(limit)).alias("limit_95"),
                        F.col(f"_c_{name}").alias("magnitudes"),
                    )
                    for name, limit in (("t2", model.t2_limits[0]), ("spe", model.q_limits[0]))
                ]
            )
        ).alias("_part"),
    )
    total = F.aggregate(F.col("_part.magnitudes"), F.lit(0.0), lambda a, v: a + v)
    return parts.where(
        (F.col("_part.statistic_value") >= F.col("_part.limit_95")) & is_finite(total) & (total > 0)
    ).select(
        *[col(c) for c in kept],
        F.col("_part.statistic").alias("statistic"),
        F.col("_part.statistic_value").alias("statistic_value"),
        F.col("_part.limit_95").alias("limit_95"),
        F.col("_part.magnitudes").alias("magnitudes"),
        tag_shares(F.col("_part.magnitudes"), model.features, tag_configs).alias("tags"),
    )


def statistic_events(
    scored: DataFrame,
    model: Model,
    interval_us: int,
    *,
    keys: Sequence[str] = ("series_id",),
    width: int | None = None,
) -> DataFrame:
    """Runs of rows at or above the 95 percent limit, per statistic, with their peak."""
    flags = exceeds(model)
    limits = {"t2": model.t2_limits[0], "spe": model.q_limits[0]}
    long = scored.where(F.col("score_valid") & flags["overall"]).select(
        *[col(k) for k in keys],
        "ts",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("statistic"),
                        F.col(n).alias("value"),
                        F.lit(float(limits[n])).alias("limit_95"),
                        flags[n].alias("hit"),
                    )
                    for n in limits
                ]
            )
        ).alias("_s"),
    )
    long = long.where("_s.hit").select(
        *[col(k) for k in keys], "ts", "_s.statistic", "_s.value", "_s.limit_95"
    )
    # The first of the largest ratios wins.
    peak = F.struct(
        (F.col("value") / F.when(F.col("limit_95") > 0, F.col("limit_95"))).alias("ratio"),
        (-micros(F.col("ts"))).alias("back"),
        F.col("value").alias("value"),
        F.col("limit_95").alias("limit_95"),
    )
    found = runs(
        long, interval_us, keys=[*keys, "statistic"], facts={"peak": (F.max(peak), F.max)}, width=width
    )
    return found.select(
        *[col(k) for k in keys],
        "statistic",
        F.col("start").alias("event_start"),
        F.col("end").alias("event_end"),
        F.col("row_count").alias("point_count"),
        from_micros(-F.col("peak.back")).alias("peak_ts"),
        F.col("peak.value").alias("statistic_value"),
        F.col("peak.limit_95").alias("limit_95"),
    )


def event_contributions(
    scored: DataFrame,
    model: Model,
    interval_us: int,
    *,
    keys: Sequence[str] = ("series_id",),
    tag_configs: Mapping[str, Mapping] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Events with the tag shares of their peak row.

    Peaks meet their feature rows on (keys, time), which spreads a busy series evenly. The rows above a limit are
    written once: the runs and the features both read them, not the scoring behind them.
    """
    ensure_checkpoint_dir(scored.sparkSession)
    hit = scored.where(F.col("score_valid") & exceeds(model)["overall"]).select(
        *[col(k) for k in keys], "ts", "t2", "spe", "score_valid", *[col(f) for f in model.features]
    ).checkpoint()
    events = statistic_events(hit, model, interval_us, keys=keys, width=width)
    rows = hit.select(*[col(k) for k in keys], F.col("ts").alias("peak_ts"), *[col(f) for f in model.features])
    at_peak = _magnitudes(events.join(rows, [*keys, "peak_ts"]), model)
    values = F.when(F.col("statistic") == "t2", F.col("_c_t2")).otherwise(F.col("_c_spe"))
    found = fence(at_peak, events.columns, magnitudes=values)
    return found.withColumn("tags", tag_shares(F.col("magnitudes"), model.features, tag_configs)).drop(
        "magnitudes"
    )


def combined_events(
    scored: DataFrame,
    model: Model,
    interval_us: int,
    *,
    keys: Sequence[str] = ("series_id",),
    width: int | None = None,
) -> DataFrame:
    """Runs where T2 or SPE reaches its 95 percent limit."""
    hit = scored.where(F.col("score_valid") & exceeds(model)["overall"])
    found = runs(hit.select(*[col(k) for k in keys], "ts"), interval_us, keys=keys, width=width)
    return found.withColumnsRenamed(
        {"start": "event_start", "end": "event_end", "row_count": "point_count"}
    )
