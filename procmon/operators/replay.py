"""Scoring a stretch of history with a frozen model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmon.config import MINUTE, PreprocessingConfig
from procmon.functions.columns import INF, col, from_micros, micros
from procmon.operators.contributions import exceedance_contributions
from procmon.operators.preprocess import feature_names, preprocess
from procmon.operators.scoring import Model, exceeds, score
from procmon.operators.windows import parse_time

# Classes whose rows survive the state filter and therefore appear in the output.
WAITING = ("filter_warmup", "filter_context", "lag_warmup", "lag_context")
REPLAYED = {
    "schema5": (*WAITING, "valid"),
    "legacy": (*WAITING, "valid", "empty_bin", "input_invalid"),
}


def invalid_reason(tags: Sequence[str]) -> Column:
    """Why a row has no score; NULL for valid rows. Segment numbers count from 0."""
    cls = F.col("row_class")
    waiting = cls.isin(*WAITING)
    infinite = F.lit(False)
    for tag in tags:
        infinite = infinite | F.coalesce(F.abs(col(tag)) == F.lit(INF), F.lit(False))
    return (
        F.when(cls == "valid", F.lit(None).cast("string"))
        .when(waiting & (F.col("raw_segment_id") != 0), "time_gap_reset")
        .when(waiting & (F.col("final_segment_id") != 0), "insufficient_context")
        .when(cls.isin("filter_warmup", "lag_warmup"), "warming_up")
        .when(cls == "empty_bin", "missing_input")
        .when(cls == "input_invalid", F.when(infinite, "non_finite_input").otherwise("missing_input"))
        .otherwise("insufficient_context")
    )


def history_start(start, config: PreprocessingConfig, semantics: str):
    """Start of the history a replay reads; None means all of it."""
    if semantics == "schema5" and config.filter_method == "first_order":
        return None
    return from_micros(
        micros(F.lit(parse_time(start)).cast("timestamp_ntz")) - F.lit(config.context_minutes * MINUTE)
    )


def replay(
    readings: DataFrame,
    model: Model,
    tags: Sequence[str],
    config: PreprocessingConfig,
    start,
    end,
    *,
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    semantics: str = "schema5",
    source_interval_minutes: float | None = None,
    shard_minutes: int | None = None,
    times: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scores of [start, end] and the preprocessed history behind them.

    The history bound is applied before the windows, so it prunes the scan. Rows that
    cannot be scored stay in the result with a reason. `times` as in `preprocess`.
    """
    if list(model.features) != feature_names(tags, config):
        raise ValueError("the model's features do not match the preprocessing")
    first, last = parse_time(start), parse_time(end)
    if first > last:
        raise ValueError("the replay starts after its end")
    upto = F.lit(last).cast("timestamp_ntz")
    bound = history_start(first, config, semantics)
    inside = col(ts) <= upto if bound is None else (col(ts) <= upto) & (col(ts) >= bound)
    rows = preprocess(
        readings.where(inside),
        tags,
        config,
        ts=ts,
        keys=keys,
        semantics=semantics,
        source_interval_minutes=source_interval_minutes,
        shard_minutes=shard_minutes,
        segment_ids=True,
        times=None if times is None else times.where(inside),
    )
    output = rows.where(
        F.col("ts").between(F.lit(first).cast("timestamp_ntz"), upto)
        & F.col("row_class").isin(*REPLAYED[semantics])
    )
    return score(output, model, invalid_reason(tags)), rows


def replay_contributions(
    scores: DataFrame,
    model: Model,
    tag_configs: Mapping[str, Mapping] | None = None,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Tag shares of every scored row and statistic at or above its 95 percent limit."""
    return exceedance_contributions(scores, model, tag_configs).select(
        *[col(k) for k in keys], "ts", "statistic", "statistic_value", "limit_95", "tags"
    )


def replay_summary(
    scores: DataFrame,
    rows: DataFrame,
    model: Model,
    start,
    end,
    *,
    keys: Sequence[str] = ("series_id",),
    semantics: str = "schema5",
) -> DataFrame:
    """Counts, exceedances and maxima per series."""
    key_cols = [col(k) for k in keys]
    valid = F.col("score_valid")
    over = {level: exceeds(model, level) for level in (95, 99)}
    counted = scores.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("output_row_count"),
        F.count_if(valid).alias("score_valid_count"),
        *[
            F.count_if(F.coalesce(F.col("invalid_reason") == r, F.lit(False))).alias(f"reason_{r}")
            for r in ("warming_up", "insufficient_context", "missing_input", "non_finite_input", "time_gap_reset")
        ],
        *[
            F.count_if(F.col("overall_status") == s).alias(f"status_{s}")
            for s in ("normal", "attention", "abnormal", "not_scored")
        ],
        *[
            F.count_if(valid & over[level][name]).alias(f"{name}_exceedance_{level}_count")
            for name in ("t2", "spe")
            for level in (95, 99)
        ],
        F.max("t2").alias("maximum_t2"),
        F.max("spe").alias("maximum_spe"),
    )
    first = F.lit(parse_time(start)).cast("timestamp_ntz")
    last = F.lit(parse_time(end)).cast("timestamp_ntz")
    inputs = (
        F.col("row_class").isin(*REPLAYED["schema5"], "state_filtered")
        if semantics == "schema5"
        else F.col("row_class") != "partial_bin"
    )
    entered = rows.groupBy(*key_cols).agg(
        F.sum("bucket_rows").alias("source_row_count"),
        F.count_if(inputs & F.col("ts").between(first, last)).alias("_entered"),
    )
    return (
        counted.join(entered, list(keys))
        .withColumn("state_filter_excluded_rows", F.col("_entered") - F.col("output_row_count"))
        .drop("_entered")
    )
