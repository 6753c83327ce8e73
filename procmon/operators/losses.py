"""Where rows were lost between the raw data and the feature matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmon.config import PreprocessingConfig
from procmon.functions.columns import col

# Classes of rows that reach the state filter, and of those that pass it.
PASSED = {
    "schema5": ("filter_warmup", "filter_context", "lag_warmup", "lag_context", "valid"),
    "legacy": (
        "empty_bin", "input_invalid", "filter_warmup", "filter_context", "lag_warmup", "lag_context", "valid",
    ),
}


def loss_summary(
    rows: DataFrame,
    config: PreprocessingConfig,
    *,
    by: Sequence[str] = ("series_id",),
    semantics: str = "schema5",
    n_tags: int = 0,
    more: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Counters of one preprocessed frame per group, in a single aggregation, with `more` aggregates if wanted."""
    cls = F.col("row_class")
    partial = cls == "partial_bin"
    present = ~partial
    passed = cls.isin(*PASSED[semantics])
    entered = passed | (cls == "state_filtered")
    count = lambda when: F.count_if(when)
    reduction = (
        F.sum(F.when(present, F.col("bucket_rows")).otherwise(0)) - count(present & (F.col("bucket_rows") > 0))
        if config.resamples
        else F.lit(0)
    )
    return rows.groupBy(*[col(b) for b in by]).agg(
        F.sum("bucket_rows").alias("source_row_count"),
        count(present).alias("resampled_row_count"),
        reduction.cast("long").alias("resampling_row_reduction"),
        count(present & (F.col("bucket_rows") == 0)).alias("empty_bin_count"),
        count(partial).alias("partial_resampling_bin_loss"),
        F.sum(F.when(partial, F.col("bucket_rows")).otherwise(0)).alias("partial_resampling_row_loss"),
        count(F.col("raw_segment_start")).alias("raw_segment_count"),
        (count(F.col("raw_segment_start")) - 1).alias("raw_gap_count"),
        count(cls == "input_invalid").alias("input_invalid_loss"),
        count(cls == "engineering_range").alias("engineering_range_loss"),
        count(entered).alias("state_filter_input_rows"),
        count(passed).alias("state_filter_output_rows"),
        count(cls == "state_filtered").alias("state_filter_loss"),
        count(cls == "filter_warmup").alias("filter_warmup_loss"),
        count(cls == "filter_context").alias("filter_context_invalid_loss"),
        count(cls == "lag_warmup").alias("lag_warmup_loss"),
        count(cls == "lag_context").alias("lag_context_invalid_loss"),
        count(cls == "valid").alias("final_dynamic_row_count"),
        F.lit(n_tags * len(config.lags)).alias("dynamic_feature_count"),
        *[value.alias(name) for name, value in (more or {}).items()],
    )


def loss_ratios(summary: DataFrame) -> DataFrame:
    """Share of resampled rows that were lost, and share that can be explored.

    State-filter loss here is everything that did not pass the state filter, so invalid
    inputs count in it as well as on their own.
    """
    state = F.greatest(
        F.lit(0), F.col("resampled_row_count") - F.col("state_filter_output_rows")
    )
    lost = (
        F.col("input_invalid_loss")
        + F.col("filter_warmup_loss")
        + F.col("filter_context_invalid_loss")
        + F.col("lag_warmup_loss")
        + F.col("lag_context_invalid_loss")
        + state
    )
    rows = F.col("resampled_row_count")
    share = lambda value: F.when(rows > 0, value / rows).otherwise(F.lit(0.0))
    return summary.withColumn("loss_count", lost).withColumn("loss_ratio", share(lost)).withColumn(
        "effective_coverage_ratio", share(F.col("final_dynamic_row_count"))
    )


def engineering_losses(rows: DataFrame, tags: Sequence[str], by: Sequence[str] = ("series_id",)) -> DataFrame:
    """Rows each tag's engineering range removed; a row can count for several tags."""
    ranged = [t for t in tags if f"{t}__outside" in rows.columns]
    cells = [
        F.struct(F.lit(t).alias("tag"), col(f"{t}__outside").alias("hit")) for t in ranged
    ]
    lost = rows.where(F.col("row_class") == "engineering_range").select(
        *[col(b) for b in by], F.inline(F.array(*cells))
    )
    return lost.where("hit").groupBy(*[col(b) for b in by], "tag").agg(F.count(F.lit(1)).alias("lost_rows"))
