"""Training: independent windows to one feature matrix, a model and a loss account."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.config import PreprocessingConfig
from procmon.functions.columns import col
from procmon.operators import dpca
from procmon.operators.losses import loss_summary
from procmon.operators.preprocess import feature_names, preprocess
from procmon.operators.quality import quality_gate
from procmon.operators.scoring import Model
from procmon.operators.windows import in_windows, training_windows, windows_frame


@dataclass(frozen=True)
class TrainingSet:
    """All enabled windows, preprocessed in isolation from each other."""

    rows: DataFrame  # keys, window_id, ts, row_class, features, segment numbers
    windows: DataFrame  # every window, enabled or not
    tags: tuple[str, ...]
    config: PreprocessingConfig
    keys: tuple[str, ...]

    @property
    def features(self) -> list[str]:
        return feature_names(self.tags, self.config)

    @property
    def dynamic(self) -> DataFrame:
        return self.rows.where(F.col("row_class") == "valid").select(
            *[col(k) for k in self.keys], "window_id", "ts", *[col(f) for f in self.features]
        )

    @property
    def reference(self) -> DataFrame:
        """Values of the rows that passed every filter before smoothing and lags."""
        lost = ("partial_bin", "empty_bin", "input_invalid", "engineering_range", "state_filtered")
        values = [f.column for f in self.config.state_filters]
        return self.rows.where(~F.col("row_class").isin(*lost)).select(
            *[col(k) for k in self.keys], "window_id", "ts", *[col(n) for n in dict.fromkeys([*self.tags, *values])]
        )


def build_training_set(
    readings: DataFrame,
    windows: Sequence[Mapping],
    tags: Sequence[str],
    config: PreprocessingConfig,
    *,
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    engineering_ranges: Mapping[str, tuple[float, float]] | None = None,
    exclude_engineering_range: bool = False,
    source_interval_minutes: float | None = None,
    preserve: Sequence[str] = (),
    shard_minutes: int | None = None,
    tag_configs: Mapping[str, Mapping] | None = None,
    check_quality: bool = False,
    times: DataFrame | None = None,
) -> TrainingSet:
    """Cut the readings into the enabled windows and preprocess all of them in one job.

    With `tag_configs` the roles of the tags are checked; `check_quality` refuses readings
    with faults that must not be trained on, and runs a job for it. `times` as in `preprocess`.
    """
    if tag_configs is not None:
        required_roles(tags, [f.column for f in config.state_filters], tag_configs)
    checked = training_windows(list(windows))
    enabled = [w for w in checked if w["enabled"]]
    if not enabled:
        raise ValueError("at least one training window must be enabled")
    frame = windows_frame(readings.sparkSession, checked)
    # The outer bounds reach the scan; the join then assigns rows to windows.
    first, last = min(w["start"] for w in enabled), max(w["end"] for w in enabled)
    inside = col(ts).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
    near = readings.where(inside)
    bounds = frame.where("enabled").select("window_id", "window_start", "window_end")
    if check_quality:
        quality_gate(
            near, tags, ts=ts, keys=keys, expected_interval_minutes=source_interval_minutes or config.sample_interval_minutes,
            engineering_ranges=engineering_ranges, variability=True,
        )
    rows = preprocess(
        in_windows(near, bounds, ts=ts),
        tags,
        config,
        ts=ts,
        keys=[*keys, "window_id"],
        engineering_ranges=engineering_ranges,
        exclude_engineering_range=exclude_engineering_range,
        preserve=preserve,
        bounds=("window_start", "window_end"),
        source_interval_minutes=source_interval_minutes,
        shard_minutes=shard_minutes,
        segment_ids=True,
        times=None if times is None else in_windows(times.where(inside), bounds, ts=ts),
    )
    return TrainingSet(rows, frame, tuple(tags), config, tuple(keys))


def _outcome(summary: DataFrame, config: PreprocessingConfig) -> DataFrame:
    used = F.col("final_dynamic_row_count") > 0
    nothing = (F.col("resampled_row_count") == 0) & F.lit(config.resamples)
    return (
        summary.withColumn("status", F.when(used, "used").otherwise("dropped"))
        .withColumn(
            "dropped_reason",
            F.when(~used, F.when(nothing, "no_complete_resampling_bins").otherwise("insufficient_after_smoothing_and_lag")),
        )
        .withColumn("smoothing_lag_loss", F.col("filter_warmup_loss") + F.col("lag_warmup_loss"))
    )


def segment_summary(training: TrainingSet) -> DataFrame:
    """Losses and outcome per window and physical segment."""
    by = [*training.keys, "window_id", "raw_segment_id"]
    spans = {"start": F.min("bucket_first"), "end": F.max("bucket_last")}
    counted = loss_summary(training.rows, training.config, by=by, n_tags=len(training.tags), more=spans)
    result = _outcome(counted, training.config)
    number = F.format_string("%s-segment-%03d", F.col("window_id"), F.col("raw_segment_id") + 1)
    return result.withColumn("segment_name", number).drop("raw_segment_count", "raw_gap_count")


def window_summary(training: TrainingSet) -> DataFrame:
    """Losses and outcome per window; disabled and empty windows are listed too."""
    by = [*training.keys, "window_id"]
    counted = _outcome(
        loss_summary(training.rows, training.config, by=by, n_tags=len(training.tags)), training.config
    )
    listed = training.windows
    if training.keys:
        series = training.rows.select(*[col(k) for k in training.keys]).distinct()
        listed = F.broadcast(listed).crossJoin(series)  # windows are a short hand-written list
    joined = listed.join(counted, by, "left")
    return joined.withColumn(
        "status", F.when(~F.col("enabled"), "disabled").otherwise(F.coalesce("status", F.lit("dropped")))
    ).withColumn(
        "dropped_reason",
        F.when(F.col("enabled") & F.col("source_row_count").isNull(), "no_raw_samples").otherwise(
            F.col("dropped_reason")
        ),
    )


def window_totals(summary: DataFrame) -> DataFrame:
    """Enabled, used and dropped windows and the rows that train the model."""
    return summary.agg(
        F.count_if("enabled").alias("enabled_window_count"),
        F.count_if(F.col("status") == "used").alias("used_window_count"),
        F.count_if(F.col("status") == "dropped").alias("dropped_window_count"),
        F.coalesce(F.sum("final_dynamic_row_count"), F.lit(0)).alias("training_rows"),
    )


def duplicate_times(dynamic: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Feature times that several windows produced; a sound training set has none."""
    return (
        dynamic.groupBy(*[col(k) for k in keys], "ts")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def train(
    training: TrainingSet, variance_threshold: float = 0.95, n_components: int | None = None
) -> Model:
    """One model over all enabled windows; a time that two of them produced is refused."""
    if not duplicate_times(training.dynamic, training.keys).isEmpty():
        raise ValueError("training windows produce the same time twice")
    return dpca.fit(training.dynamic, training.features, variance_threshold, n_components)


def train_per_series(
    training: TrainingSet, variance_threshold: float = 0.95, n_components: int | None = None
) -> DataFrame:
    return dpca.fit_series(
        training.dynamic,
        training.features,
        keys=training.keys,
        variance_threshold=variance_threshold,
        n_components=n_components,
    )


def required_roles(tags: Sequence[str], states: Sequence[str], tag_configs: Mapping[str, Mapping]) -> None:
    """Only continuous inputs may enter a model, only state filters may filter."""
    wrong = [
        t for t in tags if tag_configs.get(t, {}).get("role", "continuous_input") != "continuous_input"
    ]
    wrong += [s for s in states if tag_configs.get(s, {}).get("role") != "state_filter"]
    if wrong:
        raise ValueError(f"tags with an unsuitable role: {', '.join(wrong)}")
