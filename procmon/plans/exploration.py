"""State exploration: cluster a history and propose periods worth a look."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.config import ExplorationConfig, PerformanceConfig, PreprocessingConfig
from procmon.functions.columns import col, iso, require_columns, to_number
from procmon.operators import clustering, dpca
from procmon.operators.downsample import downsample_states
from procmon.operators.losses import loss_ratios, loss_summary
from procmon.operators.performance import performance_candidates
from procmon.operators.preprocess import feature_names, preprocess
from procmon.operators.scoring import Model, score
from procmon.session import ensure_checkpoint_dir

# Thresholds of the warnings.
FEW_ROWS = 3
LOW_COVERAGE = 0.5
HIGH_LOSS = 0.3


@dataclass(frozen=True)
class Exploration:
    model: Model
    centers: list[list[float]]
    points: DataFrame  # scores with cluster_id, center_distance, segment and lag-0 values
    losses: DataFrame
    clusters: DataFrame
    tag_statistics: DataFrame
    candidates: DataFrame
    performance: DataFrame | None
    warnings: DataFrame
    display: DataFrame


def explore(
    readings: DataFrame,
    tags: Sequence[str],
    config: PreprocessingConfig,
    exploration: ExplorationConfig = ExplorationConfig(),
    performance: PerformanceConfig | None = None,
    *,
    performance_series: DataFrame | None = None,
    keys: Sequence[str] = ("series_id",),
    engineering_ranges: Mapping[str, tuple[float, float]] | None = None,
    bounds: tuple[str, str] | None = None,
    source_interval_minutes: float | None = None,
    shard_minutes: int | None = None,
) -> Exploration:
    """Preprocess, fit a throw-away model, cluster its scores and rank candidate periods.

    The feature rows are written to the checkpoint folder once, as fitting and clustering
    read them many times.
    """
    preserve = []
    if performance and performance_series is None:
        require_columns(readings, [performance.performance_tag])
        if performance.performance_tag not in tags:
            preserve = [performance.performance_tag]
    rows = preprocess(
        readings, tags, config, keys=keys, engineering_ranges=engineering_ranges, preserve=preserve,
        bounds=bounds, source_interval_minutes=source_interval_minutes, shard_minutes=shard_minutes,
        segment_ids=True, intermediates=True,
    )
    features = feature_names(tags, config)
    valid = rows.where(F.col("row_class") == "valid")
    if preserve:
        valid = valid.withColumn("_performance", col(f"{preserve[0]}__filtered"))
    elif performance and performance_series is None:
        valid = valid.withColumn("_performance", col(f"{performance.performance_tag}__filtered"))
    valid = valid.select(
        *[col(k) for k in keys], "ts", "final_segment_id", *[col(f) for f in features],
        *(["_performance"] if "_performance" in valid.columns else []),
    )
    ensure_checkpoint_dir(readings.sparkSession)
    valid = valid.checkpoint()
    model = dpca.fit(valid, features)
    scored = score(valid, model).where("score_valid")
    centers = clustering.fit_centers(scored, model.pcs, exploration.cluster_count, exploration.random_state)
    points = clustering.assign(scored, model.pcs, centers).checkpoint()
    interval = config.interval_us
    segment = "final_segment_id"
    candidates = clustering.cluster_candidates(
        points, model.pcs, centers, exploration, interval, keys=keys, segment=segment
    )
    clusters, tag_statistics = clustering.cluster_summary(points, tags, interval, keys=keys, segment=segment)
    counts = candidates.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    clusters = clusters.join(counts, "cluster_id", "left").withColumn(
        "candidate_count", F.coalesce("candidate_count", F.lit(0))
    )
    best = None
    if performance:
        if performance_series is not None:
            given = performance_series.select(
                *[col(k) for k in keys], "ts",
                to_number(performance_series, performance.performance_tag).alias("_performance"),
            )
            twice = given.groupBy(*[col(k) for k in keys], "ts").count().where("count > 1")
            if not twice.isEmpty():
                raise ValueError("the performance series repeats a time")
            points = points.drop("_performance").join(given, [*keys, "ts"], "left")
        best = performance_candidates(
            points, "_performance", performance, interval, keys=keys, segment=segment
        )
    losses = loss_ratios(loss_summary(rows, config, by=keys, n_tags=len(tags)))
    return Exploration(
        model, centers, points, losses, clusters, tag_statistics, candidates, best,
        exploration_warnings(clusters, losses, best, performance),
        downsample_states(points, interval, keys=keys, segment=segment, limit=exploration.maximum_plot_points),
    )


def exploration_warnings(
    clusters: DataFrame,
    losses: DataFrame,
    best: DataFrame | None = None,
    performance: PerformanceConfig | None = None,
) -> DataFrame:
    """code, cluster_id, value, threshold."""

    def warn(frame, when, code, value, threshold, cluster=None):
        return frame.where(when).select(
            F.lit(code).alias("code"),
            (cluster if cluster is not None else F.lit(None).cast("string")).alias("cluster_id"),
            value.cast("double").alias("value"),
            F.lit(float(threshold)).alias("threshold"),
        )

    name = F.col("cluster_id")
    total = losses.agg(
        F.sum("loss_count").alias("lost"), F.sum("resampled_row_count").alias("n"),
        F.sum("final_dynamic_row_count").alias("valid"),
    ).select(
        (F.col("lost") / F.col("n")).alias("loss"), (F.col("valid") / F.col("n")).alias("coverage")
    )
    parts = [
        warn(clusters, F.col("sample_count") < FEW_ROWS, "cluster_sample_count_low", F.col("sample_count"), FEW_ROWS, name),
        warn(clusters, F.col("candidate_count") == 0, "cluster_has_no_candidate", F.col("candidate_count"), 1, name),
        warn(total, F.col("coverage") < LOW_COVERAGE, "exploration_coverage_low", F.col("coverage"), LOW_COVERAGE),
        warn(total, F.col("loss") > HIGH_LOSS, "preprocessing_loss_ratio_high", F.col("loss"), HIGH_LOSS),
    ]
    if best is not None:
        found = best.agg(F.count(F.lit(1)).alias("n"))
        k = performance.candidate_count
        parts.append(warn(found, F.col("n") < k, "performance_candidate_insufficient", F.col("n"), k))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def accepted_windows(
    candidates: DataFrame, decisions: DataFrame, existing: DataFrame, run_id: str, source: str = "cluster"
) -> DataFrame:
    """Accepted candidates as disabled training windows that are not listed yet."""
    chosen = candidates.join(
        decisions.where(F.col("decision") == "accepted").select("candidate_id", "comment"), "candidate_id"
    )
    made = chosen.select(
        F.format_string(f"state-exploration-{run_id}-%s", F.col("candidate_id")).alias("window_id"),
        F.col("start").alias("window_start"),
        F.col("end").alias("window_end"),
        F.lit(source).alias("source"),
        F.col("candidate_id").alias("source_ref"),
        F.lit(False).alias("enabled"),
        "comment",
    )
    return made.join(existing.select("window_id"), "window_id", "left_anti")


def candidate_records(candidates: DataFrame) -> DataFrame:
    """Candidates with ISO times, as reports show them."""
    return candidates.withColumn("start", iso(F.col("start"))).withColumn("end", iso(F.col("end")))
