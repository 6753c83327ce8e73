"""Operating states: clusters of component scores and what characterises them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmon.config import ExplorationConfig
from procmon.functions.columns import col, covered_minutes, feature_name, micros
from procmon.operators import dpca
from procmon.operators.quantiles import exact_quantiles
from procmon.operators.runs import longest_runs, runs, tag_runs
from procmon.operators.scoring import Model, score
from procmon.session import ensure_checkpoint_dir

STARTS = 10  # k-means initialisations; the cheapest wins
MAD_SCALE = 1.4826


def fit_centers(points: DataFrame, pcs: Sequence[str], k: int, seed: int = 0) -> list[list[float]]:
    """K-means centers, numbered by their coordinates in ascending order."""
    if not 2 <= k <= 10:
        raise ValueError("the cluster count must lie between 2 and 10")
    if len(pcs) < 2:
        raise ValueError("clustering needs at least two components")
    chosen = points.select(*[col(p).alias(f"c{i}") for i, p in enumerate(pcs)])
    vectors = VectorAssembler(inputCols=chosen.columns, outputCol="v").transform(chosen).select("v")
    chosen = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if chosen.limit(k + 1).count() <= k:
            raise ValueError("clustering needs more rows than clusters")
        if chosen.distinct().limit(k).count() < k:
            raise ValueError("there are fewer distinct states than clusters")
        best = None
        for start in range(STARTS):
            model = KMeans(featuresCol="v", k=k, seed=seed + start).fit(chosen)
            cost = model.summary.trainingCost
            if best is None or cost < best[0]:
                best = (cost, [c.tolist() for c in model.clusterCenters()])
    finally:
        chosen.unpersist()
    return sorted(best[1])


def distance(pcs: Sequence[str], center: Sequence[float]) -> Column:
    return F.sqrt(
        reduce(lambda a, b: a + b, [(col(p) - F.lit(float(c))) * (col(p) - F.lit(float(c))) for p, c in zip(pcs, center)])
    )


def assign(points: DataFrame, pcs: Sequence[str], centers: Sequence[Sequence[float]]) -> DataFrame:
    """Add the nearest center's id (`cluster_001` ...) and the distance to it."""
    options = [
        F.struct(distance(pcs, c).alias("d"), F.lit(f"cluster_{i + 1:03d}").alias("id"))
        for i, c in enumerate(centers)
    ]
    return (
        points.withColumn("_near", F.array_min(F.array(*options)))
        .withColumn("cluster_id", F.col("_near.id"))
        .withColumn("center_distance", F.col("_near.d"))
        .drop("_near")
    )


def cluster_rows(
    rows: DataFrame, features: Sequence[str], k: int, *, n_components: int | None = None, seed: int = 0
) -> tuple[DataFrame, list[list[float]], Model]:
    """States of rows that have no model yet: components of their own, then centers and assignment."""
    model = dpca.fit(rows, features, n_components=n_components)
    if model.k < 2:
        model = dpca.fit(rows, features, n_components=2)
    scored = score(rows, model)
    centers = fit_centers(scored, model.pcs, k, seed)
    return assign(scored, model.pcs, centers), centers, model


def cluster_with_model(
    rows: DataFrame, features: Sequence[str], model: Model, centers: Sequence[Sequence[float]]
) -> DataFrame:
    """States of new rows under a saved model; its features must be those given, in the same order."""
    if list(features) != list(model.features):
        raise ValueError("the features differ from the model's, or their order does")
    if any(len(c) != model.k for c in centers):
        raise ValueError("the centers do not match the model's components")
    return assign(score(rows, model), model.pcs, centers)


def state_runs(
    points: DataFrame,
    interval_us: int,
    *,
    keys: Sequence[str] = ("series_id",),
    segment: str | None = None,
    width: int | None = None,
) -> DataFrame:
    """Stretches that stay in one cluster (and in one segment, if given)."""
    same = ["cluster_id", *([segment] if segment else [])]
    return runs(points, interval_us, keys=keys, same=same, width=width)


def representative_runs(points: DataFrame, interval_us: int, *, keys=("series_id",), limit: int = 3,
                        width: int | None = None) -> DataFrame:
    found = state_runs(points, interval_us, keys=keys, width=width)
    return longest_runs(found, limit, keys=keys, extra=["cluster_id"])


def cluster_counts(points: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Rows, share and center of each cluster."""
    spots = points.sparkSession.createDataFrame(
        [(f"cluster_{i + 1:03d}", [float(v) for v in c]) for i, c in enumerate(centers)],
        "cluster_id string, center array<double>",
    )
    counted = points.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("sample_count"))
    whole = F.sum("sample_count").over(Window.partitionBy())  # at most ten rows
    return spots.join(F.broadcast(counted), "cluster_id", "left").select(
        "cluster_id",
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        (F.coalesce("sample_count", F.lit(0)) / whole).alias("share"),
        "center",
    )


def cluster_summary(
    points: DataFrame,
    tags: Sequence[str],
    interval_us: int,
    *,
    keys: Sequence[str] = ("series_id",),
    segment: str | None = None,
    width: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(per cluster, per cluster and tag): size, duration, spread, and unlagged tag values.

    The points are written once: the counts, both quantiles, the runs and the values read them, not the scoring behind them.
    """
    needed = dict.fromkeys([*keys, "ts", "cluster_id", "center_distance", *([segment] if segment else []), *[feature_name(t, 0) for t in tags]])
    ensure_checkpoint_dir(points.sparkSession)
    points = points.select(*[col(c) for c in needed]).checkpoint()
    counted = points.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.stddev_pop("center_distance").alias("pc_score_dispersion"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
    )
    medians = exact_quantiles(
        points, ["cluster_id"], "center_distance", {"median_distance_to_centroid": 0.5}
    )
    stretches = state_runs(points, interval_us, keys=keys, segment=segment, width=width)
    lengths = stretches.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("segment_count"),
        F.sum(covered_minutes(micros(F.col("start")), micros(F.col("end")), interval_us)).alias(
            "total_duration_minutes"
        ),
    )
    total = F.sum("sample_count").over(Window.partitionBy())  # at most ten rows
    clusters = (
        counted.join(medians, "cluster_id")
        .join(lengths, "cluster_id")
        .withColumn("coverage_ratio", F.col("sample_count") / total)
    )
    cells = points.select(
        "cluster_id",
        F.inline(
            F.array(
                *[F.struct(F.lit(t).alias("tag"), col(feature_name(t, 0)).alias("value")) for t in tags]
            )
        ),
    )
    stats = cells.groupBy("cluster_id", "tag").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("minimum"),
        F.max("value").alias("maximum"),
    )
    middle = exact_quantiles(cells, ["cluster_id", "tag"], "value", {"median": 0.5})
    return clusters, stats.join(middle, ["cluster_id", "tag"])


def stability(rows: DataFrame, by: Sequence[str], value: str = "center_distance") -> DataFrame:
    """1 / (1 + 1.4826 * median absolute deviation) of the distances per group."""
    middle = exact_quantiles(rows, by, value, {"_m": 0.5})
    off = rows.join(middle, list(by)).withColumn("_off", F.abs(col(value) - F.col("_m")))
    spread = exact_quantiles(off, by, "_off", {"_mad": 0.5})
    return spread.withColumn("stability_score", 1.0 / (1.0 + MAD_SCALE * F.col("_mad"))).drop("_mad")


def cluster_candidates(
    points: DataFrame,
    pcs: Sequence[str],
    centers: Sequence[Sequence[float]],
    config: ExplorationConfig,
    interval_us: int,
    *,
    keys: Sequence[str] = ("series_id",),
    segment: str | None = None,
    width: int | None = None,
) -> DataFrame:
    """Long, calm stretches near their cluster's center, best first within each cluster."""
    same = ["cluster_id", *([segment] if segment else [])]
    # Written once: the rows and the shard ends that carry runs on both read them, not the scoring behind them.
    ensure_checkpoint_dir(points.sparkSession)
    points = points.select(
        *[col(k) for k in keys], "ts", *[col(s) for s in same], "center_distance", *[col(p) for p in pcs]
    ).checkpoint()
    tagged = tag_runs(points, interval_us, keys=keys, same=same, width=width)
    # Read four times below; written once so that the runs are not found again each time.
    tagged = tagged.checkpoint()
    by = [*keys, "cluster_id", "run_start"]
    means = tagged.groupBy(*[col(b) for b in by]).agg(
        F.max("ts").alias("run_end"),
        F.count(F.lit(1)).alias("sample_count"),
        *[F.avg(col(p)).alias(p) for p in pcs],
    )
    means = means.withColumn(
        "duration_minutes", covered_minutes(micros(F.col("run_start")), micros(F.col("run_end")), interval_us)
    ).where(F.col("duration_minutes") >= config.minimum_candidate_duration_minutes)
    off = F.lit(None).cast("double")
    for i, center in enumerate(centers):
        off = F.when(F.col("cluster_id") == f"cluster_{i + 1:03d}", distance(pcs, center)).otherwise(off)
    means = means.withColumn("centroid_distance", off).drop(*pcs)
    long_enough = tagged.join(means.select(*[col(b) for b in by]), by, "left_semi")
    ranked = means.join(stability(long_enough, by), by)
    order = Window.partitionBy(*[col(k) for k in keys], "cluster_id").orderBy(
        F.col("centroid_distance"),
        F.col("stability_score").desc(),
        F.col("duration_minutes").desc(),
        F.col("run_start"),
    )
    return (
        ranked.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= config.candidate_count_per_cluster)
        .withColumn("candidate_id", F.format_string("%s-candidate-%03d", F.col("cluster_id"), F.col("rank")))
        .withColumn("completeness_ratio", F.lit(1.0))
        .withColumnsRenamed({"run_start": "start", "run_end": "end"})
    )
