"""Best sliding windows of a performance tag, without overlaps."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.config import MINUTE, PerformanceConfig
from procmon.functions.columns import col, from_micros, is_finite, micros, range_deviation, within
from procmon.operators.clustering import stability
from procmon.operators.shards import OWN, SHARD, default_width, shard_rows
from procmon.operators.windows import in_windows


def window_rows(config: PerformanceConfig, interval_us: int) -> int:
    return ceil(config.minimum_duration_minutes * MINUTE / interval_us)


def sliding_windows(
    points: DataFrame,
    value: str,
    config: PerformanceConfig,
    interval_us: int,
    *,
    keys: Sequence[str] = ("series_id",),
    segment: str | None = None,
    width: int | None = None,
) -> DataFrame:
    """Every gap-free window of the configured length: start, end and ranking measures.

    Windows end at their last row; shards read the rows before them from their halo. The time a row
    takes does not grow with the length of the window. A shard, with its halo, is one Arrow group; it holds at most
    twice the larger of the rows of a shard and of a window.
    """
    w = window_rows(config, interval_us)
    width = max(width or default_width(interval_us), w * interval_us)
    names = {f"k{i}": col(k) for i, k in enumerate(keys)}
    value_type = points.schema[value].dataType
    x = col(value).cast("double")
    off = range_deviation(x, config.lower, config.upper) if config.direction == "target_range" else F.lit(0.0)
    finite = points.where(is_finite(col(value))).select(
        *[c.alias(n) for n, c in names.items()],
        micros(F.col("ts")).alias("us"),
        x.alias("x"),
        within(x, config.target_min, config.target_max).cast("double").alias("hit"),
        off.alias("off"),
        (col(segment) if segment else F.lit(None).cast("int")).alias("seg"),
    )
    rows = shard_rows(finite, "us", width, (w - 1) * interval_us)
    measures = ["mean", "median", "minimum", "maximum", "target_ratio", "mean_target_deviation"]
    kept = [f for f in finite.schema.fields if f.name in names or f.name == "us"]
    schema = T.StructType([*kept, *[T.StructField(m, T.DoubleType()) for m in measures]])

    def measure(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("us")
        us = shard["us"].to_numpy()
        ends = np.flatnonzero((_run_lengths(us, shard["seg"], interval_us) >= w) & shard[OWN].to_numpy())
        values = {n: shard[n].to_numpy() for n in ("x", "hit", "off")}
        median = pd.Series(values["x"]).rolling(w).median().to_numpy()
        columns = [
            trailing(np.add, values["x"], w, ends) / w,
            median[ends],
            trailing(np.minimum, values["x"], w, ends),
            trailing(np.maximum, values["x"], w, ends),
            trailing(np.add, values["hit"], w, ends) / w,
            trailing(np.add, values["off"], w, ends) / w,
        ]
        rest = shard.select([f.name for f in kept]).take(pa.array(ends))
        return pa.table([*rest.columns, *map(pa.array, columns)], [*rest.column_names, *measures])

    measured = rows.groupBy(*names, SHARD).applyInArrow(measure, schema)
    return measured.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        from_micros(F.col("us") - (w - 1) * interval_us).alias("start"),
        from_micros(F.col("us")).alias("end"),
        F.lit(w).alias("sample_count"),
        "mean",
        "median",
        F.col("minimum").cast(value_type).alias("minimum"),
        F.col("maximum").cast(value_type).alias("maximum"),
        "target_ratio",
        "mean_target_deviation",
    )


def _run_lengths(us: np.ndarray, segments: pa.ChunkedArray, interval_us: int) -> np.ndarray:
    """How many rows in unbroken succession end at each row; NULL is a segment of its own."""
    codes = segments.combine_chunks().dictionary_encode(null_encoding="encode")
    codes = (pa.concat_arrays(codes.chunks) if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
    at = np.arange(len(us))
    broken = np.ones(len(us), bool)
    broken[1:] = (np.diff(us) != interval_us) | (np.diff(codes) != 0)
    return at - np.maximum.accumulate(np.where(broken, at, 0)) + 1


def trailing(combine: np.ufunc, values: np.ndarray, w: int, ends: np.ndarray) -> np.ndarray:
    """`combine` over the w values up to each of `ends`, which must not lie before row w - 1.

    The values are cut into blocks of w. A window is the tail of one block and the head of the next, so two
    running results are enough for any window. Nothing is ever taken away again: the rounding is that of a plain sum.
    """
    blocks = np.concatenate([values, np.zeros(-len(values) % w)]).reshape(-1, w)
    heads = combine.accumulate(blocks, axis=1).ravel()
    tails = combine.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.where((ends + 1) % w == 0, heads[ends], combine(tails[ends - (w - 1)], heads[ends]))


def _ranking(config: PerformanceConfig) -> list:
    if config.direction == "higher_is_better":
        return [F.col("mean").desc(), F.col("median").desc(), F.col("start")]
    if config.direction == "lower_is_better":
        return [F.col("mean"), F.col("median"), F.col("start")]
    return [F.col("target_ratio").desc(), F.col("mean_target_deviation"), F.col("mean"), F.col("start")]


def best_windows(
    windows: DataFrame,
    config: PerformanceConfig,
    interval_us: int,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """The best windows of each series that share no row, ranked.

    A pick rules out at most 2w - 1 window starts, so the best k * (2w - 1) windows of a
    series always hold its k picks. Spark cuts every partition to that many before the
    shuffle, and only they reach the greedy pass.
    """
    w, k = window_rows(config, interval_us), config.candidate_count
    order = Window.partitionBy(*[col(c) for c in keys]).orderBy(*_ranking(config))
    shortlist = windows.withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= k * (2 * w - 1)
    )
    reach = pd.Timedelta(microseconds=(w - 1) * interval_us)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        taken: list[int] = []
        starts = group["start"].tolist()
        for i, start in enumerate(starts):
            if len(taken) == k:
                break
            if all(abs(start - starts[j]) > reach for j in taken):
                taken.append(i)
        return group.iloc[taken].assign(rank=range(1, len(taken) + 1)).drop(columns="place")

    fields = [f for f in shortlist.schema.fields if f.name != "place"]
    schema = T.StructType([*fields, T.StructField("rank", T.IntegerType())])
    return shortlist.groupBy(*[col(c) for c in keys]).applyInPandas(pick, schema)


def performance_candidates(
    points: DataFrame,
    value: str,
    config: PerformanceConfig,
    interval_us: int,
    *,
    keys: Sequence[str] = ("series_id",),
    segment: str | None = None,
    width: int | None = None,
) -> DataFrame:
    """Best windows with the clusters they touch and how steady their scores are."""
    every = sliding_windows(points, value, config, interval_us, keys=keys, segment=segment, width=width)
    best = best_windows(every, config, interval_us, keys)
    inside = in_windows(
        points.select(*[col(k) for k in keys], "ts", "cluster_id", "center_distance"),
        best.select(*[col(k) for k in keys], "rank", "start", "end"),
        start="start",
        end="end",
        on=keys,
    )
    by = [*keys, "rank"]
    clusters = inside.groupBy(*[col(b) for b in by]).agg(
        F.array_sort(F.collect_set("cluster_id")).alias("associated_cluster_ids")  # at most ten
    )
    result = best.join(clusters, by).join(stability(inside, by), by)
    step = interval_us // MINUTE
    return result.withColumn(
        "candidate_id", F.format_string("performance-candidate-%03d", F.col("rank"))
    ).withColumn("duration_minutes", F.col("sample_count") * step)
