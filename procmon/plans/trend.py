"""Trend views: raw, resampled and filtered values of a few tags side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmon.config import PreprocessingConfig
from procmon.functions.columns import col, is_finite, micros, to_number
from procmon.operators import quality
from procmon.operators.downsample import downsample_trend
from procmon.operators.losses import PASSED
from procmon.operators.preprocess import preprocess, raw_threshold_us
from procmon.operators.shards import default_width, with_previous

MAX_TAGS = 8
MODES = ("raw", "smoothed", "both")


def _gap_starts(rows: DataFrame, keys, threshold_us: int, width: int) -> DataFrame:
    """Mark rows that follow a physical gap; the first row of a series never does."""
    shaped = with_previous(
        rows.withColumn("_us", micros(F.col("ts"))), keys, "_us", width, {"_before": F.col("_us")}
    )
    return shaped.withColumn(
        "gap_start", F.coalesce(F.col("_us") - F.col("_before") > threshold_us, F.lit(False))
    ).drop("_us", "_before")


def trend_stages(
    readings: DataFrame,
    tags: Sequence[str],
    config: PreprocessingConfig,
    *,
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    source_interval_minutes: float | None = None,
    shard_minutes: int | None = None,
) -> dict[str, DataFrame]:
    """{"raw", "resampled", "filtered"}: keys, ts, gap_start and the tags."""
    if len(tags) > MAX_TAGS:
        raise ValueError(f"a trend shows at most {MAX_TAGS} tags")
    key_cols = [col(k) for k in keys]
    threshold = raw_threshold_us(config, source_interval_minutes)
    width = default_width(config.interval_us)
    raw = readings.select(
        *key_cols, col(ts).alias("ts"), *[to_number(readings, t).alias(t) for t in tags]
    )
    rows = preprocess(
        readings, tags, config, ts=ts, keys=keys, source_interval_minutes=source_interval_minutes,
        shard_minutes=shard_minutes, intermediates=True, segment_ids=True,
    )
    first = (F.col("raw_segment_id") == 0) & F.col("raw_segment_start")
    rows = rows.withColumn("gap_start", F.col("raw_segment_start") & ~first)
    kept = rows.where(F.col("row_class").isin(*PASSED["schema5"]))
    return {
        "raw": _gap_starts(raw, keys, threshold, width),
        "resampled": rows.select(*key_cols, "ts", "gap_start", *[col(t) for t in tags]),
        "filtered": kept.select(
            *key_cols, "ts", "gap_start", *[col(f"{t}__filtered").alias(t) for t in tags]
        ),
    }


def trend_rows(
    stages: Mapping[str, DataFrame],
    tags: Sequence[str],
    start,
    end,
    mode: str = "both",
    *,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Rows to plot in [start, end]: `{tag}__raw`, `{tag}__smoothed` and gap markers.

    Gap markers come from the full series, so cutting the view does not move them.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    inside = lambda df: df.where(F.col("ts").between(F.lit(start), F.lit(end)))
    named = lambda df, mark, gap: inside(df).select(
        *[col(k) for k in keys], "ts", F.col("gap_start").alias(gap),
        *[col(t).alias(f"{t}__{mark}") for t in tags],
    )
    raw = named(stages["raw"], "raw", "raw_gap_start")
    smooth = named(stages["filtered"], "smoothed", "filtered_gap_start")
    how = {"raw": "left", "smoothed": "right", "both": "full"}[mode]
    joined = raw.join(smooth, [*keys, "ts"], how)
    for name in ("raw_gap_start", "filtered_gap_start"):
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return joined.withColumn("gap_start", F.col("raw_gap_start") | F.col("filtered_gap_start"))


def trend_view(
    stages: Mapping[str, DataFrame],
    tags: Sequence[str],
    start,
    end,
    mode: str = "both",
    *,
    keys: Sequence[str] = ("series_id",),
    tag_configs: Mapping[str, Mapping] | None = None,
    reference: tuple | None = None,
    limit: int = 1200,
) -> dict[str, DataFrame]:
    """Plotted rows, statistics per period, axis limits and, for one tag, histograms."""
    rows = trend_rows(stages, tags, start, end, mode, keys=keys)
    values = [f"{t}__{m}" for t in tags for m in ("raw", "smoothed")]
    result = {
        "rows": downsample_trend(
            rows, values, keys=keys, required=[f"{t}__raw" for t in tags], limit=limit
        )
    }
    raw = stages["raw"]
    cut = lambda a, b: raw.where(F.col("ts").between(F.lit(a), F.lit(b)))
    periods = {"full": raw, "current": cut(start, end)}
    if reference:
        periods["reference"] = cut(*reference)
    stats = None
    for name, part in periods.items():
        one = quality.tag_profile(part, tags, tag_configs=tag_configs).withColumn("period", F.lit(name))
        stats = one if stats is None else stats.unionByName(one)
    result["statistics"] = stats
    shown = {"raw": ["raw"], "smoothed": ["smoothed"], "both": ["raw", "smoothed"]}[mode]
    limits = None
    for tag in tags:
        bounds = [v for k, v in (tag_configs or {}).get(tag, {}).items() if k.endswith(("_min", "_max")) and v is not None]
        with_bounds = rows
        names = [f"{tag}__{m}" for m in shown]
        for i, value in enumerate(bounds):
            with_bounds = with_bounds.withColumn(f"_b{i}", F.lit(float(value)))
            names.append(f"_b{i}")
        one = quality.axis_limits(with_bounds, names).withColumn("tag", F.lit(tag))
        limits = one if limits is None else limits.unionByName(one)
    result["axis_limits"] = limits
    if len(tags) == 1:
        hist = None
        for name, part in periods.items():
            if name != "full":
                one = quality.histogram(part, tags[0]).withColumn("period", F.lit(name))
                hist = one if hist is None else hist.unionByName(one)
        result["histograms"] = hist
    return result


def preview(
    readings: DataFrame,
    config: PreprocessingConfig,
    tags: Sequence[str] | None = None,
    candidates: Sequence[str] = (),
    *,
    keys: Sequence[str] = ("series_id",),
    source_interval_minutes: float | None = None,
    limit: int = 1200,
) -> dict[str, DataFrame]:
    """The three stages, thinned; without tags, the five noisiest candidates are shown."""
    if not tags:
        ranked = quality.difference_noise(readings, candidates, keys=keys)
        best = ranked.groupBy("tag", "tag_order").agg(F.max("noise").alias("noise"))
        order = best.orderBy(F.col("noise").desc_nulls_last(), "tag_order").limit(5).collect()
        tags = [r["tag"] for r in order]
    stages = trend_stages(
        readings, tags, config, keys=keys, source_interval_minutes=source_interval_minutes
    )
    return {name: downsample_trend(df, tags, keys=keys, limit=limit) for name, df in stages.items()}


def scatter(rows: DataFrame, tags: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per pair of tags, how many rows hold a finite value of both."""
    pairs = [(a, b) for i, a in enumerate(tags) for b in tags[i + 1 :]]
    both: list[Column] = [
        F.struct(
            F.lit(a).alias("x"), F.lit(b).alias("y"), F.count_if(is_finite(col(a)) & is_finite(col(b))).alias("n")
        )
        for a, b in pairs
    ]
    return rows.groupBy(*[col(k) for k in keys]).agg(F.array(*both).alias("p")).select(
        *[col(k) for k in keys], F.inline("p")
    )
