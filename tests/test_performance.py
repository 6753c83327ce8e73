"""Sliding windows and long trailing means against a direct computation, and their cost."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import DAY, series
from procmon import PerformanceConfig, PreprocessingConfig
from procmon.operators.performance import sliding_windows, trailing
from procmon.operators.preprocess import LONG_FRAME, preprocess


@pytest.mark.parametrize("w", [1, 2, 5, 16, 40])
def test_two_running_results_make_any_window(w):
    values = np.random.default_rng(w).normal(size=40)
    values[7] = 1e16  # must leave no trace in the windows behind it
    ends = np.arange(w - 1, 40)
    whole = [values[e - w + 1 : e + 1] for e in ends]
    np.testing.assert_allclose(trailing(np.add, values, w, ends), [v.sum() for v in whole], rtol=1e-12, atol=1e-12)
    assert trailing(np.minimum, values, w, ends).tolist() == [v.min() for v in whole]
    assert trailing(np.maximum, values, w, ends).tolist() == [v.max() for v in whole]


def directly(times, values, segments, w, low, high):
    rows = {}
    for e in range(w - 1, len(times)):
        part = slice(e - w + 1, e + 1)
        even = all(b - a == 5 for a, b in zip(times[part], times[part][1:]))
        if even and len(set(segments[part])) == 1:
            x = np.array(values[part])
            off = np.maximum(np.maximum(low - x, x - high), 0)
            rows[times[e]] = (x.mean(), np.median(x), x.min(), x.max(), ((x >= low) & (x <= high)).mean(), off.mean())
    return rows


@pytest.mark.parametrize("width", [None, 30])
def test_windows_equal_the_definition(spark, width):
    rng = np.random.default_rng(3)
    times = [5 * i for i in range(30)] + [5 * i for i in range(33, 60)]
    values = rng.normal(size=len(times)).round(3).tolist()
    segments = [float(i > 40) for i in range(len(times))]
    config = PerformanceConfig("x", direction="target_range", minimum_duration_minutes=30, candidate_count=3, target_min=-0.5, target_max=0.5)
    df = series(spark, times, x=values, seg=segments)
    df = df.union(series(spark, [0, 5], "nulls", x=[None, float("nan")], seg=[0, 0]))
    got = sliding_windows(df, "x", config, 300_000_000, segment="seg", width=width and width * 60_000_000)
    want = directly(times, values, segments, 6, -0.5, 0.5)
    rows = got.orderBy("end").collect()
    assert [int((r["end"] - DAY).total_seconds() // 60) for r in rows] == sorted(want)
    names = ["mean", "median", "minimum", "maximum", "target_ratio", "mean_target_deviation"]
    np.testing.assert_allclose([[r[n] for n in names] for r in rows], [want[t] for t in sorted(want)], rtol=1e-9, atol=1e-12)
    assert all(r["sample_count"] == 6 and (r["end"] - r["start"]).total_seconds() == 1500 for r in rows)


def test_a_row_costs_the_same_in_a_long_window(spark):
    points = spark.range(1_000_000).select(
        F.lit("s").alias("series_id"),
        (F.lit(pd.Timestamp("2020-01-01")).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 5).cast("int"))).alias("ts"),
        F.rand(1).alias("x"),
    )
    seconds = {}
    for w in (10, 10, 10_000):  # the first run also starts the Python workers
        config = PerformanceConfig("x", direction="higher_is_better", minimum_duration_minutes=5 * w, candidate_count=1)
        started = time.perf_counter()
        count, total = sliding_windows(points, "x", config, 300_000_000).agg(F.count("*"), F.sum("median")).first()
        seconds[w] = time.perf_counter() - started
        assert count == 1_000_000 - w + 1 and abs(total / count - 0.5) < 0.05
    # A thousand times the window; an order statistic with deletion takes the logarithm of it.
    assert seconds[10_000] < 10 * seconds[10] + 10


@pytest.mark.parametrize("semantics, shard", [("schema5", None), ("schema5", 600), ("legacy", None)])
def test_long_trailing_means_equal_the_definition(spark, semantics, shard):
    w = LONG_FRAME + 3
    times = [5 * i for i in range(150)] + [5 * i for i in range(160, 330)]
    values = np.random.default_rng(5).normal(size=len(times))
    values[20] = 1e15  # leaves the frame again
    tag = [None if i == 250 else float(v) for i, v in enumerate(values)]
    df = series(spark, times, A=tag)
    config = PreprocessingConfig(5, 5 * w, 0, 5, filter_method="trailing_mean")
    out = preprocess(df, ["A"], config, semantics=semantics, shard_minutes=shard, intermediates=True).orderBy("ts").toPandas()
    got = out["A__filtered"].to_numpy(float)
    broken = {150, 250} if semantics == "legacy" else {150, 251}
    want, held = [], []
    for i, v in enumerate(tag):
        if i in broken and semantics != "legacy" or i == 150:
            held = []
        held = [*held, np.nan if v is None else v][-w:]
        full = len(held) == w and not (semantics == "schema5" and v is None)
        want.append(np.mean(held) if full else np.nan)
    np.testing.assert_array_equal(np.isnan(got), np.isnan(want))
    np.testing.assert_allclose(got[~np.isnan(got)], np.array(want)[~np.isnan(got)], rtol=1e-9, atol=1e-9)


def test_a_row_costs_the_same_under_a_long_trailing_mean(spark):
    points = spark.range(1_000_000).select(
        F.lit("s").alias("series_id"),
        (F.lit(pd.Timestamp("2020-01-01")).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 5).cast("int"))).alias("ts"),
        F.rand(1).alias("x"),
    )
    seconds = {}
    for w in (100, 10_000):
        config = PreprocessingConfig(5, 5 * w, 0, 5, filter_method="trailing_mean")
        started = time.perf_counter()
        rows = preprocess(points, ["x"], config).where("row_class = 'valid'")
        count, mean = rows.agg(F.count("*"), F.avg("x__lag_000min")).first()
        seconds[w] = time.perf_counter() - started
        assert count == 1_000_000 - w + 1 and abs(mean - 0.5) < 0.01
    assert seconds[10_000] < 3 * seconds[100] + 10
