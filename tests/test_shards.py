"""Results must not depend on how a series is cut into shards."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from procmon import PreprocessingConfig
from procmon.operators.preprocess import feature_names, preprocess
from tests.frames import series

N = 700


def readings(spark):
    rng = np.random.default_rng(11)
    minutes = np.cumsum(np.where(rng.random(N) < 0.03, rng.integers(2, 9, N), 1)) * 5
    a = [None if x < 0.02 else float(v) for x, v in zip(rng.random(N), rng.normal(size=N) * 10)]
    b = rng.normal(size=N).tolist()
    state = (rng.random(N) < 0.95).astype(float).tolist()
    return minutes, a, b, state, series(spark, minutes.tolist(), A=a, B=b, S=state)


def config(method, **more):
    smoothing = 15 if method.startswith("trailing") else 0
    alpha = 0.2 if method == "first_order" else None
    return PreprocessingConfig(
        5, smoothing, 10, 5, filter_method=method, first_order_alpha=alpha, gap_threshold_minutes=10,
        state_filters=({"column": "S", "minimum": 1},), **more,
    )


@pytest.mark.parametrize("method", ["trailing_mean", "first_order"])
def test_shard_width_changes_nothing(spark, method):
    *_, df = readings(spark)
    cfg = config(method)
    options = dict(engineering_ranges={"B": (-2, 2)}, exclude_engineering_range=True, segment_ids=True)
    names = ["ts", "row_class", "raw_segment_id", "final_segment_id", *feature_names(["A", "B"], cfg)]
    frames = []
    for shard in (None, 10, 237):
        out = preprocess(df, ["A", "B"], cfg, shard_minutes=shard, **options)
        frames.append(out.select(*[f"`{n}`" for n in names]).toPandas().sort_values("ts").reset_index(drop=True))
    for other in frames[1:]:
        pd.testing.assert_frame_equal(frames[0], other, rtol=1e-12, atol=1e-12)


def test_first_order_equals_pandas(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=2000) * 100
    minutes = np.arange(2000) * 5 + np.where(np.arange(2000) >= 1500, 60, 0)
    df = series(spark, minutes.tolist(), A=x.tolist())
    # The slow ones reach over hundreds of shards, so shards are composed in groups and groups of groups.
    for alpha, shard in ((1e-6, 50), (1e-4, 50), (0.003, 50), (0.02, 500), (0.35, 500), (0.97, 500), (1.0, 500)):
        cfg = PreprocessingConfig(5, 0, 0, 5, filter_method="first_order", first_order_alpha=alpha)
        out = preprocess(df, ["A"], cfg, shard_minutes=shard).orderBy("ts").toPandas()
        want = pd.concat([pd.Series(p).ewm(alpha=alpha, adjust=False).mean() for p in (x[:1500], x[1500:])])
        np.testing.assert_allclose(out["A__lag_000min"], want, rtol=1e-11, atol=1e-11)


def test_resampling_over_shards(spark):
    minutes, a, b, *_ = readings(spark)
    df = series(spark, minutes.tolist(), A=a, B=b)
    cfg = PreprocessingConfig(15, 0, 15, 15, resampling_method="mean", gap_threshold_minutes=25)
    frames = []
    for shard in (None, 15, 333):
        out = preprocess(df, ["A", "B"], cfg, source_interval_minutes=5, shard_minutes=shard)
        frames.append(out.toPandas().sort_values("ts").reset_index(drop=True))
    for other in frames[1:]:
        pd.testing.assert_frame_equal(frames[0], other, rtol=1e-12)
    grid = frames[0]
    assert (grid["row_class"] == "empty_bin").sum() > 0
    assert grid["bucket_rows"].sum() == N


def test_slow_filter_forgets_nothing_over_millions_of_rows(spark):
    ids = spark.range(0, 3_200_000, 1, 8)
    df = ids.select(
        F.lit("s").alias("series_id"), F.expr("timestamp_ntz'2000-01-01' + make_dt_interval(0, 0, cast(id * 5 as int))").alias("ts"),
        F.when(F.col("id") == 0, 1.0).otherwise(0.0).alias("A"),
    )
    cfg = PreprocessingConfig(5, 0, 0, 5, filter_method="first_order", first_order_alpha=1e-6)
    out = preprocess(df, ["A"], cfg)
    at = [1, 65_535, 1_500_000, 2_500_000, 3_100_000]
    times = [pd.Timestamp("2000-01-01") + pd.Timedelta(minutes=5 * i) for i in at]
    got = out.where(F.col("ts").isin([F.lit(t).cast("timestamp_ntz") for t in times])).orderBy("ts").toPandas()
    np.testing.assert_allclose(got["A__lag_000min"], (1 - 1e-6) ** np.array(at, float), rtol=1e-9)


@pytest.mark.parametrize("shard", [None, 10, 30, 500])
def test_steps_off_the_grid_are_refused_for_every_cut(spark, shard):
    cfg = PreprocessingConfig(5, 0, 0, 5)
    good = series(spark, [0, 5, 10, 75, 80, 600], A=[1.0] * 6)
    assert preprocess(good, ["A"], cfg, shard_minutes=shard).where("row_class = 'valid'").count() == 6
    for times in ([0, 5, 10, 73, 78], [0, 5, 601], [0, 5, 5]):
        with pytest.raises(Exception, match="sampling grid"):
            preprocess(series(spark, times, A=[1.0] * len(times)), ["A"], cfg, shard_minutes=shard).collect()


def test_rows_without_key_or_time_are_refused(spark):
    cfg = PreprocessingConfig(5, 0, 0, 5)
    good = series(spark, [0, 5, 10], A=[1.0] * 3)
    for column, kind in (("series_id", "string"), ("ts", "timestamp_ntz")):
        bad = good.unionByName(good.limit(1).withColumn(column, F.lit(None).cast(kind)))
        for options in ({}, {"segment_ids": True}):
            with pytest.raises(Exception, match=f"{column} must not be null"):
                preprocess(bad, ["A"], cfg, **options).collect()


def test_no_time_zone_takes_part(spark):
    start = pd.Timestamp("2026-03-07 23:00")
    df = series(spark, [30 * i for i in range(12)], start=start.to_pydatetime(), A=[float(i) for i in range(12)])
    cfg = PreprocessingConfig(30, 0, 30, 30)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        out = preprocess(df, ["A"], cfg).orderBy("ts").toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert out["ts"].tolist() == [start + pd.Timedelta(minutes=30 * i) for i in range(12)]
    assert out["row_class"].tolist() == ["lag_warmup"] + ["valid"] * 11


def test_shards_follow_the_denser_of_the_two_intervals():
    cfg = PreprocessingConfig(60, 0, 0, 60, resampling_method="mean")
    second = 1 / 60
    width = cfg.shard_us(int(second * 60_000_000), None, second)
    assert width / 1_000_000 <= 65_536 + 3_600


def test_rows_cross_one_exchange_and_meet_no_join(spark):
    *_, df = readings(spark)
    plan = preprocess(df, ["A", "B"], config("trailing_mean"))._jdf.queryExecution().sparkPlan()
    rows = plan.toString()
    assert "Join" not in rows
    prepared = preprocess(df, ["A", "B"], config("trailing_mean"))._jdf.queryExecution().executedPlan().toString()
    lines = [x.lstrip(" :+-") for x in prepared.splitlines()]
    # Of the check of the steps between shards only two times a shard travel, never a value column.
    exchanges = [i for i, x in enumerate(lines) if x.startswith("Exchange")]
    assert sum("x0" in lines[i + 1] for i in exchanges) == 1
    assert all("x0" in lines[i + 1] or "first" in lines[i + 1] or "partial_bool_and" in lines[i + 1] or "partial_min" in lines[i + 1] for i in exchanges)


@pytest.mark.parametrize("shard", [None, 10, 500])
def test_steps_off_the_grid_are_refused_when_columns_are_left_out(spark, shard):
    for times in ([0, 5, 10, 73, 78], [0, 5, 601], [0, 5, 5]):
        rows = preprocess(series(spark, times, A=[1.0] * len(times)), ["A"], PreprocessingConfig(5, 0, 0, 5), shard_minutes=shard)
        with pytest.raises(Exception, match="sampling grid"):
            rows.select("A").count()
    empty = series(spark, [], A=[])
    assert preprocess(empty, ["A"], PreprocessingConfig(5, 0, 0, 5), shard_minutes=shard).count() == 0
