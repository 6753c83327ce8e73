"""Small series with results worked out by hand."""

import pytest

from procmon import PreprocessingConfig
from procmon.operators.preprocess import preprocess
from tests.frames import by_time, series


def cfg(interval, smoothing, lag, step, **more):
    return PreprocessingConfig(interval, smoothing, lag, step, **more)


def classes(df):
    return list(by_time(df, "row_class").values())


def features(df, *names):
    valid = df.where("row_class = 'valid'")
    return by_time(valid, *names)


def test_filters_and_lags_stay_inside_segments(spark):
    df = series(spark, [0, 5, 10, 30, 35, 40], T1=[0, 1, 2, 10, 12, 14])
    out = preprocess(df, ["T1"], cfg(5, 10, 5, 5, filter_method="trailing_mean"))
    got = features(out, "T1__lag_000min", "T1__lag_005min")
    assert got == {"00:10": (1.5, 0.5), "00:40": (13.0, 11.0)}


def test_trailing_mean_without_lag(spark):
    df = series(spark, [0, 5, 10, 15], T1=[0, 10, 20, 30])
    out = preprocess(df, ["T1"], cfg(5, 10, 0, 5, filter_method="trailing_mean"))
    assert list(features(out, "T1__lag_000min").values()) == [5, 15, 25]


@pytest.mark.parametrize("method,expected", [("mean", [2, 10]), ("median", [2, 10]), ("last", [3, 10])])
def test_right_closed_buckets(spark, method, expected):
    df = series(spark, ["00:01", "00:04", "00:06"], A=[1, 3, 10])
    config = cfg(5, 0, 0, 5, resampling_method=method, gap_threshold_minutes=5)
    out = preprocess(df, ["A"], config, source_interval_minutes=1)
    assert by_time(out, "A") == dict(zip(["00:05", "00:10"], expected))


def test_last_keeps_a_missing_last_row_and_fills_empty_buckets(spark):
    df = series(spark, ["00:01", "00:04", "00:11"], A=[1, None, 3])
    config = cfg(5, 0, 0, 5, resampling_method="last", gap_threshold_minutes=10)
    out = preprocess(df, ["A"], config, source_interval_minutes=1)
    assert by_time(out, "A", "row_class") == {
        "00:05": (None, "input_invalid"),
        "00:10": (None, "empty_bin"),
        "00:15": (3.0, "valid"),
    }


def test_two_segments_in_one_bucket_are_an_error(spark):
    df = series(spark, [0, 1, 3, 4], A=[1, 2, 100, 200])
    config = cfg(5, 0, 0, 5, resampling_method="mean")
    with pytest.raises(Exception, match="share one resampling bucket"):
        preprocess(df, ["A"], config, source_interval_minutes=1).collect()


def test_filters(spark):
    df = series(spark, [0, 5, 10], A=[0, 10, 100])
    for method, expected in [
        ("none", [0, 10, 100]),
        ("trailing_mean", [None, 5, 55]),
        ("trailing_median", [None, 5, 55]),
    ]:
        out = preprocess(
            df, ["A"], cfg(5, 10, 0, 5, filter_method=method), intermediates=True
        )
        assert list(by_time(out, "A__filtered").values()) == expected


def test_first_order_drops_invalid_rows_first(spark):
    df = series(spark, [0, 5, 10, 15, 20], A=[0, 10, None, 100, 200])
    config = cfg(5, 0, 0, 5, filter_method="first_order", first_order_alpha=0.5)
    out = preprocess(df, ["A"], config)
    assert list(features(out, "A__lag_000min").values()) == [0, 5, 100, 150]


def test_excluded_range_forces_a_break(spark):
    df = series(spark, [0, 5, 10, 15, 20, 25], A=[0, 10, 1000, 100, 110, 120])
    options = dict(engineering_ranges={"A": (-100, 200)}, exclude_engineering_range=True)
    mean = cfg(5, 10, 5, 5, filter_method="trailing_mean", gap_threshold_minutes=10)
    out = preprocess(df, ["A"], mean, **options)
    assert features(out, "A__lag_000min", "A__lag_005min") == {"00:25": (115.0, 105.0)}
    assert classes(out).count("engineering_range") == 1
    first = cfg(5, 0, 5, 5, filter_method="first_order", first_order_alpha=0.5, gap_threshold_minutes=10)
    rows = preprocess(df, ["A"], first, intermediates=True, **options)
    got = by_time(rows, "A__filtered", "row_class", "A__lag_005min")
    assert got["00:15"] == (100.0, "lag_warmup", None)
    assert got["00:20"][1:] == ("valid", 100.0)


def test_state_filter_breaks_despite_gap_tolerance(spark):
    df = series(spark, [0, 5, 10, 15], A=[0, 10, 100, 200], STATE=[1, 1, 0, 1])
    config = cfg(
        5, 0, 5, 5, filter_method="first_order", first_order_alpha=0.5, gap_threshold_minutes=10,
        state_filters=({"column": "STATE", "minimum": 1},),
    )
    out = preprocess(df, ["A"], config, intermediates=True)
    got = by_time(out, "A__filtered", "row_class")
    assert got["00:15"] == (200.0, "lag_warmup")
    assert classes(out) == ["lag_warmup", "valid", "state_filtered", "lag_warmup"]


def test_state_filter_loss(spark):
    df = series(spark, range(0, 35, 5), A=range(7), LOAD=[1, 1, 1, 0, 1, 1, 1])
    config = cfg(5, 5, 5, 5, state_filters=({"column": "LOAD", "minimum": 1},))
    out = preprocess(df, ["A"], config)
    assert classes(out) == [
        "lag_warmup", "valid", "valid", "state_filtered", "lag_warmup", "valid", "valid",
    ]


def test_legacy_filters_over_invalid_rows(spark):
    df = series(spark, [0, 5, 10, 15], A=[None, 2, 3, 4])
    config = cfg(5, 10, 5, 5, filter_method="trailing_mean")
    out = preprocess(df, ["A"], config, semantics="legacy")
    assert classes(out) == ["input_invalid", "filter_context", "lag_context", "valid"]


def test_text_values_and_gap_tolerance(spark):
    df = series(spark, range(0, 30, 5), A=[1, 2, "bad", 100, 100, 100])
    out = preprocess(df, ["A"], cfg(5, 10, 5, 5, filter_method="trailing_mean"))
    assert features(out, "A__lag_005min") == {"00:25": 100.0}
    assert classes(out).count("input_invalid") == 1
    gappy = series(spark, [0, 5, 10, 15], A=[1, 2, None, 4])
    strict = preprocess(gappy, ["A"], cfg(5, 0, 5, 5))
    assert list(features(strict, "A__lag_000min")) == ["00:05"]
    loose = preprocess(gappy, ["A"], cfg(5, 0, 5, 5, gap_threshold_minutes=10))
    assert list(features(loose, "A__lag_000min")) == ["00:05", "00:15"]


def test_irregular_steps_are_an_error(spark):
    df = series(spark, [0, 5, 7], A=[1, 2, 3])
    with pytest.raises(Exception, match="sampling grid"):
        preprocess(df, ["A"], cfg(5, 0, 0, 5)).collect()
