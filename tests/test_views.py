"""Chart views and clustering entries on small series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from procmon import PreprocessingConfig
from procmon.operators import clustering
from procmon.plans.trend import preview, trend_stages, trend_view
from tests.frames import series

N = 90


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(4)
    minutes = [5 * i + (200 if i >= 60 else 0) for i in range(N)]
    return series(spark, minutes, A=rng.normal(size=N).tolist(), B=(rng.normal(size=N) * 10).tolist(), C=[float(i) for i in range(N)])


CONFIG = PreprocessingConfig(5, 15, 0, 5, filter_method="trailing_mean", gap_threshold_minutes=10)


def test_trend_view(spark, readings):
    stages = trend_stages(readings, ["C"], CONFIG)
    at = lambda text: F.expr(f"timestamp_ntz'2026-01-01 {text}'")
    view = trend_view(stages, ["C"], at("01:00:00"), at("03:00:00"), reference=(at("00:00:00"), at("00:30:00")), limit=30)
    assert 0 < view["rows"].count() <= 30
    stats = {r["period"]: (r["valid_count"], r["minimum"], r["maximum"]) for r in view["statistics"].collect()}
    assert stats == {"full": (N, 0.0, N - 1.0), "current": (25, 12.0, 36.0), "reference": (7, 0.0, 6.0)}
    sums = {r["period"]: r["n"] for r in view["histograms"].groupBy("period").agg(F.sum("count").alias("n")).collect()}
    assert sums == {"current": 25, "reference": 7}
    (limits,) = view["axis_limits"].collect()
    assert limits["minimum"] < 12 and limits["maximum"] > 36


def test_preview_shows_the_noisiest_candidates(spark, readings):
    shown = preview(readings, CONFIG, candidates=["A", "B", "C"], limit=40)
    assert set(shown) == {"raw", "resampled", "filtered"}
    assert all(0 < df.count() <= 40 and {"A", "B", "C"} <= set(df.columns) for df in shown.values())
    assert "A" not in preview(readings, CONFIG, ["B"], limit=40)["raw"].columns


def test_clustering_with_own_and_with_saved_components(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(60, 4)) * 0.1 + m for m in (-3.0, 3.0)])
    x[:, 3] = rng.normal(size=120)
    names = [f"T{i}__lag_000min" for i in range(4)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i long, " + ", ".join(f"{n} double" for n in names))
    states, centers, model = clustering.cluster_rows(df, names, 2, n_components=2)
    got = dict(states.select("i", "cluster_id").collect())
    assert len({got[i] for i in range(60)}) == len({got[i] for i in range(60, 120)}) == 1 and got[0] != got[119]
    again = dict(clustering.cluster_with_model(df, names, model, centers).select("i", "cluster_id").collect())
    assert again == got
    with pytest.raises(ValueError, match="order"):
        clustering.cluster_with_model(df, names[::-1], model, centers)
