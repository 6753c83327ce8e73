import random

import numpy as np
import pytest

from procmon.operators import quality
from procmon.operators.brackets import bracketed_quantiles
from procmon.operators.quantiles import exact_quantiles
from tests.frames import series


def test_quantiles_by_narrowing_equal_the_plain_ones(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(5, 2)) for _ in range(3000)] + [("a", 1.5)] * 500
    rows += [("b", float(int(rng.expovariate(0.01)))) for _ in range(1000)] + [("c", 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = {"p01": 0.01, "median": 0.5, "p99": 0.99}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", wanted, group_limit=50).collect()}
    for key in "abc":
        values = [v for k, v in rows if k == key and v is not None]
        for name, p in wanted.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), rel=1e-12)
    one = exact_quantiles(df, [], "v", {"m": 0.5}, group_limit=10).collect()[0]["m"]
    assert one == pytest.approx(np.median([v for _, v in rows if v is not None]))


@pytest.mark.parametrize("accuracy", [10, 25, 10_000])
def test_quantiles_by_brackets(spark, accuracy):
    rng = random.Random(5)
    rows = [("a", rng.gauss(5, 2)) for _ in range(3000)] + [("a", 1.5)] * 900
    rows += [("b", float(int(rng.expovariate(0.01)))) for _ in range(1000)] + [("c", 2.0), ("c", None), ("d", None)]
    rows += [("e", v) for v in (1.0, 2.0, float("inf"), float("-inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    wanted = {"low": 0.0, "p01": 0.01, "median": 0.5, "p90": 0.9, "p99": 0.99, "high": 1.0}
    got = {r["k"]: r for r in bracketed_quantiles(df, ["k"], "v", wanted, accuracy).collect()}
    assert set(got) == set("abce")
    for key in "abc":
        values = [v for k, v in rows if k == key and v is not None]
        for name, p in wanted.items():
            assert got[key][name] == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert (got["e"]["low"], got["e"]["median"], got["e"]["high"]) == (float("-inf"), 1.5, float("inf"))
    finite = df.where("k in ('a', 'b')")
    one = bracketed_quantiles(finite, [], "v", {"m": 0.3}, accuracy).collect()
    assert one[0]["m"] == pytest.approx(np.quantile([v for k, v in rows if k in "ab"], 0.3))
    assert bracketed_quantiles(df.limit(0), ["k"], "v", wanted, accuracy).count() == 0


def test_a_profile_writes_no_cells(spark):
    df = series(spark, range(50), A=[float(i % 7) for i in range(50)], B=[None] * 50)
    before = spark._jsc.sc().statusTracker().getJobIdsForGroup(None)
    profile = quality.tag_profile(df, ["A", "B"])
    assert len(spark._jsc.sc().statusTracker().getJobIdsForGroup(None)) == len(before)
    rows = {r["tag"]: r for r in profile.collect()}
    assert rows["A"]["median"] == np.median([i % 7 for i in range(50)]) and rows["A"]["unique_count"] == 7
    assert rows["B"]["median"] is None and rows["B"]["valid_count"] == 0


def test_raw_profile_kinds(spark):
    df = series(spark, range(8), A=["1", None, "", "  ", "BAD", "inf", "-inf", "2"])
    row = quality.raw_profile(df, ["A"]).collect()[0]
    assert (row["valid_count"], row["missing_count"], row["empty_string_count"]) == (2, 1, 2)
    assert (row["non_numeric_count"], row["positive_infinite_count"]) == (1, 1)
    assert row["negative_infinite_count"] == 1 and row["invalid_rate"] == 0.75


def test_time_quality(spark):
    df = series(spark, [0, 5, 5, 10, 25, 27], A=[1, 2, 3, 4, 5, 6])
    got = {r["code"]: r["count"] for r in quality.time_quality(df, keys=["series_id"]).collect()}
    assert got == {"duplicate_timestamp": 2, "physical_time_gap": 1, "irregular_sampling": 1}
    small = quality.time_quality(df, keys=["series_id"], width=7 * 60_000_000)
    assert {r["code"]: r["count"] for r in small.collect()} == got


def test_unsorted_rows_need_a_row_number(spark):
    df = series(spark, [0, 10, 5], A=[1, 2, 3], n=[0, 1, 2])
    got = quality.time_quality(df, keys=["series_id"], row_order="n", expected_interval_minutes=5)
    assert "unsorted_timestamp" in {r["code"] for r in got.collect()}


def test_noise_histogram_and_gate(spark):
    df = series(spark, range(0, 25, 5), A=[0, 10, 0, 10, 0], B=[1, 1, 1, 1, 1])
    ranked = quality.difference_noise(df, ["B", "A"]).orderBy("rank").collect()
    assert [(r["tag"], r["noise"]) for r in ranked] == [("A", 10.0), ("B", 0.0)]
    bins = quality.histogram(df, "A").orderBy("bin").collect()
    counts, edges = np.histogram([0, 10, 0, 10, 0], bins=2)
    assert [b["count"] for b in bins] == counts.tolist()
    assert [b["left_edge"] for b in bins] == edges[:-1].tolist()
    with pytest.raises(quality.QualityError, match="constant_tag"):
        quality.quality_gate(df, ["A", "B"], keys=["series_id"], variability=True)
    quality.quality_gate(df, ["A", "B"], keys=["series_id"])
