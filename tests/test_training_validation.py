import math
from datetime import timedelta
from itertools import combinations

import numpy as np
import pytest

from procmon import PreprocessingConfig
from procmon.operators import validation as metrics
from procmon.operators.scoring import Model
from procmon.plans import training
from procmon.plans.validation import compare_tables, validate, verify_metrics, verify_scores
from tests.frames import DAY, at, series


def window(name, start, end, enabled=True):
    return {
        "id": name, "start": at(start).isoformat(), "end": at(end).isoformat(), "source": "manual",
        "source_ref": None, "enabled": enabled, "comment": "",
    }


def test_partial_buckets_of_isolated_windows(spark):
    df = series(spark, range(11), A=range(11))
    config = PreprocessingConfig(5, 0, 0, 5, resampling_method="mean")
    made = training.build_training_set(
        df, [window("w", "00:00", "00:10")], ["A"], config, source_interval_minutes=1
    )
    row = training.window_summary(made).collect()[0]
    assert row["partial_resampling_bin_loss"] == 1 and row["final_dynamic_row_count"] == 2
    short = [window("a", "00:01", "00:02"), window("b", "00:03", "00:05"), window("c", "00:06", "00:06", False),
             window("d", "05:00", "06:00")]
    made = training.build_training_set(df, short, ["A"], config, source_interval_minutes=1)
    got = {r["window_id"]: (r["status"], r["dropped_reason"]) for r in training.window_summary(made).collect()}
    assert got == {
        "a": ("dropped", "no_complete_resampling_bins"),
        "b": ("dropped", "no_complete_resampling_bins"),
        "c": ("disabled", None),
        "d": ("dropped", "no_raw_samples"),
    }


def test_windows_may_not_touch(spark):
    df = series(spark, range(11), A=range(11))
    with pytest.raises(ValueError, match="overlap"):
        training.build_training_set(
            df, [window("a", "00:00", "00:05"), window("b", "00:05", "00:08")], ["A"],
            PreprocessingConfig(1, 0, 0, 1),
        )


def test_training_end_to_end(spark):
    n = 80
    i = np.arange(n)
    df = series(spark, (i * 5).tolist(), A=i.tolist(), B=np.sin(i / 3).tolist(), C=np.cos(i / 5).tolist())
    config = PreprocessingConfig(5, 10, 5, 5, filter_method="trailing_mean")
    made = training.build_training_set(
        df, [window("a", "00:00", "03:00"), window("b", "03:05", "06:35")], ["A", "B", "C"], config
    )
    model = training.train(made)
    totals = training.window_totals(training.window_summary(made)).collect()[0]
    assert totals["training_rows"] == model.n_samples == n - 4
    segments = training.segment_summary(made).collect()
    assert {s["segment_name"] for s in segments} == {"a-segment-001", "b-segment-001"}
    assert training.duplicate_times(made.dynamic).count() == 0
    x = np.array([[r[f] for f in made.features] for r in made.dynamic.collect()])
    z = (x - x.mean(0)) / x.std(0)
    eigen = np.linalg.svd(z, compute_uv=False) ** 2 / (len(x) - 1)
    assert model.eigenvalues == pytest.approx(eigen, abs=1e-9)


def plain_model(limit_95=1.0, limit_99=3.0):
    names = ("A__lag_000min", "B__lag_000min")
    return Model(names, [0, 0], [1, 1], [[1.0, 0.0]], [1.0, 1.0], [0.5, 0.5],
                 (limit_95, limit_99), (limit_95, limit_99), 100)


def validation_window(name, kind, start, end):
    return {"id": name, "type": kind, "start": at(start).isoformat(), "end": at(end).isoformat(),
            "enabled": True, "comment": ""}


def test_validation_metrics(spark):
    # t2 = A^2, spe = B^2
    a = [0, 1.5, 0, 0, 0, 0, 0, 1.2, 0, 0, 1.1, 2.0]
    b = [0, 0, 0, 1.3, 0, 0, 0, 0, 0, 0, 0, 0]
    df = series(spark, range(0, 60, 5), A=a, B=b)
    config = PreprocessingConfig(5, 0, 0, 5)
    windows = [
        validation_window("n1", "normal_validation", "00:00", "00:10"),
        validation_window("n2", "normal_validation", "00:15", "00:25"),
        validation_window("x1", "known_abnormal", "00:30", "00:40"),
        validation_window("x2", "known_abnormal", "00:45", "00:55"),
    ]
    done = validate(df, plain_model(), ["A", "B"], config, windows)
    done.check_coverage()
    normal = done.normal_metrics().collect()[0]
    assert normal["overall_exceedance_rate_95"] == pytest.approx(2 / 6)
    assert normal["false_alarm_event_count_95"] == 2
    found = done.detection_metrics().collect()[0]
    assert found["detection_rate_95"] == 1.0 and found["detection_rate_99"] == 0.5
    assert found["first_detection_delay_minutes_95_median"] == 5.0
    assert found["first_detection_delay_minutes_95_max"] == 5
    rows = {r["window_id"]: r for r in done.window_metrics().collect()}
    assert rows["x1"]["single_point_exceedance"] and not rows["x2"]["single_point_exceedance"]
    assert rows["x2"]["longest_event_minutes"] == 10 and rows["x2"]["maximum_t2"] == 4.0
    tags = done.first_event_tags().where("window_id = 'x2'").collect()
    assert [(t["tag"], t["contribution_pct"]) for t in tags] == [("A", 100.0), ("B", 0.0)]
    assert verify_scores(done.scores, done.model).count() == 0
    broken = done.scores.withColumn("status", done.scores.t2_status)
    assert verify_scores(broken, done.model).count() == 1
    report = done.window_metrics()
    assert verify_metrics(report, report, ["series_id", "window_id"]).count() == 0
    gap = validate(df.where("A <> 1.2"), plain_model(), ["A", "B"], config,
                   [validation_window("y", "known_abnormal", "00:35", "00:40")])
    with pytest.raises(ValueError, match="do not cover"):
        gap.check_coverage()


def test_context_feeds_the_first_row(spark):
    df = series(spark, range(0, 60, 5), A=range(12), B=[0] * 12)
    config = PreprocessingConfig(5, 10, 5, 5, filter_method="trailing_mean")
    names = tuple(f"{t}__lag_{l:03d}min" for l in (0, 5) for t in "AB")
    model = Model(names, [0] * 4, [1] * 4, [[1, 0, 0, 0]], [1.0] * 4, [0.25] * 4, (1, 2), (1, 2), 50)
    done = validate(df, model, ["A", "B"], config,
                    [validation_window("v", "normal_validation", "00:20", "00:30")])
    done.check_coverage()
    assert [r["pc1"] for r in done.scores.orderBy("ts").collect()] == [3.5, 4.5, 5.5]
    assert done.rows.count() == 5


def test_stability_without_pairs(spark):
    rng = np.random.default_rng(5)
    tags = ["A", "B", "C", "D", "E"]
    events = []
    for e in range(12):
        share = rng.dirichlet(np.ones(5) * 0.5) * 100
        present = [(t, float(s)) for t, s in zip(tags, share) if e % 4 or t != "E"]
        events.append(("normal_validation", "t2", present))
    schema = ("window_type string, statistic string, "
              "tags array<struct<tag:string,contribution_pct:double>>")
    df = spark.createDataFrame(events, schema)
    groups, per_tag = metrics.contribution_stability(df, tags)
    row = groups.collect()[0]
    vectors, tops = [], []
    for _, _, present in events:
        values = dict(present)
        vectors.append(np.array([values.get(t, 0.0) for t in tags]))
        tops.append(set(sorted(tags, key=lambda t: (-values.get(t, 0.0), t))[:3]))
    pairs = list(combinations(range(12), 2))
    jaccard = np.mean([len(tops[a] & tops[b]) / len(tops[a] | tops[b]) for a, b in pairs])
    cosine = np.mean([
        vectors[a] @ vectors[b] / math.sqrt((vectors[a] @ vectors[a]) * (vectors[b] @ vectors[b]))
        for a, b in pairs
    ])
    assert row["average_top_k_jaccard_similarity"] == pytest.approx(jaccard)
    assert row["average_contribution_cosine_similarity"] == pytest.approx(cosine)
    by_tag = {r["tag"]: r for r in per_tag.collect()}
    for i, t in enumerate(tags):
        assert by_tag[t]["median_contribution_pct"] == pytest.approx(np.median([v[i] for v in vectors]))
        assert by_tag[t]["top_k_count"] == sum(t in s for s in tops)


def test_compare_tables(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "y")], "id int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "x"), (3, 2.0, "y")], "id int, v double, s string")
    got = {(r["id"], r["column"]) for r in compare_tables(a, b, ["id"]).collect()}
    assert got == {(2, "row"), (3, "row")}
