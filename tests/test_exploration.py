import numpy as np
import pytest

from procmon import ExplorationConfig, PerformanceConfig, PreprocessingConfig
from procmon.operators import clustering, performance
from procmon.operators.runs import longest_runs, runs, tag_runs
from procmon.operators.screening import screen
from procmon.plans.exploration import accepted_windows, explore
from tests.frames import by_time, series

STEP = 5 * 60_000_000


def test_screen(spark):
    df = series(spark, range(0, 25, 5), y=[90, 92, 94, 96, 98], c=[12, 11, 10, 9, 8])
    totals, each, found = screen(
        df, [{"column": "y", "minimum": 94}, {"column": "c", "maximum": 10}], STEP, keys=["series_id"]
    )
    row = totals.collect()[0]
    assert (row["matched_rows"], row["match_share"]) == (3, 0.6)
    assert {r["column"]: r["matched_rows"] for r in each.collect()} == {"y": 3, "c": 3}
    run = found.collect()[0]
    assert (run["start"].strftime("%H:%M"), run["end"].strftime("%H:%M")) == ("00:10", "00:20")
    with pytest.raises(Exception, match="finite"):
        screen(series(spark, [0], y=[None]), [{"column": "y", "minimum": 1}], STEP)[0].collect()


@pytest.mark.parametrize("width", [None, 2 * STEP, 3 * STEP])
def test_runs_do_not_depend_on_shards(spark, width):
    times = [0, 5, 10, 15, 30, 35, 40, 45, 50, 55, 60, 90]
    state = ["a", "a", "b", "b", "b", "b", "b", "b", "b", "a", "a", "a"]
    df = series(spark, times, cluster_id=state)
    got = sorted(
        (r["start"].strftime("%H:%M"), r["end"].strftime("%H:%M"), r["row_count"])
        for r in runs(df, STEP, same=["cluster_id"], width=width).collect()
    )
    assert got == [
        ("00:00", "00:05", 2), ("00:10", "00:15", 2), ("00:30", "00:50", 5), ("00:55", "01:00", 2),
        ("01:30", "01:30", 1),
    ]
    tagged = tag_runs(df, STEP, same=["cluster_id"], width=width)
    starts = {t: s.strftime("%H:%M") for t, s in by_time(tagged, "run_start").items()}
    assert starts["00:50"] == "00:30" and starts["01:00"] == "00:55" and starts["00:15"] == "00:10"
    top = longest_runs(runs(df, STEP, same=["cluster_id"], width=width), 2).orderBy("rank").collect()
    assert [r["start"].strftime("%H:%M") for r in top] == ["00:30", "00:00"]


def brute_best(times, x, w, config):
    from statistics import mean, median

    options = []
    for i in range(len(x) - w + 1):
        part, t = x[i : i + w], times[i : i + w]
        if any(b - a != 5 for a, b in zip(t, t[1:])) or any(v is None for v in part):
            continue
        if config.direction == "target_range":
            inside = [config.target_min <= v <= config.target_max for v in part]
            off = [max(config.target_min - v, v - config.target_max, 0) for v in part]
            options.append(((-mean(inside), mean(off), mean(part), i), i))
        else:
            sign = -1 if config.direction == "higher_is_better" else 1
            options.append(((sign * mean(part), sign * median(part), i), i))
    taken = []
    for _, i in sorted(options):
        if all(abs(i - j) >= w for j in taken):
            taken.append(i)
        if len(taken) == config.candidate_count:
            break
    return [times[i] for i in taken]


@pytest.mark.parametrize("direction", ["higher_is_better", "lower_is_better", "target_range"])
@pytest.mark.parametrize("width", [None, 5 * STEP])
def test_best_windows_equal_brute_force(spark, direction, width):
    rng = np.random.default_rng(4)
    times = [t for t in range(0, 600, 5) if t not in (100, 230, 400)]
    x = [None if i in (15, 60) else float(v) for i, v in enumerate(rng.integers(0, 100, len(times)))]
    target = dict(target_min=40, target_max=60) if direction == "target_range" else {}
    config = PerformanceConfig("x", direction, minimum_duration_minutes=20, candidate_count=4, **target)
    df = series(spark, times, x=x)
    every = performance.sliding_windows(df, "x", config, STEP, width=width)
    got = performance.best_windows(every, config, STEP).orderBy("rank").collect()
    minute = lambda ts: ts.hour * 60 + ts.minute
    assert [minute(r["start"]) for r in got] == brute_best(times, x, 4, config)


def test_explore_finds_two_states(spark):
    rng = np.random.default_rng(19)
    n = 120
    level = np.r_[np.full(60, -3.0), np.full(60, 3.0)]
    data = {f"T{i}": (level * (1 + 0.1 * i) + rng.normal(scale=0.3, size=n)).tolist() for i in range(4)}
    data["load"] = list(range(n))
    df = series(spark, (np.arange(n) * 5).tolist(), **data)
    found = explore(
        df, ["T0", "T1", "T2", "T3"], PreprocessingConfig(5, 0, 5, 5),
        ExplorationConfig(cluster_count=2, minimum_candidate_duration_minutes=60, maximum_plot_points=50),
        PerformanceConfig("load", "higher_is_better", minimum_duration_minutes=30, candidate_count=2),
    )
    counts = {r["cluster_id"]: r["sample_count"] for r in found.clusters.collect()}
    assert sorted(counts.values()) == [59, 60]
    candidates = found.candidates.collect()
    assert {c["cluster_id"] for c in candidates} == {"cluster_001", "cluster_002"}
    assert found.display.count() == 50
    best = found.performance.orderBy("rank").collect()
    assert [b["mean"] for b in best] == [116.5, 110.5]
    assert found.warnings.count() == 0
    decisions = spark.createDataFrame(
        [(candidates[0]["candidate_id"], "accepted", "ok"), (candidates[1]["candidate_id"], "rejected", "")],
        "candidate_id string, decision string, comment string",
    )
    none = spark.createDataFrame([], "window_id string")
    made = accepted_windows(found.candidates, decisions, none, "r1").collect()
    assert [m["source_ref"] for m in made] == [candidates[0]["candidate_id"]] and not made[0]["enabled"]
    assert accepted_windows(found.candidates, decisions, spark.createDataFrame([(made[0]["window_id"],)], "window_id string"), "r1").count() == 0
    assert clustering.cluster_counts(found.points, found.centers).count() == 2
