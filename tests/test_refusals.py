"""Input that the operators and plans refuse, one case each."""

from dataclasses import replace

import numpy as np
import pytest

from frames import series
from procmon import ExplorationConfig, PerformanceConfig, PreprocessingConfig, StateFilter
from procmon.operators.preprocess import apply_state_filters
from procmon.operators.windows import select_window
from procmon.plans import training
from procmon.plans.exploration import explore


def window(name, start, end):
    return {"id": name, "start": start, "end": end, "source": "manual", "source_ref": None, "enabled": True, "comment": ""}


def test_a_window_without_rows(spark):
    df = series(spark, [0, 5, 10], A=[1, 2, 3])
    assert select_window(df, "2026-01-01T00:05:00", "2026-01-01T00:10:00").count() == 2
    with pytest.raises(ValueError, match="holds no rows"):
        select_window(df, "2026-01-02T00:00:00", "2026-01-03T00:00:00")
    assert select_window(df, "2026-01-02T00:00:00", "2026-01-03T00:00:00", allow_empty=True).count() == 0
    with pytest.raises(ValueError, match="starts after its end"):
        select_window(df, "2026-01-03T00:00:00", "2026-01-02T00:00:00")


def test_state_filters_that_leave_nothing(spark):
    df = series(spark, [0, 5, 10, 15], A=[1, 2, 3, 4], state=[0, 1, None, 2])
    running = lambda low, high: PreprocessingConfig(5, 0, 0, 5, state_filters=(StateFilter("state", low, high),))
    assert [r["A"] for r in apply_state_filters(df, running(1, 2)).orderBy("ts").collect()] == [2.0, 4.0]
    with pytest.raises(Exception, match="removed all rows"):
        apply_state_filters(df, running(7, 9)).count()
    assert apply_state_filters(df, running(7, 9), allow_empty=True).count() == 0
    assert apply_state_filters(df.limit(0), running(7, 9)).count() == 0
    assert apply_state_filters(df, PreprocessingConfig(5, 0, 0, 5)).count() == 4
    with pytest.raises(ValueError, match="state"):
        apply_state_filters(df.drop("state"), running(1, 2))


def test_training_refuses_repeated_times_and_unsuitable_roles(spark):
    df = series(spark, range(0, 100, 5), A=range(20), B=[(i * 7) % 5 for i in range(20)])
    config = PreprocessingConfig(5, 0, 0, 5)
    whole = [window("w", "2026-01-01T00:00:00", "2026-01-01T01:35:00")]
    made = training.build_training_set(df, whole, ["A", "B"], config)
    twice = replace(made, rows=made.rows.unionByName(made.rows))
    with pytest.raises(ValueError, match="same time twice"):
        training.train(twice)
    with pytest.raises(ValueError, match="unsuitable role: B"):
        training.build_training_set(df, whole, ["A", "B"], config, tag_configs={"B": {"role": "state_filter"}})
    filtered = PreprocessingConfig(5, 0, 0, 5, state_filters=(StateFilter("B", 0, 9),))
    with pytest.raises(ValueError, match="unsuitable role: B"):
        training.build_training_set(df, whole, ["A"], filtered, tag_configs={})


def test_exploration_refuses_a_performance_series_that_repeats_a_time(spark):
    times = range(0, 300, 5)
    rng = np.random.default_rng(2)
    common = rng.normal(size=60)
    tags = {name: (common + 0.1 * rng.normal(size=60)).tolist() for name in "ABCD"}  # one component and a residual
    df = series(spark, times, **tags)
    load = series(spark, [*times, 0], load=range(61))
    with pytest.raises(ValueError, match="repeats a time"):
        explore(
            df, list(tags), PreprocessingConfig(5, 0, 0, 5), ExplorationConfig(cluster_count=2, minimum_candidate_duration_minutes=30),
            PerformanceConfig("load", "higher_is_better", minimum_duration_minutes=30, candidate_count=1), performance_series=load,
        )
