"""Replay of a short history with a gap, a missing value and a state change."""

import numpy as np
import pytest

from procmon import PreprocessingConfig
from procmon.operators.replay import replay, replay_contributions, replay_summary
from procmon.operators.scoring import Model
from tests.frames import series

# Five-minute readings; there is none from minute 65 to 80, the 12th lacks one tag, and the 10th is of another state.
MINUTES = [*range(0, 70, 5), *range(80, 115, 5)]
A = [None if i == 11 else 0.35 * ((7 * i) % 13) for i in range(21)]
B = [0.125 * ((5 * i) % 17) for i in range(21)]
MODE = [int(i != 9) for i in range(21)]
REASONS = {55: "missing_input", 60: "insufficient_context", 65: "insufficient_context", 85: "time_gap_reset"}
SCORED = [20, 25, 30, 35, 40, 90, 95, 100, 105, 110]


def directly():
    """minute: (means of the two tags over two readings, T2 of them, SPE of those five minutes before, status)."""
    at = dict(zip(MINUTES, zip(A, B)))
    mean = {m: np.add(at[m], at[m - 5]) / 2 for m in SCORED + [15, 85]}
    out = {}
    for m in SCORED:
        t2, spe = float(mean[m] @ mean[m]), float(mean[m - 5] @ mean[m - 5])
        out[m] = mean[m], t2, spe, "abnormal" if max(t2, spe) > 7 else "attention" if max(t2, spe) > 4 else "normal"
    return out


TAGS = ["A", "B"]
WINDOW = ("2026-01-01T00:20:00", "2026-01-01T01:50:00")


def model():
    names = tuple(f"{t}__lag_{lag:03d}min" for lag in (0, 5) for t in TAGS)
    return Model(names, np.zeros(4), np.ones(4), np.eye(4)[:2], np.ones(4), np.full(4, 0.25), (4.0, 7.0), (4.0, 7.0), 100)


@pytest.mark.parametrize("shard", [None, 30])
def test_legacy_replay(spark, shard):
    df = series(spark, MINUTES, A=A, B=B, mode=MODE)
    config = PreprocessingConfig(
        5, 10, 5, 5, filter_method="trailing_mean", state_filters=({"column": "mode", "minimum": 1.0},)
    )
    scores, rows = replay(df, model(), TAGS, config, *WINDOW, semantics="legacy", shard_minutes=shard)
    got = {r["ts"].hour * 60 + r["ts"].minute: r for r in scores.collect()}
    want = directly()
    assert sorted(got) == sorted([*want, *REASONS])
    for minute, reason in REASONS.items():
        row = got[minute]
        assert (row["status"], row["invalid_reason"], row["t2"], row["spe"]) == ("not_scored", reason, None, None)
    for minute, (_, t2, spe, status) in want.items():
        row = got[minute]
        assert (row["status"], row["invalid_reason"]) == (status, None), minute
        assert (row["t2"], row["spe"]) == (pytest.approx(t2, rel=1e-9), pytest.approx(spe, rel=1e-9))
    assert {w[3] for w in want.values()} == {"normal", "attention", "abnormal"}

    meta = {t: {"description": f"Tag {t}", "unit": "u"} for t in TAGS}
    shares = replay_contributions(scores, model(), meta).collect()
    assert len(shares) == sum((t2 > 4) + (spe > 4) for _, t2, spe, _ in want.values())
    only_t2 = [m for m, (_, t2, spe, _) in want.items() if t2 > 4 >= spe]
    assert only_t2
    for r in shares:
        minute = r["ts"].hour * 60 + r["ts"].minute
        if minute in only_t2:
            share = 100 * want[minute][0] ** 2 / want[minute][1]
            assert {t["tag"]: pytest.approx(t["contribution_pct"], rel=1e-9) for t in r["tags"]} == dict(zip(TAGS, share))
            assert [(t["unit"], t["lag_start_minutes"], t["lag_end_minutes"]) for t in r["tags"]] == [("u", 0, 0)] * 2

    row = replay_summary(scores, rows, model(), *WINDOW, semantics="legacy").collect()[0]
    assert (row["source_row_count"], row["output_row_count"], row["score_valid_count"]) == (19, 14, 10)
    assert row["state_filter_excluded_rows"] == 3
    over = lambda k, limit: sum(w[k] > limit for w in want.values())
    assert (row["t2_exceedance_95_count"], row["spe_exceedance_99_count"]) == (over(1, 4), over(2, 7))
    assert row["maximum_t2"] == pytest.approx(max(w[1] for w in want.values()))


@pytest.mark.parametrize("shard", [None, 60])
def test_first_order_replay_reads_all_history(spark, shard):
    x = [float((i * 7) % 11) for i in range(60)]
    x[40] = None
    df = series(spark, range(0, 300, 5), A=x, B=[1.0] * 60)
    config = PreprocessingConfig(5, 0, 5, 5, filter_method="first_order", first_order_alpha=0.35)
    scores, rows = replay(df, model(), TAGS, config, "2026-01-01T03:00:00", "2026-01-01T04:00:00", shard_minutes=shard)
    y, want = None, {}
    for i, v in enumerate(x):
        if v is None:
            y = None
            continue
        y = v if y is None else 0.35 * v + 0.65 * y
        want[5 * i] = y
    got = {r["ts"].hour * 60 + r["ts"].minute: r for r in scores.collect()}
    assert sorted(got) == [m for m in range(180, 241, 5) if m != 200]
    for minute, row in got.items():
        if minute == 205:
            assert row["invalid_reason"] == "insufficient_context"
        else:
            assert row["pc1"] == pytest.approx(want[minute], rel=1e-12)
