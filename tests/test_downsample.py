"""Chart sampling against a direct computation on small series."""

from functools import reduce

import numpy as np
import pytest

from procmon.operators.downsample import downsample_scores, downsample_states, downsample_trend, mark_breaks
from tests.frames import DAY, series

STEP = 5 * 60_000_000
N = 150


def positions(df):
    return sorted(int((r["ts"] - DAY).total_seconds() // 300) for r in df.select("ts").collect())


def grid(m, room):
    return set(np.unique(np.linspace(0, m - 1, room, dtype=int)).tolist())


def even(items, room):
    if room <= 0:
        return []
    if room >= len(items):
        return list(items)
    return [items[i * len(items) // room] for i in range(room)]


def direct_trend(columns, gap, limit):
    n = len(gap)
    critical = {0, n - 1}
    for i in range(1, n):
        if gap[i]:
            critical |= {i - 1, i}
    critical |= {i for i in range(n) if any(c[i] is None for c in columns)}
    if n <= limit:
        return list(range(n))
    if len(critical) >= limit:
        middle = sorted(critical - {0, n - 1})
        keep = middle if len(middle) <= limit - 2 else [middle[i] for i in grid(len(middle), limit - 2)]
        return sorted({0, n - 1, *keep})
    room = limit - len(critical)
    found = set()
    for part in np.array_split(np.arange(n), max(1, room // (2 * len(columns)))):
        for c in columns:
            known = [i for i in part if c[i] is not None]
            if known:
                found |= {min(known, key=lambda i: (c[i], i)), min(known, key=lambda i: (-c[i], i))}
    rest = sorted(int(i) for i in found - critical)
    if len(rest) > room:
        rest = [rest[i] for i in grid(len(rest), room)]
    return sorted(critical | set(rest))


@pytest.mark.parametrize("limit,missing,width", [(40, (7, 33), None), (40, (7, 33), 13 * STEP), (20, range(0, N, 3), None)])
def test_trend(spark, limit, missing, width):
    rng = np.random.default_rng(1)
    a = [None if i in missing else float(v) for i, v in enumerate(rng.integers(0, 30, N))]
    b = rng.normal(size=N).tolist()
    gap = [i in (50, 90) for i in range(N)]
    df = series(spark, range(0, 5 * N, 5), A=a, B=b, g=[int(g) for g in gap]).selectExpr("*", "g = 1 AS gap_start")
    got = positions(downsample_trend(df, ["A", "B"], keys=["series_id"], limit=limit, width=width))
    assert got == direct_trend([a, b], gap, limit)


def test_scores(spark):
    rng = np.random.default_rng(2)
    t2 = rng.gamma(2, 1, N).tolist()
    spe = rng.gamma(2, 1, N).tolist()
    name = lambda v, lo, hi: "abnormal" if v >= hi else "attention" if v >= lo else "normal"
    order = ["normal", "attention", "abnormal"]
    for lo, hi, limit in ((7.0, 8.0, 40), (2.0, 4.0, 40), (2.0, 4.0, 4)):
        s2, sq = [name(v, lo, hi) for v in t2], [name(v, lo, hi) for v in spe]
        both = [max(a, b, key=order.index) for a, b in zip(s2, sq)]
        df = series(
            spark, range(0, 5 * N, 5), t2=t2, spe=spe, t2_limit_ratio=[v / lo for v in t2],
            spe_limit_ratio=[v / lo for v in spe], t2_status=s2, spe_status=sq, status=both,
        )
        sev = [order.index(s) for s in both]
        critical = {0, N - 1, int(np.argmax(t2)), int(np.argmax(spe))} | {i for i in range(N) if sev[i]}
        for column in (s2, sq, both):
            for i in range(1, N):
                if column[i] != column[i - 1]:
                    critical |= {i - 1, i}
        worst = [max(a, b) / lo for a, b in zip(t2, spe)]
        if len(critical) <= limit:
            chosen = set(critical)
        elif limit < 5:
            ranked = sorted(range(N), key=lambda i: (sev[i], worst[i]), reverse=True)
            chosen = {0, N - 1}
            expected = None
        else:
            count = (limit - 2) // 3
            elapsed = np.arange(N) * 300e9
            bucket = np.minimum((elapsed / (elapsed[-1] + 1) * count).astype(int), count - 1)
            chosen = {0, N - 1}
            for k in range(count):
                part = [i for i in range(N) if bucket[i] == k]
                chosen |= {
                    max(part, key=lambda i: (sev[i], worst[i])), max(part, key=lambda i: t2[i]), max(part, key=lambda i: spe[i]),
                }
        if limit < 5 and len(critical) > limit:
            inner = [i for i in ranked if i not in (0, N - 1)]
            chosen |= set(inner[: limit - 2])
        chosen |= set(even([i for i in range(N) if i not in chosen], limit - len(chosen)))
        assert positions(downsample_scores(df, limit=limit)) == sorted(chosen)


@pytest.mark.parametrize("limit", [60, 12])
def test_states(spark, limit):
    rng = np.random.default_rng(3)
    times = [5 * i for i in range(N)]
    segment = [i // 40 for i in range(N)]
    cluster = [f"cluster_{int(v)}" for v in np.repeat(rng.integers(0, 3, N // 10), 10)]
    pc1, pc2 = rng.normal(size=N).tolist(), rng.normal(size=N).tolist()
    df = series(spark, times, pc1=pc1, pc2=pc2, seg=segment, cluster_id=cluster)
    chosen = []

    def add(items):
        for i in sorted(set(items)):
            if len(chosen) < limit and i not in chosen:
                chosen.append(i)

    add([0, N - 1])
    for i in range(1, N):
        if segment[i] != segment[i - 1]:
            add([i - 1, i])
    for i in range(1, N):
        if cluster[i] != cluster[i - 1]:
            add([i - 1, i])
    for pc in (pc1, pc2):
        add([int(np.argmin(pc)), int(np.argmax(pc))])
    chosen += even([i for i in range(N) if i not in chosen], limit - len(chosen))
    got = positions(downsample_states(df, STEP, segment="seg", limit=limit))
    assert got == sorted(chosen)
    marks = {r["ts"]: r["break_before"] for r in mark_breaks(df, STEP, segment="seg", width=7 * STEP).collect()}
    assert sum(marks.values()) == 3


@pytest.mark.parametrize("lo,hi,limit", [(7.0, 8.0, 40), (2.0, 4.0, 40), (2.0, 4.0, 4), (9.0, 9.5, 5), (2.0, 4.0, 400)])
def test_scores_over_shards(spark, lo, hi, limit):
    """Shards of one row, of few and of many rows, with gaps, choose the same rows of every series."""
    rng = np.random.default_rng(7)
    name = lambda v: "not_scored" if v is None else "abnormal" if v >= hi else "attention" if v >= lo else "normal"
    frames = []
    for s, n in (("a", N), ("b", 3 * N), ("c", 1), ("d", 41)):
        times = np.cumsum(5 * (1 + 40 * (rng.random(n) < 0.1))).tolist()
        t2, spe = ([None if v < 0.2 else float(v) for v in np.round(rng.gamma(2, 1, n), 1)] for _ in range(2))
        ratio = lambda values: [None if v is None else v / lo for v in values]
        frames.append(
            series(
                spark, times, s, t2=t2, spe=spe, t2_limit_ratio=ratio(t2), spe_limit_ratio=ratio(spe), t2_status=[name(v) for v in t2],
                spe_status=[name(v) for v in spe], status=[name(None if None in p else max(p)) for p in zip(t2, spe)],
            )
        )
    df = reduce(lambda a, b: a.unionByName(b), frames)
    chosen = lambda width: sorted((r["series_id"], r["ts"]) for r in downsample_scores(df, limit=limit, width=width).collect())
    whole = chosen(None)
    assert {s: sum(k[0] == s for k in whole) for s in "abcd"} == {"a": min(limit, N), "b": min(limit, 3 * N), "c": 1, "d": min(limit, 41)}
    for width in (STEP, 13 * STEP, 100 * STEP):
        assert chosen(width) == whole
