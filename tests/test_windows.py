import random

from pyspark.sql import functions as F

from procmon.operators import windows
from tests.frames import at, series


def frame(spark, spans, key="s"):
    rows = [(key, name, at(a), at(b)) for name, a, b in spans]
    return spark.createDataFrame(rows, "series_id string, window_id string, window_start timestamp_ntz, window_end timestamp_ntz")


def hours(rows):
    return sorted((r[0].strftime("%H:%M"), r[1].strftime("%H:%M")) for r in rows)


def test_merge_and_subtract(spark):
    cuts = frame(spark, [("c", "16:00", "17:00"), ("a", "10:00", "10:30"), ("b", "10:30", "11:00")])
    day = frame(spark, [("day", "08:00", "20:00"), ("late", "21:00", "22:00")])
    times = series(spark, range(480, 1201, 5), A=[0] * 145)
    for width in (60 * 60_000_000, windows.DAY_US):
        merged = windows.merge_windows(cuts, keys=["series_id"], width=width)
        assert hours(merged.select("window_start", "window_end").collect()) == [("10:00", "11:00"), ("16:00", "17:00")]
        assert {r["window_id"] for r in merged.collect()} == {"a", "c"}
        left = windows.subtract_windows(day, cuts, times, width=width)
        assert hours(left.select("start", "end").collect()) == [
            ("08:00", "09:55"), ("11:05", "15:55"), ("17:05", "20:00"), ("21:00", "22:00"),
        ]


def test_overlap_flags_and_samples(spark):
    spans = frame(spark, [("a", "00:00", "03:00"), ("b", "01:00", "01:30"), ("c", "02:59", "04:00"), ("d", "05:00", "06:00")])
    got = {r["window_id"]: r["overlaps"] for r in windows.flag_overlaps(spans, keys=["series_id"], width=60 * 60_000_000).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": False}
    times = series(spark, range(0, 181, 5), A=[0] * 37)
    rows = {r["window_id"]: r for r in windows.summarise_windows(spans, times, 5, on=["series_id"]).collect()}
    assert rows["a"]["quality_status"] == "ready" and rows["c"]["raw_samples"] == 1
    assert rows["d"]["quality_status"] == "sampling_gap" and rows["d"]["raw_samples"] == 0


def test_subtract_reads_the_times_once_and_equals_a_direct_cut(spark):
    clock = lambda m: f"{m // 60:02d}:{m % 60:02d}"
    draw = random.Random(5)
    span = lambda name, most: (name, *(lambda a: (a, min(1430, a + draw.randrange(0, most, 5))))(draw.randrange(300, 1300, 5)))
    spans = [span(f"w{i}", 900) for i in range(12)]  # they overlap, as candidates may
    cuts = [span(f"x{i}", most) for i, most in enumerate([10, 25, 40, 40, 250, 5])]
    moments = sorted(draw.sample(range(300, 1436), 300))
    times = series(spark, [m for m in moments for _ in range(2)], A=[0] * 600)
    shown = lambda rows: frame(spark, [(n, clock(a), clock(b)) for n, a, b in rows])

    expected = set()
    merged = []
    for a, b in sorted((a, b) for _, a, b in cuts):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for name, lo, hi in spans:
        hit = [(a, b) for a, b in merged if b >= lo and a <= hi]
        if not hit:
            expected.add((name, clock(lo), clock(hi)))
            continue
        for i in range(len(hit) + 1):
            low = lo if i == 0 else hit[i - 1][1] + 1
            high = hi if i == len(hit) else hit[i][0] - 1
            free = [m for m in moments if low <= m <= high]
            if free:
                expected.add((name, clock(lo if i == 0 else free[0]), clock(hi if i == len(hit) else free[-1])))
    for minutes in (60, 97, 1440):
        left = windows.subtract_windows(shown(spans), shown(cuts), times, width=minutes * 60_000_000)
        got = [(r["window_id"], r["start"].strftime("%H:%M"), r["end"].strftime("%H:%M")) for r in left.collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    every = spark.range(600).select(F.lit("s").alias("series_id"), F.expr("timestamp_ntz'2024-01-01 05:00:00' + make_dt_interval(0, 0, cast(id AS INT))").alias("ts"))
    left = windows.subtract_windows(shown(spans), shown(cuts), every)
    assert "Range (" not in left._jdf.queryExecution().optimizedPlan().toString()
