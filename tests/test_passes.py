"""What is read once stays read once, and join keys cost nothing below the grouping that makes the rows."""

import pytest
from pyspark.sql import functions as F

from procmon import ExplorationConfig, PreprocessingConfig
from procmon.catalog.periods import label_crosstab
from procmon.catalog.views import _whole
from procmon.functions.columns import from_micros, micros
from procmon.operators import clustering, contributions
from procmon.operators.downsample import downsample_scores, downsample_states
from procmon.operators.preprocess import preprocess
from procmon.operators.scoring import Model, score
from procmon.operators.shards import number_rows
from procmon.plans import training

STEP = 5 * 60_000_000


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def points(spark, n=40):
    return spark.range(n).select(
        F.lit("s").alias("series_id"), from_micros(F.col("id") * STEP).alias("ts"), (F.col("id") % 7).cast("double").alias("A"),
        F.when(F.col("id") % 20 < 10, "cluster_001").otherwise("cluster_002").alias("cluster_id"),
        (F.col("id") % 5).cast("double").alias("center_distance"), F.col("id").cast("double").alias("A__lag_000min"),
    )


def test_join_keys_are_not_tested_below_the_grouping(spark):
    grouped = points(spark).groupBy(F.col("series_id"), F.col("ts")).agg(F.sum("A").alias("A")).withColumn("us", micros(F.col("ts")))
    placed = number_rows(number_rows(grouped, ["series_id"], "us", 10 * STEP, "p"), ["series_id"], "us", 7 * STEP, "q")
    assert "isnotnull" not in optimised(placed)
    assert {(r["p"], r["q"]) for r in placed.collect()} == {(i, i) for i in range(40)}


def test_cluster_summary_scores_once(spark):
    clusters, tags = clustering.cluster_summary(points(spark), ["A"], STEP)
    assert "Range (" not in optimised(clusters) and "Range (" not in optimised(tags)
    assert {r["cluster_id"]: (r["sample_count"], r["segment_count"]) for r in clusters.collect()} == {"cluster_001": (20, 2), "cluster_002": (20, 2)}


def test_first_order_prepares_once(spark):
    config = PreprocessingConfig(5, 0, 0, 5, filter_method="first_order", first_order_alpha=0.5)
    rows = preprocess(points(spark), ["A"], config, shard_minutes=50)
    assert "Range (" not in optimised(rows)
    assert rows.where("row_class = 'valid'").count() == 40


def test_whole_numbers_round_like_round(spark):
    values = [0.5, -0.5, 1.5, -2.5, 2.4999999999999996, 0.49999999999999994, 104.99999999999999, 7.0, -7.9, 0.0, 123456789012.5, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(~_whole(F.col("v")).eqNullSafe(F.round("v").cast("long"))).count() == 0


def test_times_come_back_to_the_microsecond(spark):
    us = [0, 1, -1, 86_399_999_999, 86_400_000_000, -86_400_000_001, 1_700_000_000_123_457, -2_208_988_800_000_001]
    df = spark.createDataFrame([(u,) for u in us], "us long")
    assert [r[0] for r in df.select(micros(from_micros(F.col("us")))).collect()] == us


def scores(spark):
    features = [f"{t}__lag_{lag:03d}min" for lag in (0, 5, 10, 15, 20) for t in "AB"]
    model = Model(
        features, [0.0] * 10, [1.0] * 10, [[10**-0.5] * 10, [10**-0.5, -(10**-0.5)] * 5], [1.0] * 10, [0.1] * 10, (0.5, 2.0), (0.5, 2.0), 100,
    )
    made = [((F.col("id") * (j + 3) * 7) % 11 / 4.0 - 1.0).alias(f) for j, f in enumerate(features)]
    rows = spark.range(120).select(F.lit("s").alias("series_id"), from_micros(F.col("id") * STEP).alias("ts"), *made)
    return score(rows, model), model


def test_scores_are_computed_once(spark):
    scored, model = scores(spark)
    centers = [[-1.0, 0.0], [1.0, 0.0]]
    points = clustering.assign(scored, ["pc1", "pc2"], centers)
    config = ExplorationConfig(minimum_candidate_duration_minutes=5)
    for found in (
        contributions.event_contributions(scored, model, STEP),
        clustering.cluster_candidates(points, ["pc1", "pc2"], centers, config, STEP),
        downsample_scores(scored, limit=20),
        downsample_states(points, STEP, limit=20),
    ):
        assert "Range (" not in optimised(found) and found.count() > 0


def test_neighbours_of_chart_rows_read_the_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    scored, _ = scores(spark)
    for thin in (lambda rows: downsample_scores(rows, limit=20), lambda rows: downsample_states(rows.withColumn("cluster_id", F.lit("c")), STEP, limit=20)):
        before = seen.value
        thin(scored.mapInPandas(count, scored.schema)).count()
        assert seen.value - before == 120


def test_chart_rows_meet_their_picks_in_one_pass(spark):
    scored, _ = scores(spark)
    plan = optimised(downsample_scores(scored, limit=20))
    assert plan.count("LogicalRDD") <= 4  # the rows and one row per shard, for the picks and for the result
    assert plan.count("Join") <= 3 and "Union" not in plan


def test_label_crosstab_reads_shipments_once(spark):
    assert "Relation" not in optimised(label_crosstab(spark, "/root/testdata/sf0.001"))


def test_segments_are_prepared_once(spark):
    config = PreprocessingConfig(5, 0, 5, 5)
    assert "Range (" not in optimised(preprocess(points(spark), ["A"], config, shard_minutes=50, segment_ids=True))
    window = {"id": "w", "start": "1970-01-01", "end": "1970-01-02", "source": "manual", "source_ref": None, "enabled": True, "comment": ""}
    found = training.segment_summary(training.build_training_set(points(spark), [window], ["A"], config, shard_minutes=50))
    assert optimised(found).count("Aggregate") == 2  # the summary of the shards, the account
    rows = found.collect()
    assert [(r["source_row_count"], r["start"].minute, r["end"].hour) for r in rows] == [(40, 0, 3)]


def test_grid_check_reads_the_times_it_is_given(spark):
    config = PreprocessingConfig(5, 0, 0, 5)
    twice = points(spark).unionByName(points(spark)).where("minute(ts) < 10 OR hour(ts) > 2")
    grouped = lambda rows: rows.groupBy("series_id", "ts").agg(F.avg("A").alias("A"))
    plain = preprocess(grouped(twice), ["A"], config, shard_minutes=20)
    given = preprocess(grouped(twice), ["A"], config, shard_minutes=20, times=twice)
    assert given.exceptAll(plain).count() == 0 and given.count() == plain.count() > 0
    check = lambda rows: optimised(rows).split("scalar-subquery")[0].count("Aggregate")
    assert check(given) <= check(plain)
    late = twice.withColumn("ts", F.when(F.hour("ts") > 2, F.col("ts") + F.expr("INTERVAL 1 MINUTE")).otherwise(F.col("ts")))
    with pytest.raises(Exception, match="sampling grid"):
        preprocess(grouped(late), ["A"], config, shard_minutes=20, times=late).collect()


def test_tag_shares_by_hand(spark):
    features = [f"{t}__lag_{lag:03d}min" for lag in (0, 5, 10, 15, 20) for t in "AB"]
    cases = [[1.0, 0.0, 4.0, 3.0, 9.0, 3.0, 4.5, 1.0, 4.0, 3.0], [0.0] * 10, [5.0, 2.0, 1.0, 2.0, 5.0, 2.0, 2.5, 2.0, 9.0, 2.0]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, m array<double>")
    shares = contributions.tag_shares(F.col("m"), features)
    got = {r["i"]: [tuple(t) for t in r["tags"]] for r in df.select("i", shares.alias("tags")).collect()}
    for i, case in enumerate(cases):
        want = []
        for t, tag in enumerate("AB"):
            v = case[t::2]
            at, half = v.index(max(v)), max(v) * 0.5
            first, last = at, at
            while first > 0 and v[first - 1] >= half:
                first -= 1
            while last < 4 and v[last + 1] >= half:
                last += 1
            want.append((tag, "", "", sum(v) / sum(case) * 100.0 if sum(case) else 0.0, first * 5, last * 5))
        want.sort(key=lambda w: (-w[3], w[0]))
        assert [(*g[:3], round(g[3], 9), *g[4:]) for g in got[i]] == [(*w[:3], round(w[3], 9), *w[4:]) for w in want]
    assert str(df.select(shares)._jdf.queryExecution().analyzed()).count("array_position") <= 2


def uneven(spark, n=900):
    """Two series on a five-minute grid with gaps, values that are missing or out of range, and a state."""
    kept = spark.range(n).where("(id * 7919) % 23 > 1 AND id % 200 < 150").withColumn("s", F.explode(F.array(F.lit(7), F.lit(12))))
    at = F.col("id") * STEP + (F.col("s") % 2) * 3 * 86_400_000_000
    value = lambda k, m: ((F.col("id") * k + F.col("s")) % m).cast("double")
    return kept.select(
        F.col("s").cast("long").alias("series_id"), from_micros(at).alias("ts"),
        F.when(F.col("id") % 31 > 0, value(13, 17)).alias("A"), value(29, 41).alias("B"), value(5, 11).alias("C"),
    )


@pytest.mark.parametrize("method,interval,smooth", [("none", 5, "trailing_mean"), ("mean", 15, "trailing_mean"), ("last", 15, "first_order"), ("mean", 15, "trailing_median")])
def test_valid_rows_alone_are_the_valid_rows_of_all(spark, method, interval, smooth):
    config = PreprocessingConfig(
        interval, 2 * interval, 2 * interval, interval, resampling_method=method, filter_method=smooth, gap_threshold_minutes=30,
        first_order_alpha=0.5 if smooth == "first_order" else None, state_filters=({"column": "C", "maximum": 8.0},),
    )
    made = lambda **more: preprocess(
        uneven(spark), ["A", "B"], config, engineering_ranges={"B": (1.0, 39.0)}, exclude_engineering_range=True, source_interval_minutes=5,
        shard_minutes=600, **more,
    )
    every = made().where("row_class = 'valid'")
    assert every.count() > 20
    alone = made(valid_only=True)
    assert alone.columns == every.columns
    assert alone.exceptAll(every).count() == 0 and every.exceptAll(alone).count() == 0


def test_valid_rows_are_sorted_no_third_time(spark):
    config = PreprocessingConfig(15, 30, 30, 15, resampling_method="mean", filter_method="trailing_mean", gap_threshold_minutes=30)
    rows = preprocess(uneven(spark), ["A", "B"], config, source_interval_minutes=5, shard_minutes=600, valid_only=True).select("series_id", "A__lag_030min")
    specs = optimised(rows).split("windowspecdefinition(")[1:]
    assert specs and not any("kept" in spec.split(" ASC")[0] for spec in specs)


def test_dates_are_midnights(spark):
    days = spark.range(60).where("id % 25 < 20").select(F.lit(3).alias("series_id"), F.expr("date_add(date'1969-12-10', cast(id AS int))").alias("ts"), F.col("id").cast("double").alias("A"))
    config = PreprocessingConfig(2 * 1440, 0, 0, 2 * 1440, resampling_method="mean", gap_threshold_minutes=3 * 1440)
    made = lambda rows: preprocess(rows, ["A"], config, source_interval_minutes=1440, shard_minutes=10 * 1440, times=rows)
    plain = made(days.withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert made(days).exceptAll(plain).count() == 0 and made(days).count() == plain.count() > 20
    with pytest.raises(Exception, match="ts must not be null"):
        made(days.withColumn("ts", F.when(F.col("A") > 3, F.col("ts")))).collect()
