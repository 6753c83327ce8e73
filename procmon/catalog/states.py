"""Operating states, performance windows, screening and chart views."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmon import ExplorationConfig, PerformanceConfig, PreprocessingConfig
from procmon.catalog.models import INTERVAL, MODEL, SCORE_CTES, TIME, scored
from procmon.catalog.registry import number, query, r, rounded, t, text_time, with_ctes
from procmon.catalog.timegrid import TAGS
from procmon.catalog.views import (
    DAILY_SQL,
    DAY,
    MINUTELY_SQL,
    ORDER_DAYS_SQL,
    daily,
    minutely,
    order_days,
    vector_feature,
    vectors,
)
from procmon.config import MINUTE
from procmon.operators import clustering, performance
from procmon.operators.downsample import (
    SCORE_STATUSES,
    downsample_scores,
    downsample_states,
    downsample_trend,
    mark_breaks,
)
from procmon.operators.screening import screen
from procmon.plans.exploration import accepted_windows, exploration_warnings
from procmon.plans.trend import scatter, trend_rows, trend_stages
from procmon.plans.validation import verify_scores

# Three centers on the plane of the fixed model.
CENTERS = [[-1.2, 0.1], [0.0, -0.6], [1.1, 0.5]]
PCS = ["pc1", "pc2"]
WIDTH = 40 * INTERVAL


def points(spark, sf):
    return clustering.assign(scored(spark, sf), PCS, CENTERS)


_DISTANCES = ", ".join(
    f"sqrt((p0 - {number(a)}) * (p0 - {number(a)}) + (p1 - {number(b)}) * (p1 - {number(b)})) AS d{i}"
    for i, (a, b) in enumerate(CENTERS)
)
POINT_CTES = {
    **SCORE_CTES,
    "pd": f"SELECT *, {_DISTANCES} FROM scored",
    "pts": """SELECT *, least(d0, d1, d2) AS dist, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 'cluster_001' WHEN d1 <= d2 THEN 'cluster_002'
              ELSE 'cluster_003' END AS cluster_id FROM pd""",
    "rb": f"""SELECT *, coalesce(us - lag(us) OVER o <> {INTERVAL} OR cluster_id <> lag(cluster_id) OVER o, true) AS nb FROM pts
              WINDOW o AS (PARTITION BY series_id ORDER BY us)""",
    "rn": "SELECT *, sum(CAST(nb AS INT)) OVER (PARTITION BY series_id ORDER BY us) AS run FROM rb",
    "rr": "SELECT series_id, cluster_id, run, min(us) AS a, max(us) AS b, count(*) AS cnt FROM rn GROUP BY 1, 2, 3",
}


@query(
    "cluster_assignment",
    with_ctes(**POINT_CTES) + f"SELECT series_id, {TIME} AS ts, cluster_id, {r('dist')} AS center_distance FROM pts",
)
def cluster_assignment(spark, sf):
    p = points(spark, sf)
    return p.select(
        "series_id", text_time(F.col("ts")).alias("ts"), "cluster_id", rounded(F.col("center_distance")).alias("center_distance")
    )


@query(
    "cluster_counts",
    with_ctes(**POINT_CTES)
    + f"SELECT cluster_id, count(*) AS sample_count, {r('count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS share FROM pts GROUP BY 1",
)
def cluster_counts(spark, sf):
    c = clustering.cluster_counts(points(spark, sf), CENTERS)
    return c.select("cluster_id", "sample_count", rounded(F.col("share")).alias("share"))


@query(
    "cluster_summary",
    with_ctes(
        **POINT_CTES,
        ru=f"SELECT cluster_id, count(*) AS segs, CAST(sum((b - a + {INTERVAL}) // {MINUTE}) AS BIGINT) AS mins FROM rr GROUP BY 1",
    )
    + f"""SELECT cluster_id, count(*) AS sample_count, {r('stddev_pop(dist)')} AS pc_score_dispersion,
      {r('quantile_cont(dist, 0.5)')} AS median_distance_to_centroid, {t('make_timestamp(min(us))')} AS start, {t('make_timestamp(max(us))')} AS stop,
      any_value(segs) AS segment_count, any_value(mins) AS total_duration_minutes FROM pts JOIN ru USING (cluster_id) GROUP BY 1""",
)
def cluster_summary(spark, sf):
    c, _ = clustering.cluster_summary(points(spark, sf), TAGS, INTERVAL, width=WIDTH)
    return c.select(
        "cluster_id", "sample_count", rounded(F.col("pc_score_dispersion")).alias("pc_score_dispersion"),
        rounded(F.col("median_distance_to_centroid")).alias("median_distance_to_centroid"),
        text_time(F.col("start")).alias("start"), text_time(F.col("end")).alias("stop"), "segment_count", "total_duration_minutes",
    )


@query(
    "cluster_tag_statistics",
    with_ctes(**POINT_CTES)
    + " UNION ALL ".join(
        f"""SELECT cluster_id, '{v}' AS tag, {r(f'avg({v}_l0)')} AS mean, {r(f'stddev_pop({v}_l0)')} AS std, {r(f'quantile_cont({v}_l0, 0.5)')} AS median,
        {r(f'min({v}_l0)')} AS minimum, {r(f'max({v}_l0)')} AS maximum FROM pts GROUP BY 1"""
        for v in TAGS
    ),
)
def cluster_tag_statistics(spark, sf):
    _, s = clustering.cluster_summary(points(spark, sf), TAGS, INTERVAL, width=WIDTH)
    return s.select("cluster_id", "tag", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "median", "minimum", "maximum")])


@query(
    "representative_runs",
    with_ctes(**POINT_CTES)
    + f"""SELECT series_id, cluster_id, {t('make_timestamp(a)')} AS start, {t('make_timestamp(b)')} AS stop, cnt AS row_count,
      row_number() OVER (PARTITION BY series_id, cluster_id ORDER BY cnt DESC, a) AS rank FROM rr QUALIFY rank <= 3""",
)
def representative_runs(spark, sf):
    runs = clustering.representative_runs(points(spark, sf), INTERVAL, width=WIDTH)
    return runs.select(
        "series_id", "cluster_id", text_time(F.col("start")).alias("start"), text_time(F.col("end")).alias("stop"), "row_count", "rank"
    )


_SPLIT = {
    **POINT_CTES,
    "sb": f"""SELECT *, coalesce(us - lag(us) OVER o <> {INTERVAL} OR cluster_id <> lag(cluster_id) OVER o OR year(make_timestamp(us)) <> lag(year(make_timestamp(us))) OVER o, true) AS sn
              FROM pts WINDOW o AS (PARTITION BY series_id ORDER BY us)""",
    "sr2": "SELECT *, sum(CAST(sn AS INT)) OVER (PARTITION BY series_id ORDER BY us) AS srun FROM sb",
}


@query(
    "segment_state_runs",
    with_ctes(**_SPLIT)
    + f"""SELECT series_id, cluster_id, {t('make_timestamp(min(us))')} AS start, {t('make_timestamp(max(us))')} AS stop, count(*) AS row_count
    FROM sr2 GROUP BY series_id, cluster_id, srun""",
)
def segment_state_runs(spark, sf):
    """Stretches in one cluster that do not cross the borders of segments, here calendar years."""
    marked = points(spark, sf).withColumn("segment", F.year("ts"))
    found = clustering.state_runs(marked, INTERVAL, segment="segment", width=WIDTH)
    return found.select("series_id", "cluster_id", text_time(F.col("start")).alias("start"), text_time(F.col("end")).alias("stop"), "row_count")


_LONG = 3 * INTERVAL // MINUTE
_OFF = " ".join(
    f"WHEN 'cluster_{i + 1:03d}' THEN sqrt((m0 - {number(a)}) * (m0 - {number(a)}) + (m1 - {number(b)}) * (m1 - {number(b)}))"
    for i, (a, b) in enumerate(CENTERS)
)


@query(
    "cluster_candidates",
    with_ctes(
        **POINT_CTES,
        md="SELECT *, quantile_cont(dist, 0.5) OVER (PARTITION BY series_id, run) AS mid FROM rn",
        ag="""SELECT series_id, cluster_id, run, min(us) AS a, max(us) AS b, count(*) AS cnt, avg(p0) AS m0, avg(p1) AS m1,
              1.0 / (1.0 + 1.4826 * quantile_cont(abs(dist - mid), 0.5)) AS stab FROM md GROUP BY 1, 2, 3""",
        cd=f"SELECT *, CASE cluster_id {_OFF} END AS off FROM ag WHERE (b - a + {INTERVAL}) // {MINUTE} >= {_LONG}",
        rk="SELECT *, row_number() OVER (PARTITION BY series_id, cluster_id ORDER BY off, stab DESC, b - a DESC, a) AS rank FROM cd",
    )
    + f"""SELECT series_id, cluster_id, {t('make_timestamp(a)')} AS start, {t('make_timestamp(b)')} AS stop, cnt AS sample_count,
      {r('off')} AS centroid_distance, {r('stab')} AS stability_score, rank FROM rk WHERE rank <= 2""",
)
def cluster_candidates(spark, sf):
    config = ExplorationConfig(minimum_candidate_duration_minutes=_LONG, candidate_count_per_cluster=2)
    c = clustering.cluster_candidates(points(spark, sf), PCS, CENTERS, config, INTERVAL, width=WIDTH)
    return c.select(
        "series_id", "cluster_id", text_time(F.col("start")).alias("start"), text_time(F.col("end")).alias("stop"), "sample_count",
        rounded(F.col("centroid_distance")).alias("centroid_distance"), rounded(F.col("stability_score")).alias("stability_score"), "rank",
    )


@query("kmeans_states")
def kmeans_states(spark, sf):
    """Clusters of the label-wise embeddings; ids follow the order of the centers."""
    v = vectors(spark, sf)
    pcs = [vector_feature(j) for j in range(8)]
    centers = clustering.fit_centers(v, pcs, 4)
    return clustering.assign(v, pcs, centers).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.avg("center_distance").alias("mean_distance")
    )


@query(
    "accepted_candidates",
    with_ctes(
        **POINT_CTES,
        md="SELECT *, quantile_cont(dist, 0.5) OVER (PARTITION BY series_id, run) AS mid FROM rn",
        ag="""SELECT series_id, cluster_id, run, min(us) AS a, max(us) AS b, count(*) AS cnt, avg(p0) AS m0, avg(p1) AS m1,
              1.0 / (1.0 + 1.4826 * quantile_cont(abs(dist - mid), 0.5)) AS stab FROM md GROUP BY 1, 2, 3""",
        cd=f"SELECT *, CASE cluster_id {_OFF} END AS off FROM ag WHERE (b - a + {INTERVAL}) // {MINUTE} >= {_LONG}",
        rk="SELECT *, row_number() OVER (PARTITION BY series_id, cluster_id ORDER BY off, stab DESC, b - a DESC, a) AS rank FROM cd",
        ac="""SELECT *, series_id || '-' || cluster_id || '-candidate-' || printf('%03d', rank) AS cid
              FROM rk WHERE rank <= 1 AND stab > 0.7 AND cnt <= 8""",
    )
    + f"""SELECT 'state-exploration-r-' || cid AS window_id, {t('make_timestamp(a)')} AS window_start, {t('make_timestamp(b)')} AS window_end,
      'cluster' AS source, cid AS source_ref, false AS enabled, '' AS comment FROM ac""",
)
def accepted_candidates(spark, sf):
    """Steady candidates accepted as training windows, in the shape the training plan reads."""
    config = ExplorationConfig(minimum_candidate_duration_minutes=_LONG, candidate_count_per_cluster=1)
    found = clustering.cluster_candidates(points(spark, sf), PCS, CENTERS, config, INTERVAL)
    found = found.withColumn("candidate_id", F.concat_ws("-", "series_id", "candidate_id"))
    decisions = found.select(
        "candidate_id", F.when(F.col("stability_score") > 0.7, "accepted").otherwise("rejected").alias("decision"), F.lit("").alias("comment")
    )
    existing = found.where("sample_count > 8").select(
        F.format_string("state-exploration-r-%s", F.col("candidate_id")).alias("window_id")
    )
    made = accepted_windows(found, decisions, existing, "r")
    return made.withColumns({c: text_time(F.col(c)) for c in ("window_start", "window_end")})


# ---- performance ---------------------------------------------------------------------

TARGET = PerformanceConfig("total", "target_range", 120000.0, 180000.0, minimum_duration_minutes=3 * DAY, candidate_count=5)


@query(
    "sliding_windows",
    with_ctes(
        o=ORDER_DAYS_SQL,
        x=f"""SELECT *, ts - lag(ts, 2) OVER k = INTERVAL 2 DAY AS whole, lag(ts, 2) OVER k AS first, avg(total) OVER f AS mean,
          quantile_cont(total, 0.5) OVER f AS median, avg(CASE WHEN total BETWEEN 120000 AND 180000 THEN 1e0 ELSE 0e0 END) OVER f AS ratio,
          avg(greatest(120000 - total, total - 180000, 0)) OVER f AS off FROM o
          WINDOW k AS (PARTITION BY series_id ORDER BY ts), f AS (PARTITION BY series_id ORDER BY ts ROWS 2 PRECEDING)""",
    )
    + f"""SELECT series_id, {t('first')} AS start, {t('ts')} AS stop, {r('mean')} AS mean, {r('median')} AS median, {r('ratio')} AS target_ratio,
      {r('off')} AS mean_target_deviation FROM x WHERE whole""",
)
def sliding_windows(spark, sf):
    w = performance.sliding_windows(order_days(spark, sf), "total", TARGET, DAY * MINUTE, width=200 * DAY * MINUTE)
    return w.select(
        "series_id", text_time(F.col("start")).alias("start"), text_time(F.col("end")).alias("stop"),
        *[rounded(F.col(c)).alias(c) for c in ("mean", "median", "target_ratio", "mean_target_deviation")],
    )


@query("performance_candidates")
def performance_candidates(spark, sf):
    """Best order periods per priority, with the clusters of the days in them; checked by brute force in the tests."""
    days = order_days(spark, sf).select("series_id", "ts", "total", (F.col("total") / 1e5).alias("pc1"), F.col("orders").alias("pc2"))
    days = clustering.assign(days, PCS, [[0.8, 1.0], [1.5, 2.0], [2.2, 1.0]])
    return performance.performance_candidates(days, "total", TARGET, DAY * MINUTE)


CONDITIONS = [{"column": "total", "minimum": 120000.5}, {"column": "orders", "maximum": 2}]
_SCREEN = with_ctes(
    o=ORDER_DAYS_SQL,
    m="SELECT series_id, ts, total >= 120000.5 AS c0, orders <= 2 AS c1 FROM o",
    x="""SELECT *, coalesce(ts - lag(ts) OVER k <> INTERVAL 1 DAY, true) AS nb FROM m WHERE c0 AND c1 WINDOW k AS (PARTITION BY series_id ORDER BY ts)""",
    y="SELECT *, sum(CAST(nb AS INT)) OVER (PARTITION BY series_id ORDER BY ts) AS run FROM x",
    z="SELECT series_id, min(ts) AS a, max(ts) AS b, count(*) AS n FROM y GROUP BY series_id, run",
)


def _screen(spark, sf):
    return screen(order_days(spark, sf), CONDITIONS, DAY * MINUTE, keys=["series_id"], width=128 * DAY * MINUTE)


@query(
    "performance_screen",
    _SCREEN
    + f"SELECT series_id, count(*) AS total_rows, count(*) FILTER (c0 AND c1) AS matched_rows, {r('avg(CAST(c0 AND c1 AS INT))')} AS match_share FROM m GROUP BY 1",
)
def performance_screen(spark, sf):
    return _screen(spark, sf)[0].withColumn("match_share", rounded(F.col("match_share")))


@query(
    "performance_conditions",
    _SCREEN
    + """SELECT series_id, 'total' AS "column", count(*) FILTER (c0) AS matched_rows FROM m GROUP BY 1
    UNION ALL SELECT series_id, 'orders', count(*) FILTER (c1) FROM m GROUP BY 1""",
)
def performance_conditions(spark, sf):
    return _screen(spark, sf)[1].select("series_id", "column", "matched_rows")


@query(
    "performance_runs",
    _SCREEN
    + f"""SELECT series_id, {t('a')} AS start, {t('b')} AS stop, n AS row_count, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, a) AS rank
    FROM z QUALIFY rank <= 10""",
)
def performance_runs(spark, sf):
    found = _screen(spark, sf)[2]
    return found.select("series_id", text_time(F.col("start")).alias("start"), text_time(F.col("end")).alias("stop"), "row_count", "rank")


@query(
    "exploration_warnings",
    with_ctes(**POINT_CTES)
    + """SELECT 'exploration_coverage_low' AS code, round(count(*) FILTER (cls = 'valid') / CAST(count(*) AS DOUBLE), 6) AS value FROM every
      HAVING count(*) FILTER (cls = 'valid') < 0.5 * count(*)
    UNION ALL SELECT 'preprocessing_loss_ratio_high', round((count(*) FILTER (cls <> 'valid') + count(*) FILTER (cls = 'input_invalid')) / CAST(count(*) AS DOUBLE), 6) FROM every
      HAVING count(*) FILTER (cls <> 'valid') + count(*) FILTER (cls = 'input_invalid') > 0.3 * count(*)
    UNION ALL SELECT 'cluster_has_no_candidate', 0 FROM pts GROUP BY cluster_id""",
)
def warnings(spark, sf):
    from procmon.catalog.timegrid import BASE, prepared
    from procmon.operators.losses import loss_ratios, loss_summary

    losses = loss_ratios(loss_summary(prepared(spark, sf), BASE, n_tags=3))
    counts = clustering.cluster_counts(points(spark, sf), CENTERS).withColumn("candidate_count", F.lit(0))
    w = exploration_warnings(counts, losses)
    return w.select("code", F.round("value", 6).alias("value"))


# ---- charts --------------------------------------------------------------------------


@query(
    "break_markers",
    with_ctes(d=DAILY_SQL)
    + f"""SELECT series_id, {t('ts')} AS ts, coalesce(ts - lag(ts) OVER (PARTITION BY series_id ORDER BY ts) <> INTERVAL 1 DAY, false) AS break_before FROM d""",
)
def break_markers(spark, sf):
    m = mark_breaks(daily(spark, sf), DAY * MINUTE, width=100 * DAY * MINUTE)
    return m.select("series_id", text_time(F.col("ts")).alias("ts"), "break_before")


_VIEW = PreprocessingConfig(60, 0, 0, 60, resampling_method="mean", gap_threshold_minutes=240)


@query(
    "trend_rows",
    with_ctes(
        m=MINUTELY_SQL,
        a="""SELECT *, coalesce(ts - lag(ts) OVER k > INTERVAL 240 MINUTE, true) AS gap, lag(ts) OVER k IS NULL AS head FROM m
             WINDOW k AS (PARTITION BY series_id ORDER BY ts)""",
        b=f"""SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY series_id ORDER BY ts) AS seg,
              epoch_us(ts) + ((-epoch_us(ts) % {60 * MINUTE}) + {60 * MINUTE}) % {60 * MINUTE} AS label FROM a""",
        c="SELECT series_id, seg, make_timestamp(label) AS ts, avg(value) AS value FROM b GROUP BY 1, 2, 3",
        e="SELECT *, coalesce(lag(seg) OVER (PARTITION BY series_id ORDER BY ts) <> seg, false) AS g FROM c",
    )
    + f"""SELECT coalesce(a.series_id, e.series_id) AS series_id, {t('coalesce(a.ts, e.ts)')} AS ts, {r('a.value')} AS value__raw, {r('e.value')} AS value__smoothed,
      coalesce(a.gap AND NOT a.head, false) OR coalesce(e.g, false) AS gap_start
    FROM (SELECT * FROM a WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20') a
    FULL JOIN (SELECT * FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20') e ON a.series_id = e.series_id AND a.ts = e.ts""",
)
def trend_view_rows(spark, sf):
    stages = trend_stages(minutely(spark, sf), ["value"], _VIEW, source_interval_minutes=1, shard_minutes=3000)
    start, end = F.expr("timestamp_ntz'2024-01-03 00:00:00'"), F.expr("timestamp_ntz'2024-01-20 00:00:00'")
    rows = trend_rows(stages, ["value"], start, end)
    return rows.select(
        "series_id", text_time(F.col("ts")).alias("ts"), rounded(F.col("value__raw")).alias("value__raw"),
        rounded(F.col("value__smoothed")).alias("value__smoothed"), "gap_start",
    )


@query("scatter_pairs", with_ctes(d=DAILY_SQL) + """SELECT 'qty' AS x, 'disc' AS y, count(*) FILTER (qty IS NOT NULL AND disc IS NOT NULL) AS n FROM d
  UNION ALL SELECT 'qty', 'tax', count(*) FROM d UNION ALL SELECT 'disc', 'tax', count(disc) FROM d""")
def scatter_pairs(spark, sf):
    return scatter(daily(spark, sf), ["qty", "disc", "tax"])


@query("trend_downsample")
def trend_downsample(spark, sf):
    """At most 300 rows per return flag; checked by brute force in the tests."""
    marked = mark_breaks(daily(spark, sf), 3 * DAY * MINUTE, name="gap_start").drop("gap_start")
    marked = marked.withColumn("gap_start", F.lit(False))
    thin = downsample_trend(marked, ["qty", "price"], keys=["series_id"], limit=300)
    return thin.select("series_id", text_time(F.col("ts")).alias("ts"), "qty", "price")


@query("score_downsample")
def score_downsample(spark, sf):
    """At most 40 scores per supplier; checked by brute force in the tests."""
    scores = scored(spark, sf).select("series_id", "ts", "t2", "spe", "t2_limit_ratio", "spe_limit_ratio", *SCORE_STATUSES)
    thin = downsample_scores(scores, limit=40)
    return thin.select("series_id", text_time(F.col("ts")).alias("ts"), "t2", "spe", "status")


@query("state_downsample")
def state_downsample(spark, sf):
    """At most 40 cluster points per supplier; checked by brute force in the tests."""
    thin = downsample_states(points(spark, sf), INTERVAL, limit=40)
    return thin.select("series_id", text_time(F.col("ts")).alias("ts"), "pc1", "pc2", "cluster_id")


@query(
    "verify_scores",
    with_ctes(**SCORE_CTES)
    + f"""SELECT series_id, {TIME} AS ts, {r('t2')} AS t2, {r('spe')} AS spe, 'abnormal' AS overall_status FROM scored
      WHERE us // {DAY * MINUTE} % 5 = 0 AND greatest(c2, cq) < 2""",
)
def verify(spark, sf):
    """Scores whose statuses do not follow from their statistics: every fifth day is marked wrongly here."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01"))
    saved = scored(spark, sf).withColumn("overall_status", F.when(day % 5 == 0, "abnormal").otherwise(F.col("overall_status")))
    wrong = verify_scores(saved, MODEL, keys=["series_id"])
    return wrong.select(
        "series_id", text_time(F.col("ts")).alias("ts"), rounded(F.col("t2")).alias("t2"), rounded(F.col("spe")).alias("spe"), "overall_status"
    )
