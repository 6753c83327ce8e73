"""Windows, training sets, validation metrics and contribution stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmon.catalog.models import (
    INTERVAL,
    MODEL,
    SCORE_CTES,
    STATISTIC_ROWS,
    event_ctes,
    magnitude_ctes,
    scored,
)
from procmon.catalog.registry import query, r, rounded, t, text_time, with_ctes
from procmon.catalog.timegrid import SHARD, TAGS
from procmon.catalog.views import (
    DAILY_SQL,
    DAY,
    ORDER_WINDOWS_SQL,
    SUPPLY_SQL,
    daily,
    order_windows,
    supply,
    supply_times,
    table,
)
from procmon.config import MINUTE, PreprocessingConfig
from procmon.operators import validation, windows
from procmon.operators.contributions import combined_events, event_contributions
from procmon.plans import training
from procmon.session import ensure_checkpoint_dir

YEAR = 365 * 1440 * MINUTE


# ---- interval arithmetic -------------------------------------------------------------


@query(
    "window_overlap",
    with_ctes(
        w=ORDER_WINDOWS_SQL,
        l="""SELECT *, max(window_end) OVER (PARTITION BY series_id ORDER BY window_start, window_end, window_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM w""",
    )
    + "SELECT series_id, window_id, coalesce(window_start <= latest, false) AS overlaps FROM l",
)
def window_overlap(spark, sf):
    f = windows.flag_overlaps(order_windows(spark, sf), keys=["series_id"], width=YEAR)
    return f.select("series_id", "window_id", "overlaps")


MERGED = dict(
    w=ORDER_WINDOWS_SQL,
    l="""SELECT *, coalesce(window_start > max(window_end) OVER (PARTITION BY series_id ORDER BY window_start, window_end, window_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM w""",
    g="SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY series_id ORDER BY window_start, window_end, window_id) AS grp FROM l",
    m="""SELECT series_id, arg_min(window_id, (window_start, window_end, window_id)) AS window_id, min(window_start) AS s,
         max(window_end) AS e, count(*) AS merged_count FROM g GROUP BY series_id, grp""",
)


@query(
    "merge_exclusions",
    with_ctes(**MERGED) + f"SELECT series_id, window_id, {t('s')} AS window_start, {t('e')} AS window_end, merged_count FROM m",
)
def merge_exclusions(spark, sf):
    m = windows.merge_windows(order_windows(spark, sf), keys=["series_id"], width=YEAR)
    return m.withColumn("window_start", text_time(F.col("window_start"))).withColumn(
        "window_end", text_time(F.col("window_end"))
    )


def _exclusions(shipments):
    """A closed period per supplier around each of its largest shipments."""
    s = shipments.where(F.col("price") > 100000)
    return s.select(
        "series_id", F.concat_ws("-", "series_id", text_time(F.col("ts"))).alias("window_id"),
        F.col("ts").alias("window_start"), (F.col("ts") + F.expr("INTERVAL 6 DAYS")).alias("window_end"),
    )


def _halves(shipments):
    """Two candidate periods per supplier: before and after the start of 1999."""
    s = shipments.withColumn("window_id", F.when(F.year("ts") < 1999, "early").otherwise("late"))
    return s.groupBy("series_id", "window_id").agg(F.min("ts").alias("window_start"), F.max("ts").alias("window_end"))


@query(
    "subtract_exclusions",
    with_ctes(
        s=SUPPLY_SQL,
        x="SELECT series_id, ts AS a, ts + INTERVAL 6 DAY AS b FROM s WHERE price > 100000",
        l="SELECT *, coalesce(a > max(b) OVER (PARTITION BY series_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM x",
        g="SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY series_id ORDER BY a, b) AS grp FROM l",
        m="SELECT series_id, min(a) AS a, max(b) AS b FROM g GROUP BY series_id, grp",
        c="SELECT series_id, CASE WHEN year(ts) < 1999 THEN 'early' ELSE 'late' END AS window_id, min(ts) AS lo, max(ts) AS hi FROM s GROUP BY 1, 2",
        hit="SELECT c.series_id, window_id, count(*) AS n FROM c JOIN m ON c.series_id = m.series_id AND m.b >= c.lo AND m.a <= c.hi GROUP BY 1, 2",
        free="""SELECT c.series_id, c.window_id, lo, hi, ts,
                (SELECT count(*) FROM m WHERE m.series_id = c.series_id AND m.b >= c.lo AND m.a <= c.hi AND m.b < s.ts) AS done
                FROM c JOIN s ON s.series_id = c.series_id AND s.ts BETWEEN lo AND hi
                WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.series_id = c.series_id AND s.ts BETWEEN m.a AND m.b)""",
        p="SELECT series_id, window_id, lo, hi, done, min(ts) AS f, max(ts) AS z FROM free GROUP BY ALL",
    )
    + f"""SELECT series_id, window_id, {t('CASE WHEN done = 0 THEN lo ELSE f END')} AS start, {t('CASE WHEN done = n THEN hi ELSE z END')} AS stop
      FROM p JOIN hit USING (series_id, window_id)
    UNION ALL SELECT series_id, window_id, {t('lo')}, {t('hi')} FROM c WHERE (series_id, window_id) NOT IN (SELECT (series_id, window_id) FROM hit)""",
)
def subtract_exclusions(spark, sf):
    # Written once: candidates, exclusions and timestamps all read the shipments.
    ensure_checkpoint_dir(spark)
    shipments = supply(spark, sf).select("series_id", "ts", "price").checkpoint()
    p = windows.subtract_windows(_halves(shipments), _exclusions(shipments), shipments, width=YEAR)
    return p.select("series_id", "window_id", text_time(F.col("start")).alias("start"), text_time(F.col("end")).alias("stop"))


@query(
    "window_samples",
    with_ctes(
        s=SUPPLY_SQL,
        w="SELECT series_id, strftime(ts, '%Y-%m') AS window_id, min(ts) AS a, min(ts) + INTERVAL 20 DAY AS b FROM s GROUP BY 1, 2",
        n="SELECT w.series_id, w.window_id, count(*) AS n FROM w JOIN s ON s.series_id = w.series_id AND s.ts BETWEEN a AND b GROUP BY 1, 2",
    )
    + f"""SELECT series_id, window_id, coalesce(n, 0) AS raw_samples, 28800 AS duration_minutes, 21 AS expected_samples,
      CASE WHEN coalesce(n, 0) = 21 THEN 'ready' ELSE 'sampling_gap' END AS quality_status FROM w LEFT JOIN n USING (series_id, window_id)""",
)
def window_samples(spark, sf):
    s = supply(spark, sf)
    w = s.groupBy("series_id", F.date_format("ts", "yyyy-MM").alias("window_id")).agg(F.min("ts").alias("window_start"))
    w = w.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 20 DAYS"))
    found = windows.summarise_windows(w, s, DAY, on=["series_id"])
    return found.select("series_id", "window_id", "raw_samples", "duration_minutes", "expected_samples", "quality_status")


@query("select_window", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-09-30'")
def select_window(spark, sf):
    rows = windows.select_window(table(spark, sf, "lineitem"), "1997-03-01", "1997-09-30", ts="l_shipdate")
    return rows.select("l_orderkey", "l_linenumber")


# ---- training ------------------------------------------------------------------------

WINDOWS = [
    {"id": i, "start": a, "end": b, "source": "manual", "source_ref": None, "enabled": on, "comment": ""}
    for i, a, b, on in (
        ("w1", "1995-06-01", "1996-08-15", True),
        ("w2", "1997-01-03", "1998-02-20", True),
        ("w3", "1999-01-01", "1999-03-01", False),
        ("w4", "2000-02-02", "2000-02-09", True),
    )
]
STEP = 14 * DAY
CONFIG = PreprocessingConfig(
    STEP, 0, STEP, STEP, resampling_method="mean", gap_threshold_minutes=30 * DAY
)


def _training(spark, sf):
    return training.build_training_set(
        supply(spark, sf), WINDOWS, TAGS, CONFIG, source_interval_minutes=DAY, shard_minutes=SHARD,
        times=supply_times(spark, sf),
    )


TRAINING = with_ctes(
    s=SUPPLY_SQL,
    w="SELECT * FROM (VALUES "
    + ", ".join(f"('{w['id']}', TIMESTAMP '{w['start']}', TIMESTAMP '{w['end']}', {w['enabled']})" for w in WINDOWS)
    + ") AS v(window_id, lo, hi, enabled)",
    x="SELECT s.*, window_id, lo, hi, epoch_us(ts) AS us FROM s JOIN w ON enabled AND ts BETWEEN lo AND hi",
    a=f"""SELECT *, coalesce(us - lag(us) OVER k > {30 * DAY * MINUTE}, true) AS gap FROM x
          WINDOW k AS (PARTITION BY series_id, window_id ORDER BY us)""",
    b=f"""SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY series_id, window_id ORDER BY us) AS seg,
          us + ((-us % {STEP * MINUTE}) + {STEP * MINUTE}) % {STEP * MINUTE} AS label FROM a""",
    c="""SELECT series_id, window_id, lo, hi, seg, label, count(*) AS n, avg(qty) AS qty, avg(price) AS price, avg(disc) AS disc
         FROM b GROUP BY ALL""",
    d="SELECT *, lag(label) OVER (PARTITION BY series_id, window_id, seg ORDER BY label) AS prev FROM c",
    e=f"SELECT *, unnest(generate_series(CASE WHEN prev IS NULL THEN label ELSE prev + {STEP * MINUTE} END, label, {STEP * MINUTE})) AS us FROM d",
    g=f"""SELECT series_id, window_id, seg, us, CASE WHEN us = label THEN n ELSE 0 END AS n, CASE WHEN us = label THEN disc END AS disc,
          us - {STEP * MINUTE} < epoch_us(lo) OR us > epoch_us(hi) AS part FROM e""",
    h="""SELECT *, CASE WHEN part THEN 'partial_bin' WHEN n = 0 THEN 'empty_bin' WHEN disc IS NULL THEN 'input_invalid' END AS cls FROM g""",
    i=f"""SELECT *, coalesce(seg <> lag(seg) OVER o OR us - lag(us) OVER o > {30 * DAY * MINUTE}, true) AS brk FROM h WHERE cls IS NULL
          WINDOW o AS (PARTITION BY series_id, window_id ORDER BY us)""",
    j="""SELECT series_id, window_id, seg, n, CASE WHEN brk THEN 'lag_warmup' ELSE 'valid' END AS cls FROM i
         UNION ALL SELECT series_id, window_id, seg, n, cls FROM h WHERE cls IS NOT NULL""",
)
_COUNTS = """CAST(sum(n) AS BIGINT) AS source_row_count, count(*) FILTER (cls <> 'partial_bin') AS resampled_row_count,
  count(*) FILTER (cls = 'partial_bin') AS partial_resampling_bin_loss, count(*) FILTER (cls = 'empty_bin') AS empty_bin_count,
  count(*) FILTER (cls = 'input_invalid') AS input_invalid_loss, count(*) FILTER (cls = 'lag_warmup') AS lag_warmup_loss,
  count(*) FILTER (cls = 'valid') AS final_dynamic_row_count"""
_NAMES = [
    "source_row_count", "resampled_row_count", "partial_resampling_bin_loss", "empty_bin_count", "input_invalid_loss",
    "lag_warmup_loss", "final_dynamic_row_count",
]
_REASON = """CASE WHEN final_dynamic_row_count > 0 THEN NULL WHEN resampled_row_count = 0 THEN 'no_complete_resampling_bins'
  ELSE 'insufficient_after_smoothing_and_lag' END"""


@query(
    "training_windows",
    TRAINING
    + f""", k AS (SELECT series_id, window_id, {_COUNTS} FROM j GROUP BY 1, 2)
    SELECT p.series_id, w.window_id, {', '.join(_NAMES)},
      CASE WHEN NOT enabled THEN 'disabled' WHEN final_dynamic_row_count > 0 THEN 'used' ELSE 'dropped' END AS status,
      CASE WHEN NOT enabled THEN NULL WHEN source_row_count IS NULL THEN 'no_raw_samples' ELSE {_REASON} END AS dropped_reason
    FROM w CROSS JOIN (SELECT DISTINCT series_id FROM x) p LEFT JOIN k ON k.series_id = p.series_id AND k.window_id = w.window_id""",
)
def training_windows(spark, sf):
    w = training.window_summary(_training(spark, sf))
    return w.select("series_id", "window_id", *_NAMES, "status", "dropped_reason")


@query(
    "training_segments",
    TRAINING
    + f""", k AS (SELECT series_id, window_id, seg, {_COUNTS} FROM j GROUP BY 1, 2, 3),
    sp AS (SELECT series_id, window_id, seg, min(ts) AS a, max(ts) AS z FROM b GROUP BY 1, 2, 3)
    SELECT series_id, window_id || '-segment-' || lpad(CAST(seg AS VARCHAR), 3, '0') AS segment_name, {t('a')} AS start, {t('z')} AS stop,
      {', '.join(_NAMES)}, {_REASON} AS dropped_reason FROM k JOIN sp USING (series_id, window_id, seg)""",
)
def training_segments(spark, sf):
    s = training.segment_summary(_training(spark, sf))
    return s.select(
        "series_id", "segment_name", text_time(F.col("start")).alias("start"), text_time(F.col("end")).alias("stop"),
        *_NAMES, "dropped_reason",
    )


@query("duplicate_training_times", TRAINING + "SELECT series_id, CAST(us AS VARCHAR) AS ts, count(*) AS copies FROM i GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_training_times(spark, sf):
    return training.duplicate_times(_training(spark, sf).dynamic)


# ---- validation ----------------------------------------------------------------------

# Validation periods over the scored supplier series.
PERIODS = [
    ("n1", "normal_validation", "1996-03-01", "1997-06-30"),
    ("n2", "normal_validation", "1997-07-10", "1998-06-30"),
    ("a1", "known_abnormal", "1998-07-10", "1999-12-31"),
    ("a2", "known_abnormal", "2000-01-10", "2001-06-30"),
]
VALID_CTES = {
    **SCORE_CTES,
    "vw": "SELECT * FROM (VALUES "
    + ", ".join(f"('{i}', '{k}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, k, a, b in PERIODS)
    + ") AS v(window_id, window_type, lo, hi)",
    "vs": "SELECT s.*, window_id, window_type, lo, hi FROM scored s JOIN vw ON make_timestamp(us) BETWEEN lo AND hi",
    **event_ctes(
        "series_id, window_id, window_type",
        "SELECT series_id, window_id, window_type, us FROM vs WHERE greatest(c2, cq) > 0",
    ),
}


def _validated(spark, sf):
    w = windows.windows_frame(
        spark,
        [
            {"id": i, "type": k, "start": windows.parse_time(a), "end": windows.parse_time(b)}
            for i, k, a, b in PERIODS
        ],
    )
    # Written once: the metrics and the events both read the scores.
    ensure_checkpoint_dir(spark)
    scores = windows.in_windows(scored(spark, sf), w).checkpoint()
    events = combined_events(scores, MODEL, INTERVAL, keys=["series_id", "window_id", "window_type"], width=40 * INTERVAL)
    return scores, events


_RATE = lambda flag: r(f"avg(CAST({flag} AS INT))")


@query(
    "validation_windows",
    with_ctes(
        **VALID_CTES,
        kw=f"""SELECT series_id, window_id, any_value(window_type) AS window_type, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS scored_rows,
          count(*) FILTER (greatest(c2, cq) = 0) AS status_normal, {_RATE('c2 > 0')} AS t2_exceedance_95, {_RATE('cq > 1')} AS spe_exceedance_99,
          {r('max(t2)')} AS maximum_t2, {r('max(spe)')} AS maximum_spe, min(us) FILTER (greatest(c2, cq) > 0) AS fx FROM vs GROUP BY 1, 2""",
        zw=f"SELECT series_id, window_id, count(*) AS event_count, CAST(max(b - a + {INTERVAL}) // {MINUTE} AS BIGINT) AS longest, max(c) AS mc FROM ev GROUP BY 1, 2",
    )
    + f"""SELECT series_id, window_id, window_type, scored_rows, (epoch_us(hi) - epoch_us(lo)) // {INTERVAL} + 1 AS expected_rows, status_normal,
      t2_exceedance_95, spe_exceedance_99, maximum_t2, maximum_spe, coalesce(event_count, 0) AS event_count,
      coalesce(longest, 0) AS longest_event_minutes, {t('make_timestamp(fx)')} AS first_exceedance, (fx - epoch_us(lo)) // {MINUTE} AS delay_minutes,
      coalesce(event_count = 1 AND mc = 1, false) AS single_point_exceedance
    FROM kw LEFT JOIN zw USING (series_id, window_id)""",
)
def validation_windows(spark, sf):
    scores, events = _validated(spark, sf)
    m = validation.window_metrics(scores, events, MODEL, INTERVAL)
    return m.select(
        "series_id", "window_id", "window_type", "scored_rows", "expected_rows", "status_normal",
        *[rounded(F.col(c)).alias(c) for c in ("t2_exceedance_95", "spe_exceedance_99", "maximum_t2", "maximum_spe")],
        "event_count", "longest_event_minutes", text_time(F.col("first_overall_95")).alias("first_exceedance"),
        F.col("first_exceedance_delay_minutes").alias("delay_minutes"), "single_point_exceedance",
    )


@query(
    "normal_validation",
    with_ctes(**VALID_CTES)
    + f"""SELECT count(*) AS scoring_row_count, {_RATE('c2 > 0')} AS t2_exceedance_rate_95, {_RATE('cq > 0')} AS spe_exceedance_rate_95,
      {_RATE('greatest(c2, cq) > 0')} AS overall_exceedance_rate_95, {_RATE('greatest(c2, cq) > 1')} AS overall_exceedance_rate_99,
      (SELECT count(*) FROM ev WHERE window_type = 'normal_validation') AS false_alarm_event_count_95,
      (SELECT CAST(max(b - a + {INTERVAL}) // {MINUTE} AS BIGINT) FROM ev WHERE window_type = 'normal_validation') AS longest_false_alarm_minutes
    FROM vs WHERE window_type = 'normal_validation'""",
)
def normal_validation(spark, sf):
    scores, events = _validated(spark, sf)
    n = validation.normal_metrics(scores, events, MODEL, INTERVAL)
    rates = ["t2_exceedance_rate_95", "spe_exceedance_rate_95", "overall_exceedance_rate_95", "overall_exceedance_rate_99"]
    return n.select(
        "scoring_row_count", *[rounded(F.col(c)).alias(c) for c in rates], "false_alarm_event_count_95",
        "longest_false_alarm_minutes",
    )


@query(
    "detection",
    with_ctes(
        **VALID_CTES,
        kw=f"""SELECT series_id, window_id, any_value(lo) AS lo, max(c2) AS m2, max(cq) AS mq,
          (min(us) FILTER (greatest(c2, cq) > 0) - epoch_us(any_value(lo))) // {MINUTE} AS delay FROM vs WHERE window_type = 'known_abnormal' GROUP BY 1, 2""",
    )
    + f"""SELECT count(*) AS valid_window_count, count(*) FILTER (greatest(m2, mq) > 0) AS overall_detected_window_count_95,
      count(*) FILTER (greatest(m2, mq) > 1) AS overall_detected_window_count_99, count(*) FILTER (m2 > 0) AS t2_detected_window_count_95,
      count(*) FILTER (mq > 1) AS spe_detected_window_count_99, {_RATE('greatest(m2, mq) > 0')} AS detection_rate_95,
      max(delay) AS first_detection_delay_minutes_95_max, {r('quantile_cont(delay, 0.5)')} AS first_detection_delay_minutes_95_median FROM kw""",
)
def detection(spark, sf):
    scores, events = _validated(spark, sf)
    d = validation.detection_metrics(validation.window_metrics(scores, events, MODEL, INTERVAL))
    median = "first_detection_delay_minutes_95_median"
    return d.select(
        "valid_window_count", "overall_detected_window_count_95", "overall_detected_window_count_99",
        "t2_detected_window_count_95", "spe_detected_window_count_99",
        rounded(F.col("detection_rate_95")).alias("detection_rate_95"), "first_detection_delay_minutes_95_max",
        rounded(F.col(median)).alias(median),
    )


@query(
    "label_crosstab",
    with_ctes(**SCORE_CTES)
    + """SELECT CAST(year(make_timestamp(us)) % 4 AS VARCHAR) AS label, CASE greatest(c2, cq) WHEN 2 THEN 'abnormal' WHEN 1 THEN 'attention' ELSE 'normal' END AS status,
      count(*) AS row_count FROM scored WHERE year(make_timestamp(us)) % 4 <> 3 GROUP BY 1, 2""",
)
def label_crosstab(spark, sf):
    # Written once: the statuses and the labels made of their times both read the scores.
    ensure_checkpoint_dir(spark)
    scores = scored(spark, sf).select("series_id", "ts", "status").checkpoint()
    year = F.year("ts") % 4
    labels = scores.select("series_id", "ts", F.when(year != 3, year).alias("label"))
    return validation.label_crosstab(scores, labels)


_STABLE = {
    **SCORE_CTES,
    **event_ctes("series_id, statistic", STATISTIC_ROWS, ", arg_min(us, (-value / lim, us)) AS peak"),
    **magnitude_ctes(),
    "es": "SELECT e.statistic, e.series_id || '/' || e.peak AS id, tag, pct FROM ev e JOIN shares s ON s.series_id = e.series_id AND s.statistic = e.statistic AND s.us = e.peak",
    "rk": "SELECT *, row_number() OVER (PARTITION BY statistic, id ORDER BY pct DESC, tag) AS place FROM es",
}


def _stability(spark, sf):
    events = event_contributions(scored(spark, sf), MODEL, INTERVAL)
    return validation.contribution_stability(events, TAGS, ["statistic"])


@query(
    "contribution_stability",
    with_ctes(
        **_STABLE,
        unit="SELECT statistic, id, tag, pct / sqrt(sum(pct * pct) OVER (PARTITION BY statistic, id)) AS u FROM es",
        sums="SELECT statistic, tag, sum(u) AS s FROM unit GROUP BY 1, 2",
        cs="SELECT statistic, sum(s * s) AS q FROM sums GROUP BY 1",
        n="SELECT statistic, count(DISTINCT id) AS m FROM es GROUP BY 1",
        top="SELECT statistic, max(c) AS c FROM (SELECT statistic, tag, count(*) AS c FROM rk WHERE place = 1 GROUP BY 1, 2) GROUP BY 1",
    )
    + f"""SELECT statistic, m AS event_count, 3 AS top_k, {r('c / CAST(m AS DOUBLE)')} AS top1_consistency_rate, 1e0 AS average_top_k_jaccard_similarity,
      {r('(q - m) / (CAST(m AS DOUBLE) * (m - 1))')} AS average_contribution_cosine_similarity FROM n JOIN cs USING (statistic) JOIN top USING (statistic)""",
)
def contribution_stability(spark, sf):
    groups, _ = _stability(spark, sf)
    return groups.select(
        "statistic", "event_count", "top_k", rounded(F.col("top1_consistency_rate")).alias("top1_consistency_rate"),
        F.round("average_top_k_jaccard_similarity", 9).alias("average_top_k_jaccard_similarity"),
        rounded(F.col("average_contribution_cosine_similarity")).alias("average_contribution_cosine_similarity"),
    )


@query(
    "tag_recurrence",
    with_ctes(**_STABLE)
    + f"""SELECT statistic, tag, count(*) FILTER (place = 1) AS top1_count, count(*) FILTER (place <= 3) AS top_k_count,
      {r('avg(pct)')} AS average_contribution_pct, {r('quantile_cont(pct, 0.5)')} AS median_contribution_pct FROM rk GROUP BY 1, 2""",
)
def tag_recurrence(spark, sf):
    _, tags = _stability(spark, sf)
    return tags.select(
        "statistic", "tag", "top1_count", "top_k_count",
        *[rounded(F.col(c)).alias(c) for c in ("average_contribution_pct", "median_contribution_pct")],
    )


@query(
    "trend_union",
    with_ctes(a=SUPPLY_SQL, b=DAILY_SQL)
    + f"SELECT {t('ts')} AS ts, count(*) AS series FROM (SELECT ts, series_id FROM a UNION ALL SELECT ts, series_id FROM b) GROUP BY ts",
)
def trend_union(spark, sf):
    both = supply(spark, sf).select("ts", "series_id").unionByName(daily(spark, sf).select("ts", "series_id"))
    return both.groupBy(text_time(F.col("ts")).alias("ts")).agg(F.count(F.lit(1)).alias("series"))
