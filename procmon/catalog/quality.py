"""Checks and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from procmon.catalog.registry import query, r, rounded, t, text_time, with_ctes
from procmon.catalog.views import (
    DAILY_SQL,
    MINUTELY_SQL,
    SUPPLY_SQL,
    daily,
    minutely,
    supply,
    table,
)
from procmon.config import MINUTE
from procmon.operators import quality

TAGS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CONFIGS = {
    "l_quantity": {"engineering_min": 2.0, "engineering_max": 45.0},
    "l_extendedprice": {"alarm_min": 1000.0, "alarm_max": 80000.0},
}
CELLS = " UNION ALL ".join(
    f"SELECT l_returnflag, '{x}' AS tag, {x} AS v, l_shipdate FROM lineitem" for x in TAGS
)
RAW = ["value", "props", "event_type", "user_id"]
RAW_CELLS = " UNION ALL ".join(f"SELECT '{x}' AS tag, CAST({x} AS VARCHAR) AS raw FROM events" for x in RAW)


@query(
    "raw_profile",
    with_ctes(c=RAW_CELLS, n="SELECT *, TRY_CAST(trim(raw) AS DOUBLE) AS v FROM c")
    + f"""SELECT tag, count(*) AS sample_count, count(v) FILTER (isfinite(v)) AS valid_count,
      count(*) - count(raw) AS missing_count, count(*) FILTER (trim(raw) = '') AS empty_string_count,
      count(*) FILTER (raw IS NOT NULL AND trim(raw) <> '' AND v IS NULL) AS non_numeric_count,
      count(DISTINCT v) AS unique_count, {r('min(v)')} AS minimum, {r('max(v)')} AS maximum,
      {r('1.0 - count(v) / CAST(count(*) AS DOUBLE)')} AS invalid_rate,
      CASE WHEN count(v) = 0 THEN 'no_finite_numeric_values' END AS suggestion
    FROM n GROUP BY tag""",
)
def raw_profile(spark, sf):
    p = quality.raw_profile(table(spark, sf, "events"), RAW)
    return p.select(
        "tag", "sample_count", "valid_count", "missing_count", "empty_string_count", "non_numeric_count",
        "unique_count", rounded(F.col("minimum")).alias("minimum"), rounded(F.col("maximum")).alias("maximum"),
        rounded(F.col("invalid_rate")).alias("invalid_rate"), "suggestion",
    )


@query(
    "tag_profile",
    with_ctes(c=CELLS)
    + f"""SELECT l_returnflag, tag, count(*) AS sample_count, count(v) AS valid_count,
      count(DISTINCT v) AS unique_count, {r('min(v)')} AS minimum, {r('max(v)')} AS maximum,
      {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS standard_deviation,
      {r('quantile_cont(v, 0.01)')} AS p01, {r('quantile_cont(v, 0.05)')} AS p05,
      {r('quantile_cont(v, 0.5)')} AS median, {r('quantile_cont(v, 0.95)')} AS p95,
      {r('quantile_cont(v, 0.99)')} AS p99,
      CASE WHEN tag = 'l_quantity' THEN count(*) FILTER (v < 2 OR v > 45) END AS engineering_range_outside_count,
      CASE WHEN tag = 'l_extendedprice' THEN count(*) FILTER (v < 1000 OR v > 80000) END AS alarm_range_outside_count
    FROM c GROUP BY 1, 2""",
)
def tag_profile(spark, sf):
    p = quality.tag_profile(table(spark, sf, "lineitem"), TAGS, keys=["l_returnflag"], tag_configs=CONFIGS)
    numbers = ["minimum", "maximum", "mean", "standard_deviation", "p01", "p05", "median", "p95", "p99"]
    return p.select(
        "l_returnflag", "tag", "sample_count", "valid_count", "unique_count",
        *[rounded(F.col(n)).alias(n) for n in numbers],
        "engineering_range_outside_count", "alarm_range_outside_count",
    )


@query(
    "quality_time",
    with_ctes(
        e="SELECT event_type AS series_id, date_trunc('minute', ts) AS ts FROM events",
        d="SELECT DISTINCT series_id, ts FROM e",
        s="SELECT series_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY series_id ORDER BY ts)) / 60e6 AS m FROM d",
        dup="SELECT series_id, count(*) AS n FROM e GROUP BY series_id, ts HAVING count(*) > 1",
    )
    + """SELECT series_id, 'duplicate_timestamp' AS code, 'error' AS severity, CAST(sum(n) AS BIGINT) AS count FROM dup GROUP BY 1
    UNION ALL SELECT series_id, 'physical_time_gap', 'warning', count(*) FROM s WHERE m > 1 GROUP BY 1""",
)
def quality_time(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts")
    )
    return quality.time_quality(e, keys=["series_id"], expected_interval_minutes=1)


@query(
    "quality_tag",
    with_ctes(
        c=CELLS,
        p="""SELECT l_returnflag, tag, count(v) AS n, count(DISTINCT v) AS u,
             count(*) FILTER (tag = 'l_quantity' AND (v < 2 OR v > 45)) AS e FROM c GROUP BY 1, 2""",
    )
    + """SELECT l_returnflag, tag, 'engineering_range' AS code, 'warning' AS severity, e AS count FROM p WHERE e > 0
    UNION ALL SELECT l_returnflag, tag, 'constant_tag', 'error', n FROM p WHERE u <= 1""",
)
def quality_tag(spark, sf):
    p = quality.tag_profile(table(spark, sf, "lineitem"), TAGS, keys=["l_returnflag"], tag_configs=CONFIGS)
    return quality.tag_issues(p, keys=["l_returnflag"])


@query(
    "model_quality",
    with_ctes(
        c=CELLS,
        f="SELECT tag, count(DISTINCT v) AS fu FROM c GROUP BY 1",
        p="""SELECT tag, count(v) AS n, count(DISTINCT v) AS u,
             count(*) FILTER (tag = 'l_quantity' AND (v < 2 OR v > 45)) AS e FROM c
             WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1""",
        k="""SELECT *, e > 0 AS ranged, u > 1 AND u <= least(10, greatest(2, floor(n * 0.01))) AS discrete FROM p""",
    )
    + """SELECT tag, n AS valid_count, u AS unique_count, fu = 1 AS constant_in_full_data,
      concat_ws(',', CASE WHEN u <= 1 THEN 'constant_tag' END, CASE WHEN ranged THEN 'engineering_range' END,
        CASE WHEN discrete THEN 'suspected_discrete_state' END) AS codes,
      CASE WHEN u <= 1 THEN 'blocking' WHEN ranged OR discrete THEN 'review' ELSE 'usable' END AS status,
      CASE WHEN u <= 1 THEN 'exclude_or_adjust_reference' WHEN ranged OR discrete THEN 'review' ELSE 'use' END AS suggested_action
    FROM k JOIN f USING (tag)""",
)
def model_quality(spark, sf):
    full = table(spark, sf, "lineitem")
    part = full.where(F.col("l_shipdate") < F.expr("timestamp_ntz'1999-01-01 00:00:00'"))
    q = quality.model_quality(full, part, TAGS, tag_configs=CONFIGS)
    return q.select(
        "tag", "valid_count", "unique_count", "constant_in_full_data", F.concat_ws(",", "codes").alias("codes"),
        "status", "suggested_action",
    )


@query(
    "constant_exclusions",
    with_ctes(c="SELECT l_orderkey, 'l_quantity' AS tag, l_quantity AS v FROM lineitem UNION ALL SELECT l_orderkey, 'l_tax', l_tax FROM lineitem")
    + f"""SELECT l_orderkey, tag, 'constant_in_reference_window' AS reason, count(v) AS sample_count,
      count(DISTINCT v) AS unique_count, {r('min(v)')} AS constant_value
    FROM c GROUP BY 1, 2 HAVING count(DISTINCT v) = 1""",
)
def constant_exclusions(spark, sf):
    p = quality.tag_profile(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], keys=["l_orderkey"])
    found = quality.constant_exclusions(p, keys=["l_orderkey"])
    return found.withColumn("constant_value", rounded(F.col("constant_value")))


@query(
    "numeric_candidates",
    with_ctes(c=RAW_CELLS)
    + """SELECT tag, count(raw) AS filled, count(TRY_CAST(trim(raw) AS DOUBLE)) AS numeric,
      coalesce(count(TRY_CAST(trim(raw) AS DOUBLE)) / nullif(CAST(count(raw) AS DOUBLE), 0) >= 0.8, false) AS is_candidate
    FROM c GROUP BY 1""",
)
def numeric_candidates(spark, sf):
    return quality.numeric_candidates(table(spark, sf, "events"), RAW).drop("tag_order")


@query(
    "difference_noise",
    with_ctes(
        d=DAILY_SQL,
        w="""SELECT series_id, qty - lag(qty) OVER k AS a, price - lag(price) OVER k AS b, tax - lag(tax) OVER k AS c
             FROM d WINDOW k AS (PARTITION BY series_id ORDER BY ts)""",
        u="""SELECT series_id, 'qty' AS tag, stddev_pop(a) AS noise FROM w GROUP BY 1
             UNION ALL SELECT series_id, 'price', stddev_pop(b) FROM w GROUP BY 1
             UNION ALL SELECT series_id, 'tax', stddev_pop(c) FROM w GROUP BY 1""",
    )
    + f"""SELECT series_id, tag, {r('noise')} AS noise,
      row_number() OVER (PARTITION BY series_id ORDER BY noise DESC) AS rank FROM u""",
)
def difference_noise(spark, sf):
    n = quality.difference_noise(daily(spark, sf), ["qty", "price", "tax"], keys=["series_id"], width=512 * 1440 * MINUTE)
    return n.select("series_id", "tag", rounded(F.col("noise")).alias("noise"), "rank")


@query(
    "histogram",
    with_ctes(
        b="""SELECT l_returnflag, least(20, greatest(1, floor(sqrt(count(*))))) AS bins, min(l_extendedprice) AS lo,
             max(l_extendedprice) AS hi FROM lineitem GROUP BY 1""",
        p="""SELECT l_returnflag, CAST(least(floor((l_extendedprice - lo) / (hi - lo) * bins), bins - 1) AS BIGINT) AS bin
             FROM lineitem JOIN b USING (l_returnflag)""",
        g="SELECT l_returnflag, lo, hi, bins, unnest(range(CAST(bins AS BIGINT))) AS bin FROM b",
        c="SELECT l_returnflag, bin, count(*) AS n FROM p GROUP BY 1, 2",
    )
    + f"""SELECT l_returnflag, bin, {r('lo + (hi - lo) / bins * bin')} AS left_edge,
      {r('lo + (hi - lo) / bins * (bin + 1)')} AS right_edge, coalesce(n, 0) AS count
    FROM g LEFT JOIN c USING (l_returnflag, bin)""",
)
def histogram(spark, sf):
    h = quality.histogram(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return h.select(
        "l_returnflag", "bin", rounded(F.col("left_edge")).alias("left_edge"),
        rounded(F.col("right_edge")).alias("right_edge"), "count",
    )


@query(
    "axis_limits",
    f"""SELECT l_suppkey, {r('least(min(l_quantity), min(l_tax)) - 0.05 * (greatest(max(l_quantity), max(l_tax)) - least(min(l_quantity), min(l_tax)))')} AS minimum,
      {r('greatest(max(l_quantity), max(l_tax)) + 0.05 * (greatest(max(l_quantity), max(l_tax)) - least(min(l_quantity), min(l_tax)))')} AS maximum
    FROM lineitem GROUP BY 1""",
)
def axis_limits(spark, sf):
    a = quality.axis_limits(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], ["l_suppkey"])
    return a.select(
        "l_suppkey", rounded(F.col("minimum")).alias("minimum"), rounded(F.col("maximum")).alias("maximum")
    )


STEPS = with_ctes(
    s=SUPPLY_SQL,
    p="SELECT series_id, ts, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS before FROM s",
    m="SELECT series_id, (epoch_us(ts) - epoch_us(before)) / 60e6 AS step, count(*) AS c FROM p WHERE before IS NOT NULL GROUP BY 1, 2",
    i="""SELECT series_id, step AS interval_minutes FROM m
         QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY c DESC, step) = 1""",
)


@query("modal_interval", STEPS + "SELECT * FROM i")
def modal_interval(spark, sf):
    return quality.modal_interval(supply(spark, sf), keys=["series_id"], width=400 * 1440 * MINUTE)


@query(
    "dataset_summary",
    STEPS
    + f"""SELECT series_id, row_count, {t('a')} AS time_start, {t('b')} AS time_end, interval_minutes
    FROM (SELECT series_id, count(*) AS row_count, min(ts) AS a, max(ts) AS b FROM s GROUP BY 1) LEFT JOIN i USING (series_id)""",
)
def dataset_summary(spark, sf):
    d = quality.dataset_summary(supply(spark, sf), keys=["series_id"])
    return d.withColumn("time_start", text_time(F.col("time_start"))).withColumn("time_end", text_time(F.col("time_end")))


@query(
    "physical_gaps",
    STEPS
    + f"""SELECT series_id, {t('before')} AS gap_start, {t('ts')} AS gap_end,
      (epoch_us(ts) - epoch_us(before)) / 60e6 AS gap_minutes
    FROM p WHERE (epoch_us(ts) - epoch_us(before)) / 60e6 > 14400""",
)
def physical_gaps(spark, sf):
    g = quality.physical_gaps(supply(spark, sf), 14400, keys=["series_id"], width=200 * 1440 * MINUTE)
    return g.withColumn("gap_start", text_time(F.col("gap_start"))).withColumn("gap_end", text_time(F.col("gap_end")))


@query(
    "suggested_split",
    with_ctes(
        s=SUPPLY_SQL,
        p="""SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i,
             count(*) OVER (PARTITION BY series_id) AS n FROM s""",
    )
    + f"""SELECT series_id, max(n) AS time_points, {t('min(ts)')} AS trend_default_start,
      {t('max(ts) FILTER (i = least(n - 1, 29999))')} AS trend_default_end,
      {t('max(ts) FILTER (i = greatest(0, least(n - 2, floor(n * 0.65))))')} AS suggested_normal_end,
      {t('max(ts) FILTER (i = greatest(0, least(n - 2, floor(n * 0.65))) + 1)')} AS suggested_validation_start
    FROM p GROUP BY 1""",
)
def suggested_split(spark, sf):
    s = quality.suggested_split(supply(spark, sf), keys=["series_id"], width=300 * 1440 * MINUTE)
    times = ["trend_default_start", "trend_default_end", "suggested_normal_end", "suggested_validation_start"]
    return s.select("series_id", "time_points", *[text_time(F.col(c)).alias(c) for c in times])


@query(
    "hourly_profile",
    with_ctes(m=MINUTELY_SQL)
    + f"""SELECT series_id, 'value' AS tag, count(*) AS sample_count, {r('avg(value)')} AS mean,
      {r('quantile_cont(value, 0.5)')} AS median FROM m GROUP BY 1""",
)
def hourly_profile(spark, sf):
    p = quality.tag_profile(minutely(spark, sf), ["value"], keys=["series_id"])
    return p.select(
        "series_id", "tag", "sample_count", rounded(F.col("mean")).alias("mean"), rounded(F.col("median")).alias("median")
    )
