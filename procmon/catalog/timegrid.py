"""Segments, resampling, filters, lags and row classes on the supplier series."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from procmon.catalog.registry import number, query, r, rounded, t, text_time, with_ctes
from procmon.catalog.views import DAILY_SQL, DAY, SUPPLY_SQL, daily, supply, supply_number_times, supply_numbers
from procmon.config import MINUTE, PreprocessingConfig
from procmon.functions.columns import feature_name
from procmon.operators.losses import engineering_losses, loss_ratios, loss_summary
from procmon.operators.preprocess import build_dynamic_matrix, preprocess

STEP = 14 * DAY
TAGS = ["qty", "price", "disc"]
RANGES = {"price": (1500.0, 98000.0)}
MAX_TAX = 0.0637
SHARD = 400 * DAY  # minutes; several shards per series even on small data

BASE = PreprocessingConfig(
    sample_interval_minutes=STEP,
    smoothing_window_minutes=2 * STEP,
    max_lag_minutes=2 * STEP,
    lag_step_minutes=STEP,
    resampling_method="mean",
    filter_method="trailing_mean",
    gap_threshold_minutes=30 * DAY,
    state_filters=({"column": "tax", "maximum": MAX_TAX},),
)


def prepared(spark, sf, config=BASE, **more):
    options = dict(
        engineering_ranges=RANGES, exclude_engineering_range=True, source_interval_minutes=DAY, shard_minutes=SHARD,
        times=supply_number_times(spark, sf),
    )
    rows = preprocess(supply_numbers(spark, sf), TAGS, config, **{**options, **more})
    return rows.withColumn("series_id", F.col("series_id").cast("string"))


def grid_ctes(method: str = "mean") -> dict[str, str]:
    """Segments, buckets and empty buckets, as SQL."""
    step, gap = STEP * MINUTE, 30 * DAY * MINUTE
    reduce = {
        "mean": "avg({0})",
        "median": "quantile_cont({0}, 0.5)",
        "last": "arg_max_null({0}, us)",
    }[method]
    values = [*TAGS, "tax"]
    return {
        "raw": SUPPLY_SQL,
        "a": f"""SELECT *, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER k > {gap}, true) AS gap
                 FROM raw WINDOW k AS (PARTITION BY series_id ORDER BY ts)""",
        "b": f"""SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY series_id ORDER BY us) AS seg,
                 us + ((-us % {step}) + {step}) % {step} AS label, price < 1500 OR price > 98000 AS beyond FROM a""",
        "c": f"""SELECT series_id, seg, label, count(*) AS n, {', '.join(f'{reduce.format(v)} AS {v}' for v in values)},
                 bool_or(beyond) AS beyond FROM b GROUP BY 1, 2, 3""",
        "d": "SELECT *, lag(label) OVER (PARTITION BY series_id, seg ORDER BY label) AS prev FROM c",
        "e": f"""SELECT *, unnest(generate_series(CASE WHEN prev IS NULL THEN label ELSE prev + {step} END, label, {step})) AS us
                 FROM d""",
        "g": f"""SELECT series_id, seg, us, CASE WHEN us = label THEN n ELSE 0 END AS n,
                 {', '.join(f'CASE WHEN us = label THEN {v} END AS {v}' for v in values)},
                 us = label AND beyond AS beyond FROM e""",
    }


def class_ctes(method: str = "mean", smooth: str = "avg({0})", w: int = 2, lags: int = 2) -> dict[str, str]:
    """Input classes, final segments, filtered values, lags and row classes, as SQL."""
    gap = 30 * DAY * MINUTE
    lagged = ", ".join(
        f"lag({v}_f, {i}) OVER f AS {v}_l{i}" for i in range(lags + 1) for v in TAGS
    )
    names = [f"{v}_l{i}" for i in range(lags + 1) for v in TAGS]
    nothing = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in names)
    ctes = grid_ctes(method)
    ctes |= {
        "h": f"""SELECT *, CASE WHEN n = 0 THEN 'empty_bin'
                 WHEN qty IS NULL OR price IS NULL OR disc IS NULL OR tax IS NULL THEN 'input_invalid'
                 WHEN beyond THEN 'engineering_range' WHEN NOT (tax <= {MAX_TAX}) THEN 'state_filtered' END AS cls FROM g""",
        "i": """SELECT *, count(*) FILTER (cls = 'engineering_range') OVER o AS ce,
                 count(*) FILTER (cls IS NULL OR cls = 'state_filtered') OVER o AS cu
                 FROM h WINDOW o AS (PARTITION BY series_id ORDER BY us)""",
        "j": f"""SELECT *, coalesce(seg <> lag(seg) OVER o OR us - lag(us) OVER o > {gap} OR ce <> lag(ce) OVER o
                 OR cu - lag(cu) OVER o > 1, true) AS brk FROM i WHERE cls IS NULL
                 WINDOW o AS (PARTITION BY series_id ORDER BY us)""",
        "k": "SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY series_id ORDER BY us) AS fseg FROM j",
        "k1": "SELECT *, row_number() OVER (PARTITION BY series_id, fseg ORDER BY us) AS rin FROM k",
        "l": f"""SELECT *, {', '.join(f"CASE WHEN rin >= {w} THEN {smooth.format(v)} OVER (PARTITION BY series_id, fseg ORDER BY us ROWS {w - 1} PRECEDING) END AS {v}_f" for v in TAGS)}
                 FROM k1""",
        "m": f"""SELECT *, {lagged} FROM l WINDOW f AS (PARTITION BY series_id, fseg ORDER BY us)""",
        "kept": f"""SELECT series_id, seg, us, n, qty, price, disc, tax, fseg, rin, brk, {', '.join(f'{v}_f' for v in TAGS)},
                 CASE WHEN rin < {w} THEN 'filter_warmup' WHEN rin <= {lags} THEN 'lag_warmup'
                 WHEN rin < {lags + w} THEN 'lag_context' ELSE 'valid' END AS cls, {', '.join(names)} FROM m""",
        "every": f"""SELECT * FROM kept UNION ALL
                 SELECT series_id, seg, us, n, qty, price, disc, tax, NULL, NULL, false, {', '.join(f'NULL AS {v}_f' for v in TAGS)}, cls, {nothing}
                 FROM i WHERE cls IS NOT NULL""",
    }
    return ctes


CLASSES = with_ctes(**class_ctes())
TS = t("make_timestamp(us)")


def digits(name: str, method: str = "") -> int:
    """Six decimals, but four for filtered prices of five figures: a recursion and a weighted sum differ in the twelfth digit."""
    return 4 if method == "first_order" and name.startswith("price") else 6


def _values(df, names, method: str = ""):
    return [rounded(F.col(f"`{n}`"), digits(n, method)).alias(n) for n in names]


# ---- segments ------------------------------------------------------------------------


def _segments_sql(days: int) -> str:
    return (
        with_ctes(
            s=SUPPLY_SQL,
            a=f"""SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER k > {days * DAY * MINUTE}, true) AS gap FROM s
                  WINDOW k AS (PARTITION BY series_id ORDER BY ts)""",
            b="SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY series_id ORDER BY ts) - 1 AS raw_segment_id FROM a",
        )
        + f"""SELECT series_id, CAST(raw_segment_id AS BIGINT) AS raw_segment_id, {t('min(ts)')} AS start, {t('max(ts)')} AS stop, count(*) AS row_count
        FROM b GROUP BY 1, 2"""
    )


def _segments(spark, sf, days):
    config = PreprocessingConfig(DAY, 0, 0, DAY, gap_threshold_minutes=days * DAY)
    rows = preprocess(supply(spark, sf), ["qty"], config, segment_ids=True, shard_minutes=SHARD)
    return rows.groupBy("series_id", "raw_segment_id").agg(
        text_time(F.min("ts")).alias("start"),
        text_time(F.max("ts")).alias("stop"),
        F.count(F.lit(1)).alias("row_count"),
    )


@query("segment_gaps", _segments_sql(1))
def segment_gaps(spark, sf):
    return _segments(spark, sf, 1)


@query("segment_gaps_tolerance", _segments_sql(10))
def segment_gaps_tolerance(spark, sf):
    return _segments(spark, sf, 10)


# ---- resampling ----------------------------------------------------------------------


def _resample_sql(method):
    return (
        with_ctes(**grid_ctes(method))
        + f"SELECT series_id, {TS} AS ts, n AS bucket_rows, {r('qty')} AS qty, {r('price')} AS price, {r('disc')} AS disc FROM g"
    )


def _resample(spark, sf, method):
    config = replace(BASE, resampling_method=method, filter_method="none", max_lag_minutes=0, state_filters=())
    rows = preprocess(supply(spark, sf), TAGS, config, source_interval_minutes=DAY, shard_minutes=SHARD)
    return rows.select("series_id", text_time(F.col("ts")).alias("ts"), "bucket_rows", *_values(rows, TAGS))


@query("resample_mean", _resample_sql("mean"))
def resample_mean(spark, sf):
    return _resample(spark, sf, "mean")


@query("resample_median", _resample_sql("median"))
def resample_median(spark, sf):
    return _resample(spark, sf, "median")


@query("resample_last", _resample_sql("last"))
def resample_last(spark, sf):
    return _resample(spark, sf, "last")


@query(
    "empty_bins",
    with_ctes(**grid_ctes())
    + "SELECT series_id, count(*) AS buckets, count(*) FILTER (n = 0) AS empty_buckets, CAST(sum(n) AS BIGINT) AS source_rows FROM g GROUP BY 1",
)
def empty_bins(spark, sf):
    config = replace(BASE, filter_method="none", max_lag_minutes=0, state_filters=())
    rows = preprocess(supply(spark, sf), TAGS, config, source_interval_minutes=DAY)
    return rows.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("buckets"),
        F.count_if(F.col("bucket_rows") == 0).alias("empty_buckets"),
        F.sum("bucket_rows").alias("source_rows"),
    )


# ---- filters, lags, classes ----------------------------------------------------------


def _filtered(spark, sf, config):
    rows = prepared(spark, sf, replace(config, max_lag_minutes=0), intermediates=True)
    names = [f"{v}__filtered" for v in TAGS]
    return rows.where(F.col("qty__filtered").isNotNull()).select(
        "series_id", text_time(F.col("ts")).alias("ts"), *_values(rows, names, config.filter_method)
    )


def _filtered_sql(ctes, method=""):
    return ctes + f"SELECT series_id, {TS} AS ts, " + ", ".join(
        f"{r(f'{v}_f', digits(v, method))} AS {v}__filtered" for v in TAGS
    )


@query("trailing_mean", _filtered_sql(CLASSES) + " FROM l WHERE qty_f IS NOT NULL")
def trailing_mean(spark, sf):
    return _filtered(spark, sf, BASE)


@query(
    "trailing_median",
    _filtered_sql(with_ctes(**class_ctes(smooth="quantile_cont({0}, 0.5)", w=3))) + " FROM l WHERE qty_f IS NOT NULL",
)
def trailing_median(spark, sf):
    return _filtered(
        spark, sf, replace(BASE, filter_method="trailing_median", smoothing_window_minutes=3 * STEP)
    )


_ALPHA, _SLOW = 0.2718281828, 0.000001


def _recursion_sql(alpha: float) -> str:
    ctes = class_ctes()
    ctes = {n: ctes[n] for n in list(ctes)[: list(ctes).index("l")]}
    ctes["y"] = (
        "SELECT series_id, fseg, us, rin, " + ", ".join(f"{v} AS {v}_f" for v in TAGS) + " FROM k1 WHERE rin = 1 UNION ALL "
        "SELECT k1.series_id, k1.fseg, k1.us, k1.rin, "
        + ", ".join(f"{number(alpha)} * k1.{v} + (1e0 - {number(alpha)}) * y.{v}_f" for v in TAGS)
        + " FROM y JOIN k1 ON k1.series_id = y.series_id AND k1.fseg = y.fseg AND k1.rin = y.rin + 1"
    )
    return _filtered_sql(with_ctes(**ctes).replace("WITH", "WITH RECURSIVE", 1), "first_order") + " FROM y"


@query("first_order", _recursion_sql(_ALPHA))
def first_order(spark, sf):
    return _filtered(spark, sf, replace(BASE, filter_method="first_order", first_order_alpha=_ALPHA))


@query("first_order_slow", _recursion_sql(_SLOW))
def first_order_slow(spark, sf):
    """A filter that remembers millions of rows: its state passes through many shards."""
    return _filtered(spark, sf, replace(BASE, filter_method="first_order", first_order_alpha=_SLOW))


FEATURES = [feature_name(v, lag) for lag in BASE.lags for v in TAGS]
_FEATURE_SQL = ", ".join(
    f"{r(f'{v}_l{i}', digits(v))} AS {feature_name(v, lag)}" for i, lag in enumerate(BASE.lags) for v in TAGS
)


@query("lag_matrix", CLASSES + f"SELECT series_id, {TS} AS ts, {_FEATURE_SQL} FROM kept WHERE cls = 'valid'")
def lag_matrix(spark, sf):
    rows = prepared(spark, sf).where("row_class = 'valid'")
    return rows.select("series_id", text_time(F.col("ts")).alias("ts"), *_values(rows, FEATURES))


@query("row_classes", CLASSES + f"SELECT series_id, {TS} AS ts, cls AS row_class, n AS bucket_rows, coalesce(brk, false) AS segment_start FROM every")
def row_classes(spark, sf):
    return prepared(spark, sf).select(
        "series_id", text_time(F.col("ts")).alias("ts"), "row_class", "bucket_rows", "segment_start"
    )


@query(
    "resegment",
    CLASSES + f"SELECT series_id, {TS} AS ts, CAST(seg - 1 AS BIGINT) AS raw_segment_id, CAST(fseg - 1 AS BIGINT) AS final_segment_id FROM kept",
)
def resegment(spark, sf):
    rows = prepared(spark, sf, segment_ids=True).where("final_segment_id IS NOT NULL")
    return rows.select("series_id", text_time(F.col("ts")).alias("ts"), "raw_segment_id", "final_segment_id")


@query("engineering_exclusion", CLASSES + "SELECT series_id, 'price' AS tag, count(*) AS lost_rows FROM every WHERE cls = 'engineering_range' GROUP BY 1")
def engineering_exclusion(spark, sf):
    return engineering_losses(prepared(spark, sf), TAGS)


_LOSS = """count(*) AS resampled_row_count, count(*) FILTER (n = 0) AS empty_bin_count,
  CAST(sum(n) AS BIGINT) - count(*) FILTER (n > 0) AS resampling_row_reduction,
  count(*) FILTER (cls = 'input_invalid') AS input_invalid_loss,
  count(*) FILTER (cls = 'engineering_range') AS engineering_range_loss,
  count(*) FILTER (cls = 'state_filtered') AS state_filter_loss,
  count(*) FILTER (cls = 'filter_warmup') AS filter_warmup_loss,
  count(*) FILTER (cls = 'lag_warmup') AS lag_warmup_loss,
  count(*) FILTER (cls = 'lag_context') AS lag_context_invalid_loss,
  count(*) FILTER (cls = 'valid') AS final_dynamic_row_count,
  CAST(max(seg) AS BIGINT) AS raw_segment_count"""


@query("loss_summary", CLASSES + f"SELECT series_id, {_LOSS} FROM every GROUP BY 1")
def losses(spark, sf):
    s = loss_summary(prepared(spark, sf), BASE, n_tags=3)
    return s.select(
        "series_id", "resampled_row_count", "empty_bin_count", "resampling_row_reduction", "input_invalid_loss",
        "engineering_range_loss", "state_filter_loss", "filter_warmup_loss", "lag_warmup_loss",
        "lag_context_invalid_loss", "final_dynamic_row_count", "raw_segment_count",
    )


@query(
    "loss_ratios",
    CLASSES
    + f"""SELECT series_id, count(*) FILTER (cls = 'input_invalid') + count(*) FILTER (cls <> 'valid' AND cls NOT IN ('empty_bin', 'input_invalid', 'engineering_range', 'state_filtered'))
      + count(*) FILTER (cls IN ('empty_bin', 'input_invalid', 'engineering_range', 'state_filtered')) AS loss_count,
      {r("count(*) FILTER (cls = 'valid') / CAST(count(*) AS DOUBLE)")} AS effective_coverage_ratio FROM every GROUP BY 1""",
)
def ratios(spark, sf):
    s = loss_ratios(loss_summary(prepared(spark, sf), BASE, n_tags=3))
    return s.select("series_id", "loss_count", rounded(F.col("effective_coverage_ratio")).alias("effective_coverage_ratio"))


# ---- plain daily grid ----------------------------------------------------------------

_DAILY = PreprocessingConfig(DAY, 0, 0, DAY, gap_threshold_minutes=DAY, state_filters=({"column": "qty", "minimum": 25.2},))


@query("state_filter", with_ctes(d=DAILY_SQL) + f"SELECT series_id, {t('ts')} AS ts, {r('qty')} AS qty FROM d WHERE qty >= 25.2 AND price IS NOT NULL")
def state_filter(spark, sf):
    rows = preprocess(daily(spark, sf), ["qty", "price"], _DAILY, shard_minutes=256 * DAY)
    return rows.where("row_class = 'valid'").select(
        "series_id", text_time(F.col("ts")).alias("ts"), rounded(F.col("qty")).alias("qty")
    )


_PLAIN = PreprocessingConfig(DAY, 3 * DAY, 2 * DAY, DAY, filter_method="trailing_mean")


@query(
    "dynamic_matrix",
    with_ctes(
        d=DAILY_SQL,
        a=f"""SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER k > {DAY * MINUTE}, true) AS gap FROM d
              WINDOW k AS (PARTITION BY series_id ORDER BY ts)""",
        b="SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY series_id ORDER BY ts) AS seg FROM a",
        c="""SELECT *, row_number() OVER f AS rin, avg(qty) OVER (f ROWS 2 PRECEDING) AS q, avg(tax) OVER (f ROWS 2 PRECEDING) AS x
             FROM b WINDOW f AS (PARTITION BY series_id, seg ORDER BY ts)""",
        e="""SELECT *, lag(q, 1) OVER f AS q1, lag(q, 2) OVER f AS q2, lag(x, 1) OVER f AS x1, lag(x, 2) OVER f AS x2
             FROM c WINDOW f AS (PARTITION BY series_id, seg ORDER BY ts)""",
    )
    + f"""SELECT series_id, {t('ts')} AS ts, {r('q')} AS qty__lag_000min, {r('x')} AS tax__lag_000min,
      {r('q1')} AS qty__lag_1440min, {r('x1')} AS tax__lag_1440min, {r('q2')} AS qty__lag_2880min, {r('x2')} AS tax__lag_2880min
    FROM e WHERE rin >= 5""",
)
def dynamic_matrix(spark, sf):
    m = build_dynamic_matrix(daily(spark, sf), ["qty", "tax"], _PLAIN, shard_minutes=128 * DAY)
    names = [c for c in m.columns if "__lag_" in c]
    return m.select("series_id", text_time(F.col("ts")).alias("ts"), *_values(m, names))


# ---- older order of steps ------------------------------------------------------------

_LEGACY = PreprocessingConfig(
    DAY, 2 * DAY, DAY, DAY, filter_method="trailing_mean", state_filters=({"column": "tax", "maximum": 0.0403},)
)


@query(
    "legacy_classes",
    with_ctes(
        d=DAILY_SQL,
        a=f"""SELECT *, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER k > {DAY * MINUTE}, true) AS gap FROM d
              WINDOW k AS (PARTITION BY series_id ORDER BY ts)""",
        b="SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY series_id ORDER BY us) AS seg FROM a",
        c=" SELECT *, row_number() OVER f AS rseg, "
        + ", ".join(
            f"CASE WHEN count({v}) OVER (f ROWS 1 PRECEDING) = 2 THEN avg({v}) OVER (f ROWS 1 PRECEDING) END AS {v}_f"
            for v in ("qty", "disc", "tax")
        )
        + " FROM b WINDOW f AS (PARTITION BY series_id, seg ORDER BY us)",
        e="SELECT *, coalesce(tax_f <= 0.0403, false) AS kept FROM c",
        g=f"""SELECT *, coalesce(seg <> lag(seg) OVER o OR us - lag(us) OVER o > {DAY * MINUTE}, true) AS brk FROM e WHERE kept
              WINDOW o AS (PARTITION BY series_id ORDER BY us)""",
        h="SELECT *, sum(CAST(brk AS INT)) OVER (PARTITION BY series_id ORDER BY us) AS fseg FROM g",
        i="""SELECT *, row_number() OVER f AS rin, lag(qty_f) OVER f AS q1, lag(disc_f) OVER f AS d1 FROM h
             WINDOW f AS (PARTITION BY series_id, fseg ORDER BY us)""",
    )
    + f"""SELECT series_id, {t('ts')} AS ts, CASE WHEN qty IS NULL OR disc IS NULL THEN 'input_invalid' WHEN rseg < 2 THEN 'filter_warmup'
      WHEN qty_f IS NULL OR disc_f IS NULL THEN 'filter_context' WHEN rin <= 1 THEN 'lag_warmup'
      WHEN q1 IS NULL OR d1 IS NULL THEN 'lag_context' ELSE 'valid' END AS row_class FROM i
    UNION ALL SELECT series_id, {t('ts')}, 'state_filtered' FROM e WHERE NOT kept""",
)
def legacy_classes(spark, sf):
    rows = preprocess(daily(spark, sf), ["qty", "disc"], _LEGACY, semantics="legacy", shard_minutes=128 * DAY)
    return rows.select("series_id", text_time(F.col("ts")).alias("ts"), "row_class")
