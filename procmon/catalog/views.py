"""Sensor-like readings derived from the given tables, and the same in SQL.

Sums run over whole cents and percents, so both engines get identical averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 1440


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(value: Column) -> Column:
    """round(value) as a long, halves away from zero, without the decimal numbers that `round` goes through."""
    whole = value.cast("long")
    return F.when(value - whole >= 0.5, whole + 1).when(value - whole <= -0.5, whole - 1).otherwise(whole)


def _days(spark, sf_dir, series) -> DataFrame:
    """Nearly every group of a supplier is one row, so keys and days are grouped as numbers."""
    cents = lambda c: F.sum(_whole(F.col(c) * 100)).cast("double") / F.lit(100.0)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(series.alias("series_id"), F.col("l_shipdate").cast("date").alias("ts"))
        .agg(
            (F.sum("l_quantity") / F.count(F.lit(1))).alias("qty"),
            (cents("l_extendedprice") / F.count(F.lit(1))).alias("price"),
            F.nullif(cents("l_discount") / F.count(F.lit(1)), F.lit(0.0)).alias("disc"),
            (cents("l_tax") / F.count(F.lit(1))).alias("tax"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


def _daily(spark, sf_dir, series) -> DataFrame:
    """The groups of `_days`, named afterwards."""
    return _days(spark, sf_dir, series).select(
        F.col("series_id").cast("string").alias("series_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        "qty", "price", "disc", "tax", "lines",
    )


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments per supplier and day: many sparse series."""
    return _daily(spark, sf_dir, F.col("l_suppkey"))


def supply_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and days as in `supply`, a row for each shipment: nothing is grouped."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("series_id"), F.col("l_shipdate").cast("date").cast("timestamp_ntz").alias("ts")
    )


def supply_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`supply` with suppliers as numbers and days as dates, which cost less to compare and to count."""
    return _days(spark, sf_dir, F.col("l_suppkey"))


def supply_number_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`supply_times` of `supply_numbers`."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id"), F.col("l_shipdate").cast("date").alias("ts"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments per return flag and day: few dense series."""
    return _daily(spark, sf_dir, F.col("l_returnflag"))


def _daily_sql(series: str) -> str:
    cents = lambda c: f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / 100e0"
    return f"""SELECT CAST({series} AS VARCHAR) AS series_id, date_trunc('day', l_shipdate) AS ts,
      sum(l_quantity) / count(*) AS qty, {cents('l_extendedprice')} / count(*) AS price,
      nullif({cents('l_discount')} / count(*), 0) AS disc, {cents('l_tax')} / count(*) AS tax,
      count(*) AS lines
    FROM lineitem GROUP BY 1, 2"""


SUPPLY_SQL = _daily_sql("l_suppkey")
DAILY_SQL = _daily_sql("l_returnflag")


def minutely(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type and minute."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("series_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"))
        .agg(
            (F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / F.lit(100.0) / F.count(F.lit(1))).alias("value"),
            F.count(F.lit(1)).cast("double").alias("hits"),
        )
    )


MINUTELY_SQL = """SELECT event_type AS series_id, date_trunc('minute', ts) AS ts,
      CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100e0 / count(*) AS value,
      CAST(count(*) AS DOUBLE) AS hits
    FROM events GROUP BY 1, 2"""


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per day and priority, as an outside performance series."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts"))
        .agg(
            (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double") / F.lit(100.0) / F.count(F.lit(1))).alias("total"),
            F.count(F.lit(1)).cast("double").alias("orders"),
        )
    )


ORDER_DAYS_SQL = """SELECT o_orderpriority AS series_id, date_trunc('day', o_orderdate) AS ts,
      CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100e0 / count(*) AS total,
      CAST(count(*) AS DOUBLE) AS orders
    FROM orders GROUP BY 1, 2"""


def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-week window per order, keyed by customer."""
    o = table(spark, sf_dir, "orders")
    start = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz")
    days = F.expr("make_dt_interval(cast(20 + o_orderkey % 3 AS INT))")
    return o.select(
        F.col("o_custkey").cast("string").alias("series_id"),
        F.format_string("w%012d", F.col("o_orderkey")).alias("window_id"),
        start.alias("window_start"),
        (start + days).alias("window_end"),
    )


ORDER_WINDOWS_SQL = """SELECT CAST(o_custkey AS VARCHAR) AS series_id,
      'w' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS window_id,
      date_trunc('day', o_orderdate) AS window_start,
      date_trunc('day', o_orderdate) + to_days(CAST(20 + o_orderkey % 3 AS INTEGER)) AS window_end
    FROM orders"""


def vectors(spark: SparkSession, sf_dir: str, n: int = 64) -> DataFrame:
    """Embeddings as ready feature vectors: eight tags at eight lags."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("series_id"),
        "vec_id",
        *[F.col("embedding")[j].cast("double").alias(vector_feature(j)) for j in range(n)],
    )


def vector_feature(j: int) -> str:
    return f"t{j % 8}__lag_{5 * (j // 8):03d}min"
