"""Maximal runs of rows that follow each other at exactly the sampling interval."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmon.functions.columns import col, from_micros, micros
from procmon.operators.shards import SHARD, default_width, shard_rows, shard_window

# A fact about a run: an aggregate over its rows, and how partial results combine.
Fact = tuple[Column, Callable[[Column], Column]]


def _breaks(window, interval_us: int, same: Sequence[str], start: str, end: str) -> Column:
    previous_end = F.lag(end).over(window)
    broken = previous_end.isNull() | (F.col(start) - previous_end != interval_us)
    for name in same:
        broken = broken | ~F.lag(col(name)).over(window).eqNullSafe(col(name))
    return broken


def runs(
    rows: DataFrame,
    interval_us: int,
    *,
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    same: Sequence[str] = (),
    facts: Mapping[str, Fact] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Runs of the given rows: keys, `same`, `start`, `end`, `row_count` and the facts.

    Filter the rows first. Runs are found inside time shards; only the first and the last
    of a shard can continue elsewhere, so at most two rows per shard are merged along the
    series.
    """
    facts = dict(facts or {})
    width = width or default_width(interval_us)
    key_cols = [col(k) for k in keys]
    sharded = shard_rows(rows.withColumn("_us", micros(col(ts))), "_us", width)
    window = shard_window(keys, "_us")
    sharded = sharded.withColumn("_brk", _breaks(window, interval_us, same, "_us", "_us"))
    sharded = sharded.withColumn(
        "_run",
        F.sum(F.col("_brk").cast("int")).over(window.rowsBetween(Window.unboundedPreceding, 0)),
    )
    pieces = sharded.groupBy(*key_cols, SHARD, "_run").agg(
        *[F.first(col(s)).alias(s) for s in same],
        F.min("_us").alias("_start"),
        F.max("_us").alias("_end"),
        F.count(F.lit(1)).alias("row_count"),
        *[value.alias(name) for name, (value, _) in facts.items()],
    )
    last = F.max("_run").over(Window.partitionBy(*key_cols, col(SHARD)))
    pieces = pieces.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == last))

    along = Window.partitionBy(*key_cols).orderBy("_start")
    edges = pieces.where("_edge").withColumn(
        "_brk", _breaks(along, interval_us, same, "_start", "_end")
    )
    edges = edges.withColumn(
        "_run",
        F.sum(F.col("_brk").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)),
    )
    merged = edges.groupBy(*key_cols, "_run").agg(
        *[F.first(col(s)).alias(s) for s in same],
        F.min("_start").alias("_start"),
        F.max("_end").alias("_end"),
        F.sum("row_count").alias("row_count"),
        *[combine(F.col(name)).alias(name) for name, (_, combine) in facts.items()],
    )
    columns = [*keys, *same, "_start", "_end", "row_count", *facts]
    inner = pieces.where(~F.col("_edge"))
    united = inner.select(*[col(c) for c in columns]).unionByName(
        merged.select(*[col(c) for c in columns])
    )
    return united.select(
        *[col(c) for c in [*keys, *same]],
        from_micros(F.col("_start")).alias("start"),
        from_micros(F.col("_end")).alias("end"),
        "row_count",
        *facts,
    )


def tag_runs(
    rows: DataFrame,
    interval_us: int,
    *,
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    same: Sequence[str] = (),
    name: str = "run_start",
    width: int | None = None,
) -> DataFrame:
    """Every row with the start time of the run it belongs to."""
    width = width or default_width(interval_us)
    key_cols = [col(k) for k in keys]
    sharded = shard_rows(rows.withColumn("_us", micros(col(ts))), "_us", width)
    window = shard_window(keys, "_us")
    sharded = sharded.withColumn("_brk", _breaks(window, interval_us, same, "_us", "_us"))
    # The start of the run as far as this shard can see.
    sharded = sharded.withColumn(
        "_local",
        F.max(F.when(F.col("_brk"), F.col("_us"))).over(
            window.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    ends = sharded.groupBy(*key_cols, SHARD).agg(
        F.min("_us").alias("_first"),
        F.max("_us").alias("_last"),
        F.max("_local").alias("_tail"),
        *[F.min_by(col(s), F.col("_us")).alias(f"_first_{s}") for s in same],
        *[F.max_by(col(s), F.col("_us")).alias(f"_last_{s}") for s in same],
    )
    along = Window.partitionBy(*key_cols).orderBy(SHARD)
    joined = F.coalesce(F.col("_first") - F.lag("_last").over(along) == interval_us, F.lit(False))
    for s in same:
        joined = joined & F.lag(f"_last_{s}").over(along).eqNullSafe(F.col(f"_first_{s}"))
    # A shard hands its tail run on when it opens one itself or is not joined to the left.
    ends = ends.withColumn("_joined", joined)
    own = (F.col("_tail") > F.col("_first")) | ~F.col("_joined")
    ends = ends.withColumn(
        "_open",
        F.last(F.when(own, F.col("_tail")), ignorenulls=True).over(
            along.rowsBetween(Window.unboundedPreceding, -1)
        ),
    )
    carry = ends.select(*key_cols, SHARD, "_first", F.when(F.col("_joined"), F.col("_open")).alias("_open"))
    tagged = sharded.join(carry, [*keys, SHARD])
    start = F.when(
        (F.col("_local") == F.col("_first")) & F.col("_open").isNotNull(), F.col("_open")
    ).otherwise(F.col("_local"))
    return tagged.withColumn(name, from_micros(start)).drop(
        "_us", "_brk", "_local", "_first", "_open", SHARD, "_own"
    )


def longest_runs(
    found: DataFrame, limit: int, *, keys: Sequence[str] = ("series_id",), extra: Sequence[str] = ()
) -> DataFrame:
    """The `limit` longest runs per key, earlier ones first on ties.

    Ranking with a limit lets Spark cut each partition to `limit` rows before the shuffle.
    """
    order = Window.partitionBy(*[col(k) for k in [*keys, *extra]]).orderBy(
        F.col("row_count").desc(), F.col("start")
    )
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
