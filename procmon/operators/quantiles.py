"""Exact quantiles of groups that may be far larger than one task's memory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procmon.functions.columns import col
from procmon.session import ensure_checkpoint_dir

# Distinct values one group may hold before its quantiles are selected by narrowing.
GROUP_LIMIT = 2_000_000
BUCKETS = 4096


def exact_quantiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Linearly interpolated quantiles of the non-NULL values per group.

    Equal values are counted first, map-side. Groups with few distinct values then use the
    built-in exact percentile. For larger ones the wanted ranks are narrowed down by
    histograms: each pass keeps the buckets that hold a rank, until they are small.
    """
    key_cols = [col(k) for k in keys]
    counted = (
        rows.where(col(value).isNotNull())
        .groupBy(*key_cols, col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    # Written once: the sizes and the quantiles both read the counts, not the rows behind them.
    ensure_checkpoint_dir(rows.sparkSession)
    counted = counted.checkpoint()
    sizes = counted.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("_d"),
        F.sum("_c").alias("_n"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    large = sizes.where(F.col("_d") > group_limit)
    large_rows = large.collect()  # at most total rows / group_limit of them
    if not large_rows:
        return _plain(counted, keys, probabilities)
    spark = rows.sparkSession
    schema = counted.select(*key_cols).schema
    names = spark.createDataFrame([tuple(r[k] for k in keys) for r in large_rows], schema)
    if keys:
        small = counted.join(F.broadcast(names), list(keys), "left_anti")
        big = counted.join(F.broadcast(names), list(keys), "left_semi")
    else:
        small, big = counted.limit(0), counted
    found = _select(spark, big, keys, large_rows, probabilities, group_limit)
    fields = ", ".join(f"`{name}` double" for name in probabilities)
    values = spark.createDataFrame(
        [(*key, *[found[key, p] for p in probabilities.values()]) for key in {k for k, _ in found}],
        ", ".join([*[f"`{k}` {schema[k].dataType.simpleString()}" for k in keys], fields]),
    )
    return _plain(small, keys, probabilities).unionByName(values) if keys else values


def _plain(counted: DataFrame, keys, probabilities) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probabilities.values()])
    found = counted.groupBy(*[col(k) for k in keys]).agg(
        F.percentile(F.col("_v"), wanted, F.col("_c")).alias("_q")
    )
    return found.select(
        *[col(k) for k in keys],
        *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(probabilities)],
    )


def _select(spark, big, keys, large_rows, probabilities, group_limit) -> dict:
    """{(key, probability): quantile} for the large groups."""
    # One open range per wanted rank: (key, rank, lowest value, highest value, rows below).
    wanted, total = {}, {}
    for row in large_rows:
        key = tuple(row[k] for k in keys)
        total[key] = row["_n"]
        for p in probabilities.values():
            rank = p * (row["_n"] - 1)
            for r in {floor(rank), ceil(rank)}:
                wanted[key, r] = (row["_lo"], row["_hi"], 0, row["_d"])
    done: dict = {}
    schema = ", ".join(
        [f"`{k}` {big.schema[k].dataType.simpleString()}" for k in keys]
        + ["_lo double", "_hi double", "_below long"]
    )
    while wanted:
        ranges = {(key, lo, hi, below) for (key, _), (lo, hi, below, _) in wanted.items()}
        ranged = spark.createDataFrame([(*k, lo, hi, below) for k, lo, hi, below in ranges], schema)
        inside = (
            big.join(F.broadcast(ranged), list(keys)) if keys else big.crossJoin(F.broadcast(ranged))
        ).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        span = F.col("_hi") / 2 - F.col("_lo") / 2
        place = F.when(
            span > 0, F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / span * BUCKETS)
        ).otherwise(F.lit(0))
        # A range with few values is resolved value by value, any other by bucket.
        per_range = [*[col(k) for k in keys], "_lo", "_hi", "_below"]
        histogram = inside.groupBy(*per_range, place.alias("_b")).agg(
            F.sum("_c").alias("_c"),
            F.min("_v").alias("_first"),
            F.max("_v").alias("_last"),
            F.count(F.lit(1)).alias("_d"),
        )
        order = Window.partitionBy(*per_range).orderBy("_b")
        histogram = histogram.withColumn("_upto", F.sum("_c").over(order) + F.col("_below"))
        ranks = spark.createDataFrame(
            [(*k, lo, hi, below, r) for (k, r), (lo, hi, below, _) in wanted.items()],
            schema + ", _rank long",
        )
        hit = histogram.join(F.broadcast(ranks), [*keys, "_lo", "_hi", "_below"]).where(
            (F.col("_rank") >= F.col("_upto") - F.col("_c")) & (F.col("_rank") < F.col("_upto"))
        )
        following = {}
        for row in hit.collect():  # one row per wanted rank
            key = tuple(row[k] for k in keys)
            if row["_d"] == 1 or row["_first"] == row["_last"]:
                done[key, row["_rank"]] = row["_first"]
            else:
                below = row["_upto"] - row["_c"]
                following[key, row["_rank"]] = (row["_first"], row["_last"], below, row["_d"])
        wanted = following
    result = {}
    for key, n in total.items():
        for p in probabilities.values():
            rank = p * (n - 1)
            low, high = done[key, floor(rank)], done[key, ceil(rank)]
            result[key, p] = low + (high - low) * (rank - floor(rank))
    return result
