"""Exact quantiles in two readings: a mergeable sketch brackets every wanted rank, then values are counted inside the brackets only.

The sketch is the built-in approximate percentile; its partial states merge map-side, whatever the number of groups, and its rank error is at most
n / accuracy. Asked MARGIN times that error below and above a wanted rank, it gives two values of the data between which the
exact one lies, up to one rank. The second reading counts the rows below and above each bracket and, value by value, the rows in it; a running sum finds the exact value.
Nothing is collected, and nothing of the rows is written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmon.functions.columns import col

ACCURACY = 10_000
#: Bracket ends lie this many sketch errors away from the wanted rank.
MARGIN = 4


def bracket_columns(value: Column, probabilities: Mapping[str, float], accuracy: int = ACCURACY) -> list[Column]:
    """Aggregates for the first reading, taken beside any others: `_n` values, and `_ends`, two bracket ends per probability."""
    value, slack = value.cast("double"), MARGIN / accuracy
    # Beyond the ends of the data the bracket is open, so the extremes need no sketch.
    asked = [min(1.0, max(0.0, q)) for p in probabilities.values() for q in (p - slack, p + slack)]
    return [
        F.count(value).alias("_n"),
        F.percentile_approx(value, [float(q) for q in asked], accuracy).alias("_ends"),
    ]


def resolve(
    rows: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], found: DataFrame, accuracy: int = ACCURACY
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group; `found` has the keys and the `bracket_columns` of the same rows.

    Groups without a value have no row. A rank outside its bracket, which the sketch's bound rules out, is an error.
    """
    slack = MARGIN / accuracy
    spans = []
    for i, p in enumerate(probabilities.values()):
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.lit(float("-inf")) if p <= slack else F.get("_ends", F.lit(2 * i))
        # NaN is the largest double, also above infinity.
        high = F.lit(float("nan")) if p >= 1 - slack else F.get("_ends", F.lit(2 * i + 1))
        spans.append(F.struct(F.lit(i).alias("_i"), low.alias("_low"), high.alias("_high"), rank.alias("_rank")))
    key_cols, names = [col(k) for k in keys], list(keys)
    spans = found.where(F.col("_n") > 0).select(*key_cols, F.array(*spans).alias("_spans"))
    values = rows.where(col(value).isNotNull()).select(*key_cols, col(value).cast("double").alias("_v"))
    # One row a group on the right; the planner broadcasts it while it is small.
    met = values.join(spans, names) if keys else values.crossJoin(F.broadcast(spans))
    cells = met.select(*key_cols, "_v", F.inline("_spans"))
    side = F.when(F.col("_v") < F.col("_low"), -1).when(F.col("_v") > F.col("_high"), 1).otherwise(0)
    counted = cells.groupBy(*key_cols, "_i", "_rank", side.alias("_side"), F.when(side == 0, F.col("_v")).alias("_in")).agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
    )
    order = Window.partitionBy(*key_cols, "_i").orderBy("_side", "_in")
    upto = counted.withColumn("_upto", F.sum("_c").over(order))
    # Next to the bracket one more rank is known on either side: the largest value below and the smallest above.
    holds = lambda r: (
        F.when(F.col("_side") == 0, (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r))
        .when(F.col("_side") < 0, F.col("_upto") - 1 == r)
        .otherwise(F.col("_upto") - F.col("_c") == r)
    )
    at = lambda r: F.min(F.when(holds(r), F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least"))))
    picked = upto.groupBy(*key_cols, "_i").agg(
        at(F.floor("_rank")).alias("_a"), at(F.ceil("_rank")).alias("_b"), (F.max("_rank") - F.floor(F.max("_rank"))).alias("_part")
    )
    exact = F.when(
        F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
    ).when(F.col("_part") == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part"))
    return (
        picked.withColumn("_q", exact)
        .groupBy(*key_cols)
        .agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(probabilities)])
    )


def bracketed_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], accuracy: int = ACCURACY
) -> DataFrame:
    """Both readings over one input."""
    found = rows.groupBy(*[col(k) for k in keys]).agg(*bracket_columns(col(value), probabilities, accuracy))
    return resolve(rows, keys, value, probabilities, found, accuracy)
