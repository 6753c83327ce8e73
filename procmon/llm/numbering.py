"""Numbers of rows in a given order, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procmon.llm.common import partitions, stored


def numbered(rows: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """`rows` with `idx`, the place of each row in its group from 0 on, and `size`, the rows of the group.

    Rows are dealt into ranges of (group, order), so a large group spreads over many tasks; a row's number is its
    number within the range, lifted by the rows of its group in the ranges before. `group` has no nulls. Nulls come first in the
    order; rows equal in all of `order` follow each other in any order. `rows` is run twice, so it should be a stored table.
    """
    dealt = stored(rows.repartitionByRange(partitions(rows.sparkSession), group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    of_group = Window.partitionBy(group)
    lifted = counts.select(
        group, "_range", F.sum("_n").over(of_group).alias("size"),
        (F.sum("_n").over(of_group.orderBy("_range")) - F.col("_n")).alias("_before"),
    )
    number = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    placed = dealt.withColumn("_number", number).join(lifted, [group, "_range"])
    return placed.withColumn("idx", F.col("_before") + F.col("_number") - 1).drop("_range", "_before", "_number")
