"""Comparing the members of large groups with each other, in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import partitions

#: Members in a block. A group of more is cut into blocks, and each pair of blocks is a task of its own.
BLOCK = 1000


def block_pairs(rows: DataFrame, group: str, member: str, size: int = BLOCK) -> DataFrame:
    """(group, member, lo, hi, side, pack) for groups of two and more.

    Every pair of members of a group meets in one pair of blocks (lo, hi): in lo = hi if both are in the same
    block, else with side 0 in block lo and side 1 in block hi. Rows with the same `pack` belong into one call;
    small groups share packs. Members must not repeat within a group.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("n")).where("n > 1")
    blocks = f"cast(ceil(n / {size}) as int)"
    own = rows.join(counts, group).select(
        group, member, F.expr(blocks).alias("blocks"), F.expr(f"cast(pmod(xxhash64({member}, 3), {blocks}) as int)").alias("own")
    )
    each = own.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    packs = 64 * partitions(rows.sparkSession)
    return each.select(
        group, member, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.expr("cast(own > other as int)").alias("side"),
        F.expr(f"if(blocks = 1, pmod(xxhash64({group}), {packs}), xxhash64({group}, least(own, other), greatest(own, other)))").alias("pack"),
    )


def runs(rows: pa.Table, group: str) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Row numbers of the members that meet: (block, None), or (block lo, block hi)."""
    key, lo, hi, side = (np.asarray(rows.column(c)) for c in (group, "lo", "hi", "side"))
    order = np.lexsort((side, hi, lo, key))
    change = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)) + 1
    for part in np.split(order, change):
        if not len(part):
            continue
        if lo[part[0]] == hi[part[0]]:
            yield part, None
        else:
            yield part[side[part] == 0], part[side[part] == 1]


def clusters(left: np.ndarray, right: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For links between positions, the smallest node reachable from each position."""
    label = nodes.copy()
    while len(left):
        before = label.copy()
        np.minimum.at(label, left, before[right])
        np.minimum.at(label, right, label[left])
        if np.array_equal(before, label):
            break
    return label
