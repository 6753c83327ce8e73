"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procmon.session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds).cast("int")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once as Parquet into the shared folder and read back: cuts the lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Written once into the shared folder, bucketed and sorted by `key`: grouping and joining by it need no exchange."""
    spark = df.sparkSession
    n, name = partitions(spark), f"bucketed_{uuid.uuid4().hex[:12]}"
    rows = df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key)
    rows.option("path", shared_folder(spark, name)).saveAsTable(name)
    return spark.table(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node reachable over the edges, for every node of an edge.

    Every node adopts the smallest label among its own and its neighbours', then the label of
    that label (pointer jumping), until nothing changes. Each round is written to the shared
    folder, so a lost executor costs one round. Nodes without an edge are not returned.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    both = stored(both.union(both.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        # A neighbour's label; the node's own; and both pass down to the node that is the old label.
        seen = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("near"))
        hooks = new.where("near < label").groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        new = new.join(hooks, "node", "left").select("node", F.least("near", F.coalesce("hook", "near")).alias("near"), "label")
        up = new.select(F.col("node").alias("near"), F.col("near").alias("top"))
        new = stored(new.join(up, "near", "left").select("node", F.least("near", F.coalesce("top", "near")).alias("new"), "label"), "labels")
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


def batches(rows: Iterable[pa.RecordBatch], limit: int = 4 << 20, column: str = "text") -> Iterator[pa.Table]:
    """Arrow batches cut or joined to about `limit` bytes of text; a longer text comes alone."""
    held, size = [], 0
    for batch in rows:
        lengths = np.diff(offsets(batch.column(column)))
        start = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i
            size += int(n)
        if len(lengths) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array without nulls."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    raw = array.buffers()[1]
    if raw is None or not len(array):
        return np.zeros(1, np.int64)
    return np.frombuffer(raw, kind, len(array) + 1, array.offset * width).astype(np.int64)


def text_bytes(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and the n + 1 offsets of the texts in them."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    at = offsets(array)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalising step of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        bases = _BASE, pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in bases]
    return _POWERS[0][:n], _POWERS[1][:n]


__all__ = [
    "batches", "bucketed", "components", "fold", "mix64", "offsets", "partitions", "powers", "read", "shared_folder", "stored",
    "text_bytes", "whole_text",
]
