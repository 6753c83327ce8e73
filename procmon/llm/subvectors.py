"""Centroid clustering of integer vectors, with distances looked up by dictionary codes of subvectors.

Vectors are packed where they are read. A pack holds, for every block of BLOCK dimensions, the dictionary of its
different subvectors and one code per vector, so nothing is lost. In each round the squared distances of a
dictionary's entries to the centroids are computed once; the distance of a vector is the sum of the entries its codes name.
The sums of the vectors of a cluster come from counting codes: entry times count. All arithmetic is on whole numbers, so the
result does not depend on packs, tasks or their order.

    vectors -> packs (written once) -> rounds: one row of sums for each pack and cluster, added up by cluster -> centroids
            -> last assignment (written) -> inertia by cluster

Only the centroids travel, `k` times the dimensions, and only they and the `k` rows of sums reach the driver. Dictionaries belong to
their pack, so none grows with the table, and a pack of PACK vectors is small beside a task's memory. A large cluster is
added up in its packs first.

Defined cases: vectors that are null, have another number of components, or hold null or non-finite components are left out. A
component of 2**27 or more in magnitude after scaling would carry squared distances beyond a long: such a vector takes no part and
returns with null cluster and distance. Rows with a repeated or null id are vectors of their own. With fewer vectors than centroids there
are as many centroids as vectors; equal vectors may start several centroids, and the later ones then stay empty and unchanged.
An empty table gives no rows. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import stored

#: Dimensions in a block, and vectors in a pack.
BLOCK = 2
PACK = 1 << 15
LIMIT = 1 << 27


def quantised(column: Column, dimensions: int, scale: float) -> Column:
    """floor(scale * x) of every component; null if the vector takes no part."""
    wide = F.transform(column, lambda x: x.cast("double"))
    usable = (F.size(column) == dimensions) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(wide, lambda x: F.floor(x * F.lit(scale))))


def _pack(ids: pa.Array, vectors: np.ndarray) -> pa.RecordBatch:
    """One row: the ids, and one after another the dictionaries and the codes of all blocks."""
    entries, sizes, codes = [], [], []
    for low in range(0, vectors.shape[1], BLOCK):
        distinct, code = np.unique(vectors[:, low : low + BLOCK], axis=0, return_inverse=True)
        entries.append(distinct.reshape(-1))
        sizes.append(len(distinct))
        codes.append(code.reshape(-1).astype(np.int32))
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)
    return pa.RecordBatch.from_arrays(
        [one(ids), one(np.concatenate(entries)), one(np.array(sizes, np.int32)), one(np.concatenate(codes))], ["ids", "entries", "sizes", "codes"]
    )


@dataclass(frozen=True)
class Pack:
    ids: pa.Array
    #: For each block the dictionary (entries x dimensions) and the codes of the vectors.
    blocks: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, batch: pa.RecordBatch, row: int, dimensions: int) -> Pack:
        ids, entries, sizes, codes = (batch.column(c)[row].values for c in ("ids", "entries", "sizes", "codes"))
        entries, codes = np.asarray(entries), np.asarray(codes).reshape(-1, len(ids))
        blocks, at = [], 0
        for k, (low, n) in enumerate(zip(range(0, dimensions, BLOCK), np.asarray(sizes))):
            width = min(BLOCK, dimensions - low)
            blocks.append((entries[at : at + n * width].reshape(n, width), codes[k]))
            at += n * width
        return cls(ids, blocks)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance); of equal distances the smaller number."""
        total, low = np.zeros((len(self.ids), len(centroids)), np.int64), 0
        for entries, codes in self.blocks:
            part = centroids[:, low : low + entries.shape[1]]
            total += ((entries[:, None, :] - part[None, :, :]) ** 2).sum(axis=2)[codes]
            low += entries.shape[1]
        cluster = total.argmin(axis=1)
        return cluster, total[np.arange(len(cluster)), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """For each cluster the sum of its vectors, from how often it has each entry."""
        found = []
        for entries, codes in self.blocks:
            counts = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries)).reshape(k, len(entries))
            found.append(counts @ entries)
        return np.concatenate(found, axis=1)


def packed(vectors: DataFrame, dimensions: int) -> DataFrame:
    """`vectors` (id, v) as packs; to be written once and read back."""

    def rows(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACK:
                yield from joined(held)
                held, n = [], 0
        if n:
            yield from joined(held)

    def joined(held):
        table = pa.Table.from_batches(held)
        ids, lists = table.column("id").combine_chunks(), table.column("v").combine_chunks()
        ids, lists = (x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in (ids, lists))
        yield _pack(ids, np.asarray(lists.flatten()).reshape(-1, dimensions))

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v").mapInArrow(rows, f"ids array<{kind}>, entries array<long>, sizes array<int>, codes array<int>")


def _round(packs: DataFrame, centroids: np.ndarray, dimensions: int) -> np.ndarray:
    """The centroids after one assignment; the floor of each mean, or as before where no vector is nearest."""
    shared = packs.sparkSession.sparkContext.broadcast(centroids)
    names = [f"s{i}" for i in range(dimensions)]

    def rows(batches):
        centers = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                pack = Pack.of(batch, row, dimensions)
                cluster, _ = pack.nearest(centers)
                sums, n = pack.sums(cluster, len(centers)), np.bincount(cluster, minlength=len(centers))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centers))), pa.array(n), *map(pa.array, sums.T)], ["cluster", "n", *names])

    found = packs.mapInArrow(rows, ", ".join(f"{c} long" for c in ["cluster", "n", *names]))
    moved = centroids.copy()
    for r in found.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).where("n > 0").collect():
        moved[r["cluster"]] = [r[c] // r["n"] for c in names]
    shared.unpersist()
    return moved


def cluster(
    vectors: DataFrame, key: str, column: str, dimensions: int, k: int, rounds: int, order: Column, scale: float = 1.0
) -> tuple[DataFrame, np.ndarray]:
    """((key, cluster, distance) of every vector that takes part, the last centroids).

    The first centroids are the `k` vectors that come first by `order`, then by their components; the components of all are floor(scale * x).
    """
    own = vectors.select(F.col(key).alias("id"), quantised(F.col(column), dimensions, scale).alias("v"), order.alias("h")).where("v is not null")
    # Of fixed size: each row with whether its distances fit a long.
    fits = F.forall("v", lambda x: F.abs(x) < LIMIT)
    first = own.where(fits).orderBy("h", "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dimensions)
    outside = own.where(~fits).select(F.col("id").alias(key), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    if not len(centroids):
        return outside, centroids
    packs = stored(packed(own.where(fits), dimensions), "packs")
    for _ in range(rounds):
        centroids = _round(packs, centroids, dimensions)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def rows(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                pack = Pack.of(batch, row, dimensions)
                found, distance = pack.nearest(shared.value)
                yield pa.RecordBatch.from_arrays([pack.ids, pa.array(found.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    kind = own.schema["id"].dataType.simpleString()
    told = packs.mapInArrow(rows, f"id {kind}, cluster int, distance long")
    return told.withColumnRenamed("id", key).unionByName(outside), centroids


def with_inertia(assigned: DataFrame) -> DataFrame:
    """`assigned` with the distances summed over its cluster and over all; `assigned` is a stored table."""
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = assigned.agg(F.coalesce(F.sum("distance"), F.lit(0)).alias("inertia"))
    # One row a cluster, and one.
    return assigned.join(F.broadcast(own), "cluster", "left").crossJoin(F.broadcast(whole))
