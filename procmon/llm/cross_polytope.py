"""Near-duplicate embeddings by cross-polytope hashing.

Vectors of length one are rotated by three rounds of random signs and a fast Hadamard transform; the hash is
the number of the nearest vertex of the cross-polytope, that is the coordinate of largest magnitude and its sign.
A table joins ROTATIONS hashes. Every vector enters, in each of TABLES tables, the PROBES buckets whose vertices
are nearest to it, and two vectors meet if they share a bucket. Whatever meets is compared exactly, by the cosine
in double precision. Equal vectors are one vector with a number of copies.

Large buckets are cut into blocks that meet pair by pair in separate tasks (pairs.py); a pair that shares several
buckets counts in the first of them. A task returns, for each vector, the number of links and one neighbour of its
local component, never the pairs.

At cosine 0.95 and 64 dimensions two vectors share a bucket of one table with probability 0.91, and miss each
other in all six with less than 1e-6.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so
do vectors of different lengths. Rows without vec_id, too, link with nothing; they are kept and their component is
null. Equal vectors link with each other. Rows that repeat a vec_id share its component. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import components, mix64, stored
from procmon.llm.pairs import block_pairs, clusters, runs

TABLES, ROTATIONS, PROBES = 6, 2, 4
COSINE = 0.95
_NEAR = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        pair = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, number: int) -> np.ndarray:
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for turn in range(3):
        at = np.arange(width, dtype=np.uint64) + np.uint64((number * 3 + turn + 1) << 32)
        x = hadamard(x * np.where(mix64(at) >> np.uint64(63), -1.0, 1.0))
    return x


def buckets(x: np.ndarray) -> np.ndarray:
    """For unit vectors the buckets of all tables, nearest first: one row of TABLES * PROBES numbers each."""
    out = []
    for table in range(TABLES):
        vertices, losses = [], []
        for k in range(ROTATIONS):
            y = rotated(x, table * ROTATIONS + k)
            size = np.abs(y)
            near = np.argsort(-size, axis=1, kind="stable")[:, :_NEAR]
            height = np.take_along_axis(size, near, 1)
            vertices.append(near * 2 + (np.take_along_axis(y, near, 1) < 0))
            losses.append(height[:, :1] ** 2 - height**2)
        codes, loss = [], []
        for choice in product(range(vertices[0].shape[1]), repeat=ROTATIONS):
            code = np.full(len(x), table, np.uint64)
            for k, i in enumerate(choice):
                code = code * np.uint64(1 << 24) + vertices[k][:, i].astype(np.uint64)
            codes.append(mix64(code + np.uint64(x.shape[1])))
            loss.append(sum(losses[k][:, i] for k, i in enumerate(choice)))
        best = np.argsort(np.array(loss).T, axis=1, kind="stable")[:, :PROBES]
        out.append(np.take_along_axis(np.array(codes).T, best, 1))
    return np.concatenate(out, axis=1).view(np.int64)


def _unit(vectors: list[np.ndarray]) -> np.ndarray:
    x = np.array(vectors, float)
    # Scaling first keeps the squares of very large and very small components finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashed(batches):
    for batch in batches:
        vectors = [np.array(v, float) for v in batch.column("vector").to_pylist()]
        found: list = [None] * len(vectors)
        for size in {len(v) for v in vectors}:
            rows = [i for i, v in enumerate(vectors) if len(v) == size]
            for i, codes in zip(rows, buckets(_unit([vectors[i] for i in rows]))):
                found[i] = codes.tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("copies"), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(found, pa.list_(pa.int64()))],
            ["node", "copies", "packed", "codes"],
        )


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket in which a pair counts: the smallest common one of the first table that has one."""
    found = np.zeros(len(a), np.int64)
    open_ = np.ones(len(a), bool)
    for table in range(TABLES):
        part = slice(table * PROBES, (table + 1) * PROBES)
        same = (a[:, part, None] == b[:, None, part]).any(2)
        has = same.any(1) & open_
        found[has] = np.where(same, a[:, part], np.iinfo(np.int64).max).min(1)[has]
        open_ &= ~has
    return found


def _compare(rows: pa.Table) -> pa.Table:
    node, copies, bucket = (np.asarray(rows.column(c)) for c in ("node", "copies", "bucket"))
    vectors = [np.frombuffer(v) for v in rows.column("packed").to_pylist()]
    codes = np.array(rows.column("codes").to_pylist(), np.int64).reshape(len(node), -1)
    out = []
    for first, second in runs(rows, "bucket"):
        a = _unit([vectors[i] for i in first])
        b = a if second is None else _unit([vectors[i] for i in second])
        if a.shape[1] != b.shape[1]:
            continue
        near = a @ b.T >= COSINE
        i, j = np.nonzero(np.triu(near, 1) if second is None else near)
        left, right = first[i], (first if second is None else second)[j]
        if not len(left):
            continue
        counts = _first_common(codes[left], codes[right]) == bucket[first[0]]
        left, right = left[counts], right[counts]
        both, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        links = np.bincount(at, weights=copies[np.concatenate([right, left])])
        label = clusters(at[: len(left)], at[len(left) :], node[both])
        out.append((node[both], links.astype(np.int64), label))
    node, links, label = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"node": pa.array(node), "links": pa.array(links), "label": pa.array(label)})


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull() & ~odd & F.exists("vector", lambda x: x != 0)
    own = own.withColumn("vector", F.when(F.coalesce(usable, F.lit(False)), F.col("vector")))
    distinct = own.where("vector IS NOT NULL").groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    hashed = stored(distinct.mapInArrow(_hashed, "node long, copies long, packed binary, codes array<long>"), "hashed")
    met = hashed.select("node", F.explode("codes").alias("bucket")).distinct()
    rows = block_pairs(met, "bucket", "node").join(hashed, "node")
    found = stored(rows.groupBy("pack").applyInArrow(_compare, "node long, links long, label long"), "found")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found, "node", "label").select(F.col("node").alias("_n"), "component")
    classes = distinct.join(counts, "node", "left").join(label, F.col("node") == F.col("_n"), "left").select(
        F.col("vector").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")
    )
    return own.join(classes, F.col("vector") == F.col("_v"), "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == F.coalesce("component_id", "id"))).alias("kept"),
    )
