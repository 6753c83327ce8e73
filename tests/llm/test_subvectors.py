"""Centroid clustering against SQL and a plain computation."""

from hashlib import sha256
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from procmon.catalog.registry import QUERIES
from procmon.llm import subvectors


def test_equals_sql(same):
    same("op11_subvector_clusters")


def directly(vectors, k, rounds):
    """({row: (cluster, distance)}, centroids) for lists of whole numbers in the order in which the first ones start a centroid."""
    centers = [list(v) for v in vectors[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centers))
    for _ in range(rounds):
        found = [near(v)[1] for v in vectors]
        for i in range(len(centers)):
            own = [v for v, f in zip(vectors, found) if f == i]
            if own:
                centers[i] = [sum(x) // len(own) for x in zip(*own)]
    return [near(v)[::-1] for v in vectors], centers


@pytest.mark.parametrize("n, dimensions, spread", [(400, 5, 6), (90, 8, 50_000), (7, 4, 3), (300, 2, 1)])
def test_equals_plain_computation(spark, monkeypatch, n, dimensions, spread):
    monkeypatch.setattr(subvectors, "PACK", 64)
    rng = np.random.default_rng(n)
    vectors = rng.integers(-spread, spread + 1, (n, dimensions)).tolist()
    rows = [(i, [x / 64 for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    told, centers = subvectors.cluster(df, "id", "v", dimensions, 10, 3, F.col("id"), 64.0)
    got = {r["id"]: (r["cluster"], r["distance"]) for r in told.collect()}
    want, last = directly(vectors, 10, 3)
    assert centers.tolist() == last and got == dict(enumerate(want))


def test_odd_vectors(spark, tmp_path):
    good = [[float(np.sin(i * j)) for j in range(64)] for i in range(1, 40)]
    odd = [None, [], [1.0] * 63, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] * 64]
    rows = [(i, v) for i, v in enumerate(good + odd)] + [(3, good[3]), (3, good[5]), (None, good[4]), (None, [3e38] * 64), (900, [-2.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit("x").alias("cluster"), F.lit(1).alias("v"), F.lit(1).alias("id"))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op11_subvector_clusters"](spark, str(tmp_path)).collect()
    kept = [(i, v) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in kept)
    whole = [(i, [floor(64 * x) for x in v]) for i, v in kept if max(map(abs, v)) < 1e6]
    whole.sort(key=lambda r: (sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    want, centers = directly([v for _, v in whole], 16, 3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    told = [r for r in got if r["cluster"] is not None]
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in told), key=key) == sorted(((i, *w) for (i, _), w in zip(whole, want)), key=key)
    assert len(got) == len(told) + 1 and {r["inertia"] for r in got} == {sum(d for _, d in want)}
    for r in told:
        assert r["cluster_inertia"] == sum(d for c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == sha256(",".join(map(str, centers[r["cluster"]])).encode()).hexdigest()


def test_empty_table(spark, no_tables):
    assert QUERIES["op11_subvector_clusters"](spark, no_tables).collect() == []
