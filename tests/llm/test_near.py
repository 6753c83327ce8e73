"""Near-duplicate documents and embeddings against all pairs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from procmon.catalog.registry import QUERIES
from procmon.llm import bag_minhash, cross_polytope, pairs
from procmon.llm.common import components
from tests.llm.conftest import prose


def smallest_reachable(nodes, links):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def shingles(text):
    words = (text or "").encode().lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def edited(text, seed, changes):
    words, r = text.split(), np.random.default_rng(seed)
    for i in r.choice(len(words), changes, replace=False):
        words[i] = f"new{r.integers(1000)}"
    return " ".join(words)


def test_documents_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(bag_minhash, "GROUP_BLOCK", 7)  # large groups are cut into blocks
    texts = [prose(i, 80 + i) for i in range(20)]
    for i in range(6):
        texts += [edited(texts[i], 100 * i + k, 1 + k % 5) for k in range(8)]
    texts += [texts[3], texts[3] + " ", "spam " * 200, "spam " * 190, "spam " * 100, "two words", "Two  WORDS", ""]
    rows = list(enumerate(texts))
    bags = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(bags[i], bags[j]) >= 0.8]
    want = smallest_reachable(range(len(texts)), links)
    got = bag_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"] for r in got if r["kept"]} == set(want.values())


def test_signature_estimates_weighted_jaccard():
    """Slots agree with the probability sum(min) / sum(max), also for heavy and uneven weights."""
    rng = np.random.default_rng(3)
    for shift in (0, 3, 11):
        agreed, true = [], []
        for _ in range(60):
            names = np.sort(rng.integers(0, 1 << 62, 40).astype(np.uint64))
            a = rng.integers(1, 30, 40)
            b = np.maximum(1, a + rng.integers(-shift, shift + 1, 40))
            owner = np.repeat([0, 1], 40)
            s = bag_minhash.signatures(owner, np.concatenate([names, names]), np.concatenate([a, b]), 2)
            agreed.append((s[0] == s[1]).mean())
            true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
        assert abs(np.mean(agreed) - np.mean(true)) < 4 * 0.5 / np.sqrt(60 * bag_minhash.SLOTS)


def test_odd_documents(spark, documents, odd_documents):
    rows = bag_minhash.near_duplicates(documents).collect()
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None and r["doc_id"] != 12}
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == by_id[3]["component_id"] == 1
    assert by_id[7]["component_id"] == by_id[8]["component_id"] == 7 and by_id[10]["component_id"] == 9
    assert all(by_id[i]["kept"] and by_id[i]["component_id"] == i for i in (4, 5, 6, 11, 13))
    twins = [r for r in rows if r["doc_id"] == 12]
    assert sorted(r["kept"] for r in twins) == [False, True, True]
    kept = bag_minhash.representatives(documents)
    assert kept.columns == documents.columns and kept.count() == sum(r["kept"] for r in rows)


def test_components_and_blocks(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 99), (7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == smallest_reachable({x for e in edges for x in e}, edges)
    members = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 5)], "g long, m long")
    met = pairs.block_pairs(members, "g", "m", 6)
    sides = met.select("g", "lo", "hi", "side", "m").collect()
    seen = Counter()
    for lo, hi in {(r["lo"], r["hi"]) for r in sides}:
        here = [(r["side"], r["m"]) for r in sides if (r["lo"], r["hi"]) == (lo, hi)]
        seen.update(frozenset((a, b)) for s, a in here for t, b in here if a < b and (lo == hi or s != t))
    assert len(seen) == 25 * 24 // 2 and set(seen.values()) == {1}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    out = []
    for i in range(300):
        out.append(rng.normal(size=24))
    for i in range(20):
        out += [out[i] + rng.normal(size=24) * rng.choice([0.1, 0.25, 0.35]) for _ in range(6)]
    out += [out[0] * 7.0, out[1], out[1], out[2] * 1e200, -out[3]]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [1.0, None]), (1004, [float("nan")] * 24), (1005, [float("inf")] * 24), (None, rows[4][1]), (1006, [3.0])]
    return rows, odd


def test_embeddings_equal_all_pairs(spark, vectors, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 5)
    rows, odd = vectors
    x = np.array([v for _, v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    links = [(i, j) for i, j in zip(*np.nonzero(near)) if i > j]
    want = smallest_reachable(range(len(rows)), links)
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash"))
    got = {r["vec_id"]: r for r in cross_polytope.near_duplicates(df).collect()}
    assert [got[i]["n_links"] for i in range(len(rows))] == [int(n) - 1 for n in near.sum(axis=1)]
    assert [got[i]["component_id"] for i in range(len(rows))] == [want[i] for i in range(len(rows))]
    assert all(got[i]["kept"] == (want[i] == i) for i in range(len(rows)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i, _ in odd if i is not None)
    assert got[None]["n_links"] == 0 and got[None]["kept"]


def test_rotations_keep_lengths_and_differ():
    x = np.random.default_rng(1).normal(size=(50, 48))
    turned = [cross_polytope.rotated(x, k) for k in range(3)]
    for t in turned:
        assert t.shape == (50, 64) and np.allclose((t * t).sum(1), (x * x).sum(1))
    assert not np.allclose(turned[0], turned[1])


def test_query_on_the_test_table(spark):
    assert QUERIES["op3_near_embeddings"](spark, "/root/testdata/sf0.001").count() == 500
