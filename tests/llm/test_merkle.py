"""The manifest against a tree built in plain Python."""

from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from procmon.catalog.registry import QUERIES
from procmon.llm import merkle


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def grow(leaves):
    """(top, for each leaf the list of (place, siblings)) of a tree."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, i in enumerate(at):
            run = runs[i // 3]
            proofs[k].append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        nodes, at = [H(*r) for r in runs], [i // 3 for i in at]
    return (nodes or [None])[0], proofs


def climb(proof, node):
    for at, others in proof:
        node = H(*others[:at], node, *others[at:])
    return node


def directly(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(field, r))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: grow([leaf(r) for r in groups[s]]) for s in names}
    root, last = grow([trees[s][0] for s in names])
    out = []
    for s, more in zip(names, last):
        for r, proof in zip(groups[s], trees[s][1]):
            now = r
            if crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0:
                now = (*r[:4], None if r[4] is None else r[4].replace("\n", ""))
            end = climb(proof + more, leaf(now))
            out.append((r[0], leaf(r), trees[s][0], root, H(*(x for _, others in proof + more for x in others)), end, end == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_equals_sql(same):
    got = same("op12_merkle_manifest")
    assert len(got) == 200


def test_odd_documents(spark, tables, odd_documents):
    got = QUERIES["op12_merkle_manifest"](spark, tables).select(COLUMNS).collect()
    want = directly([(d, s, lang, "x", t) for d, t, lang, s in odd_documents])
    assert Counter(map(tuple, got)) == Counter(want)
    assert {r["verified"] for r in got} == {True, False}
    assert all(r["verified"] for r in got if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 2)


@pytest.mark.parametrize("sizes", [[1], [2, 1, 1], [3, 9, 27, 28], [40, 5, 10, 26], [1] * 30])
def test_many_rounds_of_small_blocks(spark, monkeypatch, sizes):
    """Blocks of three leaves, so that trees of every shape take several rounds."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = [(1000 * s + i, None if s == 2 else f"s{s}", "t" * i) for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "id long, part string, body string").repartition(3)
    got = merkle.manifest(docs, "id", "part", merkle.leaf(F.col("id"), F.col("body"))).withColumn("end", merkle.folded(F.col("proof"), F.col("leaf"))).collect()
    assert sorted(r["id"] for r in got) == sorted(r[0] for r in rows)
    leaf = lambda r: H(*(f"{len(str(v))}:{v}" for v in (r[0], r[2])))
    names = sorted({r[1] for r in rows}, key=lambda s: (s is not None, s))
    trees = {s: grow([leaf(r) for r in rows if r[1] == s]) for s in names}
    root, last = grow([trees[s][0] for s in names])
    place = {r[0]: [x[0] for x in rows if x[1] == r[1]].index(r[0]) for r in rows}
    for r in got:
        proof = trees[r["part"]][1][place[r["id"]]] + last[names.index(r["part"])]
        assert [(p["at"], list(p["siblings"])) for p in r["proof"]] == proof
        assert (r["subroot"], r["root"], r["end"]) == (trees[r["part"]][0], root, root)


def test_no_rows_and_one_row(spark, no_tables):
    assert QUERIES["op12_merkle_manifest"](spark, no_tables).collect() == []
    one = spark.createDataFrame([(7, None)], "doc_id long, source string")
    (got,) = merkle.manifest(one, "doc_id", "source", merkle.leaf(F.col("doc_id"))).collect()
    assert got["leaf"] == got["subroot"] == got["root"] == H("1:7") and got["proof"] == []
