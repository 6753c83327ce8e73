"""Repeated passages against a dictionary of all strings of 200 bytes."""

import hashlib
from collections import Counter

import numpy as np

from procmon.llm import repeats
from tests.llm.conftest import prose


def direct(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(c for c, g in zip(d, gone) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(d), len(d) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_equals_dictionary(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_CHUNK", 3_000)  # stretches are cut at chunks too
    a, b, c = prose(1, 400), prose(2, 300), prose(3, 50)
    texts = [
        a, a[:900] + "X" + a[901:], b, b, c, None, "", "x" * 199, "x" * 200, "y" * 201, "z" * 700, prose(4, 80) + b[100:299] + prose(5, 80),
        prose(6, 80) + b[100:300] + prose(7, 80), "ab" * 150 + prose(8, 20), "q" + "ab" * 150, a[100:700] + b[200:600] + a[100:700], "é" * 150 + a[:250],
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == direct(texts)


def test_odd_documents(spark, documents, odd_documents):
    want = Counter(zip([d for d, *_ in odd_documents], direct([t for _, t, *_ in odd_documents])))
    got = repeats.remove_repeats(documents).collect()
    assert Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == want
