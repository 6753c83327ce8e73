"""Fingerprints against SQL, a plain computation, and true set measures."""

import re
from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from procmon.catalog.registry import QUERIES
from procmon.llm import bottom_k as b
from tests.llm.conftest import prose


def hashes(text):
    lower = text.translate(str.maketrans(b.UPPER, b.LOWER))
    w = [crc32(x.encode()) for x in re.split("[ \t\n\x0b\f\r]+", lower) if x]
    runs = [w] if 0 < len(w) < b.WORDS else [w[i : i + b.WORDS] for i in range(len(w) - b.WORDS + 1)]
    return {sum(x * c for x, c in zip(r, b.FACTORS)) % b.PRIME for r in runs}


def lowest(text):
    return sorted(hashes(text))[: b.K]


def like(x, y):
    union = sorted({*x, *y})[: b.K]
    return 1.0 if not union else sum(h in x and h in y for h in union) / len(union)


def test_equals_sql(same):
    assert len(same("op13_bottom_k")) == 200


def test_odd_documents(spark, tables, odd_documents):
    got = QUERIES["op13_bottom_k"](spark, tables)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    docs = sorted(((d, t or "") for d, t, *_ in odd_documents), key=lambda r: (r[0] is not None, r[0] or 0, sha256(r[1].encode()).hexdigest()))
    want = []
    for (d, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        x, y, z = lowest(t), lowest(edited), lowest(after)
        text = lambda s: "".join(f"{h:016x}" for h in s)
        want.append((d, len(t), sha256(edited.encode()).hexdigest(), text(x), text(y), like(x, y), like(x, z)))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want, key=repr)


def test_one_document_follows_itself(spark):
    docs = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    (row,) = b.followed(docs).collect()
    assert (row["start"], row["next_sketch"]) == ("ab", lowest("abcdefgh"))
    assert b.followed(docs.limit(0)).collect() == []


def test_estimates_come_near_the_truth(spark):
    words = prose(5, 9000).split()
    words = [f"{w}{i % 997}" for i, w in enumerate(words)]
    texts = [(" ".join(words[:6000]), " ".join(words[2000:])), (" ".join(words[:3000]), " ".join(words)), ("one two", "one two"), ("", "one two"), ("", "")]
    df = spark.createDataFrame(texts, "a string, b string").select("a", "b", b.sketch(F.col("a")).alias("x"), b.sketch(F.col("b")).alias("y"))
    got = df.select(
        "a", "b", b.resemblance(F.col("x"), F.col("y")).alias("r"), b.containment(F.col("x"), F.col("y")).alias("c"), b.distinct_count(F.col("x")).alias("n"),
        b.merged(F.col("x"), F.col("y")).alias("m"),
    ).collect()
    for r in got:
        x, y = hashes(r["a"]), hashes(r["b"])
        assert abs(r["r"] - (len(x & y) / len(x | y) if x | y else 1)) < 0.15
        assert abs(r["c"] - (len(x & y) / len(x) if x else 1)) < 0.25
        assert abs(r["n"] - len(x)) <= 0.3 * len(x)
        assert r["m"] == sorted(x | y)[: b.K]


def test_sketches_of_groups_merge(spark):
    rows = [("g" if i % 3 else "h", prose(i, 80)) for i in range(60)]
    df = spark.createDataFrame(rows, "source string, text string").repartition(7).select("source", b.sketch(F.col("text")).alias("s"))
    for r in b.of_groups(df, "source", "s").collect():
        assert r["s"] == sorted(set().union(*(hashes(t) for g, t in rows if g == r["source"])))[: b.K]
