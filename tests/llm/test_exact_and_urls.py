"""Exact copies and URL rules against SQL and direct computation."""

import random
import re
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from procmon.llm import exact_dedup, url_filter
from procmon.llm.queries import URL_RULES


def test_equal_sql(same):
    assert len(same("op6_exact_dedup")) == 200
    assert len(same("op10_url_filter")) == 50


def test_copies_of_odd_documents(spark, documents, odd_documents):
    index = exact_dedup.DigestIndex(spark)
    got = exact_dedup.deduplicate(documents, index).collect()
    groups = {}
    for d, t, *_ in odd_documents:
        groups.setdefault(sha256((t or "").encode()).hexdigest(), []).append(d)
    low = lambda d: -1 if d is None else d
    assert Counter((r["doc_id"], r["text_sha256"]) for r in got) == Counter((d, h) for h, ds in groups.items() for d in ds)
    for h, ds in groups.items():
        rows = [r for r in got if r["text_sha256"] == h]
        keep = max(ds, key=low)
        assert {r["keep_id"] for r in rows} == {keep} and {r["group_size"] for r in rows} == {len(ds)}
        assert [r["doc_id"] for r in rows if r["kept"]] == [keep]
    kept = exact_dedup.distinct(documents, exact_dedup.DigestIndex(spark))
    assert kept.columns == documents.columns and kept.count() == len(groups)


def test_later_batches_meet_the_index(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, buckets=3)
    exact_dedup.deduplicate(rows((1, "a"), (2, "b"), (5, "a")), index).collect()
    # A later session continues the index from its folder.
    again = exact_dedup.DigestIndex(spark, index.path, 3)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.deduplicate(rows((9, "a"), (7, "c"), (8, "c")), again).collect()}
    assert got == {9: (5, False), 7: (8, False), 8: (8, True)}
    assert again.rows().count() == 3
    plan = rows((1, "a")).select(F.col("text").alias("digest")).join(again.rows().hint("merge"), "digest", "left_anti")
    assert "SelectedBucketsCount: 3 out of 3" in plan._jdf.queryExecution().executedPlan().toString()


def test_a_batch_tried_again_keeps_the_same_documents(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first, second = rows((1, "a"), (2, "b"), (5, "a")), rows((9, "a"), (7, "c"))
    verdict = lambda docs, **named: sorted(exact_dedup.deduplicate(docs, index, **named).collect())
    once = verdict(first)
    assert [(r["doc_id"], r["kept"]) for r in once] == [(1, False), (2, True), (5, True)]
    assert verdict(first) == once and index.rows().count() == 2
    later = verdict(second)
    assert [(r["doc_id"], r["keep_id"], r["kept"]) for r in later] == [(7, 7, True), (9, 5, False)]
    assert verdict(first) == once and verdict(second) == later and index.rows().count() == 3
    # Equal rows under another name are new data: the index knows all of their texts.
    assert not any(r["kept"] for r in verdict(first, batch="another day"))
    # Only a part of the digests had been appended when the job was lost.
    half = exact_dedup.DigestIndex(spark, buckets=3)
    seen = exact_dedup.identities(first)
    half.learn(seen.where("doc_id = 2"), exact_dedup.batch_name(seen))
    assert sorted(exact_dedup.deduplicate(first, half).collect()) == once


def test_parts_change_nothing(spark, documents):
    whole = exact_dedup.deduplicate(documents, exact_dedup.DigestIndex(spark))
    index = exact_dedup.DigestIndex(spark)
    parts = exact_dedup.deduplicate(documents, index, parts=4)
    assert Counter(whole.collect()) == Counter(parts.collect())
    assert index.rows().count() == index.rows().select("digest").distinct().count()


def test_parts_of_nothing_and_of_one_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.deduplicate(empty, exact_dedup.DigestIndex(spark), parts=3).count() == 0
    same_id = spark.createDataFrame([(4, "x"), (4, "y"), (4, "x"), (None, "y")], "doc_id long, text string")
    got = exact_dedup.deduplicate(same_id, exact_dedup.DigestIndex(spark), parts=3).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(0, 4, 2, False), (4, 4, 2, False), (4, 4, 2, True), (4, 4, 2, True)]


def judge_directly(url):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, (max(fits)[2], max(fits)[3]) if fits else (None, None)


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "HTTP://A.Org", "http://a.org/x", "http://org/", "http://Example.ORG/es/1?x=/fr/", "https://example.org/en/17#a",
        "https://sub.example.org/en/1", "https://myexample.org/en/1", "http://x.com/fr/a", "http://x.com/fr", "http://com/de/", "ftp://x.net:80/a://b", "http://ÄX.org/é",
        "http://x.org.evil.net/", "http://spam-farm.net/", "http://a.com/fr/\nb", "x://y://z.org/a",
    ]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("token", F.lit(1))
    rules = [url_filter.host_rule(*r) for r in URL_RULES] + [url_filter.word_rule("spam-farm")]
    got = url_filter.judge(df, rules).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        host, path, (rule, verdict) = judge_directly(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
        assert r["verdict"] == (verdict or ("block" if "spam-farm" in host else "allow"))


def test_many_rules_run_only_on_candidates(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    hosts = [".".join(r.sample(words, 2)) for _ in range(300)]
    rules = {(r.choice(hosts), r.choice(["/", "/a/", "/a/b", ""]), r.choice(["allow", "block"])) for _ in range(150)}
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{r.choice(['', 'sub.'])}{r.choice(hosts)}{r.choice(['', '/', '/a', '/a/', '/a/bc', '/c'])}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    loose = url_filter.Rule("any", "block", "^[^ ]* /c$", (), False)
    got = url_filter.judge(df, [url_filter.host_rule(*x) for x in rules] + [loose])
    for row in got.collect():
        host, path = re.match(r"([^/]*)(.*)", urls[row["page_id"]][7:]).groups()
        fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        top = [f for f in fits if f[:2] == max(fits)[:2]]
        assert row["rule"] in ({f[2] for f in top} or {None})
        assert row["verdict"] == (max(fits)[3] if fits else "block" if path == "/c" else "allow")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "Python" not in plan


def test_hosts_with_blanks(spark):
    pages = spark.createDataFrame([(1, "http://my site.org/x"), (2, "http://a b.casino.net/"), (3, "http://x casino/"), (4, "http://org x/")], "page_id long, url string")
    rules = [url_filter.host_rule("org", "/", "allow"), url_filter.word_rule("casino")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert got == {1: ("org/", "allow"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow")}
