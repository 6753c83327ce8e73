"""Context-tree weighting against the definition, computed node by node."""

import math
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

from procmon.catalog.registry import QUERIES
from procmon.llm.context_tree import DEPTH, MARK, score_documents


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def direct(train):
    """Function from a text to the log10 of its probability after `train`."""
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def bits(text):
        data = [MARK] * DEPTH + list(text) + [MARK]
        for i in range(DEPTH, len(data)):
            for bit in range(8):
                prefix = (1 << bit) | (data[i] >> (8 - bit))
                path = [tuple(data[i - d : i]) for d in range(DEPTH + 1)]
                yield prefix, path, (data[i] >> (7 - bit)) & 1

    for text in train:
        for prefix, path, bit in bits(text):
            for d, context in enumerate(path):
                counts[prefix, context][bit] += 1
                if d:
                    children[prefix, path[d - 1]].add(context)

    @lru_cache(None)
    def mass(prefix, context):
        own = log_kt(*counts.get((prefix, context), (0, 0)))
        if len(context) == DEPTH:
            return own
        below = sum(mass(prefix, c) for c in children.get((prefix, context), ()))
        top = max(own, below)
        return top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)

    def score(text):
        total = 0.0
        for prefix, path, bit in bits(text):
            p, left = 0.0, 1.0
            for context in path:
                n = counts.get((prefix, context), (0, 0))
                kt = (n[bit] + 0.5) / (sum(n) + 1)
                stop = 1.0 if len(context) == DEPTH else 0.5 * math.exp(log_kt(*n) - mass(prefix, context))
                p += left * stop * kt
                left *= 1 - stop
            total += math.log10(p)
        return total

    return score


def test_scores_equal_the_definition(spark, tables, odd_documents):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    short = [(d, (t or "").encode()) for d, t, *_ in odd_documents]
    train = [t for d, t in short if not held(d)]
    score = direct(train)
    words = Counter(w for t in train for w in t.lower().split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    got = defaultdict(list)
    for r in QUERIES["op1_context_tree"](spark, tables).collect():
        got[r["doc_id"], r["n_bytes"]].append(r)
    for d, t in short:
        row = got[d, len(t)].pop()
        tokens = t.lower().split()
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        base += math.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (held(d), len(tokens) + 1, n)
        assert row["n_known"] == sum(words[w] > 0 for w in tokens) + 1
        assert math.isclose(row["base_score"], base, rel_tol=1e-9)
        if len(t) < 1_000 and d != 12:  # two documents share the id 12
            assert math.isclose(row["score"], score(t), rel_tol=1e-7)


def test_the_fifth_byte_back_decides(spark):
    rows = [(i, "Xabcd1" if i % 2 else "Yabcd2", False) for i in range(80)] + [(100, "Xabcd1", True), (101, "Xabcd2", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    score = {r["doc_id"]: r["score"] for r in score_documents(docs, "held").where("held_out").collect()}
    assert score[100] > score[101] + 1
