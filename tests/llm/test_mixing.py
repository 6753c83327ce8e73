"""The schedule against SQL, its definition, and the promise on deviations."""

from collections import Counter

import pytest

from procmon.llm import mixing


def test_equals_sql(same):
    assert len(same("op4_mix_sources")) == 200


def test_documents_keep_their_columns_and_order_takes_effect(spark, documents):
    mixed = mixing.mixed(documents, block_docs=2)
    assert mixed.columns == documents.columns and mixed.count() == documents.count()
    sources = [r["source"] for r in mixed.collect()]
    assert len(set(map(str, sources[:12]))) >= 3


@pytest.mark.parametrize("weights", [None, {"big": 1, **{str(i): 0.001 for i in range(20)}}, {"big": 2}])
def test_every_prefix_is_less_than_a_block_off(spark, monkeypatch, weights):
    # Several steps, each of several stretches.
    monkeypatch.setattr(mixing, "STEP", 64)
    monkeypatch.setattr(mixing, "STRETCH", 8)
    rows = [(i, "big") for i in range(900)] + [(1000 + i, str(i % 20)) for i in range(60)] + [(2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.interleave(df, weights, block_docs=2).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["_slot"], set()).add((r["source"], r["_block"]))
    assert sorted(slots) == list(range(len(slots))) and all(len(s) == 1 for s in slots.values())
    order = [next(iter(slots[t])) for t in range(len(slots))]
    docs = Counter(s for _, s in rows)
    size = {s: -(-n // 2) for s, n in docs.items()}
    for s in size:
        assert [b for x, b in order if x == s] == list(range(size[s]))
    weight = {s: docs[s] ** 0.5 if weights is None else weights.get(s, 0) for s in size}
    done, had, since = Counter(), Counter(), 0
    for t, (s, _) in enumerate(order):
        total = sum(weight[x] for x in size if had[x] < size[x])
        done[s] += 1
        if total:
            for x in size:
                if had[x] < size[x]:
                    assert abs(done[x] - had[x] - (t + 1 - since) * weight[x] / total) < 1 + 1e-5
        if done[s] == size[s]:
            had, since = Counter(done), t + 1


def test_schedule_of_no_rows(spark):
    assert mixing.interleave(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def test_many_sources_of_very_uneven_weights(spark):
    rows = [(f"s{i:03}", 20, 10) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, n_docs long, n_blocks long")
    weights = {"s000": 0.3, **{f"s{i:03}": 0.001 for i in range(1, 300)}}
    order = [r["source"] for r in mixing.schedule(df, weights).orderBy("slot").collect()]
    assert Counter(order) == Counter({s: 10 for s, *_ in rows})
    until = max(t for t, s in enumerate(order) if s == "s000") + 1
    assert until <= 21
    done, total = Counter(), sum(weights.values())
    for t, s in enumerate(order[:until], 1):
        done[s] += 1
        assert all(abs(done[x] - t * w / total) < 1 + 1e-5 for x, w in weights.items())
