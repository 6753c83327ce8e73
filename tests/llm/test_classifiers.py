"""Language and toxicity: held-out accuracy and odd rows."""

import math

import numpy as np
from pyspark.sql import functions as F

from procmon.catalog.registry import QUERIES
from procmon.llm import language_id, ngrams, toxicity
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = QUERIES["op7_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 150 and (held.lang == held.lang_pred).mean() > 0.97
    # Calibrated: the mean confidence is near the accuracy.
    assert abs(held.score.mean() - (held.lang == held.lang_pred).mean()) < 0.03


def test_language_of_odd_documents(spark, documents):
    model = language_id.train(documents.where("lang is not null"))
    assert model.languages == ("de", "en", "es", "fr")
    got = {r["doc_id"]: r for r in language_id.identify(documents, model).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (4, 5, 6, 14))
    assert all(0 < got[i]["score"] <= 1 and got[i]["lang_pred"] in model.languages for i in (1, 7, 9, 13, 15))
    none = language_id.train(documents.where("lang is null"))
    assert {r["lang_pred"] for r in language_id.identify(documents, none).collect()} == {"und"}


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(docs, "doc_id").toPandas()
    for lang in ("en", "de", "es", "fr"):
        held = got[got.held_out & (got.lang == lang)]
        hit = held.toxic == 1
        assert hit.sum() >= 5
        assert (held.predicted[hit] == 1).mean() >= 0.8, lang
        assert (held.predicted[~hit] == 1).mean() <= 0.04, lang


def direct_ftrl(examples, features, rate, l1, l2, epochs):
    """Weights of the second class less those of the first, feature by feature; the last one is the intercept."""
    z, n = [[0.0, 0.0] for _ in range(features + 1)], [[0.0, 0.0] for _ in range(features + 1)]

    def weight(i, k):
        size = abs(z[i][k]) - l1
        return 0.0 if size <= 0 else -math.copysign(size, z[i][k]) / ((1.0 + math.sqrt(n[i][k])) / rate + l2)

    for _ in range(epochs):
        for rows, values, label in examples:
            rows, values = [*rows, features], [*values, 1.0]
            w = [[weight(i, k) for k in (0, 1)] for i in rows]
            margin = [sum(v * x[k] for v, x in zip(values, w)) for k in (0, 1)]
            p = [math.exp(m - max(margin)) for m in margin]
            p = [x / sum(p) for x in p]
            for i, v, x in zip(rows, values, w):
                for k in (0, 1):
                    g = v * (p[k] - (label == k))
                    z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / rate * x[k]
                    n[i][k] += g * g
    return [weight(i, 1) - weight(i, 0) for i in range(features + 1)]


def test_ratios_and_learner_equal_a_direct_computation(spark):
    rows = [(i, prose(i, 12) + (" you vile gnarf" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.drop("text"))
    held = {i: set(next(ngrams.hashed([t], toxicity.SIZES, toxicity.BITS)).tolist()) for i, t, _ in rows}
    toxic = [i for i, _, y in rows if y]
    counts = {k: [sum(k in held[i] for i, _, y in rows if y == label) for label in (0, 1)] for k in set().union(*held.values())}
    ratio = {k: math.log((p + 1) / (len(toxic) + 2)) - math.log((q + 1) / (len(rows) - len(toxic) + 2)) for k, (q, p) in counts.items() if p >= toxicity.LEAST}
    ratio = {k: r for k, r in sorted(ratio.items()) if abs(r) >= toxicity.RATIO}
    assert model.features.tolist() == list(ratio) and np.allclose(model.ratio, list(ratio.values()))
    h = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)).alias("h")).collect()}
    place = {k: n for n, k in enumerate(ratio)}
    examples = [
        ([place[k] for k in sorted(held[i]) if k in place], [ratio[k] for k in sorted(held[i]) if k in place], y) for i, _, y in sorted(rows, key=lambda r: (h[r[0]], r[2]))
    ]
    w = direct_ftrl(examples, len(ratio), 0.1, 1e-4, 1e-2, toxicity.EPOCHS)
    assert np.allclose(model.weights, np.array(w[:-1]) * model.ratio, atol=1e-9)
    # All rows are in the sample, so the intercept is not moved.
    assert abs(model.intercept - w[-1]) < 1e-9


def test_planted_words_and_odd_documents(spark, documents):
    rows = [(i, prose(i, 60) + (" you vile gnarf" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.drop("text"))
    texts = [prose(900 + i, 60) for i in range(50)]
    assert (model.scores(texts) < 0.5).all() and (model.scores([t + " you VILE gnarf" for t in texts]) > 0.5).all()
    got = documents.select("doc_id", toxicity.score(model, F.col("text"), spark).alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in got)
    base = {r["s"] for r in got if r["doc_id"] in (4, 5)}
    assert len(base) == 1 and base.pop() < 0.5
    one = toxicity.train(df.drop("toxic"), df.drop("text").where("toxic = 0"))
    assert (one.scores(["x", ""]) < 0.5).all()


def test_features_outside_the_sample_are_not_kept_and_copies_count_once(spark):
    rows = [(i, prose(i, 40) + (f" gnarf{i % 30:02d}" if i % 2 else ""), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole = toxicity.train(df.drop("toxic"), df.drop("text"))
    model = toxicity.train(df.drop("toxic"), df.drop("text"), per_label=10)
    assert 0 < len(model.features) < len(whole.features) and np.isin(model.features, whole.features).all()
    # The ratio is the one over all labelled rows, whatever the sample.
    assert np.array_equal(model.ratio, whole.ratio[np.searchsorted(whole.features, model.features)])
    assert np.array_equal(toxicity.present(np.array([7, 3, 7, 9, 3]), toxicity.mask(np.array([3, 7]))), [3, 7])
    assert len(toxicity.present(np.zeros(0, np.int32), toxicity.mask(np.array([3])))) == 0


def test_ngrams_stay_inside_their_text():
    alone = [np.sort(next(ngrams.hashed([t], range(1, 4), 15))) for t in ("abc", "", "Ünï", "z")]
    together = [np.sort(g) for g in ngrams.hashed(["abc", "", "Ünï", "z"], range(1, 4), 15)]
    assert all(np.array_equal(a, b) for a, b in zip(alone, together))
    assert len(alone[0]) == 5 + 4 + 3 and len(alone[1]) == 0


def test_learner_is_sparse_and_separates():
    rng = np.random.default_rng(2)
    learner = ngrams.Ftrl(50, 3, rate=0.5, l1=1.0, l2=0.1)
    for _ in range(600):
        k = rng.integers(3)
        learner.learn(np.array([k, 3 + rng.integers(47)]), np.ones(2), int(k))
    w = learner.weights()
    assert (w[:3].argmax(1) == [0, 1, 2]).all() and (w[3:50] == 0).mean() > 0.5
