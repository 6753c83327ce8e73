"""Every stage of the pipeline against a direct computation on its own input."""

import hashlib

import corpus_pipeline
import sentencepiece

from procmon.llm import mixing, pieces, toxicity
from procmon.llm.queries import toxicity_model
from tests.llm.test_near import shingles, similarity, smallest_reachable

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append((name, before.toPandas(), docs.toPandas()))
        if name != "pieces":
            assert docs.columns == before.columns
    (_, a, b), (_, _, c), (_, _, d), (_, _, e), (_, _, f) = seen
    model = toxicity_model(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert set(b.doc_id) == {i for i, s in zip(a.doc_id, model.scores(a.text.tolist())) if s < 0.5}
    last = b.sort_values("doc_id").drop_duplicates("text", keep="last")
    assert set(c.doc_id) == set(last.doc_id)
    bags = {i: shingles(t) for i, t in zip(c.doc_id, c.text)}
    links = [(i, j) for i in bags for j in bags if i < j and similarity(bags[i], bags[j]) >= 0.8]
    label = smallest_reachable(bags, links)
    assert set(d.doc_id) == set(label.values())
    assert sorted(e.doc_id) == sorted(d.doc_id)
    library = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    text = dict(zip(e.doc_id, e.text))
    assert sorted(f.doc_id) == sorted(text)
    for i, ids, digest in zip(f.doc_id, f.ids, f.decoded_sha256):
        assert list(ids) == library.encode(text[i]) and digest == hashlib.sha256(text[i].encode()).hexdigest()


def test_run_and_odd_documents(spark, tables, no_tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["position", "doc_id", "source", "ids", "n_ids", "decoded_sha256"] and out.count() > 20
    assert corpus_pipeline.run(spark, no_tables).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "pieces"]


def test_run_keeps_the_order_of_the_schedule(spark):
    rows = corpus_pipeline.run(spark, SF).select("position", "doc_id", "source").collect()
    assert [r["position"] for r in rows] == list(range(len(rows)))
    got = [(r["doc_id"], r["source"]) for r in rows]
    docs = spark.createDataFrame(sorted(got), "doc_id long, source string")
    want = mixing.interleave(docs).orderBy("_slot", "_place").collect()
    assert got == [(r["doc_id"], r["source"]) for r in want] and got != sorted(got)


def test_pieces_of_rows_that_come_from_no_file(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "a") for i in range(30)], "doc_id long, text string, source string").repartition(4)
    got = corpus_pipeline.encode_pieces(spark, docs, SF).collect()
    assert [r["position"] for r in got] == list(range(30)) and sorted(r["doc_id"] for r in got) == list(range(30))
