"""Encoding against the library, decoding as its inverse, and the max-plus scan against a plain search."""

import hashlib
import random

import numpy as np
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from procmon.llm import pieces
from tests.llm.conftest import prose

MODEL = pieces.model_bytes()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def test_equals_the_library(spark, documents, odd_documents):
    coded = pieces.decode(pieces.encode(documents, MODEL, chunk=2_000), MODEL, out="back").collect()
    want = sorted((d is None, d or 0, LIBRARY.encode(t or ""), t or "") for d, t, *_ in odd_documents)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"], r["back"]) for r in coded) == want


def test_cuts_change_nothing():
    texts = [prose(1, 4_000), "  a  b " * 900, "a\n" * 3_000, "x" * 9_000, "word " * 2_000 + "▁ ▁mark " * 300, " lead and trail ", "日本語 テキスト" * 500]
    for t in texts:
        parts = pieces.cuts(t, 500)
        assert [i for p in parts for i in LIBRARY.encode(p)] == LIBRARY.encode(t)
    assert len(pieces.cuts(texts[0], 500)) > 20


def unigram_model():
    """A hand-made unigram model; nothing is trained."""
    r = random.Random(7)
    m = proto.ModelProto()
    m.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.remove_extra_whitespaces = False
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=name, score=0.0, type=kind)
    names = ["▁", *"abcdefgh"]
    names += list(dict.fromkeys("".join(r.choices("▁abcdefgh", k=r.randint(2, 6))) for _ in range(400)))
    for name in names:
        m.pieces.add(piece=name, score=-len(name) * r.uniform(1.0, 3.0) - 2.0, type=1)
    return m.SerializeToString()


def test_max_plus_scan_finds_the_best_segmentation(spark):
    model = unigram_model()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Pieces(model)
    r = random.Random(3)
    texts = ["".join(r.choices("abcdefgh ", k=n)) for n in (0, 1, 30, 400, 1_000)] + ["abx€c" * 60]
    score = lambda ids: sum(library.get_score(i) if i else own.least for i in ids)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (7, 64):
        got = {x["doc_id"]: x["ids"] for x in pieces.encode(df, model, chunk=chunk).collect()}
        for i, t in enumerate(texts):
            want = library.encode(t)
            if i < 5:
                assert np.isclose(score(got[i]), score(want)) and own.decode(got[i]) == t
            else:
                assert [x for x in got[i] if x] == [x for x in want if x]


def test_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((5, 5)) < 0.3, -np.inf, rng.normal(size=(5, 5))) for _ in range(3))
    assert np.allclose(pieces.plus(pieces.plus(a, b), c), pieces.plus(a, pieces.plus(b, c)))
