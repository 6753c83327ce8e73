"""What holds for all queries: one row per row, also for odd rows and empty tables."""

import pytest

from procmon.catalog.registry import QUERIES

DOCUMENT_QUERIES = [
    "op1_context_tree", "op2_near_documents", "op4_mix_sources", "op5_pieces", "op6_exact_dedup", "op7_language_id", "op8_repeats", "op9_toxicity",
    "op12_merkle_manifest", "op13_bottom_k",
]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_every_document_comes_back_once(spark, tables, odd_documents, name):
    got = QUERIES[name](spark, tables).select("doc_id").collect()
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted((d is None, d or 0) for d, *_ in odd_documents)


@pytest.mark.parametrize("name", [*DOCUMENT_QUERIES, "op3_near_embeddings", "op10_url_filter", "op11_subvector_clusters"])
def test_empty_tables_give_no_rows(spark, no_tables, name):
    assert QUERIES[name](spark, no_tables).collect() == []
