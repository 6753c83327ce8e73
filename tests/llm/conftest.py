"""Comparison of a registered query with DuckDB on the test tables."""

import os

import duckdb
import pytest

import procmon.llm.queries  # noqa: F401  (registers the queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same(spark):
    """same(name): the query's rows equal those of its SQL."""
    from procmon.catalog.registry import ORACLES, QUERIES

    con = duckdb.connect()
    if os.path.isdir(SF):
        for name in os.listdir(SF):
            con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")

    def compare(name, sf=SF):
        df = QUERIES[name](spark, sf)
        cursor = con.execute(ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        want = sorted((tuple(row[columns.index(c)] for c in sorted(columns)) for row in cursor.fetchall()), key=repr)
        got = sorted((tuple(row[c] for c in sorted(columns)) for row in df.collect()), key=repr)
        assert got == want
        return got

    return compare


WORDS = "amber birch cedar delta ember frost grove haven island jungle kernel lagoon meadow north ocean prairie quartz river stone timber".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "ly", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_documents():
    """(doc_id, text, lang, source): nulls, empty and blank texts, repeats, copies, near copies, long texts."""
    base, long = prose(1, 120), prose(2, 30_000)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "a"), (4, None, None, None), (5, "", "de", "b"), (6, " \n\t ", "de", "b"),
        (7, long, "en", "a"), (8, long + " tail", "en", "c"), (9, "one two", "fr", "c"), (10, "one two", "fr", "c"), (None, base, None, "a"),
        (None, None, None, None), (11, "Ünïcode ✓ text with wörds " * 20, "de", "b"), (12, prose(3, 60), "en", "a"), (12, prose(3, 60), "en", "a"),
        (12, prose(4, 60), "en", "a"), (13, "a" * 5_000, None, "a"), (14, "12345 67890", "es", "b"), (15, "\x00\x01 control", "es", "b"),
    ]
    return rows + [(100 + i, prose(50 + i, 40 + i), ("en", "de", "fr")[i % 3], "abc"[i % 3]) for i in range(30)]


@pytest.fixture(scope="session")
def documents(spark, odd_documents):
    """The odd documents, with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents, "doc_id long, text string, lang string, source string")
    clash = ["kept", "score", "node", "digest", "block", "held_out", "component_id", "ids", "n", "label", "row", "key", "n_chars"]
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="session")
def tables(spark, documents, tmp_path_factory):
    """A folder of tables as the queries read them."""
    folder = tmp_path_factory.mktemp("tables")
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1, 131)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def no_tables(spark, documents, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    documents.limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)
