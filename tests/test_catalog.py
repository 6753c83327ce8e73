"""Registered queries against DuckDB; PROCMON_ALL_QUERIES=1 runs every one of them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
SAMPLE = [
    "tag_profile", "segment_gaps_tolerance", "resample_median", "row_classes", "score_fixed_model", "merge_exclusions",
    "training_windows", "sliding_windows", "performance_runs", "break_markers",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PROCMON_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    return float(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(row[columns.index(c)]) for c in order) for row in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in order) for row in df.collect()), key=repr)
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SAMPLE) <= set(entry.oracle_sql())
