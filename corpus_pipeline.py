"""From raw documents to piece ids: toxicity, exact copies, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of `documents`.

Defined cases, in every stage: a null text counts as empty (toxicity: the score of the intercept; near copies: links with nothing; pieces: no
ids), so of all empty texts one stays. Null sources are a source of their own; null and repeated doc_ids are ordinary rows, of equal texts under one doc_id one row stays. Columns beside doc_id, text and source pass through
unread, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procmon.llm import bag_minhash, exact_dedup, mixing, toxicity
from procmon.llm.common import shared_folder, stored
from procmon.llm.queries import coded, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labelled ones among `docs`."""
    model = toxicity_model(spark, docs, sf_dir)
    return docs.where(toxicity.score(model, F.col("text"), spark) < 0.5)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup.distinct(docs, exact_dedup.DigestIndex(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return bag_minhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources take turns by unrounded weights."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position, doc_id, source, ids, n_ids and the digest of the decoded text; `position` is the row's place in the schedule, from 0 on.

    The stage before wrote the rows in the order of the schedule. Reading packs files by size and giant texts are encoded apart, so each row carries the
    number of its file and its row there; the rows of the files before are counted. Rows that come from no file are numbered by their partitions.
    """
    if docs.inputFiles():
        name = F.col("_metadata.file_name")
        number = lambda pattern: F.coalesce(F.regexp_extract(name, pattern, 1).try_cast("long"), F.lit(0))
        at = [F.struct(number(r"part-(\d+)").alias("part"), number(r"-c(\d+)").alias("c"), name.alias("name")).alias("_file"), F.col("_metadata.row_index").alias("_at")]
    else:
        number = F.monotonically_increasing_id()
        at = [F.struct(F.shiftright(number, 33).alias("part")).alias("_file"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")]
    # Written first, so that finding the ranges to sort by does not encode everything twice.
    rows = stored(coded(docs.select("doc_id", "source", "text", *at), keep=("doc_id", "source", "_file", "_at")), "coded")
    # One row a file, of about a hundred bytes; there are no more files than tasks that wrote the stage before.
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("_file").agg(F.count("*").alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(F.broadcast(files), "_file").withColumn("position", F.col("_before") + F.col("_at"))
    return placed.select("position", "doc_id", "source", "ids", "n_ids", "decoded_sha256").orderBy("position")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pieces", encode_pieces),
]

#: Classifier, signatures and pieces have no SQL; tests/llm/test_pipeline.py compares each stage with a direct computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
