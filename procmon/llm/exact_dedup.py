"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the text. New documents are reduced to
digests, the digests already present are found by a sort-merge anti-join, and only unknown digests
are appended. Texts never enter the index, so its size follows the number of distinct texts.

Every digest carries the name of the batch that brought it. A batch that is tried again, because the job
failed after its digests were appended, meets its own name: those digests still count as new, nothing is
appended twice, and the result is the same. Without a name given, a batch is named after its rows, so that the same
rows are the same batch. Whoever wants to feed equal rows as new data gives them another name.

A digest that many rows share is one row of counts for each task before it travels. Only when the rows learn
their verdict do all of them meet it; both sides of that join are stored tables, so adaptive execution can split it.

Defined cases: a null text counts as the empty text, and all empty texts are copies of each other.
Of equal texts the largest doc_id stays (nulls are smallest). Rows that repeat both doc_id and
text are one document stored several times: one of them stays. An empty input gives no rows. A doc_id that is
no whole number is refused with CAST_INVALID_INPUT.
Columns other than doc_id and text are never read by the index and return unchanged from `distinct`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procmon.llm.common import partitions, shared_folder, stored, whole_text


def digest() -> Column:
    """SHA-256 of the whole text, in hexadecimal."""
    return F.sha2(whole_text().cast("binary"), 256)


class DigestIndex:
    """Digests seen so far, each with the document that stays for it.

    `path` names the folder of an existing index, to be continued by a later session with the
    same number of buckets; without it a new index starts in the shared folder.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or shared_folder(spark, "digests")
        self.buckets = buckets or partitions(spark)
        self.table = f"digests_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def learn(self, seen: DataFrame, batch: str) -> None:
        """Append the digests of `seen` that the index does not hold yet, each with its largest doc_id."""
        groups = seen.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        self.append(stored(fresh, "fresh"))

    def append(self, rows: DataFrame) -> None:
        (
            rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.table)
        )


def identities(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, copies): rows that repeat a document are counted, texts are left behind."""
    return docs.select(F.col("doc_id").cast("long"), digest().alias("digest")).groupBy("digest", "doc_id").agg(F.count("*").alias("copies"))


def batch_name(seen: DataFrame) -> str:
    """A name that follows from the rows of a batch, whatever their order."""
    rows, mixed = seen.agg(F.count("*"), F.bit_xor(F.xxhash64("digest", "doc_id", "copies"))).first()
    return f"{rows}-{(mixed or 0) & (1 << 64) - 1:016x}"


def _falling_ranges(seen: DataFrame, parts: int) -> list[Column]:
    """Conditions that cut the rows into ranges of doc_id of about equal size, the largest first and nulls last."""
    at = F.percentile_approx("doc_id", [1 - i / parts for i in range(1, parts)], 1000) if parts > 1 else F.lit(None)
    cuts = sorted(set(seen.agg(at.alias("cuts")).first()["cuts"] or []), reverse=True)
    upper = [None, *cuts]
    conditions = []
    for high, low in zip(upper, [*cuts, None]):
        inside = F.lit(True) if high is None else F.col("doc_id") < high
        inside = inside & (F.col("doc_id") >= low) if low is not None else F.coalesce(inside, F.lit(True))
        conditions.append(inside)
    return conditions


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None, parts: int = 1) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; the index learns the new texts.

    group_size counts the copies within `docs`. A text that the index knew before keeps no document
    of this batch, and keep_id is the one the index names. With `parts` the rows are fed one range of doc_id after
    the other, the largest first: the later ones meet the digests stored by the earlier ones, and the result is the same.
    """
    seen = stored(identities(docs), "identities")
    batch = batch or batch_name(seen)
    for inside in _falling_ranges(seen, parts):
        index.learn(seen.where(inside), batch)
    sizes = seen.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    known = index.rows().withColumn("new", F.col("batch") == batch).drop("batch")
    verdicts = stored(sizes.join(known.hint("merge"), "digest"), "verdicts")
    told = seen.join(verdicts.hint("merge"), "digest")
    return told.select(
        "doc_id", "keep_id", "group_size",
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("new")).alias("stays"),
        F.col("digest").alias("text_sha256"),
    ).select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def distinct(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = deduplicate(docs, index, batch).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_digest"))
    own = docs.withColumn("_own", F.col("doc_id").cast("long")).withColumn("_sha", digest())
    stays = own.join(kept, (F.col("_sha") == F.col("_digest")) & F.col("_own").eqNullSafe(F.col("_keep")), "left_semi")
    return stays.dropDuplicates(["_sha", "_own"]).drop("_sha", "_own")
