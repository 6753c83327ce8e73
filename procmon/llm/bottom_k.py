"""Document fingerprints: bottom-k sketches of the hashes of five-word shingles, with built-in functions only.

Words are runs of non-blank characters (blank: 0x20, 0x09-0x0D), A-Z lower-cased; a text of fewer than five words is one shingle of all its
words. A shingle's hash is a linear form of the CRC-32s of its words modulo a prime near 2**53, so hashes are pairwise nearly independent, which is
what bottom-k estimates need; each term runs around the modulus many times, so they spread evenly. The sketch of a text is the K smallest different hashes, in rising order.

Sketches are mergeable: the K smallest of two sketches together are the sketch of both texts' shingles, so parts of a text or of a
collection can be sketched apart (`merged`). From two sketches: the share of the union's K smallest that both have estimates the resemblance
(Jaccard) of the shingle sets; K - 1 divided by the K-th smallest, as a share of the range, estimates the number of different shingles; and both give the containment.
With up to K different shingles in both texts all three are exact.

Defined cases: a null text counts as empty; a text without words has an empty sketch. Two empty sketches have resemblance and
containment 1, an empty and another one 0 (nothing is contained in everything: containment of the empty one is 1). Equal texts have equal sketches.
Long texts are taken whole. Rows of one key follow each other in the order of their digests, and rows that repeat key and text follow each other too;
a null key comes first. An empty table gives no rows. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmon.llm.common import stored, whole_text
from procmon.llm.numbering import numbered

WORDS = 5
K = 128
#: Hashes lie below this prime; the factors are fixed odd numbers below 2**28, one for each word of a shingle.
PRIME = (1 << 53) - 111
FACTORS = (181783497, 226153695, 131764357, 202557443, 164158027)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The CRC-32 of each word of a text without null."""
    split = F.split(F.translate(text, UPPER, LOWER), r"[ \t\n\x0B\f\r]+")
    return F.transform(F.filter(split, lambda w: w != ""), lambda w: F.crc32(w.cast("binary")))


def sketch(text: Column, k: int = K) -> Column:
    """The K smallest different shingle hashes of a text without null, rising."""
    # The words are bound once, whatever is done with them.
    return F.transform(F.array(words(text)), lambda w: F.slice(F.sort_array(F.array_distinct(_shingles(w))), 1, k))[0]


def _shingles(w: Column) -> Column:
    term = lambda i, j: F.get(w, i + j) * F.lit(FACTORS[j])
    several = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: sum((term(i, j) for j in range(1, WORDS)), term(i, 0)) % F.lit(PRIME))
    few = F.array(sum((F.coalesce(term(F.lit(0), j), F.lit(0)) for j in range(1, WORDS)), term(F.lit(0), 0)) % F.lit(PRIME))
    return F.when(F.size(w) >= WORDS, several).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets, 0 to 1."""
    both = F.transform(F.array(merged(a, b, k)), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))[0]
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact below K."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float((k - 1) * PRIME)) / F.greatest(F.element_at(a, -1), F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first set's shingles that the second has, 0 to 1."""
    common = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / F.greatest(F.lit(1.0), distinct_count(a, k))))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def of_groups(sketches: DataFrame, group: str, column: str, k: int = K) -> DataFrame:
    """(group, column): the sketch of all shingles of a group's rows together, merged in two steps so that a large group spreads."""
    hashes = sketches.select(group, F.explode(column).alias("_h")).distinct()
    lowest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
    some = hashes.withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(64)))
    some = some.withColumn("_n", lowest(group, "_salt")).where(F.col("_n") <= k)
    some = some.withColumn("_n", lowest(group)).where(F.col("_n") <= k)
    return some.groupBy(group).agg(F.sort_array(F.collect_list("_h")).alias(column))


def followed(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 4) -> DataFrame:
    """(key, text, next_key, start, next_sketch): with each text the next document's key, first characters (a `share`-th of the own length) and sketch.

    Documents follow each other by ascending key, the first follows the last. Only keys, digests and lengths are put in order;
    the text of a document is shuffled once, and what its predecessor needs of it once.
    """
    own = docs.select(F.col(key).alias("key"), whole_text(text).alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    # A name for joins, which do not match nulls.
    named = F.concat(F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("-")), F.lit("/"), F.col("digest"))
    own = own.withColumn("name", named)
    ids = own.groupBy("key", "digest", "name").agg(F.count("*").alias("copies"), F.max(F.length("text")).alias("n"))
    placed = stored(numbered(stored(ids.withColumn("all", F.lit("")), "identities"), "all", ("key", "digest")), "placed")
    after = placed.select(F.expr("(idx + size - 1) % size").alias("idx"), F.col("name").alias("next"))
    links = placed.join(after, "idx").select("next", F.col("name").alias("to"), "n", "copies")

    # Both uses read the same columns, so that one exchange serves them.
    texts = own.select("name", "key", "text").dropDuplicates(["name"])
    sent = texts.join(links.hint("merge"), texts["name"] == links["next"]).select(
        "to", "n", "copies", F.col("key").alias("next_key"), F.substring("text", F.lit(1), F.expr(f"cast(n div {share} as int)")).alias("start"), sketch(F.col("text")).alias("next_sketch")
    )
    met = texts.join(sent.hint("merge"), texts["name"] == sent["to"])
    # Of rows that repeat a document, each but the last is followed by its like.
    same = F.col("copy") < F.col("copies")
    told = met.withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    return told.select(
        F.col("key").alias(key), F.col("text").alias(text), F.when(same, F.col("key")).otherwise(F.col("next_key")).alias("next_key"),
        F.when(same, F.substring("text", F.lit(1), F.expr(f"cast(n div {share} as int)"))).otherwise(F.col("start")).alias("start"),
        F.when(same, sketch(F.col("text"))).otherwise(F.col("next_sketch")).alias("next_sketch"),
    )
