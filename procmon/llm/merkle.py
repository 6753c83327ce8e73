"""Merkle manifest of a table: a tree of digests for each group, and one over the groups, by butterfly exchange.

The leaf of a row is the digest H of its fields. Leaves of a group stand in a given order; every FANOUT consecutive
nodes become the H of their digests, level by level, until one node is left, the group's subroot. The subroots, in the order of
the groups, form the last tree, whose top is the root. H is SHA-256 in lowercase hexadecimal, of digests as hexadecimal text.

The partitions of the exchange are blocks of FANOUT ** BLOCK_LEVELS consecutive leaves, one row each. A block folds its own
leaves by itself. Then, round by round, FANOUT aligned blocks that differ in one digit of their number swap the roots of the subtrees
they stand for, and each hashes them: after the last round every block holds the top of the tree and has met, on its way, all
siblings of its ancestors. So there is no pass back down. Ancestors are hashed by every block below them, which costs one row a
block and round. Where the last subtree of a level has fewer blocks than the others, its blocks also answer in
place of the missing ones. Nothing but the size of the largest group reaches the driver.

    rows -> leaves, numbered within the group -> blocks -> rounds of the exchange -> subroots -> the same over the groups -> proofs

Defined cases: a null field counts as `-`; a null group comes before all others. Rows with a null key come first in their group; rows of one
key follow the order of their leaves, so equal rows are interchangeable. A leaf that is alone is its group's subroot, a single subroot is the
root, and either adds nothing to a proof. An empty table gives no rows. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmon.llm.common import stored
from procmon.llm.numbering import numbered

FANOUT = 3
#: Levels folded inside a block: a block has 2,187 leaves.
BLOCK_LEVELS = 7


def field(column: Column) -> Column:
    """A value as its byte count, `:` and its text; `-` if it is null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """H of the fields of a row, one after another."""
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def combined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


def folded(proof: Column, digest: Column) -> Column:
    """The root that a leaf leads to by its proof."""
    own = lambda node, at, others: F.concat(
        F.array_join(F.slice(others, F.lit(1), at), ""), node, F.array_join(F.slice(others, at + 1, F.size(others)), "")
    )
    return F.aggregate(proof, digest, lambda node, level: F.sha2(own(node, level["at"], level["siblings"]).cast("binary"), 256))


def _blocks(rows: DataFrame, group: str, digest: str) -> DataFrame:
    """One row per block: group, block, size of the group, `rows` (idx, digest and the rest) in order, `nodes`: the levels of the block."""
    width = FANOUT**BLOCK_LEVELS
    rest = [c for c in rows.columns if c not in (group, "size", "idx")]
    packed = (
        rows.groupBy(group, F.expr(f"idx div {width}").alias("block"))
        .agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("idx", *rest))).alias("rows"))
        .withColumn("level0", F.col(f"rows.{digest}"))
    )
    for level in range(BLOCK_LEVELS):
        runs = F.expr(f"transform(sequence(0, (size(level{level}) - 1) div {FANOUT}), r -> slice(level{level}, {FANOUT} * r + 1, {FANOUT}))")
        above = F.transform(runs, combined)
        packed = packed.withColumn(f"level{level + 1}", F.when(F.col("size") > FANOUT**level, above).otherwise(F.col(f"level{level}")))
    return packed.withColumn("nodes", F.array(*[f"level{k}" for k in range(BLOCK_LEVELS)])).withColumn("top", F.col(f"level{BLOCK_LEVELS}")[0]).drop(
        *[f"level{k}" for k in range(BLOCK_LEVELS + 1)]
    )


def exchange(blocks: DataFrame, group: str, largest: int) -> DataFrame:
    """(group, block, top, proof) from (group, block, size, top): the top of each group's tree, and the siblings on the way.

    `largest` is the number of leaves of the largest group.
    """
    width = FANOUT**BLOCK_LEVELS
    state = blocks.select(
        group, "block", "size", F.expr(f"(size + {width - 1}) div {width}").alias("n"), "top",
        F.expr("cast(array() as array<struct<at: int, siblings: array<string>>>)").alias("proof"),
    )
    span = 1
    while span * width < largest:
        # A subtree of `here` blocks, fewer than the others have, answers for the missing ones too.
        sent = state.withColumn("here", F.expr(f"least({span}, n - (block div {span}) * {span})")).select(
            group, F.expr(f"block div {FANOUT * span}").alias("up"),
            F.explode(F.expr(f"if(n > {span}, sequence(block % {span}, {span - 1}, here), array(block % {span}))")).alias("slot"),
            F.expr(f"cast((block div {span}) % {FANOUT} as int)").alias("at"), "block", "size", "n", "top", "proof",
        )
        member = F.struct("at", "top", "block", (F.col("block") % span == F.col("slot")).alias("real"), "proof")
        met = sent.groupBy(group, "up", "slot").agg(F.first("size").alias("size"), F.first("n").alias("n"), F.sort_array(F.collect_list(member)).alias("met"))
        up = met.withColumn("above", combined(F.col("met.top"))).withColumn("one", F.explode(F.filter("met", lambda m: m["real"])))
        siblings = F.expr("transform(filter(met, m -> m.at <> one.at), m -> m.top)")
        added = F.array(F.struct(F.col("one.at").alias("at"), siblings.alias("siblings")))
        risen = F.col("n") > span
        state = up.select(
            group, F.col("one.block").alias("block"), "size", "n", F.when(risen, F.col("above")).otherwise(F.col("one.top")).alias("top"),
            F.when(risen, F.concat("one.proof", added)).otherwise(F.col("one.proof")).alias("proof"),
        )
        span *= FANOUT
    return state.select(group, "block", "top", "proof")


def grown(rows: DataFrame, group: str, order: tuple[str, ...], digest: str) -> tuple[DataFrame, DataFrame]:
    """The trees of all groups, as (blocks with their leaves, top and proof of each block); `rows` is a stored table without null groups."""
    packed = stored(_blocks(numbered(rows, group, order), group, digest), "blocks")
    largest = packed.agg(F.max("size")).first()[0] or 0
    return packed, stored(exchange(packed.select(group, "block", "size", "top"), group, largest), "tops")


def proofs(packed: DataFrame, tops: DataFrame, group: str) -> DataFrame:
    """(group, row, top, proof, and what else `tops` has) for every leaf: first the siblings inside the block, then those of the block."""
    each = packed.drop("top").join(tops.withColumnRenamed("proof", "upper"), [group, "block"])
    each = each.withColumn("row", F.explode("rows")).drop("rows")
    # A level adds to the proof where its group has more than one node on it.
    at = f"cast(row.idx % {FANOUT**BLOCK_LEVELS} as int) div step"
    lower = F.expr(f"""
      transform(filter(arrays_zip(nodes, steps), l -> size > l.steps), l -> transform(array(l.steps), step -> named_struct(
        'at', cast(({at}) % {FANOUT} as int),
        'siblings', filter(slice(l.nodes, cast(({at}) div {FANOUT} * {FANOUT} + 1 as int), {FANOUT}), (x, i) -> i <> ({at}) % {FANOUT})))[0])""")
    each = each.withColumn("steps", F.array(*[F.lit(FANOUT**k) for k in range(BLOCK_LEVELS)])).withColumn("proof", F.concat(lower, "upper"))
    return each.drop("nodes", "steps", "upper", "block", "size")


def manifest(docs: DataFrame, key: str, group: str, digest: Column, carry: dict[str, Column] | None = None) -> DataFrame:
    """(key, group, leaf, the carried columns, subroot, root, proof) for every row; `proof` leads from the leaf to the root."""
    # Joins do not match nulls, so a group has a name; the name of null comes first.
    named = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    carried = [c.alias(f"_{name}") for name, c in (carry or {}).items()]
    rows = stored(docs.select(named.alias("_group"), F.col(key).alias("_key"), F.col(group).alias("_of"), digest.alias("_leaf"), *carried), "leaves")
    packed, tops = grown(rows, "_group", ("_key", "_leaf"), "_leaf")
    subroots = stored(tops.where("block = 0").select(F.lit("").alias("_all"), "_group", F.col("top").alias("_leaf")), "subroots")
    last = proofs(*grown(subroots, "_all", ("_group",), "_leaf"), "_all")
    last = last.select(F.col("row._group").alias("_group"), F.col("top").alias("root"), F.col("proof").alias("_last"))
    whole = tops.join(last, "_group").withColumn("proof", F.concat("proof", "_last")).drop("_last")
    return proofs(packed, whole, "_group").select(
        F.col("row._key").alias(key), F.col("row._of").alias(group), F.col("row._leaf").alias("leaf"),
        *[F.col(f"row._{name}").alias(name) for name in carry or {}], F.col("top").alias("subroot"), "root", "proof",
    )
