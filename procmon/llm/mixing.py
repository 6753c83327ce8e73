"""Mixing sources to target weights by proportionate-fair scheduling.

Every source is cut into blocks of `block_docs` documents. Time runs in slots of one block. A source's weight is a whole number `a` of about
2**31 parts; its k-th block (from 0) has the release time floor(k L / a) and the deadline ceil((k + 1) L / a), with L the sum over the
sources that still have blocks, and in each slot the released block with the earliest deadline runs (of equal ones that of the source that is smaller as text).
Where a source runs out, the others' windows start anew from there with the smaller sum. Up to then and between such slots every source
is less than one block from its target at every slot. No document is dropped or repeated. A source without a weight counts as one part.

The schedule is a fold over the slots, because each turn depends on those before. It goes in steps of STEP slots: a step reads one row, the blocks that
each source has had, and writes its turns and the next such row. So no row grows with the table, and a lost step is done again by itself. Turns are
numbers of blocks; documents never pass through the fold.

A document's place within its source follows from the MD5 of its doc_id. Rows are numbered within
(source, leading digits of the MD5) and lifted by the counts of the smaller digits, so a source that
holds most rows is spread like the others.

Defined cases: a null source is a source of its own; null and repeated doc_ids are ordinary rows (their
order among themselves is open); sources without a given weight, or with one of zero or less, get the
smallest weight, one part; weights of absent sources have no effect; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procmon.llm.common import partitions, shared_folder, stored

#: Documents in a block.
BLOCK_DOCS = 16
#: Weights are whole numbers of so many parts.
PARTS = 1 << 31
#: Slots folded in one step, and slots whose turns are gathered at a time, so that none is copied more often than that.
STEP = 1 << 16
STRETCH = 256
#: Without weights a source counts by its number of documents to this power.
POWER = 0.5


def _weighed(sources: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """`sources` with the weight of each and the sum of all."""
    if weights is None:
        weight = F.pow(F.col("n_docs"), F.lit(POWER))
    else:
        pairs = [F.when(F.col("source") == F.lit(k), F.lit(float(v))) for k, v in weights.items() if v > 0]
        weight = F.coalesce(*pairs, F.lit(0.0))
    return sources.withColumn("weight", weight).withColumn("sum", F.sum("weight").over(Window.partitionBy(F.lit(1))))


def schedule(sources: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """(source, block, slot) of all blocks of `sources` (source, n_docs, n_blocks)."""
    spark = sources.sparkSession
    whole = _weighed(sources, weights)
    part = F.greatest(F.lit(1), F.round(F.try_divide("weight", "sum") * PARTS)).cast("long")
    whole = whole.select("source", "n_blocks", F.coalesce(part, F.lit(1).cast("long")).alias("a"))
    one = whole.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "n_blocks", "a"))).alias("s")).where("size(s) > 0")
    # State: blocks done of each source; and since the last source ran out: the slot, the blocks done then, the sum of the parts.
    state = stored(one.select("s", F.expr("aggregate(s, 0L, (t, x) -> t + x.n_blocks)").alias("slots"), F.expr("""named_struct(
      'done', transform(s, x -> 0L), 'had', transform(s, x -> 0L), 'since', 0L, 'total', aggregate(s, 0L, (y, x) -> y + x.a))""").alias("state")), "schedule")
    chosen = """array_min(transform(s, (x, i) -> if(c.done[i] < x.n_blocks and ((c.done[i] - c.had[i]) * c.total) div x.a <= t - c.since,
      named_struct('deadline', ((c.done[i] - c.had[i] + 1) * c.total + x.a - 1) div x.a, 'i', i),
      named_struct('deadline', 9223372036854775807L, 'i', i)))).i"""
    # One slot: the chosen source is p, its blocks done so far are at most one short of all where it runs out.
    turn = f"""transform(array({chosen}), p -> transform(array(transform(c.done, (d, i) -> if(i = p, d + 1, d))), done ->
      if(done[p] < s[p].n_blocks,
        named_struct('done', done, 'had', c.had, 'since', c.since, 'total', c.total, 'turns', concat(c.turns, array(named_struct('i', p, 'block', c.done[p])))),
        named_struct('done', done, 'had', done, 'since', t + 1,
          'total', aggregate(zip_with(s, done, (x, d) -> if(d < x.n_blocks, x.a, 0L)), 0L, (y, a) -> y + a),
          'turns', concat(c.turns, array(named_struct('i', p, 'block', c.done[p])))))))[0][0]"""
    none = "cast(array() as array<struct<i: int, block: bigint>>)"
    with_turns = f"named_struct('done', o.state.done, 'had', o.state.had, 'since', o.state.since, 'total', o.state.total, 'turns', {none})"
    bare = "named_struct('done', r.done, 'had', r.had, 'since', r.since, 'total', r.total)"
    found = state.select("slots").first()
    folder, slots = shared_folder(spark, "turns"), found["slots"] if found else 0
    for first in range(0, slots, STEP):
        last = min(slots, first + STEP)
        stretch = f"aggregate(sequence(low, least(low + {STRETCH}, {last}L) - 1), {with_turns}, (c, t) -> {turn})"
        step = state.select("s", "slots", F.expr(f"""
          aggregate(sequence({first}L, {last - 1}L, {STRETCH}L), named_struct('state', state, 'all', cast(array() as array<array<struct<i: int, block: bigint>>>)),
            (o, low) -> transform(array({stretch}), r -> named_struct('state', {bare}, 'all', concat(o.all, array(r.turns))))[0])""").alias("step"))
        path = f"{folder}/first={first}"
        step.select("s", "slots", "step.state", F.flatten("step.all").alias("turns")).write.parquet(path)
        state = spark.read.parquet(path).select("s", "slots", "state")
    if not slots:
        return state.select(F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot")).where("false")
    each = spark.read.parquet(folder).select("s", F.col("first").cast("long").alias("first"), F.posexplode("turns").alias("at", "turn"))
    return each.select(F.expr("s[turn.i].source").alias("source"), F.col("turn.block").alias("block"), (F.col("first") + F.col("at")).alias("slot"))


def interleave(
    docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """`docs` with _block (number within the source), _slot (of the schedule) and _place (within the block)."""
    digits = max(2, math.ceil(math.log(4 * partitions(docs.sparkSession), 16)))
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    # A null source needs a key of its own, because joins do not match nulls.
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    rows = docs.withColumn("_md5", digest).withColumn("_source", named).withColumn("_part", F.substring("_md5", 1, digits))
    rows = rows.withColumn("_row", F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_md5")) - 1)

    slim = docs.select(named.alias("source"), F.substring(digest, 1, digits).alias("part"))
    counts = slim.groupBy("source", "part").agg(F.count("*").alias("n"))
    sources = counts.groupBy("source").agg(F.sum("n").alias("n_docs")).withColumn("n_blocks", F.expr(f"(n_docs + {block_docs - 1}) div {block_docs}"))
    told = {f"={k}": v for k, v in weights.items()} if weights is not None else None
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = counts.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
    spans = parts.withColumn("block", F.explode(F.expr(f"sequence(before div {block_docs}, (before + n - 1) div {block_docs})")))
    met = spans.join(schedule(sources, told), ["source", "block"]).groupBy("source", "part", "before")
    parts = met.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias("slots"))
    parts = parts.select(F.col("source").alias("_source"), F.col("part").alias("_part"), F.col("before").alias("_before"), F.col("slots").alias("_slots"))
    at = F.col("_before") + F.col("_row")
    block = F.expr(f"(_before + _row) div {block_docs}")
    return (
        rows.join(parts, ["_source", "_part"])
        .withColumn("_block", block)
        .withColumn("_slot", F.expr(f"_slots[cast(_block - _before div {block_docs} as int)]"))
        .withColumn("_place", (at % block_docs).cast("int"))
        .drop("_source", "_part", "_md5", "_row", "_before", "_slots")
    )


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """`docs`, same columns, in the order of the schedule."""
    return interleave(docs, weights, **options).orderBy("_slot", "_place").drop("_block", "_slot", "_place")
