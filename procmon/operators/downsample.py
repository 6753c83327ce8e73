"""Choosing the rows of a long series that a chart should show.

Every function keeps at most `limit` rows per series, chosen over all of them. Positions
are running numbers from shard summaries; what is ranked along a whole series has been
cut to about `limit` rows before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procmon.config import MINUTE
from procmon.functions.columns import STATUSES, col, is_finite, micros, present
from procmon.operators.shards import (
    SHARD,
    annotate,
    default_width,
    number_rows,
    shard_rows,
    shard_window,
    with_previous,
)
from procmon.session import ensure_checkpoint_dir

CHART_POINTS = 1200

SCORE_STATUSES = ("status", "t2_status", "spe_status")


def _with_totals(rows: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Attach per-series aggregates; one row per series."""
    found = rows.groupBy(*[col(k) for k in keys]).agg(*[v.alias(n) for n, v in totals.items()])
    if not keys:
        return rows.crossJoin(F.broadcast(found))  # a single row
    return rows.join(found, list(keys))


def _keep(rows: DataFrame) -> DataFrame:
    """Write the rows once: neighbours and totals read them twice, and the choices below the marked ones several times."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def _spread(rows: DataFrame, keys, width: int, room: str, rounded: bool) -> DataFrame:
    """Evenly spaced rows, `room` (a per-series column) of them at most.

    `rounded` places them like a rounded-down linear grid that includes both ends,
    otherwise by whole-number steps from the first row.
    """
    placed = number_rows(rows, keys, "_us", width, "_rank", total="_m")
    room_col, m, rank = F.col(room), F.col("_m"), F.col("_rank")
    if rounded:
        step = (m - 1) / F.greatest(room_col - 1, F.lit(1))
        near = F.ceil(rank / step)
        hit = (
            (F.floor((near - 1) * step) == rank)
            | (F.floor(near * step) == rank)
            | (F.floor((near + 1) * step) == rank)
            | ((rank == m - 1) & (room_col > 1))
        )
        hit = F.when(room_col <= 1, rank == 0).otherwise(hit)
        keep = F.when(room_col <= 0, F.lit(False)).when(m <= room_col, F.lit(True)).otherwise(hit)
    else:
        keep = _by_steps(rank, m, room_col)
    return placed.where(keep).drop("_rank", "_m")


def _by_steps(rank: Column, m: Column, room: Column) -> Column:
    """Whether the row of this rank among `m` is one of `room` rows at whole-number steps from the first."""
    # Some i has floor(i * m / room) = rank.
    hit = F.floor(F.ceil(rank * room / m) * m / room) == rank
    return F.when(room <= 0, F.lit(False)).when(m <= room, F.lit(True)).otherwise(hit)


def downsample_trend(
    rows: DataFrame,
    values: Sequence[str],
    *,
    ts: str = "ts",
    keys: Sequence[str] = (),
    required: Sequence[str] | None = None,
    gap: str = "gap_start",
    limit: int = CHART_POINTS,
    width: int | None = None,
) -> DataFrame:
    """Ends, gap sides and rows with missing values, then each bucket's extremes.

    `values` are the plotted columns; a row is critical when one of `required` (all of
    them by default) is missing.
    """
    if limit < 2:
        raise ValueError("a chart needs at least two points")
    width = width or default_width(5 * MINUTE)
    required = list(values if required is None else required)
    columns = rows.columns
    key_cols = [col(k) for k in keys]
    missing = reduce(lambda a, b: a | b, [col(r).isNull() for r in required], F.lit(False))
    marked = annotate(
        rows.withColumn("_us", micros(col(ts))), keys, "_us", width,
        following={"_gap_next": col(gap)}, position="_pos", total="_n",
    )
    critical = (
        (col(gap) & (F.col("_pos") > 0))
        | F.coalesce(F.col("_gap_next"), F.lit(False))
        | missing
        | (F.col("_pos") == 0)
        | (F.col("_pos") == F.col("_n") - 1)
    )
    marked = _keep(marked.withColumn("_critical", critical))
    marked = _with_totals(marked, keys, _kept=F.count_if("_critical"))

    whole = F.col("_n") <= limit
    crowded = ~whole & (F.col("_kept") >= limit)
    ends = (F.col("_pos") == 0) | (F.col("_pos") == F.col("_n") - 1)
    picked = marked.where(whole | (crowded & ends) | (~whole & ~crowded & F.col("_critical")))
    thinned = _spread(
        marked.where(crowded & F.col("_critical") & ~ends).withColumn("_room", F.lit(limit - 2)),
        keys, width, "_room", rounded=True,
    )

    series = max(1, len(values))
    free = marked.where(~whole & ~crowded).withColumn("_room", F.lit(limit) - F.col("_kept"))
    buckets = F.greatest(F.lit(1), F.floor(F.col("_room") / (2 * series)))
    size = F.floor(F.col("_n") / F.col("_buckets"))
    longer = F.col("_n") - size * F.col("_buckets")
    edge = longer * (size + 1)
    place = F.when(F.col("_pos") < edge, F.floor(F.col("_pos") / (size + 1))).otherwise(
        longer + F.floor((F.col("_pos") - edge) / size)
    )
    free = free.withColumn("_buckets", buckets).withColumn("_bucket", place)
    extremes = []
    for v in values:
        x = F.when(is_finite(col(v)), col(v))
        spot = F.when(x.isNotNull(), F.col("_pos"))
        extremes.append(F.min_by(spot, F.when(x.isNotNull(), F.struct(x, F.col("_pos")))))
        extremes.append(F.min_by(spot, F.when(x.isNotNull(), F.struct(-x, F.col("_pos")))))
    spots = (
        free.groupBy(*key_cols, "_bucket")
        .agg(F.array(*extremes).alias("_spots"))
        .select(*key_cols, F.explode(F.array_compact("_spots")).alias("_pos"))
        .distinct()
    )
    chosen = free.where(~F.col("_critical")).join(spots, [*keys, "_pos"], "left_semi")
    chosen = _spread(chosen, keys, width, "_room", rounded=True)
    result = [frame.select(*[col(c) for c in columns]) for frame in (picked, thinned, chosen)]
    return result[0].unionByName(result[1]).unionByName(result[2])


def downsample_scores(
    scores: DataFrame,
    *,
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    limit: int = CHART_POINTS,
    width: int | None = None,
) -> DataFrame:
    """Ends, exceedances, maxima and status switches, else the worst of each time bucket.

    The rows are written once, with what a shard knows of them. All else comes from one row per shard, or per shard
    and bucket, and meets the rows again on keys and shard, so a series is never in one task as a whole.
    """
    if limit < 2:
        raise ValueError("a chart needs at least two points")
    width = width or default_width(5 * MINUTE)
    columns = scores.columns
    key_cols = [col(k) for k in keys]
    rows = _keep(_score_rows(scores, ts, keys, width))
    shards = _keep(_score_shards(rows, keys))
    marked = rows.join(shards, [*keys, SHARD]).withColumn("_pos", F.col("_before") + F.col("_rn") - 1)
    ends = (F.col("_pos") == 0) | (F.col("_pos") == F.col("_n") - 1)
    critical = (
        ends
        | (F.col("_sev") > 0)
        | (F.col("_pos") == F.col("_top_t2"))
        | (F.col("_pos") == F.col("_top_spe"))
        | F.col("_side")
        | ((F.col("_rn") == 1) & F.col("_side_first"))
        | ((F.col("_rn") == F.col("_count")) & F.col("_side_last"))
    )
    marked = marked.withColumn("_critical", critical)
    long_ones = marked.where(F.col("_n") > limit)
    low = lambda value: -F.coalesce(value, F.lit(float("-inf")))
    worst_ratio = F.greatest(F.col("t2_limit_ratio"), F.col("spe_limit_ratio"))
    every = Window.partitionBy(*key_cols)
    here = lambda best: F.when(best.getField(SHARD) == F.col(SHARD), best.getField("_pos"))
    at_ends = F.when(ends, F.col("_pos"))
    if limit < 5:
        kept = long_ones.groupBy(*key_cols, SHARD).agg(F.count_if("_critical").alias("_picked"))
        kept = kept.withColumn("_kept", F.sum("_picked").over(every))
        order = every.orderBy(ends.desc(), F.col("_sev").desc(), worst_ratio.desc(), F.col("_pos"))
        top = long_ones.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)
        top = top.groupBy(*key_cols, SHARD).agg(F.collect_set("_pos").alias("_spots"))
        picks = kept.join(top, [*keys, SHARD], "left")
    else:
        count = max(1, (limit - 2) // 3)
        share = (F.col("_us") - F.col("_t0")) * 1000.0 / ((F.col("_t1") - F.col("_t0")) * 1000.0 + 1.0)
        bucket = F.least(F.floor(share * count), F.lit(count - 1))
        orders = {
            "_worst": (-F.col("_sev"), low(worst_ratio)),
            "_most_t2": (low(F.col("t2_limit_ratio")),),
            "_most_spe": (low(F.col("spe_limit_ratio")),),
        }
        first_of = lambda order: F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.col("_pos"), col(SHARD)))
        parts = long_ones.groupBy(*key_cols, SHARD, bucket.alias("_bucket")).agg(
            F.count_if("_critical").alias("_picked"),
            F.min(at_ends).alias("_end_0"),
            F.max(at_ends).alias("_end_1"),
            *[first_of(order).alias(name) for name, order in orders.items()],
        )
        same = Window.partitionBy(*key_cols, "_bucket")
        parts = parts.select(
            *key_cols, SHARD, "_picked", "_end_0", "_end_1",
            F.sum("_picked").over(every).alias("_kept"),
            *[F.min(name).over(same).alias(name) for name in orders],
        )
        found = F.array("_end_0", "_end_1", *[here(F.col(name)) for name in orders])
        picks = parts.groupBy(*key_cols, SHARD).agg(
            F.sum("_picked").alias("_picked"),
            F.max("_kept").alias("_kept"),
            F.array_distinct(F.array_compact(F.flatten(F.collect_list(found)))).alias("_spots"),
        )
    # Of a crowded series only the spots are taken, of others all critical rows.
    crowded = F.col("_kept") > limit
    spots = F.coalesce(F.col("_spots"), F.array().cast("array<bigint>"))
    taken = F.when(crowded, F.size(spots).cast("bigint")).otherwise(F.col("_picked"))
    picks = picks.select(*key_cols, SHARD, taken.alias("_taken"), F.when(crowded, spots).alias("_spots"))
    earlier = every.orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    picks = picks.select(
        *key_cols, SHARD, "_spots",
        F.coalesce(F.sum("_taken").over(earlier), F.lit(0)).alias("_taken_before"),
        F.sum("_taken").over(every).alias("_all_taken"),
    )
    # Every shard of a longer series has its picks; a series without them is shown whole.
    marked = marked.join(picks, [*keys, SHARD], "left")
    spot = F.array_contains("_spots", F.col("_pos"))
    picked = F.when(F.col("_n") <= limit, True).otherwise(F.coalesce(spot, F.col("_critical")))
    marked = marked.withColumn("_picked", picked)
    upto = shard_window(keys, "_us").rowsBetween(Window.unboundedPreceding, 0)
    taken = F.col("_taken_before") + F.sum(F.col("_picked").cast("bigint")).over(upto)
    marked = marked.withColumn("_rank", F.col("_pos") - taken)
    room, m = F.lit(limit) - F.col("_all_taken"), F.col("_n") - F.col("_all_taken")
    chosen = marked.where(F.col("_picked") | _by_steps(F.col("_rank"), m, room))
    return chosen.select(*[col(c) for c in columns])


def _score_rows(scores: DataFrame, ts: str, keys: Sequence[str], width: int) -> DataFrame:
    """Rows with their shard, their number in it, their severity, and whether a status switches beside them inside the shard."""
    rows = scores.withColumn("_us", micros(col(ts)))
    rows = rows.select(*[present(rows, c).alias(c) if c in (*keys, "_us") else col(c) for c in rows.columns])
    order = shard_window(keys, "_us")
    rank = F.lit(-1)
    for code, name in enumerate(STATUSES):
        rank = F.when(F.col("status") == name, code).otherwise(rank)
    sides = {f"_{name}_{s}": move(col(s)).over(order) for name, move in (("was", F.lag), ("then", F.lead)) for s in SCORE_STATUSES}
    local = shard_rows(rows, "_us", width).select(
        *[col(c) for c in rows.columns], SHARD, F.row_number().over(order).alias("_rn"), *[v.alias(n) for n, v in sides.items()]
    )
    switched = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col(f"_{name}_{s}") != col(s), F.lit(False)) for name in ("was", "then") for s in SCORE_STATUSES],
    )
    return local.withColumn("_sev", rank).withColumn("_side", switched).drop(*sides)


def _score_shards(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per shard: rows in it and before it, switches at its ends, and facts of the whole series."""
    key_cols = [col(k) for k in keys]
    pack = F.struct(*SCORE_STATUSES)
    best = lambda name: F.min(F.struct((-F.coalesce(F.col(name), F.lit(float("-inf")))).alias("_v"), "_rn"))
    shards = rows.groupBy(*key_cols, SHARD).agg(
        F.count(F.lit(1)).alias("_count"),
        F.min("_us").alias("_t0"),
        F.max("_us").alias("_t1"),
        F.min_by(pack, "_rn").alias("_head"),
        F.max_by(pack, "_rn").alias("_tail"),
        best("t2").alias("_best_t2"),
        best("spe").alias("_best_spe"),
    )
    every = Window.partitionBy(*key_cols)
    along = every.orderBy(SHARD)
    shards = shards.select(
        "*",
        F.coalesce(F.sum("_count").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.lag("_tail").over(along).alias("_was"),
        F.lead("_head").over(along).alias("_then"),
    )
    differ = lambda a, b: reduce(lambda x, y: x | y, [F.coalesce(F.col(a)[s] != F.col(b)[s], F.lit(False)) for s in SCORE_STATUSES])
    top = lambda best: F.min(F.struct(F.col(best)["_v"], (F.col("_before") + F.col(best)["_rn"] - 1).alias("_pos"))).over(every)["_pos"]
    return shards.select(
        *key_cols, SHARD, "_count", "_before",
        differ("_was", "_head").alias("_side_first"),
        differ("_then", "_tail").alias("_side_last"),
        F.sum("_count").over(every).alias("_n"),
        F.min("_t0").over(every).alias("_t0"),
        F.max("_t1").over(every).alias("_t1"),
        top("_best_t2").alias("_top_t2"),
        top("_best_spe").alias("_top_spe"),
    )


def mark_breaks(
    points: DataFrame,
    interval_us: int,
    *,
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    segment: str | None = None,
    name: str = "break_before",
    width: int | None = None,
) -> DataFrame:
    """Whether a gap or a segment change lies before a row; never for a series' first row."""
    values = {"_was_us": F.col("_us")}
    if segment:
        values["_was_seg"] = col(segment)
    shaped = with_previous(
        points.withColumn("_us", micros(col(ts))), keys, "_us", width or default_width(interval_us), values
    )
    broken = F.col("_us") - F.col("_was_us") != interval_us
    if segment:
        broken = broken | (F.col("_was_seg") != col(segment))
    return shaped.withColumn(name, F.coalesce(broken, F.lit(False))).drop("_us", *values)


def downsample_states(
    points: DataFrame,
    interval_us: int,
    *,
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    segment: str | None = None,
    limit: int = CHART_POINTS,
    width: int | None = None,
) -> DataFrame:
    """By priority: ends, break sides, cluster switches, PC1/PC2 extremes, even spread."""
    if limit < 2:
        raise ValueError("a chart needs at least two points")
    width = width or default_width(interval_us)
    columns = points.columns
    key_cols = [col(k) for k in keys]
    near = {"_us_": F.col("_us"), "_cluster_": F.col("cluster_id")}
    if segment:
        near["_segment_"] = col(segment)
    numbered = annotate(
        _keep(points.withColumn("_us", micros(col(ts)))), keys, "_us", width,
        previous=near, position="_pos", total="_n",
    )
    broken = F.col("_us") - F.col("_us_") != interval_us
    if segment:
        broken = broken | (F.col("_segment_") != col(segment))
    numbered = _keep(numbered.withColumn("_brk", F.coalesce(broken, F.lit(False))))
    pairs = lambda flag, level: numbered.where(flag).select(
        *key_cols,
        F.lit(level).alias("_level"),
        F.col("_pos").alias("_order"),
        F.explode(F.array(F.col("_pos") - 1, F.col("_pos"))).alias("_pos"),
    )
    ends = numbered.where((F.col("_pos") == 0) | (F.col("_pos") == F.col("_n") - 1)).select(
        *key_cols, F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_order"), "_pos"
    )
    peaks = numbered.groupBy(*key_cols).agg(
        *[
            F.min_by("_pos", F.struct(sign * F.col(pc), F.col("_pos"))).alias(f"{pc}{mark}")
            for pc in ("pc1", "pc2")
            for sign, mark in ((1, "lo"), (-1, "hi"))
        ]
    )
    extremes = peaks.select(
        *key_cols,
        F.lit(3).alias("_level"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).cast("long").alias("_order"), F.col(f"{pc}{m}").alias("_pos"))
                    for i, pc in enumerate(("pc1", "pc2"))
                    for m in ("lo", "hi")
                ]
            )
        ),
    )
    wanted = (
        ends.unionByName(pairs(F.col("_brk"), 1))
        .unionByName(pairs(F.coalesce(F.col("_cluster_") != F.col("cluster_id"), F.lit(False)), 2))
        .unionByName(extremes)
        .groupBy(*key_cols, "_pos")
        .agg(F.min(F.struct("_level", "_order")).alias("_p"))
    )
    order = Window.partitionBy(*key_cols).orderBy("_p", "_pos")
    wanted = wanted.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= limit)
    marked = numbered.join(
        wanted.select(*key_cols, "_pos", F.lit(True).alias("_pick")), [*keys, "_pos"], "left"
    )
    picked = F.col("_n").isNotNull() & ((F.col("_n") <= limit) | F.coalesce(F.col("_pick"), F.lit(False)))
    marked = _with_totals(marked.withColumn("_picked", picked), keys, _taken=F.count_if("_picked"))
    rest = marked.where(~F.col("_picked")).withColumn("_room", F.lit(limit) - F.col("_taken"))
    filled = _spread(rest, keys, width, "_room", rounded=False)
    pick = lambda frame: frame.select(*[col(c) for c in columns])
    return pick(marked.where("_picked")).unionByName(pick(filled))
