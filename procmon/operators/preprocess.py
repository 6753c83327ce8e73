"""Causal preprocessing of sensor readings up to the lagged feature matrix.

Everything from the raw rows to the features runs behind one exchange on
(keys, shard). Each row ends in exactly one `row_class`, so losses are disjoint and
complete by construction.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import ceil, exp, floor, log1p

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.config import MINUTE, PreprocessingConfig
from procmon.functions.columns import (
    DAY_US,
    all_finite,
    bucket_label,
    col,
    feature_name,
    from_micros,
    is_finite,
    micros,
    near_integer,
    outside,
    present,
    require_columns,
    to_number,
    within,
)
from procmon.operators.shards import OWN, SHARD, scan, shard_rows, shard_window
from procmon.session import ensure_checkpoint_dir

SEMANTICS = ("schema5", "legacy")

# The classes a row can end in, in the order they are decided.
ROW_CLASSES = (
    "partial_bin",
    "empty_bin",
    "input_invalid",
    "engineering_range",
    "state_filtered",
    "filter_warmup",
    "filter_context",
    "lag_warmup",
    "lag_context",
    "valid",
)


@dataclass(frozen=True)
class Layout:
    """Short internal names: x0.. values, y0.. filtered values, e0.. range violations."""

    keys: tuple[str, ...]
    tags: tuple[str, ...]
    names: tuple[str, ...]
    extra: tuple[str, ...] = field(default=())

    @property
    def xs(self) -> list[str]:
        return [f"x{i}" for i in range(len(self.names))]

    @property
    def ys(self) -> list[str]:
        return [f"y{i}" for i in range(len(self.names))]

    def x(self, name: str) -> Column:
        return F.col(f"x{self.names.index(name)}")

    def y(self, name: str) -> Column:
        return F.col(f"y{self.names.index(name)}")

    @property
    def tag_xs(self) -> list[Column]:
        return [self.x(t) for t in self.tags]

    @property
    def tag_ys(self) -> list[Column]:
        return [self.y(t) for t in self.tags]


def feature_names(tags: Sequence[str], config: PreprocessingConfig) -> list[str]:
    return [feature_name(tag, lag) for lag in config.lags for tag in tags]


def preprocess(
    readings: DataFrame,
    tags: Sequence[str],
    config: PreprocessingConfig,
    *,
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    engineering_ranges: Mapping[str, tuple[float, float]] | None = None,
    exclude_engineering_range: bool = False,
    preserve: Sequence[str] = (),
    bounds: tuple[str, str] | None = None,
    semantics: str = "schema5",
    source_interval_minutes: float | None = None,
    shard_minutes: int | None = None,
    segment_ids: bool = False,
    intermediates: bool = False,
    times: DataFrame | None = None,
    valid_only: bool = False,
) -> DataFrame:
    """Classify every row and attach its lagged features.

    `keys` separate independent series (add a window id to isolate windows). `bounds`
    names two columns holding the window a row belongs to; resampling buckets that reach
    outside it are classed `partial_bin`. With resampling, the raw step must be known:
    `source_interval_minutes`, which `segments.modal_interval` measures.

    The step from one shard into the next is checked on keys and times read apart. Where `readings` come out of a
    grouping, `times` names rows with the same keys and times before it, repeated ones included.

    With `valid_only` the result is the valid rows; the others leave as soon as what they mean for these is known.

    Result: keys, `ts`, `row_class`, `bucket_rows`, `bucket_first`, `bucket_last` (raw
    rows behind the row and their times), `raw_segment_start`, `segment_start`,
    tag values on the target grid, one column per feature; with `intermediates` also
    `{tag}__filtered`; with `segment_ids` also `raw_segment_id` and `final_segment_id`.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {', '.join(SEMANTICS)}")
    if semantics == "legacy" and config.filter_method == "first_order":
        raise ValueError("first_order filtering does not exist under legacy semantics")
    if config.resamples and source_interval_minutes is None:
        raise ValueError("resampling needs source_interval_minutes")
    if config.resamples and config.sample_interval_minutes < source_interval_minutes:
        raise ValueError("the target interval must not be shorter than the source interval")
    states = [f.column for f in config.state_filters]
    names = tuple(dict.fromkeys([*tags, *states, *preserve]))
    require_columns(readings, [*keys, ts, *names, *(bounds or ())])
    lay = Layout(tuple(keys), tuple(tags), names)
    ranges = {t: r for t, r in (engineering_ranges or {}).items() if t in tags}

    raw_gap_us = raw_threshold_us(config, source_interval_minutes)
    width = config.shard_us(raw_gap_us, shard_minutes, source_interval_minutes)
    margin = config.margin_us(raw_gap_us)

    numeric = readings.select(
        *[present(readings, k).alias(k) for k in keys],
        _us(readings, ts).alias("us"),
        *[to_number(readings, n).alias(x) for n, x in zip(names, lay.xs)],
        *([micros(col(bounds[0])).alias("lo"), micros(col(bounds[1])).alias("hi")] if bounds else []),
    )
    flags = [
        outside(lay.x(t), *ranges[t]).alias(f"e{i}") for i, t in enumerate(tags) if t in ranges
    ]
    numeric = numeric.select("*", *flags)
    label = bucket_label(F.col("us"), config.interval_us) if config.resamples else F.col("us")
    sharded = shard_rows(numeric.withColumn("label", label), "label", width, margin)

    if times is not None:
        require_columns(times, [*keys, ts])
        seen = times.select(*[present(times, k).alias(k) for k in keys], _us(times, ts).alias("us"))
        seen = seen.withColumn("label", label)
    else:
        seen = numeric.select(*keys, "us", label.alias("label"))
    times = shard_rows(seen, "label", width)
    # Rows of one bucket are less than an interval apart: where that is no gap, a bucket has no part in two segments.
    whole = config.resamples and config.interval_us <= raw_gap_us
    rows = _raw_segments(sharded, times, lay, config, raw_gap_us, source_interval_minutes)
    if not whole:
        rows = _number_raw(rows, lay)
    if config.resamples:
        rows = _resample(rows, lay, config, list(ranges), bounds, whole)
    else:
        rows = rows.select(
            "*",
            F.lit(1).cast("long").alias("n"),
            F.lit(False).alias("partial"),
            F.col("us").alias("first_us"),
            F.col("us").alias("last_us"),
        )

    if semantics == "schema5":
        rows = _classify_inputs(rows, lay, config, list(ranges), exclude_engineering_range)
        early = valid_only and not segment_ids  # segments are numbered over all rows
        rows = _segments_of_kept(rows, lay, config, exclude_engineering_range and bool(ranges), whole, early)
        rows = _filter_rows(rows, lay, config, "rin", "kept", width)
        rows = _lag_rows(rows, lay, config)
    else:
        rows = _legacy(_number_raw(rows, lay) if whole else rows, lay, config)

    result = rows.where(F.col(OWN))
    if segment_ids:
        features = [f"f{i}" for i in range(len(tags) * len(config.lags))]
        flags = [f"e{i}" for i in range(len(tags))]
        needed = {
            *keys, SHARD, "us", "cls", "n", "first_us", "last_us", "gap", "starts", "kept", *lay.xs, *flags, *features,
            *(lay.ys if intermediates else ()),
        }
        result = _number_segments(result, lay, needed)
    result = _project(result, lay, config, intermediates, segment_ids)
    return result.where(F.col("row_class") == "valid") if valid_only else result


def dynamic_matrix(preprocessed: DataFrame, tags: Sequence[str], config: PreprocessingConfig,
                   keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """The valid rows of a preprocessed frame: keys, ts and the features."""
    return preprocessed.where(F.col("row_class") == "valid").select(
        *[col(k) for k in keys], "ts", *[col(f) for f in feature_names(tags, config)]
    )


def build_dynamic_matrix(
    readings: DataFrame,
    tags: Sequence[str],
    config: PreprocessingConfig,
    *,
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    shard_minutes: int | None = None,
) -> DataFrame:
    """Filter and lag clean, regularly sampled input; a non-finite value is an error."""
    checked = readings
    for tag in tags:
        value = to_number(readings, tag)
        checked = checked.withColumn(
            tag, F.when(is_finite(value), value).otherwise(_fail("model inputs must be finite"))
        )
    plain = PreprocessingConfig(
        **{**config.__dict__, "resampling_method": "none", "state_filters": ()}
    )
    rows = preprocess(checked, tags, plain, ts=ts, keys=keys, shard_minutes=shard_minutes)
    return dynamic_matrix(rows, tags, plain, keys)


def _us(df: DataFrame, ts: str) -> Column:
    """Microseconds of a time that must be there; a date is its midnight and needs no calendar."""
    if isinstance(df.schema[ts].dataType, T.DateType):
        return F.unix_date(present(df, ts)).cast("long") * DAY_US
    return micros(present(df, ts))


def raw_threshold_us(config: PreprocessingConfig, source_interval_minutes: float | None) -> int:
    """Longest raw step that does not start a new physical segment."""
    if not config.resamples:
        return config.gap_us
    if config.gap_threshold_minutes is not None:
        return int(config.gap_threshold_minutes * MINUTE)
    return int((source_interval_minutes or config.sample_interval_minutes) * MINUTE)


def _fail(message: str, kind: str = "double") -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def _raw_segments(rows, times, lay, config, raw_gap_us, source_interval_minutes) -> DataFrame:
    """Mark rows that follow a physical gap."""
    window = shard_window(lay.keys, "us")
    step_us = (
        int((source_interval_minutes or config.sample_interval_minutes) * MINUTE)
        if config.resamples
        else config.interval_us
    )
    # In a condition, not in a column: a result that leaves columns out is checked as well.
    refused = lambda since: F.when(
        (since < step_us) | ~near_integer(since / F.lit(float(step_us))),
        _fail("timestamps must follow the sampling grid", "boolean"),
    ).otherwise(True)
    rows = rows.withColumn("step", F.col("us") - F.lag("us").over(window))
    rows = rows.where(refused(F.col("step")))
    rows = rows.where(_boundary_steps(times, lay, refused).scalar())
    return rows.withColumn("gap", F.col("step").isNull() | (F.col("step") > raw_gap_us)).drop("step")


def _raw_number(lay) -> Column:
    """The number of a physical segment inside the shard, from 1."""
    upto = shard_window(lay.keys, "us").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.col("gap").cast("int")).over(upto)


def _number_raw(rows, lay) -> DataFrame:
    return rows.withColumn("seg", _raw_number(lay))


def _boundary_steps(times, lay, refused) -> DataFrame:
    """One row: true if every step from one shard of a series into the next one in use is on the grid.

    Such a step may be longer than any halo. Only keys and times are read for it, reduced to two
    times a shard before they travel; the rows themselves are neither joined nor read again.
    """
    keys = [col(k) for k in lay.keys]
    ends = times.groupBy(*keys, SHARD).agg(F.min("us").alias("first"), F.max("us").alias("last"))
    along = Window.partitionBy(*keys).orderBy(SHARD)
    since = F.col("first") - F.lag("last").over(along)
    return ends.select(refused(since).alias("fine")).agg(F.coalesce(F.bool_and("fine"), F.lit(True)))


def _resample(rows, lay, config, ranged, bounds, whole) -> DataFrame:
    """Right-closed, right-labelled buckets per segment, empty ones included.

    The group-by reuses the (keys, shard) partitioning. Empty buckets are produced by the
    bucket that follows them and so belong to that bucket's shard. Where buckets are `whole`, in one
    segment by their length, a bucket follows a gap if one of its rows does; otherwise raw rows bring the numbers
    of their segments.
    """
    method = config.resampling_method
    reduced = {
        "mean": lambda x: F.avg(x),
        "median": lambda x: F.percentile(x, F.lit(0.5)),
        "last": lambda x: F.max_by(x, F.col("us")),
        "none": None,
    }[method]
    flags = [f"e{i}" for i, t in enumerate(lay.tags) if t in ranged]
    carried = ["lo", "hi"] if bounds else []
    buckets = rows.groupBy(*[col(k) for k in lay.keys], SHARD, "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        *([F.max("gap").alias("gap")] if whole else [F.min("seg").alias("seg"), F.max("seg").alias("seg_last")]),
        *[reduced(F.col(x)).alias(x) for x in lay.xs],
        *[F.max(e).alias(e) for e in flags],
        *[F.first(c).alias(c) for c in carried],
        F.max(OWN).alias(OWN),
    )
    window = shard_window(lay.keys, "label")
    width = F.lit(config.interval_us)
    if not whole:
        mixed = _fail("two segments share one resampling bucket", "bigint")
        buckets = buckets.withColumn("seg", F.when(F.col("seg") != F.col("seg_last"), mixed).otherwise(F.col("seg")))
        buckets = buckets.withColumn("gap", F.coalesce(F.lag("seg").over(window) != F.col("seg"), F.lit(True)))
    before = F.lag("label").over(window)
    joined = ~F.col("gap") & (before < F.col("label") - width)
    buckets = buckets.withColumn("first_label", F.when(joined, before + width).otherwise(F.col("label")))
    buckets = buckets.withColumn("us", F.explode(F.sequence("first_label", "label", width)))
    real = F.col("us") == F.col("label")
    filled = buckets.select(
        *[col(k) for k in lay.keys],
        SHARD,
        OWN,
        "us",
        *([] if whole else ["seg"]),
        (real & F.col("gap")).alias("gap"),
        F.when(real, F.col("n")).otherwise(F.lit(0)).alias("n"),
        F.when(real, F.col("first_us")).alias("first_us"),
        F.when(real, F.col("last_us")).alias("last_us"),
        *[F.when(real, F.col(x)).alias(x) for x in lay.xs],
        *[(real & F.col(e)).alias(e) for e in flags],
        *carried,
    )
    partial = (
        (F.col("us") - width < F.col("lo")) | (F.col("us") > F.col("hi")) if bounds else F.lit(False)
    )
    return filled.withColumn("partial", partial)


def _state_ok(config, value_of) -> Column:
    return reduce(
        lambda a, b: a & b,
        [within(value_of(f.column), f.minimum, f.maximum) for f in config.state_filters],
        F.lit(True),
    )


def apply_state_filters(readings: DataFrame, config: PreprocessingConfig, *, allow_empty: bool = False) -> DataFrame:
    """The rows that satisfy every state filter; a NULL satisfies none.

    Filters that leave nothing of readings that were there are an error unless `allow_empty`. It is raised when the
    result is computed, and is found out by one reading of the filtered columns alone.
    """
    require_columns(readings, [f.column for f in config.state_filters])
    if not config.state_filters:
        return readings
    fine = _state_ok(config, lambda name: to_number(readings, name))
    kept = readings.where(fine)
    if allow_empty:
        return kept
    nothing = (F.count(F.lit(1)) > 0) & (F.count_if(fine) == 0)
    checked = readings.agg(F.when(nothing, _fail("state filters removed all rows", "boolean")).otherwise(True))
    return kept.where(checked.scalar())


def _classify_inputs(rows, lay, config, ranged, exclude) -> DataFrame:
    """Everything that can be said about a row without looking at its neighbours."""
    needed = dict.fromkeys([*lay.tags, *[f.column for f in config.state_filters]])
    violated = [F.col(f"e{i}") for i, t in enumerate(lay.tags) if t in ranged]
    excluded = reduce(lambda a, b: a | b, violated, F.lit(False)) if exclude else F.lit(False)
    rows = rows.withColumn(
        "cls",
        F.when(F.col("partial"), "partial_bin")
        .when(F.col("n") == 0, "empty_bin")
        .when(~all_finite([lay.x(n) for n in needed]), "input_invalid")
        .when(excluded, "engineering_range")
        .when(~_state_ok(config, lay.x), "state_filtered"),
    )
    return rows.withColumn("kept", F.col("cls").isNull())


def _segments_of_kept(rows, lay, config, excluding, unnumbered, kept_only) -> DataFrame:
    """Number the kept rows inside their final segments (`rin`, from 1).

    A kept row starts a segment when a physical gap or an excluded out-of-range row lies
    between it and the kept row before, when the step is too long, or when a state filter
    skipped a usable row. All of these are differences of running counts, so a shard
    with its halo decides them exactly. Physical segments are numbered here where rows
    come `unnumbered`; with `kept_only` the other rows, counted by then, leave.
    """
    over_all = shard_window(lay.keys, "us").rowsBetween(Window.unboundedPreceding, 0)
    usable = F.col("kept") | (F.col("cls") == "state_filtered")
    counts = {"seg": _raw_number(lay)} if unnumbered else {}
    if excluding:
        counts["forced"] = F.count_if(F.col("cls") == "engineering_range").over(over_all)
    if config.state_filters:
        counts["usable"] = F.count_if(usable).over(over_all)
    rows = rows.select("*", *[value.alias(name) for name, value in counts.items()])
    if kept_only:
        rows = rows.where("kept").withColumn("kept", F.lit(True))
    window = shard_window(lay.keys, "us", "kept")
    starts = (
        F.lag("us").over(window).isNull()
        | (F.lag("seg").over(window) != F.col("seg"))
        | (F.col("us") - F.lag("us").over(window) > config.gap_us)
    )
    if excluding:
        starts = starts | (F.lag("forced").over(window) != F.col("forced"))
    if config.state_filters:
        starts = starts | (F.col("usable") - F.lag("usable").over(window) > 1)
    return _row_in_segment(
        rows.withColumn("starts", F.col("kept") & starts), window, "starts", "rin"
    ).drop("forced", "usable")


def _row_in_segment(rows, window, starts, name) -> DataFrame:
    rows = rows.withColumn("at", F.row_number().over(window))
    begun = F.max(F.when(F.col(starts), F.col("at"))).over(
        window.rowsBetween(Window.unboundedPreceding, 0)
    )
    return rows.withColumn(name, F.col("at") - begun + 1).drop("at")


def _filter_rows(rows, lay, config, rin, part, width) -> DataFrame:
    """Causal filter inside each segment; y0.. are NULL where its history is incomplete."""
    method, w = config.filter_method, config.filter_rows
    if method == "none" or (w == 1 and method != "first_order"):
        return rows.select("*", *[F.col(x).alias(y) for x, y in zip(lay.xs, lay.ys)])
    if method == "first_order":
        return _first_order(rows, lay, config, width)
    if method == "trailing_mean" and w > LONG_FRAME:
        return _long_means(rows, lay, w, rin, part)
    frame = shard_window(lay.keys, "us", *([part] if part else [])).rowsBetween(-(w - 1), 0)
    pick = (
        (lambda x: F.avg(x).over(frame))
        if method == "trailing_mean"
        else (lambda x: F.percentile(x, F.lit(0.5)).over(frame))
    )
    full = lambda x: (F.col(rin) >= w) & (F.count(x).over(frame) == w)
    return rows.select("*", *[F.when(full(x), pick(x)).alias(y) for x, y in zip(lay.xs, lay.ys)])


# Spark adds up a sliding frame anew for each row. From this length on, sorting the blocks of `_long_means` costs less.
LONG_FRAME = 64


def _long_means(rows, lay, w, rin, part) -> DataFrame:
    """Trailing means over `w` rows whose cost does not grow with `w`.

    The rows of a shard are cut into blocks of `w`. A frame is the tail of one block and the head of the next, and
    running sums give both, one of them backwards. Nothing is subtracted, so large values leave no rounding behind.
    """
    split = [part] if part else []
    run = shard_window(lay.keys, "us", *split)
    before = run.rowsBetween(Window.unboundedPreceding, 0)
    block = Window.partitionBy(*[col(k) for k in lay.keys], SHARD, *split, "blk")
    upto = lambda order: block.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    columns = rows.columns
    rows = rows.withColumn("at", F.row_number().over(run)).withColumn("blk", F.expr(f"(at - 1) div {w}"))
    rows = rows.select("*", *[F.count(x).over(before).alias(f"n{x}") for x in lay.xs])
    rows = rows.select("*", *[F.sum(x).over(upto(F.col("us"))).alias(f"h{x}") for x in lay.xs])
    rows = rows.select("*", *[F.sum(x).over(upto(F.col("us").desc())).alias(f"t{x}") for x in lay.xs])
    whole = (F.col("at") % w) == 0
    total = lambda x: F.when(whole, F.col(f"h{x}")).otherwise(F.lag(f"t{x}", w - 1).over(run) + F.col(f"h{x}"))
    full = lambda x: (F.col(rin) >= w) & (F.col(f"n{x}") - F.coalesce(F.lag(f"n{x}", w).over(run), F.lit(0)) == w)
    return rows.select(*columns, *[F.when(full(x), total(x) / w).alias(y) for x, y in zip(lay.xs, lay.ys)])


def _first_order(rows, lay, config, width) -> DataFrame:
    """y_t = a*x_t + (1-a)*y_(t-1), starting each segment at its first value.

    Inside a shard the recursion is a scaled prefix sum over blocks short enough that the
    scale stays far from overflow. Across shards it is an affine map of the state, so each
    shard contributes one (slope, offset) pair and the pairs are folded in order.
    """
    a = float(config.first_order_alpha)
    if a == 1.0:
        return rows.select("*", *[F.col(x).alias(y) for x, y in zip(lay.xs, lay.ys)])
    decay = -log1p(-a)
    # After a block a state has shrunk to about 1e-100. The slower the filter, the longer the block.
    block = max(2, min(1 << 62, floor(230 / decay)))
    reach = config.lag_rows * max(config.gap_us, config.interval_us)
    power = lambda exponent: F.exp(exponent * F.lit(-decay))
    b_block = exp(-decay * block)

    # The stride of a shard starts `reach` before it, so lagged values are its own too.
    rows = rows.withColumn("act", F.col("kept") & (F.col("us") >= F.col(SHARD) - reach))
    run = shard_window(lay.keys, "us", "act")
    before = run.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("at", F.row_number().over(run))
    rows = rows.withColumn(
        "from_", F.coalesce(F.max(F.when(F.col("starts"), F.col("at"))).over(before), F.lit(0))
    )
    rows = rows.withColumn("j", F.col("at") - F.greatest(F.col("from_"), F.lit(1)))
    rows = rows.withColumn("blk", F.expr(f"j div {block}")).withColumn("jm", F.col("j") % block)
    weight = F.when(F.col("starts"), F.lit(1.0)).otherwise(F.lit(a)) / power(F.col("jm"))
    piece = shard_window(lay.keys, "us", "act", "from_", "blk").rowsBetween(
        Window.unboundedPreceding, 0
    )
    zs = [f"z{i}" for i in range(len(lay.xs))]
    rows = rows.select(
        "*",
        *[
            (F.sum(F.col(x) * weight).over(piece) * power(F.col("jm"))).alias(z)
            for x, z in zip(lay.xs, zs)
        ],
    )
    # State at the end of the block before, itself fed by the one before that; anything
    # older is damped below 1e-200.
    past = run.rowsBetween(Window.unboundedPreceding, -1)
    at_end = F.col("jm") == block - 1
    ended = lambda value: F.coalesce(
        F.when(F.col("blk") > 0, F.last(F.when(at_end, value), ignorenulls=True).over(past)),
        F.lit(0.0),
    )
    rows = rows.select("*", *[ended(F.col(z)).alias(f"p{z}") for z in zs])
    rows = rows.select(
        "*", *[ended(F.col(z) + F.col(f"p{z}") * b_block).alias(f"q{z}") for z in zs]
    )
    inner = [F.col(z) + F.col(f"q{z}") * power(F.col("jm") + 1) for z in zs]
    rows = rows.select("*", *[v.alias(f"i{z}") for v, z in zip(inner, zs)])
    carried = F.when(F.col("from_") == 0, power(F.col("j") + 1)).otherwise(F.lit(0.0))
    rows = rows.withColumn("slope", carried).drop(*zs, *[f"p{z}" for z in zs], *[f"q{z}" for z in zs])

    # Read once for the states of the shards and once for the result, with everything before it behind both.
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.checkpoint()
    in_stride = F.col("act") & (F.col("us") < F.col(SHARD) + F.lit(width - reach))
    states = (
        rows.where(in_stride)
        .groupBy(*[col(k) for k in lay.keys], SHARD)
        .agg(
            F.max_by(
                F.struct("slope", F.array(*[f"i{z}" for z in zs]).alias("offset")), F.col("us")
            ).alias("state")
        )
    )
    # Shards with a row at every permitted step, after which a state has shrunk below every double.
    fewest = max(1, (width - reach) // max(config.gap_us, config.interval_us))
    entry = _entry_states(states, lay.keys, len(zs), width, 1 + ceil(750 / (decay * fewest)))
    rows = rows.join(entry, [*lay.keys, SHARD], "left")
    result = [
        F.when(
            F.col("act"),
            F.col(f"i{z}")
            + F.when(
                F.col("slope") > 0, F.col("slope") * F.coalesce(F.get("entry", F.lit(i)), F.lit(0.0))
            ).otherwise(F.lit(0.0)),
        ).alias(y)
        for i, (z, y) in enumerate(zip(zs, lay.ys))
    ]
    return rows.select("*", *result).drop(
        "act", "at", "from_", "j", "blk", "jm", "slope", "entry", *[f"i{z}" for z in zs]
    )


# Shards whose maps are composed before the next ones are looked at.
FOLD_SHARDS = 64


def _compose(maps: Column, size: int) -> Column:
    """One (slope, offset) map for maps applied in order; the identity for none."""
    identity = F.struct(F.lit(1.0).alias("slope"), F.array(*[F.lit(0.0)] * size).alias("offset"))
    return F.aggregate(
        maps,
        identity,
        lambda y, s: F.struct(
            (s["slope"] * y["slope"]).alias("slope"),
            F.zip_with(y["offset"], s["offset"], lambda v, c: s["slope"] * v + c).alias("offset"),
        ),
    )


def _entry_states(states: DataFrame, keys, size: int, width: int, reach: int) -> DataFrame:
    """(keys, shard, entry): the state at the start of each shard, from the maps of up to `reach` shards before.

    Slow filters reach far: then groups of FOLD_SHARDS shards are composed first, and the
    groups are folded like shards.
    """
    key_cols = [col(k) for k in keys]
    span = FOLD_SHARDS * width
    if reach <= FOLD_SHARDS or span > 1 << 56:  # so many microseconds, 2,283 years, are all of time
        before = Window.partitionBy(*key_cols).orderBy(SHARD).rowsBetween(-min(reach, 1 << 30), -1)
        folded = _compose(F.collect_list("state").over(before), size)
        return states.select(*key_cols, SHARD, folded["offset"].alias("entry"))
    grouped = states.withColumn("_super", F.col(SHARD) - F.pmod(F.col(SHARD), F.lit(span)))
    inner = Window.partitionBy(*key_cols, "_super").orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    local = grouped.select(*key_cols, SHARD, "_super", _compose(F.collect_list("state").over(inner), size).alias("_map"))
    whole = grouped.groupBy(*key_cols, "_super").agg(
        _compose(F.transform(F.array_sort(F.collect_list(F.struct(SHARD, "state"))), lambda x: x["state"]), size).alias("state")
    )
    upper = _entry_states(whole.withColumnRenamed("_super", SHARD), keys, size, span, 1 + -(-reach // FOLD_SHARDS))
    upper = upper.withColumnsRenamed({SHARD: "_super", "entry": "_upper"})
    return local.join(upper, [*keys, "_super"]).select(
        *key_cols, SHARD,
        F.zip_with("_upper", F.col("_map.offset"), lambda v, c: F.col("_map.slope") * v + c).alias("entry"),
    )


def _lagged(lay, config, window) -> list[Column]:
    columns = []
    for lag in config.lags:
        shift = lag // config.sample_interval_minutes
        for i in range(len(lay.tags)):
            y = lay.tag_ys[i]
            value = y if shift == 0 else F.when(F.col("rin") > shift, F.lag(y, shift).over(window))
            columns.append(value.alias(f"f{len(columns)}"))
    return columns


def _lag_rows(rows, lay, config) -> DataFrame:
    window = shard_window(lay.keys, "us", "kept")
    rows = rows.select("*", *_lagged(lay, config, window))
    w, depth = config.filter_rows, config.lag_rows
    complete = all_finite([F.col(f"f{i}") for i in range(len(lay.tags) * len(config.lags))])
    return rows.withColumn(
        "cls",
        F.when(~F.col("kept"), F.col("cls"))
        .when(F.col("rin") < w, "filter_warmup")
        .when(~all_finite(lay.tag_ys), "filter_context")
        .when(F.col("rin") <= depth, "lag_warmup")
        .when(~complete, "lag_context")
        .otherwise("valid"),
    )


def _legacy(rows, lay, config) -> DataFrame:
    """Older order of steps: filter over invalid rows, then drop states, then lag."""
    present = rows.where(~F.col("partial")) if config.resamples else rows
    w, depth = config.filter_rows, config.lag_rows
    everything = shard_window(lay.keys, "us")
    changed = F.coalesce(F.lag("seg").over(everything) != F.col("seg"), F.lit(True))
    present = _row_in_segment(present.withColumn("begins", changed), everything, "begins", "rseg")
    present = _filter_rows(present, lay, config, "rseg", None, None)
    present = present.withColumn("kept", _state_ok(config, lay.y))
    window = shard_window(lay.keys, "us", "kept")
    starts = (
        F.lag("us").over(window).isNull()
        | (F.lag("seg").over(window) != F.col("seg"))
        | (F.col("us") - F.lag("us").over(window) > config.interval_us)
    )
    present = _row_in_segment(
        present.withColumn("starts", F.col("kept") & starts), window, "starts", "rin"
    )
    present = present.select("*", *_lagged(lay, config, window))
    complete = all_finite([F.col(f"f{i}") for i in range(len(lay.tags) * len(config.lags))])
    present = present.withColumn(
        "cls",
        F.when(~F.col("kept"), "state_filtered")
        .when(F.col("n") == 0, "empty_bin")
        .when(~all_finite(lay.tag_xs), "input_invalid")
        .when(F.col("rseg") < w, "filter_warmup")
        .when(~all_finite(lay.tag_ys), "filter_context")
        .when(F.col("rin") <= depth, "lag_warmup")
        .when(~complete, "lag_context")
        .otherwise("valid"),
    ).drop("begins", "rseg")
    if not config.resamples:
        return present
    partial = rows.where(F.col("partial")).withColumn("cls", F.lit("partial_bin"))
    return present.unionByName(partial, allowMissingColumns=True)


def _number_segments(rows, lay, needed) -> DataFrame:
    """Global zero-based segment numbers from the shard summary.

    The `needed` columns are written once: the numbers in the shard and the summary both read the finished rows.
    """
    starts = F.coalesce(F.col("starts"), F.lit(False))
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.select(*[col(c) for c in rows.columns if c in needed]).checkpoint()
    rows = scan(
        rows,
        lay.keys,
        "us",
        {
            "raw_segment_id": ("sum", F.col("gap").cast("long")),
            "final_segment_id": ("sum", starts.cast("long")),
        },
    )
    return rows.withColumn("raw_segment_id", F.col("raw_segment_id") - 1).withColumn(
        "final_segment_id",
        F.when(F.coalesce(F.col("kept"), F.lit(False)), F.col("final_segment_id") - 1),
    )


def _project(rows, lay, config, intermediates, segment_ids) -> DataFrame:
    names = feature_names(lay.tags, config)
    valid = F.col("cls") == "valid"
    return rows.select(
        *[col(k) for k in lay.keys],
        from_micros(F.col("us")).alias("ts"),
        F.col("cls").alias("row_class"),
        F.col("n").alias("bucket_rows"),
        from_micros(F.col("first_us")).alias("bucket_first"),
        from_micros(F.col("last_us")).alias("bucket_last"),
        F.col("gap").alias("raw_segment_start"),
        F.coalesce(F.col("starts"), F.lit(False)).alias("segment_start"),
        *([F.col("raw_segment_id"), F.col("final_segment_id")] if segment_ids else []),
        *[F.col(x).alias(n) for n, x in zip(lay.names, lay.xs)],
        *([F.col(y).alias(f"{n}__filtered") for n, y in zip(lay.names, lay.ys)] if intermediates else []),
        *[
            F.col(f"e{i}").alias(f"{t}__outside")
            for i, t in enumerate(lay.tags)
            if f"e{i}" in rows.columns
        ],
        *[F.when(valid, F.col(f"f{i}")).alias(n) for i, n in enumerate(names)],
    )
