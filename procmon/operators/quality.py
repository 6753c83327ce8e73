"""Data checks and descriptive profiles; nothing here changes the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.config import MINUTE
from procmon.functions.columns import (
    INF,
    col,
    from_micros,
    is_blank,
    is_close,
    is_finite,
    micros,
    minutes,
    near_integer,
    outside,
    to_number,
)
from procmon.operators.brackets import bracket_columns, resolve
from procmon.operators.shards import default_width, number_rows, with_previous

RANGES = ("engineering", "normal", "alarm")

# Thresholds of the checks.
CANDIDATE_SHARE = 0.8
NEAR_CONSTANT = 1e-6


def long_form(df: DataFrame, tags: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per tag and reading: keys, tag, raw text, number, raw missing flag."""
    text = lambda t: col(t).cast("string")
    missing = lambda t: (
        col(t).isNull() | F.isnan(col(t))
        if isinstance(df.schema[t].dataType, (T.DoubleType, T.FloatType))
        else col(t).isNull()
    )
    cells = [
        F.struct(
            F.lit(t).alias("tag"),
            F.lit(i).alias("tag_order"),
            text(t).alias("raw"),
            to_number(df, t).alias("value"),
            missing(t).alias("missing"),
        )
        for i, t in enumerate(tags)
    ]
    return df.select(*[col(k) for k in keys], F.inline(F.array(*cells)))


def _range_counts(tag_configs: Mapping[str, Mapping] | None) -> list[Column]:
    """Per range kind, how many finite values lie outside; NULL where a tag has no range."""
    found = []
    for kind in RANGES:
        count = F.lit(None).cast("long")
        for tag, config in (tag_configs or {}).items():
            low, high = config.get(f"{kind}_min"), config.get(f"{kind}_max")
            if low is not None and high is not None:
                hits = F.count_if((F.col("tag") == tag) & outside(F.col("value"), low, high))
                count = F.when(F.first("tag") == tag, hits).otherwise(count)
        found.append(count.alias(f"{kind}_range_outside_count"))
    return found


PROFILE_QUANTILES = {"p01": 0.01, "p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}


def tag_profile(
    df: DataFrame,
    tags: Sequence[str],
    *,
    keys: Sequence[str] = (),
    tag_configs: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Counts, moments and exact quantiles per tag."""
    by = [*keys, "tag"]
    cells = long_form(df, tags, keys)
    value, finite = F.col("value"), is_finite(F.col("value"))
    good = F.when(finite, value)
    counts = cells.groupBy(*[col(k) for k in by]).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(finite).alias("valid_count"),
        F.count_if(F.col("missing")).alias("missing_count"),
        F.avg(F.col("missing").cast("double")).alias("missing_rate"),
        F.count_if(~F.col("missing") & value.isNull()).alias("non_numeric_count"),
        F.count_if(F.abs(value) == INF).alias("non_finite_count"),
        F.min(good).alias("minimum"),
        F.max(good).alias("maximum"),
        F.avg(good).alias("mean"),
        F.stddev_pop(good).alias("standard_deviation"),
        *bracket_columns(good, PROFILE_QUANTILES),
        *_range_counts(tag_configs),
    )
    usable = cells.where(finite)
    distinct = (
        usable.select(*[col(k) for k in by], "value")
        .distinct()
        .groupBy(*[col(k) for k in by])
        .agg(F.count(F.lit(1)).alias("unique_count"))
    )
    quantiles = resolve(usable, by, "value", PROFILE_QUANTILES, counts)
    return (
        counts.drop("_n", "_ends").join(distinct, by, "left")
        .join(quantiles, by, "left")
        .withColumn("unique_count", F.coalesce("unique_count", F.lit(0)))
    )


def raw_profile(
    df: DataFrame,
    columns: Sequence[str],
    *,
    keys: Sequence[str] = (),
    tag_configs: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Disjoint kinds of unusable cells per raw column, and whether to ignore the column."""
    by = [*keys, "tag"]
    cells = long_form(df, columns, keys)
    value, finite = F.col("value"), is_finite(F.col("value"))
    blank = ~F.col("missing") & F.coalesce(is_blank(F.col("raw")), F.lit(False))
    wrong = ~F.col("missing") & ~blank & value.isNull()
    good = F.when(finite, value)
    counts = cells.groupBy(*[col(k) for k in by]).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(finite).alias("valid_count"),
        F.count_if(F.col("missing")).alias("missing_count"),
        F.count_if(blank).alias("empty_string_count"),
        F.count_if(wrong).alias("non_numeric_count"),
        F.count_if(value == INF).alias("positive_infinite_count"),
        F.count_if(value == -INF).alias("negative_infinite_count"),
        F.min(good).alias("minimum"),
        F.max(good).alias("maximum"),
        *_range_counts(tag_configs),
    )
    distinct = (
        cells.where(finite)
        .select(*[col(k) for k in by], "value")
        .distinct()
        .groupBy(*[col(k) for k in by])
        .agg(F.count(F.lit(1)).alias("unique_count"))
    )
    result = counts.join(distinct, by, "left").withColumn(
        "unique_count", F.coalesce("unique_count", F.lit(0))
    )
    kinds = ["missing", "empty_string", "non_numeric", "positive_infinite", "negative_infinite"]
    invalid = sum((F.col(f"{k}_count") for k in kinds[1:]), F.col("missing_count"))
    empty = F.col("missing_count") + F.col("empty_string_count")
    return (
        result.withColumn("invalid_count", invalid)
        .withColumn("invalid_rate", F.col("invalid_count") / F.col("sample_count"))
        .withColumn("missing_rate", F.col("missing_count") / F.col("sample_count"))
        .withColumn(
            "non_finite_count", F.col("positive_infinite_count") + F.col("negative_infinite_count")
        )
        .withColumn(
            "suggestion",
            F.when(empty == F.col("sample_count"), "all_empty")
            .when(F.col("valid_count") == 0, "no_finite_numeric_values")
            .when(F.col("unique_count") == 1, "exact_constant_finite_values"),
        )
    )


# ---- time axis -----------------------------------------------------------------------


def time_steps(
    df: DataFrame, *, ts: str = "ts", keys: Sequence[str] = (), width: int | None = None
) -> DataFrame:
    """Distinct times of each series with the step from the one before, in minutes."""
    times = (
        df.where(col(ts).isNotNull())
        .select(*[col(k) for k in keys], micros(col(ts)).alias("us"))
        .distinct()
    )
    stepped = with_previous(
        times, keys, "us", width or default_width(5 * MINUTE), {"previous_us": F.col("us")}
    )
    return stepped.where(F.col("previous_us").isNotNull()).withColumn(
        "step_minutes", minutes(F.col("us") - F.col("previous_us"))
    )


def modal_interval(
    df: DataFrame, *, ts: str = "ts", keys: Sequence[str] = (), width: int | None = None
) -> DataFrame:
    """Most frequent step per series, the smallest on ties."""
    key_cols = [col(k) for k in keys]
    counted = (
        time_steps(df, ts=ts, keys=keys, width=width)
        .groupBy(*key_cols, "step_minutes")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    return counted.groupBy(*key_cols).agg(
        F.min_by("step_minutes", F.struct(-F.col("_c"), F.col("step_minutes"))).alias(
            "interval_minutes"
        )
    )


def physical_gaps(
    df: DataFrame,
    threshold_minutes: float,
    *,
    ts: str = "ts",
    keys: Sequence[str] = (),
    width: int | None = None,
) -> DataFrame:
    """Steps longer than the threshold: where a segment ends and the next one starts."""
    steps = time_steps(df, ts=ts, keys=keys, width=width)
    return steps.where(F.col("step_minutes") > threshold_minutes).select(
        *[col(k) for k in keys],
        from_micros(F.col("previous_us")).alias("gap_start"),
        from_micros(F.col("us")).alias("gap_end"),
        F.col("step_minutes").alias("gap_minutes"),
    )


def time_quality(
    df: DataFrame,
    *,
    ts: str = "ts",
    keys: Sequence[str] = (),
    expected_interval_minutes: float | None = None,
    row_order: str | None = None,
    width: int | None = None,
) -> DataFrame:
    """Time-axis issues per series: keys, code, severity, count.

    File order exists only where a row number does (`row_order`, unique per series);
    without one the order of arrival is not checked.
    """
    key_cols = [col(k) for k in keys]
    parts = []

    def issue(found: DataFrame, code: str, severity: str) -> None:
        parts.append(
            found.select(
                *key_cols,
                F.lit(code).alias("code"),
                F.lit(severity).alias("severity"),
                F.col("count").cast("long").alias("count"),
            )
        )

    total = lambda frame, value: frame.groupBy(*key_cols).agg(value.alias("count")).where("count > 0")
    issue(total(df, F.count_if(col(ts).isNull())), "invalid_timestamp", "error")
    if row_order is not None:
        ordered = with_previous(
            df.where(col(ts).isNotNull())
            .select(*key_cols, col(row_order).cast("long").alias("_at"), micros(col(ts)).alias("_us")),
            keys,
            "_at",
            1 << 20,
            {"_before": F.col("_us")},
        )
        back = total(ordered, F.max((F.col("_us") < F.col("_before")).cast("int")))
        issue(back, "unsorted_timestamp", "error")
    copies = (
        df.where(col(ts).isNotNull())
        .groupBy(*key_cols, col(ts))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    issue(total(copies, F.sum("_n")), "duplicate_timestamp", "error")

    steps = time_steps(df, ts=ts, keys=keys, width=width)
    if expected_interval_minutes is None:
        mode = modal_interval(df, ts=ts, keys=keys, width=width)
        # One row per series; the planner may broadcast it once it knows the size.
        steps = steps.join(mode, list(keys)) if keys else steps.crossJoin(mode)
        interval = F.col("interval_minutes")
    else:
        interval = F.lit(float(expected_interval_minutes))
    step = F.col("step_minutes")
    regular = is_close(step, interval, 1e-5, 1e-8)
    gap = (step > interval) & near_integer(step / interval)
    issue(total(steps, F.count_if(~regular & ~gap)), "irregular_sampling", "error")
    issue(total(steps, F.count_if(gap)), "physical_time_gap", "warning")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# ---- tag issues ----------------------------------------------------------------------


def tag_issues(
    profile: DataFrame,
    *,
    keys: Sequence[str] = (),
    engineering_ranges: Mapping[str, tuple[float, float]] | None = None,
    variability: bool = True,
) -> DataFrame:
    """Issues that follow from a tag profile: keys, tag, code, severity, count."""
    has_values = F.col("valid_count") > 0
    constant = has_values & (F.col("unique_count") <= 1) & F.lit(variability)
    spread = F.col("standard_deviation")
    near = (
        has_values
        & (F.col("unique_count") > 1)
        & (spread > 0)
        & (spread <= F.greatest(F.abs(F.col("mean")), F.lit(1.0)) * NEAR_CONSTANT)
        & F.lit(variability)
    )
    beyond = F.coalesce(F.col("engineering_range_outside_count"), F.lit(0))
    checks = [
        ("non_numeric_value", "error", F.col("non_numeric_count") > 0, F.col("non_numeric_count")),
        ("missing_value", "error", F.col("missing_count") > 0, F.col("missing_count")),
        ("non_finite_value", "error", F.col("non_finite_count") > 0, F.col("non_finite_count")),
        ("constant_tag", "error", constant, F.col("valid_count")),
        ("near_constant_tag", "warning", near, F.col("valid_count")),
        ("engineering_range", "warning", beyond > 0, beyond),
    ]
    cells = [
        F.when(
            when,
            F.struct(
                F.lit(code).alias("code"),
                F.lit(level).alias("severity"),
                count.cast("long").alias("count"),
            ),
        )
        for code, level, when, count in checks
    ]
    return profile.select(
        *[col(k) for k in keys], "tag", F.explode(F.array_compact(F.array(*cells))).alias("i")
    ).select(*[col(k) for k in keys], "tag", "i.code", "i.severity", "i.count")


def model_quality(
    full: DataFrame,
    reference: DataFrame,
    tags: Sequence[str],
    *,
    keys: Sequence[str] = (),
    tag_configs: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """Per tag: usable, review or blocking, from the full data and the reference period."""
    by = [*keys, "tag"]
    configs = tag_configs or {}
    whole = tag_profile(full, tags, keys=keys, tag_configs=configs)
    part = tag_profile(reference, tags, keys=keys, tag_configs=configs)
    issues = (
        tag_issues(part, keys=keys)
        .groupBy(*[col(k) for k in by])
        .agg(
            F.array_sort(F.collect_set("code")).alias("codes"),  # at most six codes
            F.count_if(F.col("severity") == "error").alias("errors"),
        )
    )
    role = F.lit("continuous_input")
    for tag, config in configs.items():
        role = F.when(F.col("tag") == tag, config.get("role", "continuous_input")).otherwise(role)
    limit = F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.col("valid_count") * 0.01)))
    discrete = (
        (F.col("role") == "continuous_input")
        & (F.col("unique_count") > 1)
        & (F.col("unique_count") <= limit)
    )
    known = F.coalesce(F.col("codes"), F.array().cast("array<string>"))
    return (
        part.join(issues, by, "left")
        .join(
            whole.select(*[col(k) for k in by], (F.col("unique_count") == 1).alias("constant_in_full_data")),
            by,
        )
        .withColumn("role", role)
        .withColumn(
            "codes",
            F.when(discrete, F.concat(known, F.array(F.lit("suspected_discrete_state")))).otherwise(known),
        )
        .withColumn(
            "status",
            F.when(F.coalesce("errors", F.lit(0)) > 0, "blocking")
            .when(F.size("codes") > 0, "review")
            .otherwise("usable"),
        )
        .withColumn(
            "suggested_action",
            F.when(F.array_contains("codes", "constant_tag"), "exclude_or_adjust_reference")
            .when(F.size("codes") > 0, "review")
            .otherwise("use"),
        )
        .drop("errors")
    )


def constant_exclusions(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tags that are exactly constant: what to record when one is excluded."""
    return profile.where((F.col("unique_count") == 1) & (F.col("valid_count") >= 1)).select(
        *[col(k) for k in keys],
        "tag",
        F.lit("constant_in_reference_window").alias("reason"),
        F.col("valid_count").alias("sample_count"),
        F.col("unique_count"),
        F.col("minimum").alias("constant_value"),
    )


class QualityError(ValueError):
    """Readings that preprocessing must not accept; `codes` says why."""

    def __init__(self, codes: Mapping[str, int]):
        self.codes = dict(codes)
        super().__init__(", ".join(f"{c}({n})" for c, n in sorted(self.codes.items())))


def quality_gate(
    df: DataFrame,
    tags: Sequence[str],
    *,
    ts: str = "ts",
    keys: Sequence[str] = (),
    expected_interval_minutes: float | None = None,
    engineering_ranges: Mapping[str, tuple[float, float]] | None = None,
    semantics: str = "schema5",
    variability: bool = False,
) -> None:
    """Raise QualityError on faults the given semantics refuse to train on."""
    configs = {
        t: {"engineering_min": low, "engineering_max": high}
        for t, (low, high) in (engineering_ranges or {}).items()
    }
    axis = time_quality(df, ts=ts, keys=keys, expected_interval_minutes=expected_interval_minutes)
    cells = tag_issues(tag_profile(df, tags, keys=keys, tag_configs=configs), keys=keys, variability=variability)
    codes = axis.select("code", "severity", "count").unionByName(cells.select("code", "severity", "count"))
    refused = F.col("severity") == "error"
    if semantics == "schema5":
        refused = refused & ~F.col("code").isin("missing_value", "non_numeric_value", "non_finite_value")
    else:
        refused = refused | (F.col("code") == "engineering_range")
    found = codes.where(refused).groupBy("code").agg(F.sum("count").alias("n")).collect()
    if found:
        raise QualityError({r["code"]: r["n"] for r in found})


# ---- columns, noise, histograms ------------------------------------------------------


def numeric_candidates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns at least four fifths of whose non-null cells are numbers."""
    usable = [
        c
        for c in columns
        if not isinstance(
            df.schema[c].dataType, (T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)
        )
    ]
    counted = (
        long_form(df, usable)
        .groupBy("tag", "tag_order")
        .agg(F.count_if(~F.col("missing")).alias("filled"), F.count("value").alias("numeric"))
    )
    share = F.col("numeric") / F.when(F.col("filled") > 0, F.col("filled"))
    return counted.withColumn("is_candidate", F.coalesce(share >= CANDIDATE_SHARE, F.lit(False)))


def difference_noise(
    df: DataFrame,
    tags: Sequence[str],
    *,
    ts: str = "ts",
    keys: Sequence[str] = (),
    limit: int = 5,
    width: int | None = None,
) -> DataFrame:
    """Tags ranked by the spread of the difference between neighbouring rows."""
    key_cols = [col(k) for k in keys]
    numbers = df.select(
        *key_cols,
        micros(col(ts)).alias("us"),
        *[to_number(df, t).alias(f"v{i}") for i, t in enumerate(tags)],
    )
    paired = with_previous(
        numbers,
        keys,
        "us",
        width or default_width(5 * MINUTE),
        {f"p{i}": F.col(f"v{i}") for i in range(len(tags))},
    )
    spread = [
        F.stddev_pop(
            F.when(
                is_finite(F.col(f"v{i}")) & is_finite(F.col(f"p{i}")), F.col(f"v{i}") - F.col(f"p{i}")
            )
        ).alias(f"s{i}")
        for i in range(len(tags))
    ]
    scores = paired.groupBy(*key_cols).agg(*spread)
    cells = [
        F.struct(F.lit(t).alias("tag"), F.lit(i).alias("tag_order"), F.col(f"s{i}").alias("noise"))
        for i, t in enumerate(tags)
    ]
    ranked = scores.select(*key_cols, F.inline(F.array(*cells)))
    order = Window.partitionBy(*(key_cols or [F.lit(0)])).orderBy(
        F.col("noise").desc_nulls_last(), "tag_order"
    )
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def histogram(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts over finite values; at most 20 bins, the last one closed."""
    key_cols = [col(k) for k in keys]
    finite = df.select(*key_cols, to_number(df, value).alias("x")).where(is_finite(F.col("x")))
    bounds = finite.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    flat = F.col("lo") == F.col("hi")
    bounds = bounds.select(
        *key_cols,
        F.least(F.lit(20), F.greatest(F.lit(1), F.floor(F.sqrt("n")))).alias("bins"),
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    joined = finite.join(bounds, list(keys)) if keys else finite.crossJoin(F.broadcast(bounds))
    place = F.least(
        F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")),
        F.col("bins") - 1,
    )
    counted = joined.groupBy(*key_cols, place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edge = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) / F.col("bins") * i
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)))
    return every.join(counted, [*keys, "bin"], "left").select(
        *key_cols,
        "bin",
        edge(F.col("bin")).alias("left_edge"),
        edge(F.col("bin") + 1).alias("right_edge"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def axis_limits(df: DataFrame, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Plot limits around the finite values: 5 percent of the span, or of the value."""
    numbers = [F.when(is_finite(to_number(df, v)), to_number(df, v)) for v in values]
    low = F.least(*[F.min(n) for n in numbers]) if len(numbers) > 1 else F.min(numbers[0])
    high = F.greatest(*[F.max(n) for n in numbers]) if len(numbers) > 1 else F.max(numbers[0])
    found = df.groupBy(*[col(k) for k in keys]).agg(low.alias("lo"), high.alias("hi"))
    span = F.col("hi") - F.col("lo")
    pad = F.when(span > 0, span * 0.05).otherwise(F.greatest(F.abs(F.col("lo")) * 0.05, F.lit(1e-6)))
    return found.select(
        *[col(k) for k in keys],
        F.coalesce(F.col("lo") - pad, F.lit(0.0)).alias("minimum"),
        F.coalesce(F.col("hi") + pad, F.lit(1.0)).alias("maximum"),
    )


def dataset_summary(
    df: DataFrame, *, ts: str = "ts", keys: Sequence[str] = (), width: int | None = None
) -> DataFrame:
    """Row count, time range and modal step."""
    key_cols = [col(k) for k in keys]
    counted = df.groupBy(*key_cols).agg(
        F.count(F.lit(1)).alias("row_count"), F.min(col(ts)).alias("time_start"), F.max(col(ts)).alias("time_end")
    )
    mode = modal_interval(df, ts=ts, keys=keys, width=width)
    return counted.join(mode, list(keys), "left") if keys else counted.crossJoin(F.broadcast(mode))


def suggested_split(
    df: DataFrame, *, ts: str = "ts", keys: Sequence[str] = (), width: int | None = None
) -> DataFrame:
    """Suggested end of the normal period, start of validation and default trend end.

    Positions are taken on the distinct times: 65 percent of them for training, and the
    first 30,000 for a trend.
    """
    key_cols = [col(k) for k in keys]
    times = df.where(col(ts).isNotNull()).select(*key_cols, micros(col(ts)).alias("us")).distinct()
    placed = number_rows(times, keys, "us", width or default_width(5 * MINUTE), total="n")
    split = F.greatest(F.lit(0), F.least(F.col("n") - 2, F.floor(F.col("n") * 0.65)))
    at = lambda position: F.max(F.when(F.col("position") == position, F.col("us")))
    found = placed.groupBy(*key_cols).agg(
        F.max("n").alias("time_points"),
        from_micros(F.min("us")).alias("trend_default_start"),
        from_micros(at(F.least(F.col("n") - 1, F.lit(29_999)))).alias("trend_default_end"),
        from_micros(at(split)).alias("suggested_normal_end"),
        from_micros(at(split + 1)).alias("suggested_validation_start"),
    )
    return found
