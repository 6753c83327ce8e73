"""Time windows chosen by engineers: checks, range joins and interval arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.config import MINUTE, PreprocessingConfig
from procmon.functions.columns import col, from_micros, micros
from procmon.operators.shards import SHARD, scan, shard_of, shard_rows
from procmon.session import ensure_checkpoint_dir

# The exact fields of each kind of window, and the validation types.
TRAINING_FIELDS = ("id", "start", "end", "source", "source_ref", "enabled", "comment")
VALIDATION_FIELDS = ("id", "type", "start", "end", "enabled", "comment")
EXCLUSION_FIELDS = ("id", "start", "end", "source", "comment")
VALIDATION_TYPES = ("normal_validation", "known_abnormal")

DAY_US = 1440 * MINUTE


def parse_time(value) -> datetime:
    if isinstance(value, datetime):
        return value
    if not isinstance(value, str) or not value.strip():
        raise ValueError("a window needs start and end times")
    try:
        return datetime.fromisoformat(value.strip())
    except ValueError as error:
        raise ValueError(f"not a timestamp: {value}") from error


def _is_text(value) -> bool:
    return isinstance(value, str) and bool(value.strip())


# What each field of a window must be, for every kind of window that has it.
FIELD_RULES = {
    "id": (_is_text, "unique non-empty text"),
    "source": (_is_text, "non-empty text"),
    "source_ref": (lambda v: v is None or _is_text(v), "text or null"),
    "enabled": (lambda v: isinstance(v, bool), "true or false"),
    "comment": (lambda v: isinstance(v, str), "text"),
    "type": (lambda v: v in VALIDATION_TYPES, " or ".join(VALIDATION_TYPES)),
}


def window_problems(windows: Sequence, fields: Sequence[str], label: str) -> list[str]:
    """Everything that is wrong with a list of windows, not only the first thing."""
    whole = [w for w in windows if isinstance(w, Mapping) and set(w) == set(fields)]
    found = [f"{label} must have exactly the fields {', '.join(fields)}"] * (len(whole) < len(windows))
    names = [w["id"] for w in whole]
    found += [f"{label} ids must be {FIELD_RULES['id'][1]}: {n} repeats" for n in {repr(n) for n in names if names.count(n) > 1}]
    for w in whole:
        found += [f"{label} {w['id']}: {f} must be {FIELD_RULES[f][1]}" for f in fields if f in FIELD_RULES and not FIELD_RULES[f][0](w[f])]
        try:
            if parse_time(w["start"]) > parse_time(w["end"]):
                found.append(f"{label} {w['id']} starts after its end")
        except ValueError as error:
            found.append(f"{label} {w['id']}: {error}")
    return found


def _checked(value, fields, label, allow_empty=False) -> list[dict]:
    if not isinstance(value, list) or (not value and not allow_empty):
        raise ValueError(f"{label} must be a non-empty list")
    problems = window_problems(value, fields, label)
    if problems:
        raise ValueError("; ".join(problems))
    return [{**w, "start": parse_time(w["start"]), "end": parse_time(w["end"])} for w in value]


def _check_disjoint(windows: Sequence[Mapping], label: str) -> None:
    latest = None
    for window in sorted(windows, key=lambda w: w["start"]):
        if latest is not None and window["start"] <= latest:
            raise ValueError(f"enabled {label} overlap")
        latest = window["end"] if latest is None else max(latest, window["end"])


def training_windows(value, allow_empty: bool = False) -> list[dict]:
    """Checked training windows; enabled ones may not overlap or touch."""
    windows = _checked(value, TRAINING_FIELDS, "training windows", allow_empty)
    _check_disjoint([w for w in windows if w["enabled"]], "training windows")
    return windows


def validation_windows(value) -> list[dict]:
    windows = _checked(value, VALIDATION_FIELDS, "validation windows")
    _check_disjoint([w for w in windows if w["enabled"]], "validation windows")
    return windows


def exclusion_windows(value) -> list[dict]:
    return _checked(value, EXCLUSION_FIELDS, "exclusion windows", allow_empty=True)


def check_apart(training: Sequence[Mapping], validation: Sequence[Mapping]) -> None:
    """Training and validation periods may not share a moment."""
    marked = [(w["start"], w["end"], i) for i, ws in enumerate((training, validation)) for w in ws]
    latest: list[datetime | None] = [None, None]
    for start, end, side in sorted(marked):
        other = latest[1 - side]
        if other is not None and start <= other:
            raise ValueError("training and validation windows overlap")
        latest[side] = end if latest[side] is None else max(latest[side], end)


def windows_frame(spark: SparkSession, windows: Sequence[Mapping]) -> DataFrame:
    """Checked windows as a DataFrame: window_id, window_start, window_end and the rest."""
    names = {"id": "window_id", "start": "window_start", "end": "window_end", "type": "window_type"}
    fields = []
    for field in windows[0]:
        kind = (
            T.TimestampNTZType()
            if field in ("start", "end")
            else T.BooleanType() if field == "enabled" else T.StringType()
        )
        fields.append(T.StructField(names.get(field, field), kind))
    rows = [tuple(w[f] for f in windows[0]) for w in windows]
    return spark.createDataFrame(rows, T.StructType(fields))


def context_start(start: Column, config: PreprocessingConfig) -> Column:
    """Earliest time whose rows can influence the first row of a window."""
    return from_micros(micros(start) - F.lit(config.context_minutes * MINUTE))


def in_windows(
    rows: DataFrame,
    windows: DataFrame,
    *,
    ts: str = "ts",
    start: str = "window_start",
    end: str = "window_end",
    on: Sequence[str] = (),
    bin_us: int = DAY_US,
) -> DataFrame:
    """Rows joined to every window that contains them, ends included.

    The range join runs as an equi-join on time bins. Windows written by hand are small
    enough for the planner to broadcast; many or computed ones are joined by shuffle.
    """
    first, last = micros(col(start)), micros(col(end))
    bins = F.sequence(first - F.pmod(first, F.lit(bin_us)), last, F.lit(bin_us))
    binned = windows.withColumn("_bin", F.explode(bins))
    us = micros(col(ts))
    marked = rows.withColumn("_bin", us - F.pmod(us, F.lit(bin_us)))
    joined = marked.join(binned, [*on, "_bin"])
    return joined.where(col(ts).between(col(start), col(end))).drop("_bin")


def select_window(rows: DataFrame, start, end, ts: str = "ts", allow_empty: bool = False) -> DataFrame:
    """Rows between two moments, ends included; the range reaches the scan. None at all is an error."""
    first, last = parse_time(start), parse_time(end)
    if first > last:
        raise ValueError("the window starts after its end")
    inside = rows.where(col(ts).between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    if not allow_empty and inside.isEmpty():
        raise ValueError("the window holds no rows")
    return inside


def flag_overlaps(
    windows: DataFrame,
    *,
    keys: Sequence[str] = (),
    start: str = "window_start",
    end: str = "window_end",
    name: str = "window_id",
    width: int = 365 * DAY_US,
) -> DataFrame:
    """Mark windows that overlap or touch one that starts earlier.

    A running maximum of the ends decides it, so no pairs are formed.
    """
    shaped = windows.withColumn("_us", micros(col(start))).withColumn("_end", micros(col(end)))
    swept = scan(
        shard_rows(shaped, "_us", width),
        keys,
        "_us",
        {"_latest": ("max", F.col("_end"))},
        inclusive=False,
        then=["_end", name],
    )
    return swept.withColumn("overlaps", F.coalesce(F.col("_us") <= F.col("_latest"), F.lit(False))).drop(
        "_us", "_end", "_latest", "_shard", "_own"
    )


def merge_windows(
    windows: DataFrame,
    *,
    keys: Sequence[str] = (),
    start: str = "window_start",
    end: str = "window_end",
    name: str = "window_id",
    keep: Sequence[str] = (),
    width: int = 365 * DAY_US,
) -> DataFrame:
    """Union of overlapping or touching windows; each keeps the first one's id and `keep`."""
    flagged = flag_overlaps(windows, keys=keys, start=start, end=end, name=name, width=width)
    shaped = flagged.withColumn("_us", micros(col(start))).withColumn("_end", micros(col(end)))
    grouped = scan(
        shard_rows(shaped, "_us", width),
        keys,
        "_us",
        {"_group": ("sum", (~F.col("overlaps")).cast("long"))},
        then=["_end", name],
    )
    first = F.struct(F.col("_us"), F.col("_end"), col(name))
    return (
        grouped.groupBy(*[col(k) for k in keys], "_group")
        .agg(
            F.min_by(col(name), first).alias(name),
            F.min(col(start)).alias(start),
            F.max(col(end)).alias(end),
            F.count(F.lit(1)).alias("merged_count"),
            *[F.min_by(col(k), first).alias(k) for k in keep],
        )
        .drop("_group")
    )


def subtract_windows(
    candidates: DataFrame,
    exclusions: DataFrame,
    times: DataFrame,
    *,
    keys: Sequence[str] = ("series_id",),
    ts: str = "ts",
    width: int = 365 * DAY_US,
) -> DataFrame:
    """What remains of each candidate window after cutting the exclusions out.

    Cuts snap to timestamps that exist: the last one before an exclusion and the first one
    after it. Outer ends stay as given; a candidate no exclusion touches is returned whole.
    Both window tables carry `keys`, window_id, window_start and window_end. The timestamps are swept
    once, shard by shard, and only the first and last free one between two events (a begin of an exclusion,
    an end of a candidate) go on; an exclusion that reaches into later shards is told to each of them.
    """
    key_cols = [col(k) for k in keys]
    none = F.lit(None).cast("long")
    # Windows and stretches are few beside the timestamps; written once, read by each step below.
    ensure_checkpoint_dir(times.sparkSession)
    exclusions = exclusions.select(*key_cols, "window_id", "window_start", "window_end").checkpoint()
    merged = merge_windows(exclusions, keys=keys, width=width).select(
        *key_cols, micros(F.col("window_start")).alias("_from"), micros(F.col("window_end")).alias("_to")
    ).checkpoint()
    named = candidates.withColumn("window_id", F.col("window_id").cast("string")).checkpoint()
    start, end = micros(F.col("window_start")), micros(F.col("window_end"))

    def event(df, us, kind, stop=none, name=F.lit(None).cast("string")):
        return df.select(
            *key_cols,
            us.alias("_us"),
            F.lit(kind).alias("_kind"),
            stop.alias("_stop"),
            name.alias("_name"),
        )

    begin = event(merged, F.col("_from"), 0, F.col("_to"))
    finish = event(named, end, 2, name=F.col("window_id"))
    totals = scan(
        shard_rows(begin.unionByName(finish), "_us", width),
        keys,
        "_us",
        {"_all": ("sum", (F.col("_kind") == 0).cast("long")), "_last_stop": ("max", F.col("_stop"))},
        then=["_kind", "_name"],
    )
    totals = totals.where("_kind = 2").select(*key_cols, F.col("_name").alias("window_id"), "_all", "_last_stop")
    open_candidates = named.join(totals, [*keys, "window_id"]).checkpoint()
    touched = F.coalesce(F.col("_last_stop") >= start, F.lit(False))
    whole = open_candidates.where(~touched).select(
        *key_cols, "window_id", F.col("window_start").alias("start"), F.col("window_end").alias("end")
    )

    # Order at one time: exclusions that go on, candidates that start, exclusions that begin, timestamps, candidates that end.
    later = merged.withColumn("_at", F.explode(F.sequence(shard_of(F.col("_from"), width), shard_of(F.greatest("_from", "_to"), width), F.lit(width))))
    events = (
        event(later.where(F.col("_at") > F.col("_from")), F.col("_at"), -2, F.col("_to"))
        .unionByName(event(named, start, -1))
        .unionByName(begin)
        .unionByName(event(times, micros(col(ts)), 1))
        .unionByName(finish)
    )
    upto = Window.partitionBy(*key_cols, SHARD).orderBy("_us", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = shard_rows(events.drop("_name"), "_us", width).select(
        *key_cols,
        SHARD,
        "_us",
        "_kind",
        F.max("_stop").over(upto).alias("_here"),
        F.count_if(F.col("_kind") == 0).over(upto).alias("_begun"),
        F.count_if(F.col("_kind").isin(-1, 2)).over(upto).alias("_edges"),
    )
    free = F.when((F.col("_kind") == 1) & (F.col("_here").isNull() | (F.col("_here") < F.col("_us"))), F.col("_us"))
    stretches = swept.groupBy(*key_cols, SHARD, "_begun", "_edges").agg(
        F.min(free).alias("_first"), F.max(free).alias("_last"), F.max("_here").alias("_here")
    ).checkpoint()
    along = Window.partitionBy(*key_cols).orderBy(SHARD).rowsBetween(Window.unboundedPreceding, -1)
    before = stretches.groupBy(*key_cols, SHARD).agg(F.max("_begun").alias("_n"), F.max("_here").alias("_stop")).select(
        *key_cols, SHARD, F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_n"), F.max("_stop").over(along).alias("_stop")
    )
    placed = stretches.where(F.col("_first").isNotNull()).join(before, [*keys, SHARD]).select(
        *key_cols,
        from_micros(F.col("_first")).alias("_first"),
        from_micros(F.col("_last")).alias("_last"),
        (F.col("_begun") + F.col("_n")).alias("_begun"),
        F.greatest("_here", "_stop").alias("_blocked"),
    )
    # Bins as long as the average candidate: each falls into few of them, and few share one.
    length = open_candidates.agg(F.avg(end - start)).first()[0] or 0
    inside = in_windows(
        placed, open_candidates.where(touched), ts="_first", on=keys, bin_us=DAY_US * max(1, ceil(length / DAY_US))
    )
    leads = F.col("_blocked").isNull() | (F.col("_blocked") < start)
    pieces = inside.groupBy(*key_cols, "window_id", "window_start", "window_end", "_begun", "_all").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.bool_and(leads).alias("_leads")
    )
    cut = pieces.select(
        *key_cols,
        "window_id",
        F.when(F.col("_leads"), F.col("window_start")).otherwise(F.col("_first")).alias("start"),
        F.when(F.col("_begun") == F.col("_all"), F.col("window_end")).otherwise(F.col("_last")).alias("end"),
    )
    return whole.unionByName(cut)


def summarise_windows(
    windows: DataFrame,
    rows: DataFrame,
    sample_interval_minutes: int,
    *,
    ts: str = "ts",
    on: Sequence[str] = (),
) -> DataFrame:
    """Duration, samples found and expected, and whether a window is complete."""
    ids = [*on, "window_id"]
    found = in_windows(rows.select(*[col(k) for k in on], col(ts)), windows.select(
        *[col(k) for k in ids], "window_start", "window_end"), ts=ts, on=on)
    counts = found.groupBy(*[col(k) for k in ids]).agg(F.count(F.lit(1)).alias("raw_samples"))
    span = micros(F.col("window_end")) - micros(F.col("window_start"))
    step = F.lit(sample_interval_minutes * MINUTE)
    return (
        windows.join(counts, ids, "left")
        .withColumn("raw_samples", F.coalesce("raw_samples", F.lit(0)))
        .withColumn("effective_samples", F.col("raw_samples"))
        .withColumn("duration_minutes", F.floor(span / F.lit(MINUTE)))
        .withColumn("expected_samples", F.floor(span / step) + 1)
        .withColumn(
            "quality_status",
            F.when(F.col("raw_samples") == F.col("expected_samples"), "ready").otherwise("sampling_gap"),
        )
    )
