"""Judging a fixed model on independent windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmon.functions.columns import STATUSES, col, covered_minutes, micros, minutes
from procmon.operators.quantiles import exact_quantiles
from procmon.operators.scoring import Model, exceeds
from procmon.session import ensure_checkpoint_dir

WINDOW_FACTS = ("window_type", "window_start", "window_end")


def _delay(first: Column) -> Column:
    return F.floor(minutes(micros(first) - micros(F.col("window_start")))).cast("long")


def window_metrics(
    scores: DataFrame,
    events: DataFrame,
    model: Model,
    interval_us: int,
    keys: Sequence[str] = ("series_id",),
) -> DataFrame:
    """Coverage, statuses, exceedance rates, events and detection times per window.

    `scores` carry window_id, window_type, window_start and window_end; `events` are the
    combined exceedance events of the same windows.
    """
    by = [*keys, "window_id"]
    over = {level: exceeds(model, level) for level in (95, 99)}
    rate = lambda flag: F.avg(flag.cast("double"))
    span = micros(F.first("window_end")) - micros(F.first("window_start"))
    counted = scores.groupBy(*[col(b) for b in by]).agg(
        *[F.first(w).alias(w) for w in WINDOW_FACTS],
        F.count(F.lit(1)).alias("scored_rows"),
        (F.floor(span / F.lit(interval_us)) + 1).alias("expected_rows"),
        F.min("ts").alias("first_scored"),
        F.max("ts").alias("last_scored"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in STATUSES],
        *[
            rate(over[level][name]).alias(f"{name}_exceedance_{level}")
            for name in ("t2", "spe")
            for level in (95, 99)
        ],
        F.max("t2").alias("maximum_t2"),
        F.max("spe").alias("maximum_spe"),
        *[
            F.min(F.when(over[level][name], F.col("ts"))).alias(f"first_{name}_{level}")
            for name in ("t2", "spe", "overall")
            for level in (95, 99)
        ],
    )
    found = events.groupBy(*[col(b) for b in by]).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.max(
            covered_minutes(micros(F.col("event_start")), micros(F.col("event_end")), interval_us)
        ).alias("longest_event_minutes"),
        F.max("point_count").alias("longest_event_points"),
    )
    return (
        counted.join(found, by, "left")
        .withColumn("event_count", F.coalesce("event_count", F.lit(0)))
        .withColumn("longest_event_minutes", F.coalesce("longest_event_minutes", F.lit(0)))
        .withColumn("coverage", F.col("scored_rows") / F.col("expected_rows"))
        .withColumn(
            "covers_window",
            (F.col("first_scored") == F.col("window_start")) & (F.col("last_scored") == F.col("window_end")),
        )
        .withColumn("first_exceedance_delay_minutes", _delay(F.col("first_overall_95")))
        .withColumn(
            "single_point_exceedance",
            F.coalesce((F.col("event_count") == 1) & (F.col("longest_event_points") == 1), F.lit(False)),
        )
    )


def normal_metrics(scores: DataFrame, events: DataFrame, model: Model, interval_us: int) -> DataFrame:
    """False-alarm rates over all rows of the normal-validation windows."""
    normal = F.col("window_type") == "normal_validation"
    over = {level: exceeds(model, level) for level in (95, 99)}
    rates = scores.where(normal).agg(
        F.count(F.lit(1)).alias("scoring_row_count"),
        *[
            F.avg(over[level][name].cast("double")).alias(f"{name}_exceedance_rate_{level}")
            for name in ("t2", "spe", "overall")
            for level in (95, 99)
        ],
    )
    alarms = events.where(normal).agg(
        F.count(F.lit(1)).alias("false_alarm_event_count_95"),
        F.coalesce(
            F.max(covered_minutes(micros(F.col("event_start")), micros(F.col("event_end")), interval_us)),
            F.lit(0),
        ).alias("longest_false_alarm_minutes"),
    )
    return rates.crossJoin(alarms)  # one row each


def detection_metrics(metrics: DataFrame) -> DataFrame:
    """How many known-abnormal windows were detected, per statistic, and how fast."""
    abnormal = metrics.where(F.col("window_type") == "known_abnormal")
    detected = {
        (name, level): F.col(f"first_{name}_{level}").isNotNull()
        for name in ("overall", "t2", "spe")
        for level in (95, 99)
    }
    counts = abnormal.agg(
        F.count(F.lit(1)).alias("valid_window_count"),
        *[F.count_if(flag).alias(f"{n}_detected_window_count_{level}") for (n, level), flag in detected.items()],
        *[
            F.avg(detected["overall", level].cast("double")).alias(f"detection_rate_{level}")
            for level in (95, 99)
        ],
        F.max("first_exceedance_delay_minutes").alias("first_detection_delay_minutes_95_max"),
    )
    delays = abnormal.select(F.col("first_exceedance_delay_minutes").cast("double").alias("delay"))
    median = exact_quantiles(delays, [], "delay", {"first_detection_delay_minutes_95_median": 0.5})
    return counts.crossJoin(median)


def first_event_tags(metrics: DataFrame, events: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Tag shares of the events that start at a window's first exceedance."""
    by = [*keys, "window_id"]
    starts = metrics.where("window_type = 'known_abnormal'").select(
        *[col(b) for b in by], F.col("first_overall_95").alias("event_start")
    )
    return events.join(starts, [*by, "event_start"]).select(
        *[col(b) for b in by], "event_start", "statistic", F.inline("tags")
    )


def label_crosstab(
    scores: DataFrame, labels: DataFrame, *, on: Sequence[str] = ("series_id", "ts"), label: str = "label"
) -> DataFrame:
    """Scored rows per engineering label and status; rows without a label are left out."""
    named = labels.select(*[col(o) for o in on], col(label).cast("string").alias("label"))
    return (
        scores.join(named, list(on), "left")
        .where(F.col("label").isNotNull())
        .groupBy("label", "status")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


# ---- contribution stability ----------------------------------------------------------


def contribution_stability(events: DataFrame, tags: Sequence[str], by: Sequence[str] = ("window_type", "statistic")):
    """How alike the contributions of different events are: (groups, tags) tables.

    Averages over all pairs of events are computed without forming pairs. The mean cosine
    follows from the length of the summed unit vectors. Every ranking keeps the same number
    k of leading tags, so a pair's Jaccard index depends only on how many tags it shares,
    and those frequencies follow from how often tags, tag pairs and tag triples lead.
    """
    k = min(3, len(tags))
    by_cols = [col(b) for b in by]
    ranked = events.select(
        *by_cols,
        F.map_from_entries(
            F.transform("tags", lambda t: F.struct(t["tag"], t["contribution_pct"]))
        ).alias("shares"),
    )
    value = lambda t: F.coalesce(F.try_element_at("shares", F.lit(t)), F.lit(0.0))
    ranked = ranked.select(
        *by_cols,
        F.array(*[value(t) for t in tags]).alias("v"),
        F.transform(
            F.slice(
                F.array_sort(
                    F.array(*[F.struct((-value(t)).alias("o"), F.lit(t).alias("tag")) for t in tags])
                ),
                1,
                k,
            ),
            lambda e: e["tag"],
        ).alias("top"),
    )
    # One short row per event, read by every part below; written once.
    ensure_checkpoint_dir(events.sparkSession)
    ranked = ranked.withColumn("top1", F.get("top", F.lit(0))).checkpoint()

    # Per tag: leading counts, mean and median share.
    cells = ranked.select(*by_cols, "top", "top1", F.posexplode("v").alias("at", "share")).withColumn(
        "tag", F.get(F.array(*[F.lit(t) for t in tags]), F.col("at"))
    )
    per_tag = cells.groupBy(*by_cols, "tag").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("top1") == F.col("tag")).alias("top1_count"),
        F.count_if(F.array_contains(F.col("top"), F.col("tag"))).alias("top_k_count"),
        F.avg("share").alias("average_contribution_pct"),
    )
    medians = exact_quantiles(cells, [*by, "tag"], "share", {"median_contribution_pct": 0.5})
    per_tag = per_tag.withColumn("top_k_recurrence_rate", F.col("top_k_count") / F.col("event_count")).join(
        medians, [*by, "tag"]
    )

    # Cosine: |sum of unit vectors|^2 counts every ordered pair, and each event with itself.
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = ranked.withColumn("norm", norm)
    p = len(tags)
    totals = unit.groupBy(*by_cols).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_if(F.col("norm") > 0).alias("nonzero"),
        *[
            F.sum(F.when(F.col("norm") > 0, F.get("v", F.lit(i)) / F.col("norm")).otherwise(0.0)).alias(f"u{i}")
            for i in range(p)
        ],
    )
    squares = sum((F.col(f"u{i}") * F.col(f"u{i}") for i in range(1, p)), F.col("u0") * F.col("u0"))
    m = F.col("event_count")
    pairs = m * (m - 1)
    totals = totals.withColumn(
        "average_contribution_cosine_similarity", F.when(pairs > 0, (squares - F.col("nonzero")) / pairs)
    ).drop("nonzero", *[f"u{i}" for i in range(p)])

    # Jaccard: pairs that share exactly 1, 2 or 3 leading tags.
    sets = ranked.select(*by_cols, F.array_sort("top").alias("s"))
    place = lambda i: F.get("s", F.lit(i))
    subsets = [F.array(place(i)) for i in range(k)]
    subsets += [F.array(place(i), place(j)) for i in range(k) for j in range(i + 1, k)]
    if k == 3:
        subsets.append(F.col("s"))
    counted = sets.select(*by_cols, F.explode(F.array(*subsets)).alias("subset"))
    counted = counted.groupBy(*by_cols, "subset").agg(F.count(F.lit(1)).alias("c"))
    shared = counted.groupBy(*by_cols).agg(
        *[
            F.sum(
                F.when(F.size("subset") == size, F.col("c") * (F.col("c") - 1) / 2).otherwise(0.0)
            ).alias(f"p{size}")
            for size in (1, 2, 3)
        ]
    )
    three = F.col("p3")
    two = F.col("p2") - 3 * three
    one = F.col("p1") - 2 * two - 3 * three
    total = F.lit(0.0)
    for size, count in ((1, one), (2, two), (3, three)):
        if size <= k:
            total = total + count * (size / (2 * k - size))
    shared = shared.withColumn("jaccard_sum", total).drop("p1", "p2", "p3")
    lead = per_tag.groupBy(*by_cols).agg(F.max("top1_count").alias("most"))
    groups = (
        totals.join(shared, list(by))
        .join(lead, list(by))
        .select(
            *by_cols,
            "event_count",
            F.lit(k).alias("top_k"),
            (F.col("most") / m).alias("top1_consistency_rate"),
            F.when(pairs > 0, F.col("jaccard_sum") / (pairs / 2)).alias("average_top_k_jaccard_similarity"),
            "average_contribution_cosine_similarity",
        )
    )
    return groups, per_tag
