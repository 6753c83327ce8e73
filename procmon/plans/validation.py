"""Validation: typed windows with look-back context, scored by a fixed model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.config import MINUTE, PreprocessingConfig
from procmon.functions.columns import col, from_micros, is_close, micros
from procmon.operators import validation
from procmon.operators.contributions import combined_events, event_contributions
from procmon.operators.quality import quality_gate
from procmon.operators.preprocess import feature_names, preprocess
from procmon.operators.scoring import Model, exceeds, score
from procmon.operators.windows import (
    check_apart,
    context_start,
    in_windows,
    validation_windows,
    windows_frame,
)


@dataclass(frozen=True)
class Validation:
    windows: DataFrame
    rows: DataFrame  # preprocessed context and window rows
    scores: DataFrame
    events: DataFrame  # combined exceedance events
    contributions: DataFrame  # events per statistic with tag shares
    model: Model
    config: PreprocessingConfig
    tags: tuple[str, ...]
    keys: tuple[str, ...]

    def window_metrics(self) -> DataFrame:
        return validation.window_metrics(
            self.scores, self.events, self.model, self.config.interval_us, self.keys
        )

    def normal_metrics(self) -> DataFrame:
        return validation.normal_metrics(self.scores, self.events, self.model, self.config.interval_us)

    def detection_metrics(self) -> DataFrame:
        return validation.detection_metrics(self.window_metrics())

    def first_event_tags(self) -> DataFrame:
        return validation.first_event_tags(self.window_metrics(), self.contributions, self.keys)

    def stability(self) -> tuple[DataFrame, DataFrame]:
        return validation.contribution_stability(self.contributions, self.model.tags)

    def check_coverage(self) -> None:
        """Raise unless every enabled window is scored from its start to its end."""
        by = [*self.keys, "window_id"]
        metrics = self.window_metrics().select(*[col(b) for b in by], "covers_window")
        enabled = self.windows.where("enabled").select("window_id")
        short = enabled.join(metrics, "window_id", "left").where(
            ~F.coalesce(F.col("covers_window"), F.lit(False))
        )
        names = sorted({r["window_id"] for r in short.select("window_id").distinct().collect()})
        if names:
            raise ValueError(f"validation data do not cover the windows {', '.join(names)}")


def validate(
    readings: DataFrame,
    model: Model,
    tags: Sequence[str],
    config: PreprocessingConfig,
    windows: Sequence[Mapping],
    *,
    training: Sequence[Mapping] = (),
    ts: str = "ts",
    keys: Sequence[str] = ("series_id",),
    tag_configs: Mapping[str, Mapping] | None = None,
    semantics: str = "schema5",
    source_interval_minutes: float | None = None,
    shard_minutes: int | None = None,
    require_coverage: bool = False,
    engineering_ranges: Mapping[str, tuple[float, float]] | None = None,
    check_quality: bool = False,
) -> Validation:
    """Score all enabled windows in one job; nothing is refitted.

    `check_quality` refuses readings with faults that must not be validated on,
    `require_coverage` windows that are not scored from start to end; both run jobs.

    Each window takes the history its first row needs, so a row can serve several
    windows. A schema5 first-order filter needs all history.
    """
    if list(model.features) != feature_names(tags, config):
        raise ValueError("the model's features do not match the preprocessing")
    checked = validation_windows(list(windows))
    enabled = [w for w in checked if w["enabled"]]
    if not enabled:
        raise ValueError("at least one validation window must be enabled")
    check_apart([w for w in training if w.get("enabled", True)], enabled)
    frame = windows_frame(readings.sparkSession, checked)
    bounds = frame.where("enabled").select("window_id", "window_type", "window_start", "window_end")
    history = readings.where(
        col(ts) <= F.lit(max(w["end"] for w in enabled)).cast("timestamp_ntz")
    )
    if semantics == "schema5" and config.filter_method == "first_order":
        first = readings.agg(F.min(col(ts)).alias("t")).collect()[0]["t"]
        bounds = bounds.withColumn("context_start", F.lit(first).cast("timestamp_ntz"))
    else:
        bounds = bounds.withColumn("context_start", context_start(F.col("window_start"), config))
        earliest = micros(F.lit(min(w["start"] for w in enabled)).cast("timestamp_ntz"))
        history = history.where(col(ts) >= from_micros(earliest - config.context_minutes * MINUTE))
    if check_quality:
        quality_gate(
            history, tags, ts=ts, keys=keys, expected_interval_minutes=source_interval_minutes or config.sample_interval_minutes,
            engineering_ranges=engineering_ranges, semantics=semantics,
        )
    rows = preprocess(
        in_windows(history, bounds, ts=ts, start="context_start"),
        tags,
        config,
        ts=ts,
        keys=[*keys, "window_id"],
        semantics=semantics,
        source_interval_minutes=source_interval_minutes,
        shard_minutes=shard_minutes,
    )
    facts = F.broadcast(bounds.drop("context_start"))  # a short hand-written list
    dynamic = (
        rows.where(F.col("row_class") == "valid")
        .select(*[col(k) for k in [*keys, "window_id"]], "ts", *[col(f) for f in model.features])
        .join(facts, "window_id")
        .where(F.col("ts").between(F.col("window_start"), F.col("window_end")))
    )
    scores = score(dynamic, model)
    by = [*keys, "window_id", "window_type"]
    events = combined_events(scores, model, config.interval_us, keys=by)
    contributions = event_contributions(
        scores, model, config.interval_us, keys=by, tag_configs=tag_configs
    )
    result = Validation(
        frame, rows, scores, events, contributions, model, config, tuple(tags), tuple(keys)
    )
    if require_coverage:
        result.check_coverage()
    return result


def verify_scores(
    saved: DataFrame,
    model: Model,
    *,
    keys: Sequence[str] = ("series_id", "window_id"),
    rel: float = 1e-12,
) -> DataFrame:
    """Saved rows whose ratios or statuses do not follow from their statistics."""
    expected = {
        "t2_limit_ratio": F.col("t2") / F.lit(model.t2_limits[0]),
        "spe_limit_ratio": F.col("spe") / F.lit(model.q_limits[0]),
    }
    wrong = F.lit(False)
    for name, value in expected.items():
        wrong = wrong | ~is_close(F.col(name), value, rel, rel)
    say = lambda n: (
        F.when(exceeds(model, 99)[n], "abnormal").when(exceeds(model, 95)[n], "attention").otherwise("normal")
    )
    for name, of in (("t2_status", "t2"), ("spe_status", "spe"), ("overall_status", "overall"), ("status", "overall")):
        wrong = wrong | ~F.col(name).eqNullSafe(say(of))
    return saved.where(F.col("score_valid") & wrong).select(
        *[col(k) for k in keys], "ts", "t2", "spe", "overall_status"
    )


def verify_metrics(saved: DataFrame, recomputed: DataFrame, by: Sequence[str], rel: float = 1e-12) -> DataFrame:
    """Metrics that differ between a saved report and a recomputation, one row each."""
    names = [c for c in saved.columns if c not in by and c in recomputed.columns]
    numeric = {f.name for f in saved.schema if f.dataType.typeName() in ("double", "float", "long", "integer")}
    text = lambda frame, side: frame.select(
        *[col(b) for b in by], *[col(n).alias(f"{side}_{n}") for n in names]
    )
    joined = text(saved, "saved").join(text(recomputed, "new"), list(by), "full")
    cells = []
    for n in names:
        a, b = col(f"saved_{n}"), col(f"new_{n}")
        same = (
            is_close(a.cast("double"), b.cast("double"), rel, rel) if n in numeric else a.eqNullSafe(b)
        )
        cells.append(
            F.when(
                ~same,
                F.struct(
                    F.lit(n).alias("metric"), a.cast("string").alias("saved"), b.cast("string").alias("recomputed")
                ),
            )
        )
    return joined.select(*[col(b) for b in by], F.inline(F.array_compact(F.array(*cells))))


def compare_tables(
    expected: DataFrame, actual: DataFrame, by: Sequence[str], *, rel: float = 1e-9, abs_tol: float = 1e-12
) -> DataFrame:
    """Cells of two tables that differ: numbers up to a tolerance, anything else exactly.

    Rows only one side has are reported as the metric `row`.
    """
    numeric = ("double", "float", "long", "integer", "short", "byte")
    names = [f.name for f in expected.schema if f.name not in by]
    missing = set(names) ^ {c for c in actual.columns if c not in by}
    if missing:
        raise ValueError(f"columns differ: {', '.join(sorted(missing))}")
    side = lambda frame, mark: frame.select(
        *[col(b) for b in by], F.lit(True).alias(f"{mark}_row"), *[col(n).alias(f"{mark}_{n}") for n in names]
    )
    joined = side(expected, "e").join(side(actual, "a"), list(by), "full")
    both = F.col("e_row") & F.col("a_row")
    cell = lambda when, name, e, a: F.when(
        when,
        F.struct(F.lit(name).alias("column"), e.cast("string").alias("expected"), a.cast("string").alias("actual")),
    )
    cells = [cell(F.col("e_row").isNull() | F.col("a_row").isNull(), "row", F.col("e_row"), F.col("a_row"))]
    for f in expected.schema:
        if f.name in by:
            continue
        e, a = col(f"e_{f.name}"), col(f"a_{f.name}")
        same = (
            is_close(a.cast("double"), e.cast("double"), rel, abs_tol)
            if f.dataType.typeName() in numeric
            else e.eqNullSafe(a)
        )
        cells.append(cell(F.coalesce(both, F.lit(False)) & ~same, f.name, e, a))
    return joined.select(*[col(b) for b in by], F.inline(F.array_compact(F.array(*cells))))
