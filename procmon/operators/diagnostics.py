"""Structure of stored models, over any number of them at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from procmon.operators.scoring import EPS

# Settings that must agree before two models may be compared.
COMPARABLE_KEYS = (
    "tags",
    "training_windows",
    "timestamp_column",
    "state_filters",
    "sample_interval_minutes",
    "resampling_method",
)


def spectrum_table(spectrum: DataFrame, model: DataFrame) -> DataFrame:
    """Eigenvalues with their cumulative explained share and a retained flag."""
    order = Window.partitionBy("model_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return spectrum.join(model.select("model_id", "k"), "model_id").select(
        "model_id",
        "i",
        "eigenvalue",
        "explained",
        F.sum("explained").over(order).alias("cumulative"),
        (F.col("i") <= F.col("k")).alias("retained"),
    )


def structure(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per model: sizes, components needed for 80, 90 and 95 percent, limits."""
    levels = spectrum_table(tables["spectrum"], tables["model"])
    need = levels.groupBy("model_id").agg(
        *[
            F.min(F.when(F.col("cumulative") >= level - 1e-12, F.col("i"))).alias(
                f"components_for_{int(level * 100)}"
            )
            for level in (0.80, 0.90, 0.95)
        ],
        F.max(F.when(F.col("retained"), F.col("cumulative"))).alias("retained_share"),
    )
    tags = tables["feature_params"].groupBy("model_id").agg(F.count_distinct("tag").alias("tag_count"))
    return (
        tables["model"]
        .drop("config_json", "version")
        .join(need, "model_id")
        .join(tags, "model_id")
        .withColumn("features_per_sample", F.col("p") / F.col("n"))
    )


def loading_energy(loadings: DataFrame, by: str) -> DataFrame:
    """Share of squared loadings per tag or lag: first, second and all retained components."""
    square = F.col("loading") * F.col("loading")
    part = lambda i: F.sum(F.when(F.col("component") == i, square).otherwise(0.0))
    grouped = loadings.groupBy("model_id", by).agg(
        part(1).alias("pc1"), part(2).alias("pc2"), F.sum(square).alias("retained")
    )
    whole = Window.partitionBy("model_id")
    share = lambda c: F.when(F.sum(c).over(whole) > EPS, F.col(c) / F.sum(c).over(whole)).otherwise(0.0)
    return grouped.select("model_id", by, *[share(c).alias(c) for c in ("pc1", "pc2", "retained")])


def lag_summary(loadings: DataFrame) -> DataFrame:
    """Energy at lag zero and beyond, and the lag that carries most (the shortest on ties)."""
    energy = loading_energy(loadings, "lag")
    zero = F.coalesce(F.sum(F.when(F.col("lag") == 0, F.col("retained"))), F.lit(0.0))
    return energy.groupBy("model_id").agg(
        zero.alias("zero_lag_energy"),
        (1.0 - zero).alias("nonzero_lag_energy"),
        F.min_by("lag", F.struct(-F.col("retained"), F.col("lag"))).alias("dominant_lag_minutes"),
    )


def loading_plot(loadings: DataFrame) -> DataFrame:
    """Tags on the PC1/PC2 plane: length of their loadings, signed by the dominant lag."""
    parts = []
    for name, i in (("pc1", 1), ("pc2", 2)):
        one = loadings.where(F.col("component") == i).groupBy("model_id", "tag").agg(
            F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("length"),
            F.min_by(
                F.struct("loading", "lag"), F.struct(-F.abs(F.col("loading")), F.col("j"))
            ).alias("peak"),
            F.count(F.lit(1)).alias("lag_feature_count"),
        )
        signed = F.when(F.col("length") <= EPS, 0.0).otherwise(
            F.when(F.col("peak.loading") < 0, -F.col("length")).otherwise(F.col("length"))
        )
        parts.append(
            one.select(
                "model_id",
                "tag",
                signed.alias(name),
                F.col("peak.lag").alias(f"{name}_dominant_lag_minutes"),
                *(["lag_feature_count"] if i == 1 else []),
            )
        )
    return parts[0].join(parts[1], ["model_id", "tag"]).withColumn(
        "magnitude", F.hypot("pc1", "pc2")
    )


def parameter_differences(parameters: DataFrame, baseline: str) -> DataFrame:
    """Settings (model_id, parameter, value) that differ from the baseline model's."""
    base = parameters.where(F.col("model_id") == baseline).select(
        "parameter", F.col("value").alias("baseline_value")
    )
    return (
        parameters.where(F.col("model_id") != baseline)
        .join(F.broadcast(base), "parameter")
        .where(~F.col("value").eqNullSafe(F.col("baseline_value")))
        .select("model_id", "parameter", "baseline_value", "value")
    )


def comparability(parameters: DataFrame, baseline: str) -> DataFrame:
    """Per model, whether it may be compared with the baseline, and what stands against it."""
    others = parameters.where(F.col("model_id") != baseline).select("model_id").distinct()
    reasons = (
        parameter_differences(parameters, baseline)
        .where(F.col("parameter").isin(*COMPARABLE_KEYS))
        .groupBy("model_id")
        .agg(F.array_sort(F.collect_set("parameter")).alias("reasons"))
    )
    return others.join(reasons, "model_id", "left").select(
        "model_id",
        F.col("reasons").isNull().alias("comparable"),
        F.concat_ws(",", "reasons").alias("reasons"),
    )


def unpivot_settings(model: DataFrame, names: Sequence[str]) -> DataFrame:
    """Settings stored as JSON with each model, one row per setting."""
    cells = [
        F.struct(F.lit(n).alias("parameter"), F.get_json_object("config_json", f"$.{n}").alias("value"))
        for n in names
    ]
    return model.select("model_id", F.inline(F.array(*cells)))
