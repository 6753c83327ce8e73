"""Models as four tables, so that many models can be stored and compared together."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procmon.functions.columns import parse_feature
from procmon.operators.scoring import EPS, Model

TABLES = ("model", "feature_params", "loadings", "spectrum")

_MODEL = """model_id string, version int, n long, k int, p int, t2_95 double, t2_99 double,
q_95 double, q_99 double, config_json string"""
_PARAMS = "model_id string, j int, feature string, tag string, lag int, mean double, scale double"
_LOADINGS = "model_id string, component int, j int, feature string, tag string, lag int, loading double"
_SPECTRUM = "model_id string, i int, eigenvalue double, explained double"


def model_tables(
    spark: SparkSession,
    models: Mapping[str, Model],
    configs: Mapping[str, Mapping] | None = None,
    version: int = 5,
) -> dict[str, DataFrame]:
    """The tables of one or more models; a model is p x k numbers, so rows are built here."""
    head, params, loadings, spectrum = [], [], [], []
    for name, m in models.items():
        config = json.dumps((configs or {}).get(name, {}), sort_keys=True, default=str)
        head.append(
            (name, version, m.n_samples, m.k, len(m.features), *map(float, m.t2_limits),
             *map(float, m.q_limits), config)
        )
        places = [(j, f, *parse_feature(f)) for j, f in enumerate(m.features)]
        params += [
            (name, *place, float(mean), float(scale))
            for place, mean, scale in zip(places, m.mean, m.scale)
        ]
        loadings += [
            (name, i + 1, *place, float(value))
            for i, row in enumerate(m.components)
            for place, value in zip(places, row)
        ]
        spectrum += [
            (name, i + 1, float(e), float(r)) for i, (e, r) in enumerate(zip(m.eigenvalues, m.explained))
        ]
    schemas = (_MODEL, _PARAMS, _LOADINGS, _SPECTRUM)
    rows = (head, params, loadings, spectrum)
    return {n: spark.createDataFrame(r, s) for n, r, s in zip(TABLES, rows, schemas)}


def series_model_tables(
    models: DataFrame, features: Sequence[str], keys: Sequence[str] = ("series_id",)
) -> dict[str, DataFrame]:
    """The same tables from the result of `fit_series`; the series is the model id."""
    named = models.where("problem IS NULL").withColumn(
        "model_id", F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    )
    places = [(f, *parse_feature(f)) for f in features]
    info = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.lit(t).alias("tag"), F.lit(l).alias("lag"))
            for f, t, l in places
        ]
    )
    pick = lambda field: F.get(info, F.col("j")).getField(field).alias(field)
    model = named.select(
        "model_id", F.lit(5).alias("version"), "n", "k", F.lit(len(features)).alias("p"),
        "t2_95", "t2_99", "q_95", "q_99", F.lit("{}").alias("config_json"),
    )
    params = named.select(
        "model_id", "scale", F.posexplode("mean").alias("j", "mean")
    ).select("model_id", "j", pick("feature"), pick("tag"), pick("lag"), "mean", F.get("scale", "j").alias("scale"))
    rows = named.select("model_id", F.posexplode("components").alias("i", "row"))
    loadings = rows.select("model_id", "i", F.posexplode("row").alias("j", "loading")).select(
        "model_id", (F.col("i") + 1).alias("component"), "j", pick("feature"), pick("tag"), pick("lag"), "loading"
    )
    spectrum = named.select(
        "model_id", "explained", F.posexplode("eigenvalues").alias("i", "eigenvalue")
    ).select("model_id", (F.col("i") + 1).alias("i"), "eigenvalue", F.get("explained", "i").alias("explained"))
    return {"model": model, "feature_params": params, "loadings": loadings, "spectrum": spectrum}


def save_model_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "error") -> None:
    for name in TABLES:
        tables[name].write.mode(mode).parquet(f"{path}/{name}")


def load_model_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def load_model(tables: Mapping[str, DataFrame], model_id: str) -> tuple[Model, dict]:
    """One model and its settings, after the integrity checks."""
    problems = [r["problem"] for r in model_problems(tables).where(F.col("model_id") == model_id).collect()]
    if problems:
        raise ValueError(f"model {model_id} is damaged: {', '.join(sorted(problems))}")
    one = {n: t.where(F.col("model_id") == model_id) for n, t in tables.items()}
    head = one["model"].collect()
    if len(head) != 1:
        raise ValueError(f"there is no single model {model_id}")
    head = head[0]
    params = one["feature_params"].orderBy("j").collect()
    spectrum = one["spectrum"].orderBy("i").collect()
    components = np.zeros((head["k"], head["p"]))
    for row in one["loadings"].collect():
        components[row["component"] - 1, row["j"]] = row["loading"]
    model = Model(
        tuple(r["feature"] for r in params),
        [r["mean"] for r in params],
        [r["scale"] for r in params],
        components,
        [r["eigenvalue"] for r in spectrum],
        [r["explained"] for r in spectrum],
        (head["t2_95"], head["t2_99"]),
        (head["q_95"], head["q_99"]),
        head["n"],
    )
    return model, json.loads(head["config_json"])


def model_problems(tables: Mapping[str, DataFrame], tolerance: float = 1e-6) -> DataFrame:
    """Integrity faults of any number of models: model_id, problem. Empty when all are sound."""
    model, params = tables["model"], tables["feature_params"]
    loadings, spectrum = tables["loadings"], tables["spectrum"]
    finite = lambda *names: F.forall(
        F.array(*[F.col(n) for n in names]), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))
    )
    found = []

    def report(frame: DataFrame, condition, problem: str) -> None:
        found.append(frame.where(condition).select("model_id", F.lit(problem).alias("problem")).distinct())

    def counted(frame):
        return frame.groupBy("model_id").agg(F.count(F.lit(1)).alias("rows"))

    shapes = (
        model.join(counted(params).withColumnRenamed("rows", "n_params"), "model_id", "left")
        .join(counted(loadings).withColumnRenamed("rows", "n_loadings"), "model_id", "left")
        .join(counted(spectrum).withColumnRenamed("rows", "n_spectrum"), "model_id", "left")
    )
    report(shapes, ~F.coalesce(F.col("n_params") == F.col("p"), F.lit(False)), "feature_count")
    report(shapes, ~F.coalesce(F.col("n_loadings") == F.col("p") * F.col("k"), F.lit(False)), "loading_count")
    full = F.least(F.col("n") - 1, F.col("p").cast("long"))
    report(shapes, ~F.coalesce(F.col("n_spectrum") == full, F.lit(False)), "spectrum_count")
    report(shapes, (F.col("n") < 3) | (F.col("k") < 1) | (F.col("k") >= full), "sample_or_component_count")
    report(params, ~finite("mean", "scale") | (F.col("scale") <= EPS), "standardisation")
    report(loadings, ~finite("loading"), "loading_values")
    levels = spectrum.join(model.select("model_id", "k"), "model_id")
    report(levels, ~finite("eigenvalue", "explained") | (F.col("explained") < 0), "spectrum_values")
    report(levels, (F.col("i") <= F.col("k")) & (F.col("eigenvalue") <= EPS), "retained_eigenvalues")
    sums = levels.groupBy("model_id").agg(
        F.sum("explained").alias("total"),
        F.max(F.when(F.col("i") > F.col("k"), F.col("eigenvalue"))).alias("rest"),
    )
    report(sums, F.col("total") > 1 + tolerance, "explained_variance")
    report(sums, ~F.coalesce(F.col("rest") > EPS, F.lit(False)), "no_residual_space")
    a = loadings.select("model_id", "j", F.col("component").alias("a"), F.col("loading").alias("la"))
    b = loadings.select("model_id", "j", F.col("component").alias("b"), F.col("loading").alias("lb"))
    gram = (
        a.join(b, ["model_id", "j"])
        .where(F.col("a") <= F.col("b"))
        .groupBy("model_id", "a", "b")
        .agg(F.sum(F.col("la") * F.col("lb")).alias("g"))
    )
    ideal = F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)
    report(gram, F.abs(F.col("g") - ideal) > F.lit(tolerance) + tolerance * ideal, "not_orthonormal")
    limits = ["t2_95", "t2_99", "q_95", "q_99"]
    wrong = (
        ~finite(*limits)
        | (F.col("t2_95") <= 0)
        | (F.col("t2_95") > F.col("t2_99"))
        | (F.col("q_95") < 0)
        | (F.col("q_95") > F.col("q_99"))
    )
    report(model, wrong, "control_limits")
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result
