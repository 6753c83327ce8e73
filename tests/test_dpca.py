import numpy as np
import pytest
from pyspark.sql import functions as F

from procmon.operators import diagnostics, dpca, tsqr
from procmon.operators.scoring import Model, score
from procmon.sources import model_store

FEATURES = [f"{t}__lag_{l:03d}min" for l in (0, 5) for t in ("A.PV", "B", "C")]


def matrix(seed=7, n=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    loads = rng.normal(size=(2, 6))
    return x @ loads + rng.normal(scale=0.3, size=(n, 6)) + np.arange(6) * 10


def frame(spark, values, key="s"):
    rows = [(key, *map(float, row)) for row in values]
    return spark.createDataFrame(rows, ["series_id", *FEATURES])


def by_svd(values):
    z = (values - values.mean(0)) / values.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    return z, s**2 / (len(z) - 1), vt


def test_fit_equals_svd(spark):
    values = matrix()
    model = dpca.fit(frame(spark, values), FEATURES)
    z, eigenvalues, vt = by_svd(values)
    assert model.eigenvalues == pytest.approx(eigenvalues, rel=1e-9)
    share = np.cumsum(eigenvalues) / eigenvalues.sum()
    assert model.k == max(2, int(np.searchsorted(share, 0.95)) + 1)
    for row, want in zip(model.components, vt):
        assert row[np.abs(row).argmax()] > 0
        assert np.abs(row) == pytest.approx(np.abs(want), abs=1e-9)
    assert 0 < model.t2_limits[0] < model.t2_limits[1]
    assert 0 < model.q_limits[0] < model.q_limits[1]


@pytest.mark.parametrize("k", [2, 5])
def test_scores_by_expression_and_by_matrix(spark, monkeypatch, k):
    values = matrix()
    model = dpca.fit(frame(spark, values), FEATURES, n_components=k)
    z, eigenvalues, _ = by_svd(values)
    t = z @ model.components.T
    want_t2 = (t**2 / eigenvalues[:k]).sum(1)
    want_spe = ((z - t @ model.components) ** 2).sum(1)
    for terms in (256, 0):
        monkeypatch.setattr("procmon.operators.scoring.EXPRESSION_TERMS", terms)
        rows = score(frame(spark, values), model).collect()
        assert [r["t2"] for r in rows] == pytest.approx(want_t2, rel=1e-8)
        assert [r["spe"] for r in rows] == pytest.approx(want_spe, rel=1e-8)


def test_one_model_per_series(spark):
    a, b = matrix(1), matrix(2, 80)
    flat = np.ones((10, 6))
    df = frame(spark, a, "a").union(frame(spark, b, "b")).union(frame(spark, flat, "c")).repartition(6)
    models = dpca.fit_series(df, FEATURES)
    found = {r["series_id"]: r for r in models.collect()}
    for key, values in (("a", a), ("b", b)):
        single = dpca.fit(frame(spark, values), FEATURES)
        assert found[key]["eigenvalues"] == pytest.approx(single.eigenvalues, rel=1e-9)
        assert found[key]["k"] == single.k
        assert found[key]["q_95"] == pytest.approx(single.q_limits[0], rel=1e-9)
        assert np.array(found[key]["components"]) == pytest.approx(single.components, abs=1e-8)
    assert "constant" in found["c"]["problem"]
    scored = dpca.score_series(df, models, FEATURES).where("series_id = 'a'")
    want = score(frame(spark, a), dpca.fit(frame(spark, a), FEATURES))
    assert sorted(r["t2"] for r in scored.collect()) == pytest.approx(
        sorted(r["t2"] for r in want.collect()), rel=1e-8
    )


def test_fit_refuses_bad_matrices(spark):
    flat = matrix()
    flat[:, 2] = 4.0
    with pytest.raises(dpca.FitError, match="constant"):
        dpca.fit(frame(spark, flat), FEATURES)
    copy = matrix()
    copy[:, 2:] = copy[:, [0]]
    with pytest.raises(dpca.FitError, match="rank"):
        dpca.fit(frame(spark, copy), FEATURES)
    report = dpca.matrix_report(frame(spark, copy), FEATURES)
    assert report["code"] == "insufficient_effective_rank"


def test_rank_of_copied_and_of_nearly_copied_columns(spark):
    values = matrix(3, 400) * 1e-3 + 1e4
    values[:, 5] = values[:, 0]
    found = dpca.moments(frame(spark, values).repartition(9), FEATURES)
    eigenvalues, _ = found.decomposed()
    assert dpca.effective_rank(eigenvalues) == 5
    near = matrix(3, 400)
    near[:, 5] = near[:, 0] + 1e-6 * np.random.default_rng(1).normal(size=400)
    eigenvalues, _ = dpca.moments(frame(spark, near).repartition(9), FEATURES).decomposed()
    assert dpca.effective_rank(eigenvalues) == 6
    assert eigenvalues == pytest.approx(by_svd(near)[1], rel=1e-6)


@pytest.mark.parametrize("held", [60, 4_000_000])
def test_factors_do_not_depend_on_the_tasks(spark, monkeypatch, held):
    monkeypatch.setattr(tsqr, "HELD_NUMBERS", held)
    values = {"a": matrix(1, 700), "b": matrix(2, 2), "c": matrix(4, 40)}
    values["c"][3, 2] = np.nan
    df = None
    for key, rows in values.items():
        df = frame(spark, rows, key) if df is None else df.union(frame(spark, rows, key))
    for n in (1, 7):
        found = {r["series_id"]: r for r in tsqr.factors(df.repartition(n), FEATURES, ["series_id"]).toPandas().to_dict("records")}
        assert {k: (r["n"], r["bad"]) for k, r in found.items()} == {"a": (700, 0), "b": (2, 0), "c": (39, 1)}
        for key, r in found.items():
            good = values[key][np.isfinite(values[key]).all(1)]
            r_ = np.array(r["r"]).reshape(-1, 6)
            assert np.array(r["mean"]) == pytest.approx(good.mean(0), rel=1e-12)
            assert r_.T @ r_ == pytest.approx((good - good.mean(0)).T @ (good - good.mean(0)), rel=1e-9, abs=1e-9)
    assert tsqr.factors(df.limit(0), FEATURES).count() == 0


def test_a_fit_reads_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    names = [f"x{i}" for i in range(6)]
    df = frame(spark, matrix()).toDF("series_id", *names)
    rows = df.mapInPandas(counted, df.schema)
    dpca.fit(rows, names)
    assert read.value == 300
    dpca.fit_series(rows, names)
    assert read.value == 600
    with pytest.raises(dpca.FitError, match="non-finite"):
        dpca.fit(df.withColumn("x1", F.lit(None).cast("double")), names)


def test_store_and_checks(spark, tmp_path):
    model = dpca.fit(frame(spark, matrix()), FEATURES)
    tables = model_store.model_tables(spark, {"m": model}, {"m": {"tags": ["A.PV", "B", "C"]}})
    model_store.save_model_tables(tables, str(tmp_path / "models"))
    again, config = model_store.load_model(
        model_store.load_model_tables(spark, str(tmp_path / "models")), "m"
    )
    assert config == {"tags": ["A.PV", "B", "C"]}
    assert again.components == pytest.approx(model.components, abs=0)
    bad = {**tables, "loadings": tables["loadings"].selectExpr(
        "model_id", "component", "j", "feature", "tag", "lag", "loading * 1.1 AS loading")}
    assert [r["problem"] for r in model_store.model_problems(bad).collect()] == ["not_orthonormal"]

    energy = {r["tag"]: r for r in diagnostics.loading_energy(tables["loadings"], "tag").collect()}
    for tag, at in (("A.PV", [0, 3]), ("B", [1, 4])):
        assert energy[tag]["pc1"] == pytest.approx((model.components[0, at] ** 2).sum())
    assert sum(r["retained"] for r in energy.values()) == pytest.approx(1)
    plot = {r["tag"]: r for r in diagnostics.loading_plot(tables["loadings"]).collect()}
    peak = model.components[1, [2, 5]]
    assert plot["C"]["pc2"] == pytest.approx(
        np.sign(peak[np.abs(peak).argmax()]) * np.linalg.norm(peak)
    )
    row = diagnostics.structure(tables).collect()[0]
    share = np.cumsum(model.explained)
    assert row["components_for_90"] == int(np.flatnonzero(share >= 0.9)[0]) + 1
    assert diagnostics.lag_summary(tables["loadings"]).collect()[0]["zero_lag_energy"] == pytest.approx(
        (model.components[:, :3] ** 2).sum() / (model.components**2).sum()
    )
