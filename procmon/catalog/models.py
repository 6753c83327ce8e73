"""Fitting, scoring, replay, contributions and diagnostics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from procmon.catalog.registry import number, query, r, rounded, t, text_time, with_ctes
from procmon.catalog.timegrid import BASE, CLASSES, FEATURES, SHARD, TAGS, class_ctes, prepared
from procmon.catalog.views import DAY, supply, supply_times, table, vector_feature, vectors
from procmon.config import MINUTE
from procmon.operators import contributions, diagnostics, dpca
from procmon.operators.replay import replay, replay_contributions, replay_summary
from procmon.operators.scoring import Model, focus_row, score, status_counts
from procmon.sources import model_store

# A small model over three tags at three lags.
_S6 = 6.0**-0.5
MODEL = Model(
    features=FEATURES,
    mean=[25.5, 38000.0, 0.051] * 3,
    scale=[7.0, 12000.0, 0.015] * 3,
    components=[[1 / 3] * 9, [_S6, -_S6, 0.0] * 3],
    eigenvalues=[2.0, 1.5, 1.2, 1.0, 0.9, 0.8, 0.6, 0.5, 0.4],
    explained=[v / 8.9 for v in (2.0, 1.5, 1.2, 1.0, 0.9, 0.8, 0.6, 0.5, 0.4)],
    t2_limits=(2.4, 4.4),
    q_limits=(6.1, 10.3),
    n_samples=1000,
)
META = {"qty": {"description": "Quantity", "unit": "pcs"}, "price": {"description": "Price", "unit": "USD"}}
COLUMNS = [f"{v}_l{i}" for i in range(3) for v in TAGS]


def score_ctes(source: str, columns=COLUMNS, model: Model = MODEL, keep: str = "*") -> dict[str, str]:
    """Standardised values, components, residuals and statistics of the rows of `source`."""
    p, k = len(columns), model.k
    weighted = lambda names, weights: " + ".join(f"{n} * {number(w)}" for n, w in zip(names, weights))
    zs, ts = [f"z{j}" for j in range(p)], [f"p{i}" for i in range(k)]
    return {
        "sz": f"SELECT {keep}, "
        + ", ".join(
            f"({c} - {number(m)}) / {number(s)} AS {z}" for c, m, s, z in zip(columns, model.mean, model.scale, zs)
        )
        + f" FROM {source}",
        "st": "SELECT *, " + ", ".join(f"{weighted(zs, row)} AS p{i}" for i, row in enumerate(model.components)) + " FROM sz",
        "sr": "SELECT *, " + ", ".join(f"{z} - ({weighted(ts, model.components[:, j])}) AS r{j}" for j, z in enumerate(zs)) + " FROM st",
        "s0": "SELECT *, "
        + " + ".join(f"p{i} * p{i} / {number(e)}" for i, e in enumerate(model.eigenvalues[:k]))
        + " AS t2, "
        + " + ".join(f"r{j} * r{j}" for j in range(p))
        + " AS spe FROM sr",
        "scored": f"""SELECT *, CASE WHEN t2 >= {number(model.t2_limits[1])} THEN 2 WHEN t2 >= {number(model.t2_limits[0])} THEN 1 ELSE 0 END AS c2,
          CASE WHEN spe >= {number(model.q_limits[1])} THEN 2 WHEN spe >= {number(model.q_limits[0])} THEN 1 ELSE 0 END AS cq FROM s0""",
    }


def status(code: str) -> str:
    return f"CASE {code} WHEN 2 THEN 'abnormal' WHEN 1 THEN 'attention' ELSE 'normal' END"


SCORE_CTES = {**class_ctes(), "ok": "SELECT * FROM kept WHERE cls = 'valid'", **score_ctes("ok")}
SCORED = with_ctes(**SCORE_CTES)
TIME = t("make_timestamp(us)")


def scored(spark, sf):
    rows = prepared(spark, sf, valid_only=True)
    return score(rows.select("series_id", "ts", *[F.col(f) for f in FEATURES]), MODEL)


NUMBERS = ["pc1", "pc2", "t2", "spe", "t2_limit_ratio", "spe_limit_ratio"]


@query(
    "score_fixed_model",
    SCORED
    + f"""SELECT series_id, {TIME} AS ts, {r('p0')} AS pc1, {r('p1')} AS pc2, {r('t2')} AS t2, {r('spe')} AS spe,
      {r(f't2 / {number(MODEL.t2_limits[0])}')} AS t2_limit_ratio, {r(f'spe / {number(MODEL.q_limits[0])}')} AS spe_limit_ratio,
      {status('c2')} AS t2_status, {status('cq')} AS spe_status, {status('greatest(c2, cq)')} AS status FROM scored""",
)
def score_fixed_model(spark, sf):
    s = scored(spark, sf)
    return s.select(
        "series_id", text_time(F.col("ts")).alias("ts"), *[rounded(F.col(n)).alias(n) for n in NUMBERS],
        "t2_status", "spe_status", "status",
    )


@query(
    "score_status",
    SCORED
    + """SELECT series_id, count(*) FILTER (greatest(c2, cq) = 0) AS normal, count(*) FILTER (greatest(c2, cq) = 1) AS attention,
      count(*) FILTER (greatest(c2, cq) = 2) AS abnormal, CAST(0 AS BIGINT) AS not_scored FROM scored GROUP BY 1""",
)
def score_status(spark, sf):
    return status_counts(scored(spark, sf), ["series_id"])


_SHARE = f"greatest(t2 / {number(MODEL.t2_limits[1])}, spe / {number(MODEL.q_limits[1])})"


@query(
    "focus_time",
    SCORED + f"SELECT series_id, {t(f'make_timestamp(arg_min(us, (-{_SHARE}, us)))')} AS focus_ts, {r(f'max({_SHARE})')} AS focus_ratio FROM scored GROUP BY 1",
)
def focus_time(spark, sf):
    f = focus_row(scored(spark, sf), MODEL)
    return f.select("series_id", text_time(F.col("focus_ts")).alias("focus_ts"), rounded(F.col("focus_ratio")).alias("focus_ratio"))


# ---- wide vectors --------------------------------------------------------------------

_P, _K = 64, 5


def _cosine_model() -> Model:
    """A fixed orthonormal basis from the cosine rule; 64 features, five components."""
    j = np.arange(_P)
    basis = np.array([np.sqrt(2 / _P) * np.cos(np.pi * (2 * j + 1) * (i + 1) / (2 * _P)) for i in range(_K)])
    spectrum = np.linspace(2.0, 0.2, _P)
    return Model(
        [vector_feature(x) for x in range(_P)], [0.0] * _P, [0.125] * _P, basis, spectrum,
        spectrum / spectrum.sum(), (9.0, 14.0), (62.0, 80.0), 500,
    )


WIDE = _cosine_model()
_WIDE_CTES = {
    "v": "SELECT CAST(label AS VARCHAR) AS series_id, vec_id, "
    + ", ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) AS x{j}" for j in range(_P))
    + " FROM embeddings",
    **score_ctes("v", [f"x{j}" for j in range(_P)], WIDE, "series_id, vec_id"),
}


@query(
    "score_wide_model",
    with_ctes(**_WIDE_CTES) + f"SELECT series_id, vec_id, {r('t2')} AS t2, {r('spe')} AS spe, {status('greatest(c2, cq)')} AS status FROM scored",
)
def score_wide_model(spark, sf):
    s = score(vectors(spark, sf), WIDE)
    return s.select("series_id", "vec_id", rounded(F.col("t2")).alias("t2"), rounded(F.col("spe")).alias("spe"), "status")


def shares_sql(places: list[list[int]], tags: list[str], lags: list[int], magnitudes: str) -> str:
    """Tag shares and lag ranges of the array column `m` of `magnitudes`, as a select list over tags.

    Lags are three, so the stretch around the peak is spelled out.
    """
    parts = []
    for tag, spots in zip(tags, places):
        a, b, c = (f"m[{j + 1}]" for j in spots)
        peak = f"greatest({a}, {b}, {c})"
        half = f"0.5e0 * {peak}"
        at = f"CASE WHEN {a} = {peak} THEN 0 WHEN {b} = {peak} THEN 1 ELSE 2 END"
        first = f"CASE {at} WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN {a} >= {half} THEN 0 ELSE 1 END ELSE CASE WHEN {b} < {half} THEN 2 WHEN {a} < {half} THEN 1 ELSE 0 END END"
        last = f"CASE {at} WHEN 2 THEN 2 WHEN 1 THEN CASE WHEN {c} >= {half} THEN 2 ELSE 1 END ELSE CASE WHEN {b} < {half} THEN 0 WHEN {c} < {half} THEN 1 ELSE 2 END END"
        lag = lambda e: f"CASE {e} WHEN 0 THEN {lags[0]} WHEN 1 THEN {lags[1]} ELSE {lags[2]} END"
        parts.append(
            f"""SELECT series_id, us, statistic, value, '{tag}' AS tag, ({a} + {b} + {c}) / list_sum(m) * 100 AS pct,
            {lag(first)} AS lag_start, {lag(last)} AS lag_end FROM {magnitudes}"""
        )
    return " UNION ALL ".join(parts)


def magnitude_ctes(source: str = "scored") -> dict[str, str]:
    p, k = len(FEATURES), MODEL.k
    pull = [
        "abs(z%d * (%s))" % (j, " + ".join(f"p{i} * {number(MODEL.components[i, j] / MODEL.eigenvalues[i])}" for i in range(k)))
        for j in range(p)
    ]
    places = [[lag * len(TAGS) + i for lag in range(3)] for i in range(len(TAGS))]
    return {
        "mag": f"""SELECT series_id, us, 't2' AS statistic, t2 AS value, [{', '.join(pull)}] AS m FROM {source} WHERE c2 > 0
          UNION ALL SELECT series_id, us, 'spe', spe, [{', '.join(f'r{j} * r{j}' for j in range(p))}] FROM {source} WHERE cq > 0""",
        "shares": shares_sql(places, TAGS, BASE.lags, "mag"),
    }


@query(
    "contribution_tags",
    with_ctes(**SCORE_CTES, **magnitude_ctes())
    + f"""SELECT series_id, {TIME} AS ts, statistic, {r('value')} AS statistic_value, tag,
      CASE tag WHEN 'qty' THEN 'pcs' WHEN 'price' THEN 'USD' ELSE '' END AS unit, {r('pct')} AS contribution_pct,
      lag_start AS lag_start_minutes, lag_end AS lag_end_minutes,
      row_number() OVER (PARTITION BY series_id, us, statistic ORDER BY pct DESC, tag) - 1 AS place FROM shares""",
)
def contribution_tags(spark, sf):
    c = contributions.exceedance_contributions(scored(spark, sf), MODEL, META)
    c = c.select("series_id", "ts", "statistic", "statistic_value", F.posexplode("tags").alias("place", "tag_"))
    return c.select(
        "series_id", text_time(F.col("ts")).alias("ts"), "statistic",
        rounded(F.col("statistic_value")).alias("statistic_value"), "place", "tag_.tag", "tag_.unit",
        rounded(F.col("tag_.contribution_pct")).alias("contribution_pct"), "tag_.lag_start_minutes", "tag_.lag_end_minutes",
    )


_M = magnitude_ctes()


@query(
    "contribution_features",
    with_ctes(**SCORE_CTES, mag=_M["mag"])
    + f"""SELECT series_id, {TIME} AS ts, statistic, j, {r('m[j + 1]')} AS magnitude FROM (SELECT *, unnest(range({len(FEATURES)})) AS j FROM mag)""",
)
def contribution_features(spark, sf):
    c = contributions.exceedance_contributions(scored(spark, sf), MODEL)
    c = c.select("series_id", "ts", "statistic", F.posexplode("magnitudes").alias("j", "magnitude"))
    return c.select(
        "series_id", text_time(F.col("ts")).alias("ts"), "statistic", "j", rounded(F.col("magnitude")).alias("magnitude")
    )


# ---- events --------------------------------------------------------------------------

INTERVAL = BASE.interval_us


def event_ctes(part: str, flag_source: str, facts: str = "") -> dict[str, str]:
    return {
        "ev0": f"""SELECT *, coalesce(us - lag(us) OVER (PARTITION BY {part} ORDER BY us) <> {INTERVAL}, true) AS nb FROM ({flag_source})""",
        "ev1": f"SELECT *, sum(CAST(nb AS INT)) OVER (PARTITION BY {part} ORDER BY us) AS ev FROM ev0",
        "ev": f"SELECT {part}, ev, min(us) AS a, max(us) AS b, count(*) AS c{facts} FROM ev1 GROUP BY {part}, ev",
    }


STATISTIC_ROWS = f"""SELECT series_id, us, 't2' AS statistic, t2 AS value, {number(MODEL.t2_limits[0])} AS lim FROM scored WHERE c2 > 0
  UNION ALL SELECT series_id, us, 'spe', spe, {number(MODEL.q_limits[0])} FROM scored WHERE cq > 0"""
EVENT_CTES = event_ctes(
    "series_id, statistic", STATISTIC_ROWS,
    ", arg_min(us, (-value / lim, us)) AS peak, arg_min(value, (-value / lim, us)) AS pv",
)


@query(
    "exceedance_events",
    with_ctes(**SCORE_CTES, **EVENT_CTES)
    + f"""SELECT series_id, statistic, {t('make_timestamp(a)')} AS event_start, {t('make_timestamp(b)')} AS event_end,
      c AS point_count, {t('make_timestamp(peak)')} AS peak_ts, {r('pv')} AS statistic_value FROM ev""",
)
def exceedance_events(spark, sf):
    e = contributions.statistic_events(scored(spark, sf), MODEL, INTERVAL, width=40 * INTERVAL)
    return e.select(
        "series_id", "statistic", text_time(F.col("event_start")).alias("event_start"),
        text_time(F.col("event_end")).alias("event_end"), "point_count",
        text_time(F.col("peak_ts")).alias("peak_ts"), rounded(F.col("statistic_value")).alias("statistic_value"),
    )


@query(
    "combined_events",
    with_ctes(**SCORE_CTES, **event_ctes("series_id", "SELECT series_id, us FROM scored WHERE greatest(c2, cq) > 0"))
    + f"SELECT series_id, {t('make_timestamp(a)')} AS event_start, {t('make_timestamp(b)')} AS event_end, c AS point_count FROM ev",
)
def combined(spark, sf):
    e = contributions.combined_events(scored(spark, sf), MODEL, INTERVAL, width=40 * INTERVAL)
    return e.select(
        "series_id", text_time(F.col("event_start")).alias("event_start"),
        text_time(F.col("event_end")).alias("event_end"), "point_count",
    )


@query(
    "event_contributions",
    with_ctes(**SCORE_CTES, **EVENT_CTES, **magnitude_ctes())
    + f"""SELECT e.series_id, e.statistic, {t('make_timestamp(a)')} AS event_start, tag, {r('pct')} AS contribution_pct,
      lag_start AS lag_start_minutes, lag_end AS lag_end_minutes
    FROM ev e JOIN shares s ON s.series_id = e.series_id AND s.statistic = e.statistic AND s.us = e.peak""",
)
def event_shares(spark, sf):
    e = contributions.event_contributions(scored(spark, sf), MODEL, INTERVAL)
    e = e.select("series_id", "statistic", text_time(F.col("event_start")).alias("event_start"), F.inline("tags"))
    return e.select(
        "series_id", "statistic", "event_start", "tag", rounded(F.col("contribution_pct")).alias("contribution_pct"),
        "lag_start_minutes", "lag_end_minutes",
    )


# ---- replay --------------------------------------------------------------------------

_START, _END = "1997-01-15T00:00:00", "2000-06-15T00:00:00"


def _history_ctes():
    """The same pipeline over the replay's history only."""
    ctes = class_ctes()
    first = f"epoch_us(TIMESTAMP '1997-01-15') - {BASE.context_minutes * MINUTE}"
    ctes["raw"] = f"SELECT * FROM ({ctes['raw']}) WHERE ts <= TIMESTAMP '2000-06-15' AND epoch_us(ts) >= {first}"
    return ctes


_REPLAY_ROWS = f"""SELECT *, CASE WHEN cls = 'valid' THEN NULL WHEN seg <> 1 THEN 'time_gap_reset' WHEN fseg <> 1 THEN 'insufficient_context'
  WHEN cls IN ('filter_warmup', 'lag_warmup') THEN 'warming_up' ELSE 'insufficient_context' END AS reason
  FROM kept WHERE us BETWEEN epoch_us(TIMESTAMP '1997-01-15') AND epoch_us(TIMESTAMP '2000-06-15')"""
_REPLAY_CTES = {
    **{n: s.replace("beyond THEN 'engineering_range'", "false THEN 'engineering_range'") for n, s in _history_ctes().items()},
    "rep": _REPLAY_ROWS,
    **score_ctes("rep"),
}


def _replay(spark, sf):
    return replay(
        supply(spark, sf), MODEL, TAGS, BASE, _START, _END, source_interval_minutes=DAY, shard_minutes=SHARD,
        times=supply_times(spark, sf),
    )


@query(
    "replay_scores",
    with_ctes(**_REPLAY_CTES)
    + f"""SELECT series_id, {TIME} AS ts, {r('t2')} AS t2, {r('spe')} AS spe,
      CASE WHEN reason IS NULL THEN {status('greatest(c2, cq)')} ELSE 'not_scored' END AS status, reason AS invalid_reason FROM scored""",
)
def replay_scores(spark, sf):
    s, _ = _replay(spark, sf)
    return s.select(
        "series_id", text_time(F.col("ts")).alias("ts"), rounded(F.col("t2")).alias("t2"),
        rounded(F.col("spe")).alias("spe"), "status", "invalid_reason",
    )


@query(
    "replay_summary",
    with_ctes(**_REPLAY_CTES)
    + f"""SELECT series_id, count(*) AS output_row_count, count(*) FILTER (reason IS NULL) AS score_valid_count,
      count(*) FILTER (reason = 'time_gap_reset') AS reason_time_gap_reset, count(*) FILTER (reason = 'insufficient_context') AS reason_insufficient_context,
      count(*) FILTER (reason = 'warming_up') AS reason_warming_up,
      count(*) FILTER (reason IS NULL AND c2 > 0) AS t2_exceedance_95_count, count(*) FILTER (reason IS NULL AND cq > 1) AS spe_exceedance_99_count,
      {r('max(t2) FILTER (reason IS NULL)')} AS maximum_t2, {r('max(spe) FILTER (reason IS NULL)')} AS maximum_spe FROM scored GROUP BY 1""",
)
def replay_counts(spark, sf):
    s, rows = _replay(spark, sf)
    summary = replay_summary(s, rows, MODEL, _START, _END)
    return summary.select(
        "series_id", "output_row_count", "score_valid_count", "reason_time_gap_reset", "reason_insufficient_context",
        "reason_warming_up", "t2_exceedance_95_count", "spe_exceedance_99_count",
        rounded(F.col("maximum_t2")).alias("maximum_t2"), rounded(F.col("maximum_spe")).alias("maximum_spe"),
    )


@query(
    "replay_contributions",
    with_ctes(**{**_REPLAY_CTES, "sv": "SELECT * FROM scored WHERE reason IS NULL"}, **magnitude_ctes("sv"))
    + f"SELECT series_id, {TIME} AS ts, statistic, tag, {r('pct')} AS contribution_pct FROM shares",
)
def replay_shares(spark, sf):
    s, _ = _replay(spark, sf)
    c = replay_contributions(s, MODEL).select("series_id", text_time(F.col("ts")).alias("ts"), "statistic", F.inline("tags"))
    return c.select("series_id", "ts", "statistic", "tag", rounded(F.col("contribution_pct")).alias("contribution_pct"))


# ---- fitting -------------------------------------------------------------------------


@query(
    "gram_matrix",
    with_ctes(
        v="SELECT vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
    )
    + f"SELECT a.j AS i, b.j AS j, {r('corr(a.x, b.x)')} AS correlation FROM v a JOIN v b USING (vec_id) WHERE a.j <= b.j GROUP BY 1, 2",
)
def gram_matrix(spark, sf):
    found = dpca.moments(vectors(spark, sf), [vector_feature(j) for j in range(64)])
    rows = [(i, j, float(found.correlation[i, j])) for i in range(64) for j in range(i, 64)]
    return spark.createDataFrame(rows, "i long, j long, correlation double").select(
        "i", "j", rounded(F.col("correlation")).alias("correlation")
    )


@query(
    "standardise",
    CLASSES
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {r(f'avg({c})')} AS mean, {r(f'stddev_pop({c})')} AS scale, count(*) AS n FROM kept WHERE cls = 'valid'"
        for f, c in zip(FEATURES, COLUMNS)
    ),
)
def standardise(spark, sf):
    found = dpca.moments(prepared(spark, sf).where("row_class = 'valid'"), FEATURES)
    rows = [(f, float(m), float(s), found.n) for f, m, s in zip(FEATURES, found.mean, found.scale)]
    return spark.createDataFrame(rows, "feature string, mean double, scale double, n long").select(
        "feature", rounded(F.col("mean")).alias("mean"), rounded(F.col("scale")).alias("scale"), "n"
    )


@query("pca_fit")
def pca_fit(spark, sf):
    """Spectrum and limits of a model fitted to all valid rows; checked against an SVD in the tests."""
    model = dpca.fit(prepared(spark, sf).where("row_class = 'valid'"), FEATURES)
    tables = model_store.model_tables(spark, {"supply": model})
    return diagnostics.spectrum_table(tables["spectrum"], tables["model"])


@query("pca_limits")
def pca_limits(spark, sf):
    model = dpca.fit(vectors(spark, sf), [vector_feature(j) for j in range(64)])
    return diagnostics.structure(model_store.model_tables(spark, {"vectors": model}))


def _series_models(spark, sf):
    rows = prepared(spark, sf).where("row_class = 'valid'")
    return dpca.fit_series(rows, FEATURES)


@query("series_models")
def series_models(spark, sf):
    """One model per supplier; checked against single fits in the tests."""
    return _series_models(spark, sf).select("series_id", "n", "k", "t2_95", "t2_99", "q_95", "q_99", "problem")


@query(
    "spectrum_moments",
    with_ctes(
        v="SELECT label, vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
        c="SELECT a.label, a.j AS i, b.j AS j, corr(a.x, b.x) AS c, count(*) AS n FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2, 3",
    )
    + f"""SELECT CAST(label AS VARCHAR) AS series_id, max(n) AS n, {r('sum(c) FILTER (i = j) * max(n) / (max(n) - 1)')} AS total,
      {r('sum(c * c) * power(max(n) / (max(n) - 1), 2)')} AS squares FROM c GROUP BY 1""",
)
def spectrum_moments(spark, sf):
    """Sum and sum of squares of the eigenvalues of one model per label, over all 64 dimensions: trace and squared entries of its correlations."""
    rows = vectors(spark, sf)
    models = dpca.fit_series(rows, [vector_feature(j) for j in range(64)], n_components=2)
    total = lambda f: F.aggregate(F.transform("eigenvalues", f), F.lit(0.0), lambda s, v: s + v)
    return models.select(
        F.col("series_id").cast("string").alias("series_id"), "n", rounded(total(lambda v: v)).alias("total"), rounded(total(lambda v: v * v)).alias("squares")
    )


@query("series_scores")
def series_scores(spark, sf):
    rows = vectors(spark, sf)
    features = [vector_feature(j) for j in range(8)]
    return dpca.score_series(rows, dpca.fit_series(rows, features, n_components=3), features).select(
        "series_id", "vec_id", "t2", "spe", "status"
    )


@query("model_checks")
def model_checks(spark, sf):
    """Integrity faults of the per-label models; sound models give no rows."""
    features = [vector_feature(j) for j in range(8)]
    models = dpca.fit_series(vectors(spark, sf), features, n_components=3)
    return model_store.model_problems(model_store.series_model_tables(models, features))


# ---- diagnostics over loadings derived from the embeddings -----------------------------


def _loadings(spark, sf):
    cells = table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("model_id"), (F.col("vec_id") % 3 + 1).cast("int").alias("component"),
        F.posexplode("embedding").alias("j", "x"),
    )
    return cells.groupBy("model_id", "component", "j").agg(F.avg(F.col("x").cast("double")).alias("loading")).select(
        "model_id", "component", "j", F.format_string("t%d", F.col("j") % 8).alias("tag"),
        (F.floor(F.col("j") / 8) * 5).cast("int").alias("lag"), "loading",
    )


_LOADINGS_SQL = """SELECT CAST(label AS VARCHAR) AS model_id, vec_id % 3 + 1 AS component, j, 't' || (j % 8) AS tag, (j // 8) * 5 AS lag,
  avg(x) AS loading FROM (SELECT label, vec_id, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2, 3, 4, 5"""


def _energy_sql(by):
    return (
        with_ctes(
            l=_LOADINGS_SQL,
            g=f"""SELECT model_id, {by}, sum(loading * loading) FILTER (component = 1) AS a, sum(loading * loading) FILTER (component = 2) AS b,
              sum(loading * loading) AS c FROM l GROUP BY 1, 2""",
        )
        + f"""SELECT model_id, {by}, {r('a / sum(a) OVER (PARTITION BY model_id)')} AS pc1, {r('b / sum(b) OVER (PARTITION BY model_id)')} AS pc2,
          {r('c / sum(c) OVER (PARTITION BY model_id)')} AS retained FROM g"""
    )


def _energy(spark, sf, by):
    e = diagnostics.loading_energy(_loadings(spark, sf), by)
    return e.select("model_id", by, *[rounded(F.col(c)).alias(c) for c in ("pc1", "pc2", "retained")])


@query("loading_energy_tag", _energy_sql("tag"))
def loading_energy_tag(spark, sf):
    return _energy(spark, sf, "tag")


@query("loading_energy_lag", _energy_sql("lag"))
def loading_energy_lag(spark, sf):
    return _energy(spark, sf, "lag")


@query(
    "lag_energy_summary",
    with_ctes(
        l=_LOADINGS_SQL,
        g="SELECT model_id, lag, sum(loading * loading) AS c FROM l GROUP BY 1, 2",
        h="SELECT *, c / sum(c) OVER (PARTITION BY model_id) AS e FROM g",
    )
    + f"""SELECT model_id, {r('sum(e) FILTER (lag = 0)')} AS zero_lag_energy, {r('1 - sum(e) FILTER (lag = 0)')} AS nonzero_lag_energy,
      arg_max(lag, e) AS dominant_lag_minutes FROM h GROUP BY 1""",
)
def lag_energy_summary(spark, sf):
    s = diagnostics.lag_summary(_loadings(spark, sf))
    return s.select(
        "model_id", rounded(F.col("zero_lag_energy")).alias("zero_lag_energy"),
        rounded(F.col("nonzero_lag_energy")).alias("nonzero_lag_energy"), "dominant_lag_minutes",
    )


@query(
    "loading_plot",
    with_ctes(
        l=_LOADINGS_SQL,
        g="""SELECT model_id, tag, component, sqrt(sum(loading * loading)) AS len, arg_max(loading, abs(loading)) AS pk,
             arg_max(lag, abs(loading)) AS pl, count(*) AS n FROM l GROUP BY 1, 2, 3""",
        h="SELECT *, CASE WHEN pk < 0 THEN -len ELSE len END AS s FROM g",
    )
    + f"""SELECT a.model_id, a.tag, {r('a.s')} AS pc1, {r('b.s')} AS pc2, a.pl AS pc1_dominant_lag_minutes, b.pl AS pc2_dominant_lag_minutes,
      {r('sqrt(a.s * a.s + b.s * b.s)')} AS magnitude, a.n AS lag_feature_count
    FROM h a JOIN h b ON a.model_id = b.model_id AND a.tag = b.tag AND a.component = 1 AND b.component = 2""",
)
def loading_plot(spark, sf):
    p = diagnostics.loading_plot(_loadings(spark, sf))
    return p.select(
        "model_id", "tag", *[rounded(F.col(c)).alias(c) for c in ("pc1", "pc2", "magnitude")],
        "pc1_dominant_lag_minutes", "pc2_dominant_lag_minutes", "lag_feature_count",
    )


def _parameters(spark, sf):
    """Settings per supplier region, derived from what its customers order."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy(F.col("c_nationkey").cast("string").alias("model_id")).agg(
        F.max("o_orderpriority").alias("tags"), F.min("o_orderstatus").alias("filter_method"),
        (F.count(F.lit(1)) % 3).cast("string").alias("sample_interval_minutes"),
    )
    names = ["tags", "filter_method", "sample_interval_minutes"]
    return g.select("model_id", F.inline(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("value")) for n in names])))


_PARAMETERS_SQL = with_ctes(
    g="""SELECT CAST(c_nationkey AS VARCHAR) AS model_id, max(o_orderpriority) AS tags, min(o_orderstatus) AS filter_method,
         CAST(count(*) % 3 AS VARCHAR) AS sample_interval_minutes FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    p="""SELECT model_id, 'tags' AS parameter, tags AS value FROM g UNION ALL SELECT model_id, 'filter_method', filter_method FROM g
         UNION ALL SELECT model_id, 'sample_interval_minutes', sample_interval_minutes FROM g""",
    d="""SELECT a.model_id, parameter, b.value AS baseline_value, a.value FROM p a JOIN p b USING (parameter)
         WHERE b.model_id = '0' AND a.model_id <> '0' AND a.value IS DISTINCT FROM b.value""",
)


@query("parameter_differences", _PARAMETERS_SQL + "SELECT * FROM d")
def parameter_differences(spark, sf):
    return diagnostics.parameter_differences(_parameters(spark, sf), "0")


@query(
    "model_comparability",
    _PARAMETERS_SQL
    + """SELECT m.model_id, count(d.parameter) = 0 AS comparable, coalesce(string_agg(d.parameter, ',' ORDER BY d.parameter), '') AS reasons
    FROM (SELECT DISTINCT model_id FROM g WHERE model_id <> '0') m LEFT JOIN d ON d.model_id = m.model_id AND d.parameter <> 'filter_method' GROUP BY 1""",
)
def model_comparability(spark, sf):
    return diagnostics.comparability(_parameters(spark, sf), "0")
