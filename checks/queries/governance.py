"""Evaluation, promotion rules, run records and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.queries.models import (
    HISTORY,
    METRICS,
    ORIGINS,
    SCORED,
    STATE,
    TARGET,
    _test,
    _train,
    small_gbt,
)
from checks.queries.selection import cleaned_parts
from checks.registry import check
from panelforge.operators import baselines, evaluation, explain
from panelforge.session import scratch_path
from panelforge.sources import store

W = sql.with_ctes


def _scored(spark, folder):
    forecasts = baselines.all_baselines(_train(spark, folder), STATE)
    test = baselines.numbered_test(_test(spark, folder), STATE)
    return forecasts.join(test.select(*STATE, "horizon", "y"), [*STATE, "horizon"])


@check(
    "forecast_metrics",
    W(*sql.PANEL) + SCORED + f"SELECT model, horizon, {METRICS} FROM sd GROUP BY ALL",
    doubles="rmse mae mape smape",
)
def forecast_metrics(spark, folder):
    return evaluation.forecast_metrics(_scored(spark, folder), ["model", "horizon"])


# two simple models over all rows: last month and the mean of three months
_SIDES = """, tb AS (SELECT m.model, CASE WHEN ds <= DATE '2000-06-01' THEN 'train' WHEN ds > DATE '2000-12-01' AND ds <= DATE '2001-07-01' THEN 'backtest' END AS split,
    monthly_revenue AS y, CASE m.model WHEN 'last' THEN revenue_lag_1 ELSE revenue_rolling_mean_3 END AS yhat
  FROM s, (SELECT unnest(['last', 'mean3']) AS model) m),
  sides AS (SELECT * FROM tb WHERE yhat IS NOT NULL AND split IS NOT NULL),
  gp AS (SELECT model, sqrt(avg((y - yhat) ** 2) FILTER (split = 'train')) AS rmse_train, sqrt(avg((y - yhat) ** 2) FILTER (split = 'backtest')) AS rmse_backtest,
    avg(abs((y - yhat) / y)) FILTER (split = 'backtest' AND y <> 0) * 100 AS mape_backtest FROM sides GROUP BY 1),
  gap AS (SELECT model, rmse_train, rmse_backtest, rmse_backtest / rmse_train AS gap_rmse_ratio, mape_backtest FROM gp)
"""
_GAP_DOUBLES = "rmse_train rmse_backtest gap_rmse_ratio mape_backtest"


def _gaps(spark, folder):
    rows = inputs.split_series(spark, folder).filter(F.col("split").isin("train", "backtest"))
    guesses = F.array(
        F.struct(F.lit("last").alias("model"), F.col("revenue_lag_1").alias("yhat")),
        F.struct(F.lit("mean3").alias("model"), F.col("revenue_rolling_mean_3").alias("yhat")),
    )
    scored = rows.select("split", F.col(TARGET).alias("y"), F.explode(guesses).alias("g")).select("split", "y", "g.*")
    return evaluation.train_backtest_gap(scored.filter(F.col("yhat").isNotNull()))


@check(
    "train_backtest_gap",
    W(*sql.SERIES) + _SIDES + "SELECT * FROM gap",
    doubles=_GAP_DOUBLES,
    rmse_train=2,
    rmse_backtest=2,
)
def train_backtest_gap(spark, folder):
    return _gaps(spark, folder)


@check(
    "gap_summary",
    W(*sql.SERIES) + _SIDES + "SELECT *, gap_rmse_ratio = max(gap_rmse_ratio) OVER () AS is_worst_gap FROM gap ORDER BY rmse_backtest",
    doubles=_GAP_DOUBLES,
    rmse_train=2,
    rmse_backtest=2,
)
def gap_summary(spark, folder):
    return evaluation.gap_summary(_gaps(spark, folder))


@check(
    "roi",
    W(*sql.PANEL)
    + HISTORY
    + """, fc AS (SELECT * FROM bl WHERE model = 'MovingAverage_3M'), av AS (SELECT avg(monthly_revenue) AS a FROM panel)
    SELECT 192.0::DOUBLE AS time_saved_hours_per_year, 15360.0::DOUBLE AS time_saving_per_year, 7.12 - 5.0 AS mape_improvement_pts,
      max(a) * ((7.12 - 5.0) / 100) * 0.1 * 12 AS accuracy_saving_per_year, 15360 + max(a) * ((7.12 - 5.0) / 100) * 0.1 * 12 AS total_benefit_per_year,
      sum(yhat) AS projected_revenue_horizon, count(*) AS forecast_horizon_months FROM fc, av""",
    doubles="time_saved_hours_per_year time_saving_per_year mape_improvement_pts accuracy_saving_per_year total_benefit_per_year projected_revenue_horizon",
    accuracy_saving_per_year=2,
    total_benefit_per_year=2,
    projected_revenue_horizon=2,
)
def roi(spark, folder):
    forecast = baselines.baseline_moving_average(_train(spark, folder), STATE)
    return evaluation.roi(forecast, inputs.panel(spark, folder), 5.0, inputs.SETTINGS)


# ---- run records: one run per origin and baseline model ----

_RUNS_SQL = f""", og AS (SELECT CAST(unnest({ORIGINS}) AS DATE) AS origin),
  h AS (SELECT origin, customer_state, ds, monthly_revenue AS y, row_number() OVER (PARTITION BY origin, customer_state ORDER BY ds) - 1 AS pos,
    count(*) OVER (PARTITION BY origin, customer_state) AS n FROM panel JOIN og ON ds <= origin),
  fu AS (SELECT origin, customer_state, monthly_revenue AS y, row_number() OVER (PARTITION BY origin, customer_state ORDER BY ds) AS horizon
    FROM panel JOIN og ON ds > origin QUALIFY horizon <= 3),
  fit AS (SELECT origin, customer_state, arg_max(y, pos) AS a, avg(y) FILTER (pos >= n - 3) AS b FROM h GROUP BY ALL),
  z AS (SELECT origin, model, y, CASE model WHEN 'Naive' THEN a ELSE b END AS yhat FROM fit JOIN fu USING (origin, customer_state),
    (SELECT unnest(['Naive', 'MovingAverage_3M']) AS model)),
  runs AS (SELECT origin, model, {METRICS} FROM z GROUP BY ALL)
"""


def _run_metrics(spark, folder):
    scored = baselines.rolling_baselines(inputs.panel(spark, folder), ORIGINS, STATE)
    return evaluation.forecast_metrics(
        scored.filter(F.col("model").isin("Naive", "MovingAverage_3M")), ["origin", "model"]
    )


def _logged(spark, folder):
    """The records written to a runs table and read back."""
    metrics = F.create_map(*[x for m in ("rmse", "mae", "mape", "smape") for x in (F.lit(m), F.col(m))])
    records = _run_metrics(spark, folder).select(
        F.concat_ws("-", "model", F.date_format("origin", "yyyyMM")).alias("run_id"),
        F.lit("revenue_forecast").alias("project"),
        F.col("model").alias("model_type"),
        F.lit("monthly").alias("granularity"),
        F.col("origin").cast("timestamp").alias("trained_at"),
        metrics.alias("metrics"),
        F.array(F.lit(TARGET)).alias("features"),
    )
    path = scratch_path(spark, "runs")
    assert store.log_run(records, path)
    return store.read_runs(spark, path)


@check(
    "log_run",
    W(*sql.PANEL)
    + _RUNS_SQL
    + "SELECT model || '-' || strftime(origin, '%Y%m') AS run_id, model AS model_type, rmse, mape, 1 AS n_features FROM runs",
    doubles="rmse mape",
)
def log_run(spark, folder):
    return _logged(spark, folder).select(
        "run_id",
        "model_type",
        F.col("metrics")["rmse"].alias("rmse"),
        F.col("metrics")["mape"].alias("mape"),
        F.size("features").alias("n_features"),
    )


@check(
    "latest_run_metrics",
    W(*sql.PANEL)
    + _RUNS_SQL
    + """SELECT model, rmse, mape, mae, smape, mape < 10 AS meets_target, 10.0::DOUBLE AS mape_target FROM runs
      ORDER BY origin DESC, model DESC LIMIT 1""",
    doubles="rmse mape mae smape mape_target",
)
def latest_run_metrics(spark, folder):
    return evaluation.latest_run_metrics(_logged(spark, folder), inputs.SETTINGS)


@check(
    "promotion_gate",
    W(*sql.PANEL)
    + _RUNS_SQL
    + """, e AS (SELECT model, origin, mape, rmse < 1e9 AS filters_passed, mape < 100 AND rmse < 1e9 AS ok FROM runs),
      g AS (SELECT *, min(CASE WHEN ok THEN mape END) OVER (PARTITION BY model ORDER BY origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS champion_mape FROM e)
    SELECT model, origin, mape, filters_passed, champion_mape, ok AND (champion_mape IS NULL OR mape <= champion_mape) AS promote FROM g""",
    doubles="mape champion_mape",
    dates="origin",
)
def promotion_gate(spark, folder):
    runs = _run_metrics(spark, folder).select(
        "model",
        "origin",
        F.col("origin").alias("trained_at"),
        F.col("model").alias("run_id"),
        "mape",
        (F.col("rmse") < 1e9).alias("filters_passed"),
    )
    return evaluation.promotion_gate(runs, 100.0, ["model"]).drop("trained_at", "run_id")


@check(
    "champion_challenger",
    W(*sql.PANEL)
    + _RUNS_SQL
    + """, sd AS (SELECT origin AS period, max(mape) FILTER (model = 'Naive') AS champion_mape, max(mape) FILTER (model = 'MovingAverage_3M') AS challenger_mape FROM runs GROUP BY 1),
      g AS (SELECT *, coalesce(challenger_mape < champion_mape, false) AS won, coalesce(champion_mape > 10, false) AS missed FROM sd)
    SELECT period, champion_mape, challenger_mape, won AND coalesce(lag(won) OVER (ORDER BY period), false) AS promote,
      missed AND coalesce(lag(missed) OVER (ORDER BY period), false) AS retrain FROM g""",
    doubles="champion_mape challenger_mape",
    dates="period",
)
def champion_challenger(spark, folder):
    errors = _run_metrics(spark, folder).select(F.col("origin").alias("period"), "model", "mape")
    return evaluation.champion_challenger(errors, "Naive", "MovingAverage_3M")


@check(
    "segment_residuals",
    W(*sql.PANEL) + SCORED + f"SELECT model, customer_state, {METRICS}, avg(y - yhat) AS bias, count(*) AS n FROM sd GROUP BY ALL",
    doubles="rmse mae mape smape bias",
    bias=2,
)
def segment_residuals(spark, folder):
    return evaluation.segment_residuals(_scored(spark, folder), STATE)


# ---- attribution ----

_SLOPE_FEATURES = ["monthly_orders", "avg_ticket", "revenue_lag_1"]
_X = {f: f"coalesce(CAST({f} AS DOUBLE), 0)" for f in _SLOPE_FEATURES}
_SHAP = (
    W(*sql.SERIES)
    + ", co AS (SELECT "
    + ", ".join(f"regr_slope(monthly_revenue, {x}) AS b_{f}, avg({x}) AS m_{f}" for f, x in _X.items())
    + " FROM s), sh AS ("
    + " UNION ALL ".join(
        f"SELECT customer_state, ds, '{f}' AS feature, ({x} - m_{f}) * b_{f} AS shap_value, "
        f"{' + '.join(f'm_{g} * b_{g}' for g in _SLOPE_FEATURES)} AS base_value FROM s, co"
        for f, x in _X.items()
    )
    + ") "
)


def _linear_values(spark, folder):
    """Attributions of a linear score whose weights are the single-feature slopes."""
    rows = inputs.series(spark, folder)
    cells = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in _SLOPE_FEATURES}
    slopes = rows.agg(*[F.regr_slope(F.col(TARGET), x).alias(f) for f, x in cells.items()]).first().asDict()
    return explain.shap_linear(rows, slopes, 0.0, ["customer_state", "ds"])


@check("shap_linear", _SHAP + "SELECT * FROM sh", doubles="shap_value base_value", dates="ds", shap_value=2, base_value=2)
def shap_linear(spark, folder):
    return _linear_values(spark, folder)


@check(
    "shap_summary",
    _SHAP + "SELECT feature, avg(abs(shap_value)) AS mean_abs_shap FROM sh GROUP BY 1",
    doubles="mean_abs_shap",
    mean_abs_shap=2,
)
def shap_summary(spark, folder):
    return explain.shap_summary(_linear_values(spark, folder))


@check(
    "local_contributions",
    _SHAP + "SELECT customer_state, ds, feature, shap_value FROM sh QUALIFY ds = max(ds) OVER (PARTITION BY customer_state)",
    doubles="shap_value",
    dates="ds",
    shap_value=2,
)
def local_contributions(spark, folder):
    return explain.local_contributions(_linear_values(spark, folder), ["customer_state", "ds"])


@check(
    "shap_tree_adds_up",
    W(*sql.PANEL)
    + """SELECT customer_state, ds, CAST(5 AS BIGINT) AS n_features, true AS adds_up FROM panel
      WHERE ds > DATE '2000-06-01' AND ds <= DATE '2000-12-01'""",
    dates="ds",
)
def shap_tree_adds_up(spark, folder):
    """Base value and attributions of a row give its prediction."""
    rows = shap_tree(spark, folder)
    return rows.groupBy("customer_state", "ds").agg(
        F.count(F.lit(1)).alias("n_features"), F.bool_and(F.abs("gap") < 1e-3).alias("adds_up")
    )


@check("shap_tree")
def shap_tree(spark, folder):
    """Attributions of every row and, as a check, how far they are from adding up."""
    model = small_gbt(spark, folder)
    rows = cleaned_parts(spark, folder)["val"]
    ids = ["customer_state", "ds"]
    values = explain.shap_tree(model, rows, ids)
    added = values.groupBy(*ids).agg((F.sum("shap_value") + F.max("base_value")).alias("explained"))
    gap = model.score(rows, 1).join(added, ids).select(*ids, (F.col("yhat") - F.col("explained")).alias("gap"))
    return values.join(gap, ids).select(*ids, "feature", "shap_value", "base_value", "gap")


