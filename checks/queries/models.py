"""Baselines and forecasters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import inputs, sql
from checks.queries.selection import _corr_ctes, _CORR, _parts, FEATURES, cleaned_parts
from checks.registry import check
from panelforge.operators import baselines, evaluation, forecast, selection
from panelforge.plans.train import TrainPlan
from panelforge.session import scratch_path

W = sql.with_ctes
STATE = inputs.STATE
TARGET = "monthly_revenue"
#: Small settings keep the checks short; the operators' defaults are larger.
GBT_SMALL = {"maxIter": 10, "maxDepth": 3}
CHOSEN = ["monthly_orders", "avg_ticket", "revenue_lag_1", "revenue_rolling_mean_3", "unique_sellers"]

HISTORY = """, h AS (SELECT customer_state, ds, monthly_revenue AS y, row_number() OVER w - 1 AS pos,
    count(*) OVER (PARTITION BY customer_state) AS n FROM panel WHERE ds <= DATE '2000-06-01' WINDOW w AS (PARTITION BY customer_state ORDER BY ds)),
  hz AS (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS horizon),
  bl AS (
    SELECT customer_state, 'Naive' AS model, horizon, yhat FROM (SELECT customer_state, arg_max(y, pos) AS yhat FROM h GROUP BY 1), hz
    UNION ALL SELECT customer_state, 'MovingAverage_3M', horizon, yhat FROM (SELECT customer_state, avg(y) AS yhat FROM h WHERE pos >= n - 3 GROUP BY 1), hz
    UNION ALL SELECT g.customer_state, 'SeasonalNaive', horizon, coalesce(h.y, g.m) FROM (SELECT customer_state, avg(y) AS m, max(n) AS n FROM h GROUP BY 1) g
      CROSS JOIN hz LEFT JOIN h ON h.customer_state = g.customer_state AND h.pos = g.n - 12 + horizon - 1
    UNION ALL SELECT customer_state, 'LinearTrend', horizon, ic + sl * (n - 1 + horizon) FROM (
      SELECT customer_state, regr_slope(y, pos) AS sl, regr_intercept(y, pos) AS ic, max(n) AS n FROM h GROUP BY 1), hz)
"""
TEST = """, ts AS (SELECT customer_state, ds, monthly_revenue AS y,
    CAST(row_number() OVER (PARTITION BY customer_state ORDER BY ds) AS INTEGER) AS horizon
  FROM panel WHERE ds > DATE '2000-06-01' AND ds <= DATE '2001-07-01' QUALIFY horizon <= 3)
"""
METRICS = """sqrt(avg((y - yhat) ** 2)) AS rmse, avg(abs(y - yhat)) AS mae,
    avg(CASE WHEN y <> 0 THEN abs((y - yhat) / y) END) * 100 AS mape,
    avg(abs(y - yhat) / ((abs(y) + abs(yhat)) / 2 + 1e-9)) * 100 AS smape"""
SCORED = HISTORY + TEST + ", sd AS (SELECT bl.*, y FROM bl JOIN ts USING (customer_state, horizon))"


def _train(spark, folder):
    panel = inputs.panel(spark, folder)
    return panel.filter(F.col("ds") <= F.to_date(F.lit("2000-06-01")))


def _test(spark, folder):
    panel = inputs.panel(spark, folder)
    return panel.filter((F.col("ds") > F.to_date(F.lit("2000-06-01"))) & (F.col("ds") <= F.to_date(F.lit("2001-07-01"))))


def _baseline(name, operator, model):
    @check(name, W(*sql.PANEL) + HISTORY + f"SELECT * FROM bl WHERE model = '{model}'", doubles="yhat")
    def run(spark, folder):
        return operator(_train(spark, folder), STATE)


_baseline("baseline_naive", baselines.baseline_naive, "Naive")
_baseline("baseline_moving_average", baselines.baseline_moving_average, "MovingAverage_3M")
_baseline("baseline_seasonal_naive", baselines.baseline_seasonal_naive, "SeasonalNaive")
_baseline("baseline_linear_trend", baselines.baseline_linear_trend, "LinearTrend")


@check(
    "evaluate_baselines",
    W(*sql.PANEL) + SCORED + f"SELECT model, {METRICS} FROM sd GROUP BY 1",
    doubles="rmse mae mape smape",
)
def evaluate_baselines(spark, folder):
    return baselines.evaluate_baselines(_train(spark, folder), _test(spark, folder), STATE)


ORIGINS = [f"2000-{m:02d}-01" for m in range(1, 13)] + [f"2001-{m:02d}-01" for m in range(1, 4)]


@check(
    "rolling_baselines",
    W(*sql.PANEL)
    + f""", og AS (SELECT CAST(unnest({ORIGINS}) AS DATE) AS origin),
      h AS (SELECT origin, customer_state, ds, monthly_revenue AS y, row_number() OVER (PARTITION BY origin, customer_state ORDER BY ds) - 1 AS pos,
        count(*) OVER (PARTITION BY origin, customer_state) AS n FROM panel JOIN og ON ds <= origin),
      fu AS (SELECT origin, customer_state, monthly_revenue AS y, CAST(row_number() OVER (PARTITION BY origin, customer_state ORDER BY ds) AS INTEGER) AS horizon
        FROM panel JOIN og ON ds > origin QUALIFY horizon <= 3),
      fit AS (SELECT origin, customer_state, arg_max(y, pos) AS a, avg(y) FILTER (pos >= n - 3) AS b, avg(y) AS m, regr_slope(y, pos) AS sl,
        regr_intercept(y, pos) AS ic, max(n) AS n FROM h GROUP BY ALL),
      z AS (SELECT fit.*, fu.horizon, fu.y, coalesce(h.y, m) AS s FROM fit JOIN fu USING (origin, customer_state)
        LEFT JOIN h ON h.origin = fit.origin AND h.customer_state = fit.customer_state AND h.pos = fit.n - 12 + fu.horizon - 1)
    SELECT origin, customer_state, 'Naive' AS model, horizon, a AS yhat, y FROM z
    UNION ALL SELECT origin, customer_state, 'MovingAverage_3M', horizon, b, y FROM z
    UNION ALL SELECT origin, customer_state, 'SeasonalNaive', horizon, s, y FROM z
    UNION ALL SELECT origin, customer_state, 'LinearTrend', horizon, ic + sl * (n - 1 + horizon), y FROM z""",
    doubles="yhat y",
    dates="origin",
)
def rolling_baselines(spark, folder):
    return baselines.rolling_baselines(inputs.panel(spark, folder), ORIGINS, STATE)


_DATASET = W(*sql.SERIES) + ", ml AS (" + " UNION ALL ".join(
    f"""SELECT customer_state, ds, CAST({h} AS INTEGER) AS horizon, lead(monthly_revenue, {h - 1}) OVER (PARTITION BY customer_state ORDER BY ds) AS label,
      CAST(coalesce(monthly_orders, 0) AS DOUBLE) AS monthly_orders, coalesce(revenue_lag_1, 0) AS revenue_lag_1 FROM s"""
    for h in (1, 2, 3)
) + "), md AS (SELECT * FROM ml WHERE label IS NOT NULL) "


@check("direct_multistep_dataset", _DATASET + "SELECT * FROM md", doubles="label monthly_orders revenue_lag_1", dates="ds")
def direct_multistep_dataset(spark, folder):
    return forecast.direct_multistep_dataset(
        inputs.series(spark, folder), ["monthly_orders", "revenue_lag_1"], keys=STATE
    )


@check(
    "prediction_intervals",
    _DATASET.rstrip()
    + HISTORY
    + """, rs AS (SELECT horizon, coalesce(stddev_samp(label - revenue_lag_1), 0) * 1.5 AS sd FROM md GROUP BY 1),
      pi AS (SELECT customer_state, model, horizon, yhat, CASE WHEN sd > 0 THEN 1.959963984540054 * sd ELSE 0.15 * abs(yhat) END AS margin
        FROM bl JOIN rs USING (horizon) WHERE model = 'Naive')
    SELECT customer_state, model, horizon, yhat, yhat - margin AS yhat_lower, yhat + margin AS yhat_upper FROM pi""",
    doubles="yhat yhat_lower yhat_upper",
    yhat_lower=2,
    yhat_upper=2,
)
def prediction_intervals(spark, folder):
    data = forecast.direct_multistep_dataset(inputs.series(spark, folder), ["revenue_lag_1"], keys=STATE)
    resid = forecast.residual_std(data, "label", "revenue_lag_1")
    return forecast.prediction_intervals(baselines.baseline_naive(_train(spark, folder), STATE), resid)


@check(
    "ensemble",
    W(*sql.PANEL) + HISTORY + "SELECT customer_state, horizon, sum(yhat * 0.25) AS yhat FROM bl GROUP BY ALL",
    doubles="yhat",
)
def ensemble(spark, folder):
    return forecast.ensemble(baselines.all_baselines(_train(spark, folder), STATE), by=["customer_state", "horizon"])


@check(
    "ensemble_weighted",
    W(*sql.PANEL)
    + SCORED
    + f""", mt AS (SELECT model, {METRICS} FROM sd GROUP BY 1), wt AS (SELECT model, (1 / mape) / sum(1 / mape) OVER () AS weight FROM mt WHERE model <> 'LinearTrend')
    SELECT customer_state, horizon, sum(yhat * coalesce(weight, 0)) AS yhat FROM bl LEFT JOIN wt USING (model) GROUP BY ALL""",
    doubles="yhat",
)
def ensemble_weighted(spark, folder):
    # weights from the test error; the trend model gets none
    metrics = baselines.evaluate_baselines(_train(spark, folder), _test(spark, folder), STATE)
    inverse = 1 / F.col("mape")
    weights = metrics.filter(F.col("model") != "LinearTrend").select(
        "model", (inverse / F.sum(inverse).over(Window.partitionBy(F.lit(1)))).alias("weight")
    )
    forecasts = baselines.all_baselines(_train(spark, folder), STATE)
    return forecast.ensemble(forecasts, weights, ["customer_state", "horizon"])


# ---- fitted forecasters: weaker checks, rows only ----

_models: dict = {}


def fitted(spark, folder, name, make, horizon=2):
    """A forecaster fitted once per session on the training split of the cleaned panel."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _models:
        train = cleaned_parts(spark, folder)["train"]
        _models[key] = forecast.DirectForecaster(name, make, horizon).fit(train, CHOSEN, keys=STATE)
    return _models[key]


def small_gbt(spark, folder):
    return fitted(spark, folder, "GBT", forecast.gbt(GBT_SMALL))


def _forecaster(name, label, make):
    @check(name)
    def run(spark, folder):
        train = cleaned_parts(spark, folder)["train"]
        model = fitted(spark, folder, label, make)
        return model.predict_with_intervals(train, STATE)


_forecaster("gbt_forecaster", "GBT", forecast.gbt(GBT_SMALL))
_forecaster("rf_forecaster", "RandomForest", forecast.random_forest())
_forecaster("ridge_forecaster", "Ridge", forecast.ridge())
_forecaster(
    "xgb_forecaster", "XGB", forecast.gbt({"maxIter": 10, "maxDepth": 4, "minInstancesPerNode": 1, "featureFraction": 0.8})
)


@check(
    "ridge_single_feature",
    W(*sql.SERIES)
    + """, md AS (SELECT customer_state, ds, monthly_revenue AS y, coalesce(revenue_lag_1, 0) AS x FROM s WHERE ds <= DATE '2000-06-01'),
      mo AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx FROM md),
      be AS (SELECT mx, my, sxy / (sxx + 1e15) AS b FROM mo)
    SELECT customer_state, ds, my + b * (x - mx) AS yhat FROM md, be""",
    doubles="yhat",
    dates="ds",
    yhat=0,
)
def ridge_single_feature(spark, folder):
    """Closed form of the penalised line, with a penalty large enough to matter."""
    train = _parts(spark, folder)[0]
    model = forecast.DirectForecaster("Ridge", forecast.ridge(1e15), 1).fit(train, ["revenue_lag_1"], keys=STATE)
    return model.score(train, 1).select("customer_state", "ds", "yhat")


@check("gbt_early_stopping")
def gbt_early_stopping(spark, folder):
    """Validation rows decide when boosting stops."""
    parts = cleaned_parts(spark, folder)
    model = forecast.DirectForecaster("GBT", forecast.gbt({"maxIter": 20, "maxDepth": 3}), 1)
    model.fit(parts["train"], CHOSEN, keys=STATE, val=parts["val"])
    scored = model.score(parts["val"], 1)
    return scored.select("customer_state", "ds", F.col(TARGET).alias("y"), "yhat")


@check("predict_multistep")
def predict_multistep(spark, folder):
    return small_gbt(spark, folder).predict(cleaned_parts(spark, folder)["train"], STATE)


@check("feature_importance")
def feature_importance(spark, folder):
    return small_gbt(spark, folder).importance(spark)


@check("tune")
def tune(spark, folder):
    """Trials of a small random search with their mean error."""
    settings = inputs.SETTINGS.with_(
        tune_trials=2,
        tune_folds=2,
        tune_space={"maxIter": (3, 5), "stepSize": (0.05, 0.3), "maxDepth": (2, 3)},
    )
    found = forecast.tune(cleaned_parts(spark, folder)["train"], CHOSEN, settings=settings, parallel=2)
    rows = [(i, float(v), p == found.best_params) for i, (p, v) in enumerate(found.trials)]
    return spark.createDataFrame(rows, "trial int, error double, is_best boolean")


@check("train_final")
def train_final(spark, folder):
    parts = cleaned_parts(spark, folder)
    history = parts["train"].unionByName(parts["val"])
    model = forecast.train_final(history, CHOSEN, GBT_SMALL, keys=STATE, horizon=1)
    return model.predict(history, STATE)


@check(
    "forecast_calendar",
    W(*sql.PANEL)
    + """, la AS (SELECT customer_state, max(ds) AS ds FROM panel WHERE ds <= DATE '2000-06-01' GROUP BY 1),
      hz AS (SELECT CAST(unnest([1, 2]) AS INTEGER) AS horizon)
    SELECT customer_state, horizon, CAST(ds + to_months(horizon) AS DATE) AS ds, true AS ordered, 10.0::DOUBLE AS mape_target FROM la, hz""",
    doubles="mape_target",
    dates="ds",
)
def forecast_calendar(spark, folder):
    """Months, horizons and the order of the interval bounds of the forecast."""
    points = forecast_query(spark, folder)
    ordered = (F.col("yhat_lower") < F.col("yhat")) & (F.col("yhat") < F.col("yhat_upper"))
    return points.select("customer_state", "horizon", "ds", ordered.alias("ordered"), "mape_target")


@check("forecast")
def forecast_query(spark, folder):
    """More months than fitted horizons are asked for: the horizon is cut."""
    train = cleaned_parts(spark, folder)["train"]
    return forecast.forecast(small_gbt(spark, folder), train, STATE, 12, inputs.SETTINGS)


def _save_and_load(spark, folder):
    """Predictions of the reloaded model minus those of the fitted one."""
    model = small_gbt(spark, folder)
    path = scratch_path(spark, "model")
    model.save(spark, path)
    again = forecast.DirectForecaster.load(spark, path)
    rows = cleaned_parts(spark, folder)["val"]
    ids = [*STATE, "ds", "horizon"]
    first = model.predict_rows(rows, [*STATE, "ds"])
    second = again.predict_rows(rows, [*STATE, "ds"]).withColumnRenamed("yhat", "yhat_loaded")
    return first.join(second, ids).select(*ids, (F.col("yhat") - F.col("yhat_loaded")).alias("difference"))


# a reloaded model predicts the same for every validation row
_SAME = (
    W(*sql.PANEL)
    + """SELECT customer_state, ds, CAST(unnest([1, 2]) AS INTEGER) AS horizon, 0.0::DOUBLE AS difference FROM panel
      WHERE ds > DATE '2000-06-01' AND ds <= DATE '2000-12-01'"""
)
for _name in ("save_model", "load_model"):
    check(_name, _SAME, doubles="difference", dates="ds")(_save_and_load)


_REQUEST = ["monthly_orders", "avg_ticket", "revenue_lag_1"]


def _requests(spark, folder):
    """One request per order-panel row that names only some of the features."""
    rows = cleaned_parts(spark, folder)["val"]
    pairs = [x for f in _REQUEST for x in (F.lit(f), F.col(f))]
    return rows.select("customer_state", "ds", F.create_map(*pairs).alias("features"))


@check("score_scenarios")
def score_scenarios(spark, folder):
    return forecast.score_scenarios(small_gbt(spark, folder), _requests(spark, folder), ["customer_state", "ds"])


def _scenarios(spark, folder):
    """Scenario table: overrides from the history (best and worst month of the business)."""
    extremes = inputs.series(spark, folder).agg(
        F.max("monthly_orders").cast("double").alias("hi"),
        F.min("monthly_orders").cast("double").alias("lo"),
        F.max("avg_ticket").alias("ticket"),
    )
    pairs = F.array(
        F.struct(F.lit("many orders").alias("scenario"), F.col("hi").alias("monthly_orders"), F.lit(None).cast("double").alias("avg_ticket")),
        F.struct(F.lit("few orders").alias("scenario"), F.col("lo").alias("monthly_orders"), F.lit(None).cast("double").alias("avg_ticket")),
        F.struct(F.lit("high ticket").alias("scenario"), F.lit(None).cast("double").alias("monthly_orders"), F.col("ticket").alias("avg_ticket")),
    )
    return extremes.select(F.explode(pairs).alias("x")).select("x.*")


@check(
    "what_if",
    W(*sql.SERIES)
    + """, la AS (SELECT customer_state, ds, CAST(monthly_orders AS DOUBLE) AS o, avg_ticket AS t, revenue_lag_1 FROM s
        QUALIFY row_number() OVER (PARTITION BY customer_state ORDER BY ds DESC) = 1),
      ex AS (SELECT CAST(max(monthly_orders) AS DOUBLE) AS hi, CAST(min(monthly_orders) AS DOUBLE) AS lo, max(avg_ticket) AS ticket FROM s)
    SELECT customer_state, ds, 'many orders' AS scenario, hi AS monthly_orders, t AS avg_ticket, revenue_lag_1 FROM la, ex
    UNION ALL SELECT customer_state, ds, 'few orders', lo, t, revenue_lag_1 FROM la, ex
    UNION ALL SELECT customer_state, ds, 'high ticket', o, ticket, revenue_lag_1 FROM la, ex""",
    doubles="monthly_orders avg_ticket revenue_lag_1",
    dates="ds",
)
def what_if(spark, folder):
    rows = forecast.what_if(inputs.series(spark, folder), _scenarios(spark, folder), STATE, ["monthly_orders", "avg_ticket"])
    return rows.select("customer_state", "ds", "scenario", "monthly_orders", "avg_ticket", "revenue_lag_1")


@check("what_if_scored")
def what_if_scored(spark, folder):
    cleaned = cleaned_parts(spark, folder)["train"]
    base = cleaned.agg(F.max("monthly_orders").alias("monthly_orders")).withColumn("scenario", F.lit("many orders"))
    rows = forecast.what_if(cleaned, base, STATE, ["monthly_orders"])
    return small_gbt(spark, folder).predict_rows(rows, ["customer_state", "ds", "scenario"])


@check("incremental_refresh")
def incremental_refresh(spark, folder):
    """A new month arrives: features, cleaning, continued boosting, new score."""
    plan = TrainPlan(spark, inputs.SETTINGS.with_(horizon=1), STATE)
    panel = inputs.panel(spark, folder)
    newest = F.to_date(F.lit("2001-05-01"))
    plan.start_from(panel.filter(F.col("ds") < newest)).clean()
    plan.selected = CHOSEN
    model = forecast.DirectForecaster("GBT", forecast.gbt({"maxIter": 5, "maxDepth": 3}), 1)
    plan.forecaster = model.fit(plan.part("train"), CHOSEN, keys=STATE)
    return plan.incremental_refresh(panel.filter(F.col("ds") >= newest), extra_trees=3)


# ---- sorting ----


@check(
    "top_features",
    _corr_ctes(_CORR, "ds <= DATE '2000-06-01'")
    + """SELECT feature_i AS feature, abs(r) AS importance FROM cr WHERE feature_j = 'monthly_revenue' AND feature_i <> 'monthly_revenue'
      AND r IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 5""",
    doubles="importance",
)
def top_features(spark, folder):
    importance = selection.target_correlation(_parts(spark, folder)[0], FEATURES, TARGET)
    return evaluation.top_features(importance.withColumnRenamed("abs_r", "importance"), 5)


@check(
    "rank_models",
    W(*sql.PANEL) + SCORED + f", mt AS (SELECT model, {METRICS} FROM sd GROUP BY 1) SELECT *, mape < 10 AS meets_target FROM mt ORDER BY mape",
    doubles="rmse mae mape smape",
)
def rank_models(spark, folder):
    return evaluation.rank_models(baselines.evaluate_baselines(_train(spark, folder), _test(spark, folder), STATE))
