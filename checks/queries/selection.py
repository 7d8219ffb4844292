"""Feature selection and drift queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.queries.data import _domain_case
from checks.registry import check
from panelforge.functions.metrics import all_metrics
from panelforge.operators import cleaning, evaluation, selection
from panelforge.operators.forecast import DirectForecaster, ridge
from panelforge.streaming.period_features import feature_names

W = sql.with_ctes
STATE = inputs.STATE
TRAIN, VAL = "ds <= DATE '2000-06-01'", "ds > DATE '2000-06-01' AND ds <= DATE '2000-12-01'"
_CYCLE = ["month", "quarter", "month_sin", "month_cos", "is_q4", "is_nov_dec"]
#: Every numeric column of the panel but the target.
FEATURES = [c for c in re.findall(r"AS (monthly_\w+|avg_\w+|median_\w+|pct_\w+|total_\w+|unique_\w+)", sql.AGGREGATES) if c != "monthly_revenue"]
FEATURES += [*feature_names(inputs.SETTINGS), *_CYCLE]


def _parts(spark, folder):
    rows = inputs.split_series(spark, folder)
    return rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "val")


def _unpivot(name: str, source: str, where: str, features=FEATURES, extra: str = "") -> str:
    arms = " UNION ALL ".join(
        f"SELECT {extra}customer_state, ds, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {source} WHERE {where}"
        for f in features
    )
    return f"{name} AS ({arms})"


def _psi_sql(bins: int, by: str = "", current: str = VAL) -> str:
    e = [f"(lo + (hi - lo) / {bins} * {i})" for i in range(bins + 1)]
    e[0], e[-1] = "(lo - 1e-9)", "(hi + 1e-9)"
    inside = [
        f"value >= {e[i]} AND value {'<' if i < bins - 1 else '<='} {e[i + 1]}" for i in range(bins)
    ]

    def counts(p):
        return f"count(value) AS {p}_n, " + ", ".join(f"count(*) FILTER ({c}) AS {p}_{i}" for i, c in enumerate(inside))

    def share(p, i):
        return f"({p}_{i} * 1.0 / nullif({p}_n, 0) + 1e-6)"

    terms = " + ".join(f"({share('c', i)} - {share('b', i)}) * ln({share('c', i)} / {share('b', i)})" for i in range(bins))
    return (
        W(*sql.SERIES, _unpivot("tl", "s", TRAIN), _unpivot("vl", "s", current))
        + f""", rg AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM tl GROUP BY 1),
      bc AS (SELECT feature, {counts('b')} FROM tl JOIN rg USING (feature) GROUP BY feature),
      cc AS (SELECT {by}feature, {counts('c')} FROM vl JOIN rg USING (feature) GROUP BY {by}feature),
      ps AS (SELECT {by}feature, CASE WHEN b_n = 0 OR c_n = 0 THEN 0.0 ELSE {terms} END AS psi FROM cc JOIN bc USING (feature))
    """
    )


@check("psi", _psi_sql(10) + "SELECT feature, psi FROM ps", doubles="psi")
def psi(spark, folder):
    train, val = _parts(spark, folder)
    return selection.psi(train, val, FEATURES, 10)


@check("psi_selection", _psi_sql(5) + "SELECT feature, psi, psi <= 0.25 AS stable FROM ps", doubles="psi")
def psi_selection(spark, folder):
    train, val = _parts(spark, folder)
    return selection.psi_selection(train, val, FEATURES, 0.25, 5)


@check(
    "drift_monitor",
    _psi_sql(5, "ds, ", "ds > DATE '2000-12-01' AND ds <= DATE '2001-07-01'")
    + "SELECT ds, feature, psi, psi > 0.25 AS retrain FROM ps",
    doubles="psi",
    dates="ds",
)
def drift_monitor(spark, folder):
    rows = inputs.split_series(spark, folder)
    recent = rows.filter(F.col("split") == "backtest")
    return selection.drift_monitor(inputs.train_rows(rows), recent, FEATURES)


@check(
    "missing_selection",
    W(*sql.SERIES)
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END) AS missing_rate, "
        f"avg(CASE WHEN {f} IS NULL THEN 1 ELSE 0 END) <= 0.15 AS keep FROM s WHERE {TRAIN}"
        for f in FEATURES
    ),
    doubles="missing_rate",
)
def missing_selection(spark, folder):
    return selection.missing_selection(_parts(spark, folder)[0], FEATURES, 0.15)


_CORR = [*FEATURES, "monthly_revenue"]


def _corr_ctes(features, where) -> str:
    order = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(features))
    flat = "(max(a.value) = min(a.value) OR max(b.value) = min(b.value))"
    return (
        W(*sql.SERIES, _unpivot("l", "s", where, features))
        + f""", k AS (SELECT *, CASE feature {order} END AS pos FROM l WHERE value IS NOT NULL),
      cr AS (SELECT a.feature AS feature_i, b.feature AS feature_j, a.pos AS pos_i, b.pos AS pos_j, count(*) AS n,
        CASE WHEN {flat} THEN NULL ELSE covar_samp(a.value, b.value) / nullif(stddev_samp(a.value) * stddev_samp(b.value), 0) END AS r
        FROM k a JOIN k b USING (customer_state, ds) GROUP BY ALL)
    """
    )


@check(
    "correlation_matrix",
    _corr_ctes(_CORR, TRAIN) + "SELECT feature_i, feature_j, n, r, abs(r) AS abs_r FROM cr",
    doubles="r abs_r",
)
def correlation_matrix(spark, folder):
    return selection.correlation_matrix(_parts(spark, folder)[0], _CORR)


@check(
    "correlation_selection",
    _corr_ctes(FEATURES, TRAIN)
    + """SELECT feature_j AS feature, CAST(pos_j AS INTEGER) AS pos,
      NOT bool_or(coalesce(pos_i < pos_j AND abs(r) > 0.9, false)) AS keep FROM cr GROUP BY ALL""",
)
def correlation_selection(spark, folder):
    return selection.correlation_selection(_parts(spark, folder)[0], FEATURES, 0.9)


@check(
    "target_correlation",
    _corr_ctes(_CORR, TRAIN)
    + """SELECT feature_i AS feature, abs(r) AS abs_r FROM cr WHERE feature_j = 'monthly_revenue' AND feature_i <> 'monthly_revenue'
      AND r IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 20""",
    doubles="abs_r",
)
def target_correlation(spark, folder):
    return selection.target_correlation(_parts(spark, folder)[0], FEATURES, "monthly_revenue")


@check(
    "pearson_test",
    W(*sql.SERIES)
    + """, st AS (SELECT 'delivery_delay_days~review_score' AS pair, covar_samp(delivery_delay_days, review_score)
          / (stddev_samp(delivery_delay_days) * stddev_samp(review_score)) AS r, count(*) AS n
        FROM v WHERE delivery_delay_days IS NOT NULL AND review_score IS NOT NULL
      UNION ALL SELECT 'monthly_orders~monthly_revenue', covar_samp(monthly_orders, monthly_revenue)
          / (stddev_samp(monthly_orders) * stddev_samp(monthly_revenue)), count(*) FROM panel)
    SELECT pair, r, n, r * sqrt(n - 2) / sqrt(1 - r * r) AS t_stat FROM st""",
    doubles="r t_stat",
)
def pearson_test(spark, folder):
    delay = selection.pearson_test(inputs.valid(spark, folder), "delivery_delay_days", "review_score")
    orders = selection.pearson_test(inputs.panel(spark, folder), "monthly_orders", "monthly_revenue")
    return delay.unionByName(orders).drop("p_value")


_MI = FEATURES


def _mi_ctes(bins: int = 8) -> str:
    probs = ", ".join(str(i / bins) for i in range(1, bins))

    def arm(f):
        return f"SELECT '{f}' AS feature, coalesce(CAST({f} AS DOUBLE), 0) AS value, monthly_revenue AS y FROM s WHERE {TRAIN}"

    below = "len(list_filter({}, lambda e: e < {}))"
    return (
        W(*sql.SERIES)
        + f""", l AS ({' UNION ALL '.join(arm(f) for f in _MI)}),
      ed AS (SELECT feature, quantile_cont(value, [{probs}]) AS e FROM l GROUP BY 1),
      ty AS (SELECT quantile_cont(monthly_revenue, [{probs}]) AS te FROM s WHERE {TRAIN}),
      j AS (SELECT feature, {below.format('e', 'value')} AS bx, {below.format('te', 'y')} AS bn, count(*) AS n
        FROM l JOIN ed USING (feature), ty GROUP BY ALL),
      pz AS (SELECT feature, n * 1.0 / sum(n) OVER (PARTITION BY feature) AS p,
        sum(n) OVER (PARTITION BY feature, bx) * 1.0 / sum(n) OVER (PARTITION BY feature) AS px,
        sum(n) OVER (PARTITION BY feature, bn) * 1.0 / sum(n) OVER (PARTITION BY feature) AS py FROM j),
      mi AS (SELECT feature, greatest(sum(p * ln(p / (px * py))), 0) AS mi_score FROM pz GROUP BY 1),
      un AS (SELECT *, mi_score / max(mi_score) OVER () AS mi_normalized FROM mi)
    """
    )


@check(
    "univariate_selection",
    _mi_ctes()
    + """SELECT feature, mi_score, mi_normalized, CASE WHEN sum(CASE WHEN mi_normalized >= 0.3 THEN 1 ELSE 0 END) OVER () >= 3
      THEN mi_normalized >= 0.3 ELSE row_number() OVER (ORDER BY mi_normalized DESC, feature) <= 3 END AS keep FROM un""",
    doubles="mi_score mi_normalized",
)
def univariate_selection(spark, folder):
    return selection.univariate_selection(_parts(spark, folder)[0], _MI, "monthly_revenue", 0.3, 3)


def _cleaned(spark, folder):
    def build():
        rows = inputs.series(spark, folder)
        train = rows.filter(F.col("ds") <= F.to_date(F.lit("2000-06-01")))
        return cleaning.clean_panel(rows, inputs.SETTINGS, STATE, fit_on=train)[0]

    return inputs._stored(spark, folder, "cleaned", build)


def cleaned_parts(spark, folder):
    from panelforge.operators.splits import split_data

    rows = split_data(_cleaned(spark, folder), inputs.SETTINGS)
    return {n: rows.filter(F.col("split") == n).drop("split", "is_live") for n in ("train", "val", "backtest")}


def cleaned_features(df):
    return [c for c in df.columns if c not in {*STATE, *cleaning.NOT_CLEANED}]


@check("wrapper_selection")
def wrapper_selection(spark, folder):
    """Error of every feature count and the rank of each feature."""
    train = cleaned_parts(spark, folder)["train"]
    found = selection.wrapper_selection(train, FEATURES, "monthly_revenue")
    rows = [(f, r, f in found.selected) for f, r in found.ranking.items()]
    return spark.createDataFrame(rows, "feature string, ranking int, selected boolean")


@check("run_feature_selection")
def run_feature_selection(spark, folder):
    parts = cleaned_parts(spark, folder)
    features = cleaned_features(parts["train"])
    result = selection.run_feature_selection(parts["train"], parts["val"], features, inputs.SETTINGS)
    return result.summary(spark)


@check(
    "selection_table",
    _mi_ctes()
    + f""", fl AS (SELECT feature, CASE WHEN mi_normalized >= 0.3 THEN 1 ELSE 0 END AS flag, mi_score FROM un),
      cv AS (SELECT feature, abs(covar_samp(value, y) / nullif(stddev_samp(value) * stddev_samp(y), 0)) AS importance FROM l GROUP BY 1),
      jn AS (SELECT feature, flag, CASE WHEN flag = 1 THEN mi_score ELSE 0 END AS m, coalesce(importance, 0) AS importance FROM fl JOIN cv USING (feature))
    SELECT CAST(CASE feature {' '.join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(_MI, 1))} END AS INTEGER) AS "Nro", {_domain_case()} AS "Dominio",
      feature AS "Variable", flag AS "flagSelected", round_even(coalesce(m * 100 / nullif(sum(m) OVER (), 0), 0), 2) AS importancia_seleccion,
      round_even(importance * 100 / sum(importance) OVER (), 2) AS importancia_modelo_final FROM jn""",
    doubles="importancia_seleccion importancia_modelo_final",
)
def selection_table(spark, folder):
    train = _parts(spark, folder)[0]
    scores = selection.univariate_selection(train, _MI, "monthly_revenue", 0.3, 0)
    filled = train.select("monthly_revenue", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in _MI])
    importance = selection.target_correlation(filled, _MI, "monthly_revenue", len(_MI)).withColumnRenamed("abs_r", "importance")
    names = F.array(*[F.lit(f) for f in _MI])
    variables = scores.select(F.array_position(names, F.col("feature")).cast("int").alias("Nro"), F.col("feature").alias("Variable"))
    return selection.selection_table(variables, scores.filter("keep"), scores, importance)


@check("selection_cost")
def selection_cost(spark, folder):
    parts = cleaned_parts(spark, folder)
    every = cleaned_features(parts["train"])
    chosen = ["monthly_orders", "avg_ticket", "revenue_lag_1", "revenue_rolling_mean_3", "unique_sellers"]
    rows = []
    for features in (every, chosen):
        model = DirectForecaster("Ridge", ridge(), 1).fit(parts["train"], features, keys=STATE)
        scored = model.score(parts["val"], 1)
        rows.append(scored.agg(*all_metrics("monthly_revenue", "yhat")).first().asDict())
    return evaluation.selection_cost(rows[0], rows[1], len(every), len(chosen), spark)
