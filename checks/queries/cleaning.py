"""Cleaning transformers over the feature panel and over order rows."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from checks import inputs, sql
from checks.registry import check
from panelforge.operators import cleaning
from panelforge.operators.stages import PanelCleaner, ZeroFill
from panelforge.session import scratch_path

W = sql.with_ctes
STATE = inputs.STATE
_COLS = ["revenue_lag_1", "avg_review_score", "avg_delivery_days", "total_freight"]


def _quantile(c: str, p: float) -> str:
    return f"quantile_cont({c}, {p})"


_BOUNDS = "SELECT " + ", ".join(f"{_quantile(c, 0.05)} AS lo_{c}, {_quantile(c, 0.95)} AS hi_{c}" for c in _COLS) + " FROM s"


def _clipped(c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, lo_{c}), hi_{c}) END"


@check(
    "outlier_clip",
    W(*sql.SERIES)
    + f", b AS ({_BOUNDS}) SELECT customer_state, ds, {', '.join(f'{_clipped(c)} AS {c}' for c in _COLS)} FROM s, b",
    doubles=" ".join(_COLS),
    dates="ds",
)
def outlier_clip(spark, folder):
    return cleaning.outlier_clip(inputs.series(spark, folder).select("customer_state", "ds", *_COLS), _COLS, 0.05, 0.95)


def _imputed(agg: str) -> str:
    fills = ", ".join(f"{agg.format(c)} AS f_{c}" for c in _COLS)
    cells = ", ".join(f"coalesce({c}, f_{c}) AS {c}" for c in _COLS)
    return W(*sql.SERIES) + f", b AS (SELECT {fills} FROM s) SELECT customer_state, ds, {cells} FROM s, b"


def _impute(strategy):
    def run(spark, folder):
        rows = inputs.series(spark, folder).select("customer_state", "ds", *_COLS)
        return cleaning.impute(rows, _COLS, strategy, STATE)

    return run


check("impute", _imputed("median({})"), doubles=" ".join(_COLS), dates="ds")(_impute("median"))
check("impute_mean", _imputed("avg({})"), doubles=" ".join(_COLS), dates="ds")(_impute("mean"))
check("impute_zero", _imputed("max(0 * coalesce({}, 0))"), doubles=" ".join(_COLS), dates="ds")(_impute("zero"))


def _filled(c: str) -> str:
    w = "PARTITION BY customer_state ORDER BY ds"
    return f"""coalesce(last_value({c} IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING),
      first_value({c} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""


check(
    "impute_forward_fill",
    W(*sql.SERIES) + f"SELECT customer_state, ds, {', '.join(_filled(c) for c in _COLS)} FROM s",
    doubles=" ".join(_COLS),
    dates="ds",
)(_impute("forward_fill"))


_CAT = ["product_category_name_english", "seller_state", "payment_type"]


def _grouped(c: str) -> str:
    keep = f"""SELECT {c} FROM (SELECT {c}, count(*) AS k FROM f WHERE {c} IS NOT NULL GROUP BY 1)
      WHERE k * 1.0 / (SELECT count({c}) FROM f) >= 0.04"""
    return f"CASE WHEN {c} IN ({keep}) THEN {c} ELSE 'other' END AS {c}"


@check(
    "rare_category_group",
    W(*sql.VALID)
    + f", g AS (SELECT {', '.join(_grouped(c) for c in _CAT)} FROM f) SELECT {', '.join(_CAT)}, count(*) AS n FROM g GROUP BY ALL",
)
def rare_category_group(spark, folder):
    rows = inputs.featured(spark, folder).select(*_CAT)
    grouped = cleaning.rare_category_group(rows, _CAT, 0.04)
    return grouped.groupBy(*_CAT).agg(F.count(F.lit(1)).alias("n"))


_KINDS = ["boleto", "credit_card", "debit_card", "not_defined", "voucher"]
_CATEGORIES = ["economy", "large", "nan", "promo", "small", "standard"]


def _hot(c: str, v: str) -> str:
    return f'CASE WHEN coalesce({c}, \'nan\') = \'{v}\' THEN 1 ELSE 0 END AS {c}__{v}'


@check(
    "one_hot",
    W(*sql.VALID)
    + "SELECT order_id, order_item_id, "
    + ", ".join(
        [_hot("payment_type", k) for k in _KINDS] + [_hot("product_category_name_english", k) for k in _CATEGORIES]
    )
    + " FROM f",
)
def one_hot(spark, folder):
    rows = inputs.featured(spark, folder).select("order_id", "order_item_id", "payment_type", "product_category_name_english")
    return cleaning.one_hot(rows, ["payment_type", "product_category_name_english"])


@check(
    "one_hot_long",
    W(*sql.VALID)
    + """, u AS (SELECT order_id, 'payment_type__' || coalesce(payment_type, 'nan') AS feature FROM f
        UNION ALL SELECT order_id, 'seller_city__' || coalesce(seller_city, 'nan') FROM f)
      SELECT order_id, feature, CAST(count(*) AS BIGINT) AS value FROM u GROUP BY ALL""",
)
def one_hot_long(spark, folder):
    rows = inputs.featured(spark, folder).select("order_id", "payment_type", "seller_city")
    long = cleaning.one_hot_long(rows, ["payment_type", "seller_city"], ["order_id"])
    return long.groupBy("order_id", "feature").agg(F.sum("value").alias("value"))


_SCALED = ["monthly_orders", "avg_ticket", "avg_delivery_days", "is_q4"]


def _scaled(shift: str, size: str, c: str) -> str:
    return f"(CAST({c} AS DOUBLE) - (SELECT {shift.format(c)} FROM s)) / (SELECT coalesce(nullif({size.format(c)}, 0), 1) FROM s) AS {c}"


def _scale_sql(shift: str, size: str) -> str:
    cells = ", ".join(_scaled(shift, size, c) for c in _SCALED[:-1])
    return W(*sql.SERIES) + f"SELECT customer_state, ds, {cells}, is_q4 FROM s"


def _scale(method):
    def run(spark, folder):
        return cleaning.scale(inputs.series(spark, folder).select("customer_state", "ds", *_SCALED), _SCALED, method)

    return run


_PLACES = {c: 4 for c in _SCALED}
check("scale", _scale_sql("avg({})", "stddev_pop({})"), doubles=" ".join(_SCALED[:-1]), dates="ds", **_PLACES)(
    _scale("standard")
)
check("scale_minmax", _scale_sql("min({})", "max({0}) - min({0})"), doubles=" ".join(_SCALED[:-1]), dates="ds", **_PLACES)(
    _scale("minmax")
)


_NUM = ["monthly_orders", "avg_ticket", "avg_review_score", "revenue_lag_1", "revenue_lag_12", "revenue_yoy_growth", "is_q4"]


def _clean_sql() -> str:
    """Clip, impute by median, encode the season and scale, fitted on the training split."""
    steps = [*sql.SERIES]
    train = "ds <= DATE '2000-06-01'"
    bounds = ", ".join(f"{_quantile(c, 0.01)} AS lo_{c}, {_quantile(c, 0.99)} AS hi_{c}" for c in _NUM)
    steps.append(f"sn AS (SELECT *, CASE WHEN is_q4 = 1 THEN 'peak' ELSE 'base' END AS season FROM s)")
    steps.append(f"b AS (SELECT {bounds} FROM sn WHERE {train})")
    steps.append(
        "cl AS (SELECT customer_state, ds, monthly_revenue, season, "
        + ", ".join(f"{_clipped(c)} AS {c}" for c in _NUM)
        + " FROM sn, b)"
    )
    steps.append(f"fi AS (SELECT {', '.join(f'median({c}) AS f_{c}' for c in _NUM)} FROM cl WHERE {train})")
    steps.append(
        "im AS (SELECT customer_state, ds, monthly_revenue, season, "
        + ", ".join(f"CAST(coalesce({c}, f_{c}) AS DOUBLE) AS {c}" for c in _NUM)
        + " FROM cl, fi)"
    )
    cont = [c for c in _NUM if c != "is_q4"]
    steps.append(
        "sc AS (SELECT "
        + ", ".join(f"avg({c}) AS a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS d_{c}" for c in cont)
        + f" FROM im WHERE {train})"
    )
    cells = ", ".join(f"({c} - a_{c}) / d_{c} AS {c}" for c in cont)
    return (
        W(*steps)
        + f"""SELECT customer_state, ds, monthly_revenue, {cells}, is_q4, CASE WHEN season = 'base' THEN 1 ELSE 0 END AS season__base,
        CASE WHEN season = 'peak' THEN 1 ELSE 0 END AS season__peak FROM im, sc"""
    )


def _clean_input(spark, folder):
    season = F.when(F.col("is_q4") == 1, "peak").otherwise("base").alias("season")
    rows = inputs.series(spark, folder).select("customer_state", "ds", "monthly_revenue", *_NUM, season)
    return rows, rows.filter(F.col("ds") <= F.to_date(F.lit("2000-06-01")))


_CLEAN = {c: 4 for c in _NUM}


@check("clean_panel", _clean_sql(), doubles="monthly_revenue " + " ".join(_NUM), dates="ds", **_CLEAN)
def clean_panel(spark, folder):
    rows, train = _clean_input(spark, folder)
    return cleaning.clean_panel(rows, inputs.SETTINGS, STATE, fit_on=train)[0]


@check("clean_panel_reloaded", _clean_sql(), doubles="monthly_revenue " + " ".join(_NUM), dates="ds", **_CLEAN)
def clean_panel_reloaded(spark, folder):
    """Parameters written, read back and applied without refitting."""
    rows, train = _clean_input(spark, folder)
    path = scratch_path(spark, "cleaning")
    cleaning.fit_cleaning(train, inputs.SETTINGS, STATE).to_frame(spark).write.parquet(path)
    model = cleaning.CleaningModel.from_frame(spark.read.parquet(path))
    return cleaning.clean_panel(rows, inputs.SETTINGS, STATE, model, fit=False)[0]


@check("clean_panel_pipeline", _clean_sql(), doubles="monthly_revenue " + " ".join(_NUM), dates="ds", **_CLEAN)
def clean_panel_pipeline(spark, folder):
    """The chain as a stage of a pipeline, fitted on the training rows, saved, read back and applied."""
    rows, _ = _clean_input(spark, folder)
    cleaner = PanelCleaner.of(inputs.SETTINGS, STATE, "ds <= DATE '2000-06-01'")
    features = [c for c in _NUM if c != "is_q4"]
    assembler = VectorAssembler(inputCols=features, outputCol="features_vec")
    path = scratch_path(spark, "pipeline")
    Pipeline(stages=[cleaner, ZeroFill(inputCols=features), assembler]).fit(rows).write().save(path)
    return PipelineModel.load(path).transform(rows).drop("features_vec")
