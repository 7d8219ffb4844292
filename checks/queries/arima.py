"""Seasonal ARIMA models of their own for every series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.registry import check
from panelforge.operators.arima import SeasonalArima

STATE = inputs.STATE

#: One lag of the change against the same place a season before, as a regression of two columns.
_ONE_LAG = sql.with_ctes(*sql.PANEL) + """, tr AS (SELECT customer_state, ds, monthly_revenue AS y,
      monthly_revenue - lag(monthly_revenue, 12) OVER w AS z, row_number() OVER (PARTITION BY customer_state ORDER BY ds DESC) AS back
      FROM panel WHERE ds <= DATE '2000-06-01' WINDOW w AS (PARTITION BY customer_state ORDER BY ds)),
    lg AS (SELECT *, lag(z) OVER (PARTITION BY customer_state ORDER BY ds) AS x FROM tr),
    eq AS (SELECT customer_state, count(*) AS n, regr_slope(z, x) AS b, regr_intercept(z, x) AS a,
        sqrt(greatest(regr_syy(z, x) - regr_slope(z, x) * regr_sxy(z, x), 0) / count(*)) AS sigma
      FROM lg WHERE z IS NOT NULL AND x IS NOT NULL GROUP BY 1 HAVING count(*) > 3)
"""


def _train(spark, folder):
    return inputs.panel(spark, folder).filter(F.col("ds") <= F.to_date(F.lit("2000-06-01")))


@check(
    "arima_one_lag",
    _ONE_LAG + "SELECT customer_state, n, a AS intercept, b AS phi, sigma FROM eq",
    doubles="intercept phi sigma",
    intercept=1,
    sigma=1,
)
def arima_one_lag(spark, folder):
    model = SeasonalArima(order=(1, 0, 0, 0)).fit(_train(spark, folder), STATE)
    return model.models.select("customer_state", "n", "intercept", F.col("coefficients")[0].alias("phi"), "sigma")


@check(
    "arima_one_lag_forecast",
    _ONE_LAG
    + """, en AS (SELECT customer_state, ds, z FROM lg WHERE back = 1),
      hz AS (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS horizon),
      fc AS (SELECT customer_state, en.ds, horizon, CASE horizon WHEN 1 THEN a + b * en.z WHEN 2 THEN a + b * (a + b * en.z)
          ELSE a + b * (a + b * (a + b * en.z)) END + lg.y AS yhat,
          1.959963984540054 * sigma * sqrt(CASE horizon WHEN 1 THEN 1 WHEN 2 THEN 1 + b * b ELSE 1 + b * b + b * b * b * b END) AS margin
        FROM en JOIN eq USING (customer_state) JOIN lg USING (customer_state), hz WHERE lg.back = 13 - horizon)
    SELECT customer_state, ds, horizon, yhat, yhat - margin AS yhat_lower, yhat + margin AS yhat_upper FROM fc""",
    doubles="yhat yhat_lower yhat_upper",
    dates="ds",
    yhat=1,
    yhat_lower=1,
    yhat_upper=1,
)
def arima_one_lag_forecast(spark, folder):
    return SeasonalArima(order=(1, 0, 0, 0)).fit(_train(spark, folder), STATE).forecast(3, STATE)


@check("arima_chosen_order")
def arima_chosen_order(spark, folder):
    """All orders up to three lags, two shocks and both seasonal terms; the best one of every state."""
    return SeasonalArima().fit(_train(spark, folder), STATE).models


@check("arima_forecast")
def arima_forecast(spark, folder):
    return SeasonalArima().fit(_train(spark, folder), STATE).forecast(3, STATE)
