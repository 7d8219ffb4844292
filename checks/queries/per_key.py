"""Linear models of their own for every series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.registry import check
from panelforge.operators.per_key import PerKeyRidge
from panelforge.session import scratch_path

W = sql.with_ctes
STATE = inputs.STATE
TWO = ["revenue_lag_1", "avg_ticket"]

#: Normal equations of two centred features with a penalty of 1, by Cramer's rule, per state and horizon.
_EQUATIONS = W(*sql.SERIES) + ", tr AS (SELECT * FROM s WHERE ds <= DATE '2000-06-01'), pl AS (" + " UNION ALL ".join(
    f"""SELECT customer_state, ds, CAST({h} AS INTEGER) AS horizon, coalesce(revenue_lag_1, 0) AS x1, coalesce(avg_ticket, 0) AS x2,
      lead(monthly_revenue, {h - 1}) OVER (PARTITION BY customer_state ORDER BY ds) AS y FROM tr"""
    for h in (1, 2, 3)
) + """), pm AS (
      SELECT customer_state, horizon, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * count(*) AS s11,
        var_pop(x2) * count(*) AS s22, covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y,
        covar_pop(x2, y) * count(*) AS s2y, var_pop(y) * count(*) AS syy
      FROM pl WHERE y IS NOT NULL GROUP BY ALL),
    pb AS (SELECT *, ((s22 + 1) * s1y - s12 * s2y) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b1,
        ((s11 + 1) * s2y - s12 * s1y) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b2 FROM pm),
    pe AS (SELECT customer_state, horizon, n, my - b1 * m1 - b2 * m2 AS intercept, b1, b2,
        sqrt((syy - 2 * (b1 * s1y + b2 * s2y) + b1 * b1 * s11 + 2 * b1 * b2 * s12 + b2 * b2 * s22) / (n - 1)) AS resid_std FROM pb)
"""


def _fitted(spark, folder):
    train = inputs.series(spark, folder).filter(F.col("ds") <= F.to_date(F.lit("2000-06-01")))
    return train, PerKeyRidge().fit(train, TWO, keys=STATE)


@check(
    "per_key_ridge",
    _EQUATIONS + "SELECT customer_state, horizon, n, intercept, b1, b2, resid_std FROM pe",
    doubles="intercept b1 b2 resid_std",
    intercept=1,
    resid_std=2,
)
def per_key_ridge(spark, folder):
    model = _fitted(spark, folder)[1]
    b = F.col("coefficients")
    return model.equations.select("customer_state", "horizon", "n", "intercept", b[0].alias("b1"), b[1].alias("b2"), "resid_std")


@check(
    "per_key_ridge_forecast",
    _EQUATIONS
    + """, la AS (SELECT customer_state, ds, coalesce(revenue_lag_1, 0) AS x1, coalesce(avg_ticket, 0) AS x2 FROM tr
        QUALIFY row_number() OVER (PARTITION BY customer_state ORDER BY ds DESC) = 1),
      pf AS (SELECT customer_state, ds, horizon, intercept + b1 * x1 + b2 * x2 AS yhat, 1.959963984540054 * 1.5 * resid_std AS margin
        FROM la JOIN pe USING (customer_state))
    SELECT customer_state, ds, horizon, yhat, yhat - margin AS yhat_lower, yhat + margin AS yhat_upper FROM pf""",
    doubles="yhat yhat_lower yhat_upper",
    dates="ds",
    yhat=1,
    yhat_lower=1,
    yhat_upper=1,
)
def per_key_ridge_forecast(spark, folder):
    """Stored, read back, and forecast from the last training row of every state."""
    train, model = _fitted(spark, folder)
    path = scratch_path(spark, "per-key")
    model.save(spark, path)
    return PerKeyRidge.load(spark, path).predict_with_intervals(train, STATE)
