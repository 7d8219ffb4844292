"""Time-series features, sorting and time splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.queries.data import SERIES_DOUBLES
from checks.registry import check
from panelforge.operators import splits, timeseries, unit_root
from panelforge.operators.joins import latest_per_key

W = sql.with_ctes
STATE = inputs.STATE
SPLIT_CASE = """CASE WHEN ds <= DATE '2000-06-01' THEN 'train' WHEN ds <= DATE '2000-12-01' THEN 'val'
  WHEN ds <= DATE '2001-07-01' THEN 'backtest' END"""


def _project(*names: str) -> str:
    return W(*sql.SERIES) + f"SELECT customer_state, ds, {', '.join(names)} FROM s"


_LAGS = [f"{a}_lag_{n}" for n in (1, 2, 3, 6, 12) for a in ("revenue", "orders")]


@check("lag_features", _project(*_LAGS), doubles=" ".join(c for c in _LAGS if c.startswith("rev")), dates="ds")
def lag_features(spark, folder):
    return timeseries.lag_features(inputs.panel(spark, folder), STATE).select("customer_state", "ds", *_LAGS)


_ROLL = [f"revenue_rolling_{a}_{n}" for n in (3, 6) for a in ("mean", "std")]


@check("rolling_features", _project(*_ROLL), doubles=" ".join(_ROLL), dates="ds")
def rolling_features(spark, folder):
    return timeseries.rolling_features(inputs.panel(spark, folder), STATE).select("customer_state", "ds", *_ROLL)


_GROW = ["revenue_mom_growth", "revenue_yoy_growth"]


@check("growth_features", _project(*_GROW), doubles=" ".join(_GROW), dates="ds")
def growth_features(spark, folder):
    return timeseries.growth_features(inputs.panel(spark, folder), STATE).select("customer_state", "ds", *_GROW)


@check("add_time_series_features", W(*sql.SERIES0) + "SELECT * FROM s0", doubles=SERIES_DOUBLES, dates="ds")
def add_time_series_features(spark, folder):
    return inputs.series0(spark, folder)


_SPINE = """, b AS (SELECT customer_state, min(ds) AS a, max(ds) AS z FROM panel GROUP BY 1),
  spine AS (SELECT customer_state, CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS ds FROM b),
  dense AS (SELECT spine.*, monthly_revenue, avg_review_score FROM spine LEFT JOIN panel USING (customer_state, ds))"""


@check(
    "calendar_densify",
    W(*sql.PANEL) + _SPINE + " SELECT customer_state, ds, monthly_revenue FROM dense",
    doubles="monthly_revenue",
    dates="ds",
)
def calendar_densify(spark, folder):
    dense = timeseries.calendar_densify(inputs.panel(spark, folder), STATE)
    return dense.select("customer_state", "ds", "monthly_revenue")


@check(
    "forward_fill",
    W(*sql.PANEL)
    + _SPINE
    + """ SELECT customer_state, ds, coalesce(
          last_value(monthly_revenue IGNORE NULLS) OVER (PARTITION BY customer_state ORDER BY ds ROWS UNBOUNDED PRECEDING),
          first_value(monthly_revenue IGNORE NULLS) OVER (PARTITION BY customer_state ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ) AS monthly_revenue,
        coalesce(last_value(avg_review_score IGNORE NULLS) OVER (PARTITION BY customer_state ORDER BY ds ROWS UNBOUNDED PRECEDING),
          first_value(avg_review_score IGNORE NULLS) OVER (PARTITION BY customer_state ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ) AS avg_review_score FROM dense""",
    doubles="monthly_revenue avg_review_score",
    dates="ds",
)
def forward_fill(spark, folder):
    dense = timeseries.calendar_densify(inputs.panel(spark, folder), STATE)
    filled = timeseries.forward_fill(dense, ["monthly_revenue", "avg_review_score"], STATE)
    return filled.select("customer_state", "ds", "monthly_revenue", "avg_review_score")


@check(
    "difference",
    W(*sql.PANEL)
    + "SELECT customer_state, ds, monthly_revenue - lag(monthly_revenue) OVER (PARTITION BY customer_state ORDER BY ds) AS revenue_diff FROM panel",
    doubles="revenue_diff",
    dates="ds",
)
def difference(spark, folder):
    return timeseries.difference(inputs.panel(spark, folder), STATE).select("customer_state", "ds", "revenue_diff")


def _acf_sql(source: str, keys: str) -> str:
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    lags = ", ".join(f"sum(d * lag_{k}) AS p{k}" for k in range(13))
    cols = ", ".join(f"lag(d, {k}) OVER ({part} ORDER BY ds) AS lag_{k}" for k in range(13))
    rows = " UNION ALL ".join(
        f"SELECT {keys}n, CAST({k} AS INTEGER) AS lag, p{k} / nullif(p0, 0) AS acf FROM sums WHERE {k} < n" for k in range(13)
    )
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""
    , cen AS (SELECT {keys}ds, monthly_revenue - avg(monthly_revenue) OVER ({part}) AS d, count(*) OVER ({part}) AS n FROM {source}),
      shifted AS (SELECT {keys}d, n, {cols} FROM cen),
      sums AS (SELECT {keys}max(n) AS n, {lags} FROM shifted {group})
    {rows}"""


@check("acf", W(*sql.PANEL) + _acf_sql("panel", "customer_state, "), doubles="acf")
def acf(spark, folder):
    return timeseries.acf(inputs.panel(spark, folder), STATE)


@check("acf_global", W(*sql.PANEL0) + _acf_sql("panel0", ""), doubles="acf")
def acf_global(spark, folder):
    return timeseries.acf(inputs.panel0(spark, folder))


def _pacf_sql(top: int) -> str:
    """Durbin–Levinson written out: one CTE per order."""
    base = _acf_sql("panel", "customer_state, ")
    head, rows = base.rsplit("sums AS (", 1)
    sums, rest = rows.split(")\n", 1)
    r = ", ".join(f"max(acf) FILTER (lag = {k}) AS r{k}" for k in range(1, top + 1))
    ctes = [f"ac AS ({rest.strip()})", f"d0 AS (SELECT customer_state, max(n) AS n, {r} FROM ac GROUP BY 1)"]
    ctes.append("d1 AS (SELECT *, r1 AS f1_1 FROM d0)")
    for k in range(2, top + 1):
        above = " + ".join(f"f{k - 1}_{j} * r{k - j}" for j in range(1, k))
        below = " + ".join(f"f{k - 1}_{j} * r{j}" for j in range(1, k))
        inner = ", ".join(f"f{k - 1}_{j} - f{k}_{k} * f{k - 1}_{k - j} AS f{k}_{j}" for j in range(1, k))
        ctes.append(f"d{k} AS (SELECT *, (r{k} - ({above})) / (1 - ({below})) AS f{k}_{k}, {inner} FROM d{k - 1})")
    out = " UNION ALL ".join(
        f"SELECT customer_state, CAST({k} AS INTEGER) AS lag, f{k}_{k} AS pacf FROM d{top} WHERE n // 2 - 1 >= {k}"
        for k in range(1, top + 1)
    )
    return W(*sql.PANEL) + f"{head}sums AS ({sums}), " + ", ".join(ctes) + " " + out


@check("pacf", _pacf_sql(12), doubles="pacf")
def pacf(spark, folder):
    return timeseries.pacf(inputs.panel(spark, folder), STATE)


@check(
    "seasonal_decompose",
    W(*sql.PANEL)
    + """, b AS (SELECT customer_state, ds, monthly_revenue AS observed, row_number() OVER w - 1 AS pos,
          count(*) OVER (PARTITION BY customer_state) AS n,
          sum(monthly_revenue) OVER (PARTITION BY customer_state ORDER BY ds ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS inner_sum,
          lag(monthly_revenue, 6) OVER w + lead(monthly_revenue, 6) OVER w AS ends
        FROM panel WINDOW w AS (PARTITION BY customer_state ORDER BY ds)),
      t AS (SELECT *, CASE WHEN pos >= 6 AND pos < n - 6 THEN (inner_sum + ends * 0.5) / 12 END AS trend FROM b WHERE n >= 24),
      ph AS (SELECT customer_state, pos % 12 AS phase, avg(observed - trend) AS s FROM t GROUP BY ALL),
      ce AS (SELECT customer_state, phase, s - avg(s) OVER (PARTITION BY customer_state) AS seasonal FROM ph)
    SELECT t.customer_state, ds, observed, trend, seasonal, observed - trend - seasonal AS resid
    FROM t JOIN ce ON ce.customer_state = t.customer_state AND ce.phase = t.pos % 12""",
    doubles="observed trend seasonal resid",
    dates="ds",
)
def seasonal_decompose(spark, folder):
    return timeseries.seasonal_decompose(inputs.panel(spark, folder), STATE)


@check(
    "latest_row",
    W(*sql.SERIES)
    + "SELECT customer_state, ds, monthly_revenue, revenue_lag_1 FROM s QUALIFY row_number() OVER (PARTITION BY customer_state ORDER BY ds DESC) = 1",
    doubles="monthly_revenue revenue_lag_1",
    dates="ds",
)
def latest_row(spark, folder):
    last = latest_per_key(inputs.series(spark, folder), STATE, "ds")
    return last.select("customer_state", "ds", "monthly_revenue", "revenue_lag_1")


@check(
    "split_data",
    W(*sql.PANEL)
    + f"SELECT customer_state, ds, monthly_orders, {SPLIT_CASE} AS split, ds = DATE '2001-07-01' AS is_live FROM panel",
    dates="ds",
)
def split_data(spark, folder):
    out = splits.split_data(inputs.panel(spark, folder), inputs.SETTINGS)
    return out.select("customer_state", "ds", "monthly_orders", "split", "is_live")


@check(
    "union_test_splits",
    W(*sql.PANEL)
    + f"SELECT * FROM (SELECT customer_state, ds, monthly_orders, {SPLIT_CASE} AS split FROM panel) WHERE split IN ('val', 'backtest')",
    dates="ds",
)
def union_test_splits(spark, folder):
    out = splits.union_test_splits(splits.split_data(inputs.panel(spark, folder), inputs.SETTINGS))
    return out.select("customer_state", "ds", "monthly_orders", "split")


@check(
    "union_history",
    W(*sql.PANEL)
    + """SELECT customer_state, ds, monthly_revenue, CASE WHEN ds <= DATE '2001-05-01' THEN monthly_orders END AS monthly_orders FROM panel""",
    doubles="monthly_revenue",
    dates="ds",
)
def union_history(spark, folder):
    # the newest months arrive without an order count
    panel = inputs.panel(spark, folder)
    cut = F.to_date(F.lit("2001-05-01"))
    history = panel.filter(F.col("ds") <= cut).select("customer_state", "ds", "monthly_revenue", "monthly_orders")
    arrived = panel.filter(F.col("ds") > cut).select("customer_state", "ds", "monthly_revenue")
    return splits.union_history(history, arrived)


@check(
    "time_series_folds",
    W(*sql.PANEL)
    + """, d AS (SELECT ds, row_number() OVER (ORDER BY ds) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT ds FROM panel)),
      e AS (SELECT *, n // 4 AS size, n - 3 * (n // 4) AS start FROM d),
      k AS (SELECT ds, CASE WHEN pos < start THEN 0 ELSE (pos - start) // size + 1 END AS block FROM e),
      x AS (SELECT ds, block, CAST(fold AS INTEGER) AS fold FROM k, (SELECT unnest([1, 2, 3]) AS fold) WHERE block <= fold)
    SELECT customer_state, ds, fold, CASE WHEN block = fold THEN 'test' ELSE 'train' END AS role, monthly_orders FROM panel JOIN x USING (ds)""",
    dates="ds",
)
def time_series_folds(spark, folder):
    out = splits.time_series_folds(inputs.panel(spark, folder), 3)
    return out.select("customer_state", "ds", "fold", "role", "monthly_orders")


@check(
    "holdout_last_n",
    W(*sql.PANEL)
    + "SELECT customer_state, ds, row_number() OVER (PARTITION BY customer_state ORDER BY ds DESC) <= 3 AS is_test FROM panel",
    dates="ds",
)
def holdout_last_n(spark, folder):
    return splits.holdout_last_n(inputs.panel(spark, folder), 3, STATE).select("customer_state", "ds", "is_test")


_AT = {1: "(-3.43035 - 6.5393 / n - 16.786 / n**2 - 79.433 / n**3)", 5: "(-2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3)",
       10: "(-2.56677 - 1.5384 / n - 2.809 / n**2)"}


@check(
    "unit_root_test",
    W(*sql.PANEL)
    + f""", ur AS (SELECT customer_state, ds, monthly_revenue AS v, lag(monthly_revenue) OVER w AS x FROM panel WINDOW w AS (PARTITION BY customer_state ORDER BY ds)),
      ud AS (SELECT customer_state, x, v - x AS y, lag(v - x) OVER (PARTITION BY customer_state ORDER BY ds) AS z FROM ur),
      um AS (SELECT customer_state, count(*) AS n, var_pop(x) * count(*) AS xx, var_pop(z) * count(*) AS zz, var_pop(y) * count(*) AS yy,
          covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy
        FROM ud WHERE x IS NOT NULL AND z IS NOT NULL GROUP BY 1),
      ub AS (SELECT *, xy / xx AS b0, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS b1, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS c1 FROM um),
      ue AS (SELECT *, yy - b0 * xy AS r0, yy - b1 * xy - c1 * zy AS r1 FROM ub),
      us AS (SELECT *, b0 / sqrt(r0 / (n - 2) / xx) AS t0, b1 / sqrt(r1 / (n - 3) * zz / (xx * zz - xz * xz)) AS t1,
          n * ln(r1 / n) + 6 < n * ln(r0 / n) + 4 AS one FROM ue),
      ut AS (SELECT customer_state, n, CAST(CASE WHEN one THEN 1 ELSE 0 END AS INTEGER) AS lags, CASE WHEN one THEN t1 ELSE t0 END AS t FROM us)
    SELECT customer_state, n, lags, t AS statistic, {_AT[1]} AS crit_1, {_AT[5]} AS crit_5, {_AT[10]} AS crit_10, t < {_AT[5]} AS stationary,
      CASE WHEN t <= {_AT[1]} THEN 0.01 WHEN t >= {_AT[10]} THEN 0.1 WHEN t < {_AT[5]} THEN 0.01 + 0.04 * (t - {_AT[1]}) / ({_AT[5]} - {_AT[1]})
        ELSE 0.05 + 0.05 * (t - {_AT[5]}) / ({_AT[10]} - {_AT[5]}) END AS p_value FROM ut""",
    doubles="statistic crit_1 crit_5 crit_10 p_value",
)
def unit_root_test(spark, folder):
    return unit_root.unit_root_test(inputs.panel(spark, folder), STATE, max_lags=1)
