"""Aggregations and business reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.queries.data import LONG_SQL, PANEL_DOUBLES, _NAMED
from checks.registry import check
from panelforge.operators import features, kpi, panel

W = sql.with_ctes


@check(
    "monthly_aggregate",
    W(*sql.VALID, sql.panel("panel", sql.STATE, trimmed=False)) + "SELECT * FROM panel",
    doubles=PANEL_DOUBLES,
    dates="ds",
)
def monthly_aggregate(spark, folder):
    return panel.monthly_aggregate(inputs.valid(spark, folder), inputs.STATE)


@check(
    "monthly_aggregate_global",
    W(*sql.VALID, sql.panel("panel", trimmed=False)) + "SELECT * FROM panel",
    doubles=PANEL_DOUBLES,
    dates="ds",
)
def monthly_aggregate_global(spark, folder):
    return panel.monthly_from_orders(inputs.tables(spark, folder))


@check(
    "monthly_aggregate_by_category",
    W(*sql.VALID, sql.panel("panel", "product_category_name_english, ", trimmed=False)) + "SELECT * FROM panel",
    doubles=PANEL_DOUBLES,
    dates="ds",
)
def monthly_aggregate_by_category(spark, folder):
    return panel.monthly_from_orders(inputs.tables(spark, folder), ["product_category_name_english"])


@check(
    "weekly_aggregate_by_city",
    W(*sql.VALID, "vw AS (SELECT * REPLACE (CAST(date_trunc('week', order_purchase_timestamp) AS DATE) AS ds) FROM v)")
    + f"SELECT customer_city, ds, {sql.AGGREGATES} FROM vw WHERE customer_city IS NOT NULL GROUP BY ALL",
    doubles=PANEL_DOUBLES,
    dates="ds",
)
def weekly_aggregate_by_city(spark, folder):
    return panel.monthly_from_orders(inputs.tables(spark, folder), ["customer_city"], grain="week")


@check(
    "monthly_aggregate_order_grain",
    W(*sql.BASE)
    + f""", fi AS (SELECT order_id, count(order_item_id) AS items, sum(price) AS ps, count(price) AS pn, sum(freight_value) AS fs, count(freight_value) AS fn FROM i GROUP BY 1),
      fp AS (SELECT order_id, count(*) AS np, sum(payment_value) AS pv, count(*) FILTER (payment_type = 'credit_card') AS cc, count(*) FILTER (payment_type = 'boleto') AS bo,
        count(*) FILTER (payment_installments > 1) AS fl, sum(payment_installments) AS si FROM p WHERE payment_value > 0 GROUP BY 1),
      fr AS (SELECT order_id, sum(review_score) AS rs, count(review_score) AS rn FROM r GROUP BY 1),
      b AS (SELECT *, CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS ds,
          {sql._ACTUAL} AS da, {sql._ACTUAL} - {sql._PLANNED} AS dd FROM o JOIN fp USING (order_id) LEFT JOIN fi USING (order_id) LEFT JOIN fr USING (order_id)
          LEFT JOIN c USING (customer_id) WHERE order_status = 'delivered'),
      md AS (SELECT b.ds, quantile_cont(p.payment_value, 0.5) AS median_ticket FROM b JOIN p USING (order_id) WHERE p.payment_value > 0 GROUP BY 1),
      of_ AS (SELECT b.ds, count(DISTINCT ct.product_category_name_english) AS unique_categories, count(DISTINCT i.seller_id) AS unique_sellers
        FROM b JOIN i USING (order_id) LEFT JOIN pr ON pr.product_id = i.product_id LEFT JOIN ct ON ct.product_category_name = pr.product_category_name GROUP BY 1),
      ag AS (SELECT ds, sum(pv) AS monthly_revenue, count(DISTINCT order_id) AS monthly_orders, count(DISTINCT customer_unique_id) AS monthly_customers,
        CAST(coalesce(sum(items), 0) AS BIGINT) AS monthly_items, sum(pv) / sum(np) AS avg_ticket, sum(rs) / sum(rn) AS avg_review_score,
        avg(da) AS avg_delivery_days, avg(dd) AS avg_delay_days, avg(CASE WHEN dd > 0 THEN 1 ELSE 0 END) AS pct_late_delivery,
        sum(fs) / sum(fn) AS avg_freight, sum(ps) / sum(pn) AS avg_price, coalesce(sum(fs), 0) AS total_freight, sum(cc) / sum(np) AS pct_credit_card,
        sum(bo) / sum(np) AS pct_boleto, sum(fl) / sum(np) AS pct_installments, sum(si) / sum(np) AS avg_installments,
        count(DISTINCT customer_state) AS unique_states FROM b GROUP BY 1)
    SELECT ag.*, median_ticket, unique_categories, unique_sellers FROM ag JOIN md USING (ds) JOIN of_ USING (ds)""",
    doubles=PANEL_DOUBLES,
    dates="ds",
)
def monthly_aggregate_order_grain(spark, folder):
    return panel.monthly_from_orders(inputs.tables(spark, folder), fanout="order")


@check("monthly_aggregate_approximate")
def monthly_aggregate_approximate(spark, folder):
    return panel.monthly_aggregate(inputs.valid(spark, folder), inputs.STATE, approximate=True)


@check(
    "trim_edge_months",
    W(*sql.PANEL) + "SELECT customer_state, ds, monthly_orders FROM panel",
    dates="ds",
)
def trim_edge_months(spark, folder):
    full = panel.monthly_from_orders(inputs.tables(spark, folder), inputs.STATE)
    return panel.trim_edge_months(full, inputs.STATE).select("customer_state", "ds", "monthly_orders")


@check("build_monthly_table", W(*sql.PANEL) + "SELECT * FROM panel", doubles=PANEL_DOUBLES, dates="ds")
def build_monthly_table(spark, folder):
    return panel.build_monthly_table(inputs.featured(spark, folder), inputs.STATE)


_KPI_DOUBLES = (
    "revenue_total avg_review_score pct_5star pct_1star avg_delivery_days pct_on_time avg_late_delay_days "
    "repeat_customer_rate avg_monthly_revenue median_monthly_revenue max_monthly_revenue min_monthly_revenue"
)


@check(
    "business_kpis",
    W(*sql.PANEL0)
    + """, a AS (SELECT sum(payment_value) AS revenue_total, avg(review_score) AS avg_review_score,
        avg(CASE WHEN review_score = 5 THEN 1 ELSE 0 END) * 100 AS pct_5star,
        avg(CASE WHEN review_score = 1 THEN 1 ELSE 0 END) * 100 AS pct_1star,
        avg(delivery_days_actual) AS avg_delivery_days,
        avg(CASE WHEN is_late_delivery = 0 THEN 1 ELSE 0 END) * 100 AS pct_on_time,
        avg(CASE WHEN delivery_delay_days > 0 THEN delivery_delay_days END) AS avg_late_delay_days FROM v),
      b AS (SELECT count(*) AS total_unique_customers, avg(CASE WHEN k > 1 THEN 1 ELSE 0 END) * 100 AS repeat_customer_rate
        FROM (SELECT customer_unique_id, count(DISTINCT order_id) AS k FROM v WHERE customer_unique_id IS NOT NULL GROUP BY 1)),
      d AS (SELECT avg(monthly_revenue) AS avg_monthly_revenue, median(monthly_revenue) AS median_monthly_revenue,
        max(monthly_revenue) AS max_monthly_revenue, min(monthly_revenue) AS min_monthly_revenue FROM panel0)
    SELECT * FROM a, b, d""",
    doubles=_KPI_DOUBLES,
    avg_monthly_revenue=2,
    median_monthly_revenue=2,
    max_monthly_revenue=2,
    min_monthly_revenue=2,
)
def business_kpis(spark, folder):
    return kpi.business_kpis(inputs.valid(spark, folder), inputs.panel0(spark, folder))


@check(
    "cancellation_rate",
    W(*sql.VALID) + "SELECT avg(is_canceled) * 100 AS cancellation_rate FROM f",
    doubles="cancellation_rate",
)
def cancellation_rate(spark, folder):
    return kpi.cancellation_rate(inputs.featured(spark, folder))


_NULLABLE = ["revenue_lag_1", "revenue_lag_12", "revenue_rolling_std_6", "revenue_yoy_growth", "avg_review_score", "monthly_revenue"]


@check(
    "null_analysis",
    W(*sql.SERIES)
    + ", n AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS null_count, round_even((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct FROM s"
        for c in _NULLABLE
    )
    + ") SELECT * FROM n WHERE null_count > 0",
    doubles="null_pct",
)
def null_analysis(spark, folder):
    return kpi.null_analysis(inputs.series(spark, folder), _NULLABLE)


@check(
    "describe_target",
    W(*sql.PANEL)
    + """SELECT count(monthly_revenue) AS count, avg(monthly_revenue) AS mean, stddev_samp(monthly_revenue) AS std,
      min(monthly_revenue) AS min, max(monthly_revenue) AS max, quantile_cont(monthly_revenue, 0.25) AS q25,
      quantile_cont(monthly_revenue, 0.5) AS q50, quantile_cont(monthly_revenue, 0.75) AS q75 FROM panel""",
    doubles="mean std min max q25 q50 q75",
    mean=2, std=2, min=2, max=2, q25=2, q50=2, q75=2,
)
def describe_target(spark, folder):
    return kpi.describe_target(inputs.panel(spark, folder))


@check(
    "pareto",
    W(*sql.VALID)
    + """, t AS (SELECT product_category_name_english AS category, sum(payment_value) AS revenue_total FROM v
        WHERE product_category_name_english IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15),
      q AS (SELECT *, round_even(revenue_total * 100 / sum(revenue_total) OVER (), 2) AS pct_revenue FROM t),
      z AS (SELECT *, sum(pct_revenue) OVER (ORDER BY revenue_total DESC, category ROWS UNBOUNDED PRECEDING) AS cumulative_pct FROM q)
    SELECT *, cumulative_pct <= 80 AS in_80_pct FROM z""",
    doubles="revenue_total pct_revenue cumulative_pct",
)
def pareto(spark, folder):
    return kpi.pareto(inputs.valid(spark, folder))


@check(
    "cumulative_share",
    W(*sql.VALID)
    + """, t AS (SELECT customer_state, seller_state, sum(payment_value) AS revenue FROM v WHERE seller_state IS NOT NULL GROUP BY ALL),
      q AS (SELECT *, revenue * 100 / nullif(sum(revenue) OVER (PARTITION BY customer_state), 0) AS share_pct FROM t)
    SELECT *, sum(share_pct) OVER (PARTITION BY customer_state ORDER BY revenue DESC ROWS UNBOUNDED PRECEDING) AS cumulative_pct FROM q""",
    doubles="revenue share_pct cumulative_pct",
    revenue=2,
)
def cumulative_share(spark, folder):
    from panelforge.operators.timeseries import cumulative_share as share

    totals = (
        inputs.valid(spark, folder)
        .filter(F.col("seller_state").isNotNull())
        .groupBy("customer_state", "seller_state")
        .agg(F.sum("payment_value").alias("revenue"))
    )
    return share(totals, "revenue", ["customer_state"])


_OUTLIER = ["payment_value", "price", "freight_value"]


@check(
    "iqr_outliers",
    W(*sql.VALID)
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x FROM v WHERE {c} IS NOT NULL" for c in _OUTLIER)
    + """), q AS (SELECT feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.5) AS median FROM u GROUP BY 1),
      g AS (SELECT *, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
    SELECT feature, q1, q3, upper_fence, median, CAST(sum(CASE WHEN x > upper_fence THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
      avg(CASE WHEN x > upper_fence THEN 1 ELSE 0 END) * 100 AS pct_outliers, max(x) AS max_value
    FROM u JOIN g USING (feature) GROUP BY ALL""",
    doubles="q1 q3 upper_fence median pct_outliers max_value",
)
def iqr_outliers(spark, folder):
    return kpi.iqr_outliers(inputs.valid(spark, folder), _OUTLIER)


@check(
    "seasonality_by_month",
    W(*sql.PANEL0)
    + """, a AS (SELECT CAST(month(ds) AS INTEGER) AS month, avg(monthly_revenue) AS avg_revenue FROM panel0 GROUP BY 1),
      e AS (SELECT arg_max(month, avg_revenue) AS best_month, arg_min(month, avg_revenue) AS worst_month FROM a),
      q AS (SELECT avg(monthly_revenue) FILTER (quarter(ds) = 4) AS q4_avg, avg(monthly_revenue) FILTER (quarter(ds) <> 4) AS rest_avg FROM panel0)
    SELECT a.*, e.*, q.*, (q4_avg / rest_avg - 1) * 100 AS q4_uplift_pct FROM a, e, q""",
    doubles="avg_revenue q4_avg rest_avg q4_uplift_pct",
    avg_revenue=2,
    q4_avg=2,
    rest_avg=2,
)
def seasonality_by_month(spark, folder):
    return kpi.seasonality_by_month(inputs.panel0(spark, folder))


@check(
    "payment_type_by_month",
    W(*sql.VALID)
    + """, a AS (SELECT ds, payment_type, count(*) AS n_payments, avg(payment_value) AS avg_ticket FROM v
        WHERE payment_type IS NOT NULL GROUP BY ALL)
    SELECT *, n_payments * 100.0 / sum(n_payments) OVER (PARTITION BY ds) AS share_pct FROM a""",
    doubles="avg_ticket share_pct",
    dates="ds",
)
def payment_type_by_month(spark, folder):
    return kpi.payment_type_by_month(inputs.valid(spark, folder))


@check(
    "repeat_customers_by_period",
    W(*sql.BASE)
    + """, k AS (SELECT c.customer_unique_id, min(CAST(date_trunc('month', order_purchase_timestamp) AS DATE)) AS cohort,
        count(DISTINCT order_id) AS orders FROM o JOIN c USING (customer_id) GROUP BY 1),
      g AS (SELECT cohort, count(*) AS customers, CAST(sum(CASE WHEN orders > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeat_customers,
        avg(CASE WHEN orders > 1 THEN 1 ELSE 0 END) * 100 AS repeat_rate_pct FROM k GROUP BY 1)
    SELECT *, customers * 1.0 / lag(customers) OVER (ORDER BY cohort) - 1 AS customer_growth FROM g""",
    doubles="repeat_rate_pct customer_growth",
    dates="cohort",
)
def repeat_customers_by_period(spark, folder):
    t = inputs.tables(spark, folder)
    return kpi.repeat_customers_by_period(t["orders"], t["customers"])


@check(
    "delay_quartiles_vs_review",
    W(*sql.VALID)
    + """, k AS (SELECT delivery_delay_days AS d, review_score FROM v WHERE delivery_delay_days IS NOT NULL AND review_score IS NOT NULL),
      q AS (SELECT quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS q2, quantile_cont(d, 0.75) AS q3 FROM k)
    SELECT CASE WHEN d <= q1 THEN 1 WHEN d <= q2 THEN 2 WHEN d <= q3 THEN 3 ELSE 4 END AS delay_quartile, count(*) AS n_rows,
      avg(review_score) AS avg_review_score, avg(d) AS avg_delay_days FROM k, q GROUP BY 1""",
    doubles="avg_review_score avg_delay_days",
)
def delay_quartiles_vs_review(spark, folder):
    return kpi.delay_quartiles_vs_review(inputs.valid(spark, folder))


@check(
    "domain_summary",
    LONG_SQL
    + """, k AS (SELECT feature, domain, CASE WHEN stddev_samp(value) > 0 THEN 1 ELSE 0 END AS flag_selected FROM d GROUP BY ALL)
    SELECT domain, count(*) AS total, CAST(sum(flag_selected) AS BIGINT) AS selected FROM k GROUP BY 1""",
)
def domain_summary(spark, folder):
    # a feature counts as selected here when it varies
    long = features.to_long(inputs.series(spark, folder), _NAMED).filter(F.col("value").isNotNull())
    flags = features.infer_domain(long).groupBy("feature", "domain").agg(
        (F.stddev_samp("value") > 0).cast("int").alias("flag_selected")
    )
    return kpi.domain_summary(flags)


@check(
    "overview_totals",
    W(*sql.PANEL0)
    + """SELECT sum(monthly_revenue) AS total_revenue, avg(monthly_revenue) AS avg_revenue,
      median(monthly_revenue) AS median_revenue, count(*) AS n_months FROM panel0""",
    doubles="total_revenue avg_revenue median_revenue",
    total_revenue=2,
    avg_revenue=2,
    median_revenue=2,
)
def overview_totals(spark, folder):
    return kpi.overview_totals(inputs.panel0(spark, folder))
