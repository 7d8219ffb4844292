"""SQL fragments of the oracles: common table expressions over the star schema."""

from __future__ import annotations

TABLES = """
o AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'canceled' WHEN 'O' THEN 'shipped' END AS order_status,
    o_orderdate AS order_purchase_timestamp,
    o_orderdate + INTERVAL 30 DAY AS order_estimated_delivery_date,
    s.first_ship AS order_delivered_carrier_date, s.last_ship AS order_delivered_customer_date
  FROM orders LEFT JOIN (
    SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1
  ) s ON l_orderkey = o_orderkey),
i AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
    l_shipdate AS shipping_limit_date, l_extendedprice AS price, l_extendedprice * l_tax AS freight_value
  FROM lineitem),
p AS (
  SELECT o_orderkey AS order_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'boleto' WHEN '3-MEDIUM' THEN 'voucher'
      WHEN '4-NOT SPECIFIED' THEN 'debit_card' WHEN '5-LOW' THEN 'not_defined' END AS payment_type,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS payment_installments, o_totalprice AS payment_value
  FROM orders),
r AS (
  SELECT l_orderkey AS order_id, CAST(1 + CAST(l_quantity AS INTEGER) % 5 AS INTEGER) AS review_score,
    l_returnflag AS review_comment_title
  FROM lineitem WHERE l_linenumber = 1),
c AS (
  SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id, c_mktsegment AS customer_city, n_name AS customer_state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
pr AS (
  SELECT p_partkey AS product_id, p_type AS product_category_name, p_retailprice AS product_weight_g,
    CAST(p_size AS DOUBLE) AS product_length_cm, CAST(p_size AS DOUBLE) AS product_height_cm,
    CAST(p_size AS DOUBLE) AS product_width_cm
  FROM part),
sl AS (
  SELECT s_suppkey AS seller_id, s_name AS seller_city, n_name AS seller_state
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
ct AS (
  SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS product_category_name_english
  FROM part WHERE p_type <> 'MEDIUM')
"""

FACTS = """
facts AS (
  SELECT o.*, i.* EXCLUDE (order_id), p.* EXCLUDE (order_id), r.* EXCLUDE (order_id)
  FROM o LEFT JOIN i USING (order_id) LEFT JOIN p USING (order_id) LEFT JOIN r USING (order_id))
"""

MASTER = """
m AS (
  SELECT facts.*, c.* EXCLUDE (customer_id),
    ct.product_category_name_english, pr.product_weight_g, pr.product_length_cm, pr.product_height_cm,
    pr.product_width_cm, sl.seller_city, sl.seller_state
  FROM facts LEFT JOIN c USING (customer_id)
    LEFT JOIN pr ON pr.product_id = facts.product_id LEFT JOIN ct ON ct.product_category_name = pr.product_category_name
    LEFT JOIN sl ON sl.seller_id = facts.seller_id)
"""


def whole_days(end: str, start: str) -> str:
    return f"CAST(floor((epoch_us({end}) - epoch_us({start})) / 86400000000.0) AS INTEGER)"


_ACTUAL = whole_days("order_delivered_customer_date", "order_purchase_timestamp")
_PLANNED = whole_days("order_estimated_delivery_date", "order_purchase_timestamp")
_CARRIER = whole_days("order_delivered_carrier_date", "order_purchase_timestamp")


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


FEATURED = f"""
f AS (
  SELECT *,
    CAST(year(order_purchase_timestamp) AS INTEGER) AS order_year,
    CAST(month(order_purchase_timestamp) AS INTEGER) AS order_month,
    CAST(quarter(order_purchase_timestamp) AS INTEGER) AS order_quarter,
    CAST(week(order_purchase_timestamp) AS INTEGER) AS order_week,
    CAST(isodow(order_purchase_timestamp) - 1 AS INTEGER) AS order_dayofweek,
    CAST(day(order_purchase_timestamp) AS INTEGER) AS order_dayofmonth,
    CAST(hour(order_purchase_timestamp) AS INTEGER) AS order_hour,
    {flag("isodow(order_purchase_timestamp) >= 6")} AS is_weekend,
    {flag("day(order_purchase_timestamp) >= 25")} AS is_end_of_month,
    CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS ds,
    {_ACTUAL} AS delivery_days_actual, {_PLANNED} AS delivery_days_estimated,
    {_ACTUAL} - {_PLANNED} AS delivery_delay_days,
    {flag(f"{_ACTUAL} - {_PLANNED} > 0")} AS is_late_delivery,
    {_CARRIER} AS carrier_days,
    {flag("payment_type = 'credit_card'")} AS is_credit_card, {flag("payment_type = 'boleto'")} AS is_boleto,
    {flag("payment_type = 'voucher'")} AS is_voucher, {flag("payment_type = 'debit_card'")} AS is_debit_card,
    {flag("payment_installments > 1")} AS payment_installments_flag,
    product_length_cm * product_height_cm * product_width_cm AS product_volume_cm3,
    freight_value / (price + freight_value + 1e-9) AS freight_ratio,
    {flag("order_status = 'delivered'")} AS is_delivered, {flag("order_status = 'canceled'")} AS is_canceled
  FROM m),
v AS (SELECT * FROM f WHERE order_status = 'delivered' AND payment_value > 0)
"""

AGGREGATES = """
    coalesce(sum(payment_value), 0) AS monthly_revenue, count(DISTINCT order_id) AS monthly_orders,
    count(DISTINCT customer_unique_id) AS monthly_customers, count(order_item_id) AS monthly_items,
    avg(payment_value) AS avg_ticket, quantile_cont(payment_value, 0.5) AS median_ticket,
    avg(review_score) AS avg_review_score, avg(delivery_days_actual) AS avg_delivery_days,
    avg(delivery_delay_days) AS avg_delay_days, avg(is_late_delivery) AS pct_late_delivery,
    avg(freight_value) AS avg_freight, avg(price) AS avg_price, coalesce(sum(freight_value), 0) AS total_freight,
    avg(is_credit_card) AS pct_credit_card, avg(is_boleto) AS pct_boleto,
    avg(payment_installments_flag) AS pct_installments, avg(payment_installments) AS avg_installments,
    count(DISTINCT product_category_name_english) AS unique_categories, count(DISTINCT seller_id) AS unique_sellers,
    count(DISTINCT customer_state) AS unique_states
"""


def panel(name: str, keys: str = "", trimmed: bool = True) -> str:
    """CTE with the monthly panel; ``keys`` is "" or a comma list ending in ", "."""
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    known = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.rstrip(", ").split(",")) if keys else "true"
    keep = "WHERE pos > 1 AND pos < len" if trimmed else ""
    return f"""
{name} AS (
  SELECT * EXCLUDE (pos, len) FROM (
    SELECT *, row_number() OVER ({part} ORDER BY ds) AS pos, count(*) OVER ({part}) AS len
    FROM (SELECT {keys}ds, {AGGREGATES} FROM v WHERE {known} GROUP BY {keys}ds)) {keep})
"""


def series_features(name: str, source: str, keys: str = "") -> str:
    """CTE with lags, rolling statistics, growth and calendar columns."""
    part = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    cols = []
    for n in (1, 2, 3, 6, 12):
        cols.append(f"lag(monthly_revenue, {n}) OVER w AS revenue_lag_{n}")
        cols.append(f"lag(monthly_orders, {n}) OVER w AS orders_lag_{n}")
    for n in (3, 6):
        frame = f"OVER ({part} ORDER BY ds ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        full = f"count(monthly_revenue) {frame} = {n}"
        cols.append(f"CASE WHEN {full} THEN avg(monthly_revenue) {frame} END AS revenue_rolling_mean_{n}")
        cols.append(f"CASE WHEN {full} THEN stddev_samp(monthly_revenue) {frame} END AS revenue_rolling_std_{n}")
    for label, n in (("mom", 1), ("yoy", 12)):
        cols.append(f"monthly_revenue / nullif(lag(monthly_revenue, {n}) OVER w, 0) - 1 AS revenue_{label}_growth")
    cols += [
        "CAST(month(ds) AS INTEGER) AS month",
        "CAST(quarter(ds) AS INTEGER) AS quarter",
        "sin(2 * pi() * month(ds) / 12) AS month_sin",
        "cos(2 * pi() * month(ds) / 12) AS month_cos",
        f"{flag('quarter(ds) = 4')} AS is_q4",
        f"{flag('month(ds) >= 11')} AS is_nov_dec",
    ]
    body = ",\n    ".join(cols)
    return f"\n{name} AS (SELECT *,\n    {body}\n  FROM {source} WINDOW w AS ({part} ORDER BY ds))\n"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


BASE = (TABLES,)
MASTERED = (TABLES, FACTS, MASTER)
VALID = (TABLES, FACTS, MASTER, FEATURED)
STATE = "customer_state, "
PANEL = (*VALID, panel("panel", STATE))
PANEL0 = (*VALID, panel("panel0"))
SERIES = (*PANEL, series_features("s", "panel", STATE))
SERIES0 = (*PANEL0, series_features("s0", "panel0"))
