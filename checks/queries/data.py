"""Sources, sinks, joins and row features."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.registry import check
from panelforge.operators import features, joins, panel, timeseries
from panelforge.session import scratch_path
from panelforge.sources import store, tables
from panelforge.sources.bindings import read

W = sql.with_ctes

# ---- sources and sinks ----

_NAMES = ["orders", "customer", "supplier", "part", "events"]


@check(
    "load_tables",
    " UNION ALL ".join(f"SELECT '{n}' AS dataset, count(*) AS n_rows FROM {n}" for n in _NAMES),
)
def load_tables(spark, folder):
    # a table that does not exist is skipped
    files = {n: f"{n}.parquet" for n in [*_NAMES, "geolocation"]}
    loaded = tables.load_tables(spark, folder, files, fmt="parquet")
    counts = [df.agg(F.lit(n).alias("dataset"), F.count(F.lit(1)).alias("n_rows")) for n, df in loaded.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@check(
    "parse_dates",
    """SELECT min(o_orderdate)::DATE AS first_date, max(o_orderdate)::DATE AS last_date,
      count(DISTINCT date_trunc('month', o_orderdate)) AS n_months FROM orders""",
    dates="first_date last_date",
)
def parse_dates(spark, folder):
    # text dates, every seventh order with an unreadable value next to a good one
    orders = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_purchase_timestamp"),
        F.when(F.col("o_orderkey") % 7 == 0, "not a date").alias("order_approved_at"),
    )
    parsed = tables.parse_dates({"orders": orders})["orders"]
    return tables.date_range(parsed.filter(F.col("order_approved_at").isNull()))


_QUALITY_COLUMNS = {
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split(),
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
    "l_linestatus l_shipdate".split(),
    "documents": "doc_id text lang source n_chars".split(),
}


def _quality_sql(name: str) -> str:
    cols = _QUALITY_COLUMNS[name]
    nulls = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in cols)
    return f"""SELECT '{name}' AS dataset, CAST(sum(k) AS BIGINT) AS rows, {len(cols)} AS cols,
      sum(k * z) * 100.0 / (sum(k) * {len(cols)}) AS null_pct, CAST(sum(k - 1) AS BIGINT) AS dup_rows
    FROM (SELECT count(*) AS k, {nulls} AS z FROM {name} GROUP BY {', '.join(cols)})"""


@check(
    "data_quality_report",
    " UNION ALL ".join(_quality_sql(n) for n in _QUALITY_COLUMNS),
    doubles="null_pct",
    null_pct=2,
)
def data_quality_report(spark, folder):
    inputs_ = {n: read(spark, folder, n).select(*c) for n, c in _QUALITY_COLUMNS.items()}
    return tables.data_quality_report(inputs_)


PANEL_DOUBLES = (
    "monthly_revenue avg_ticket median_ticket avg_review_score avg_delivery_days avg_delay_days pct_late_delivery "
    "avg_freight avg_price total_freight pct_credit_card pct_boleto pct_installments avg_installments"
)
SERIES_DOUBLES = (
    PANEL_DOUBLES
    + " "
    + " ".join(f"revenue_lag_{n}" for n in (1, 2, 3, 6, 12))
    + " revenue_rolling_mean_3 revenue_rolling_std_3 revenue_rolling_mean_6 revenue_rolling_std_6"
    + " revenue_mom_growth revenue_yoy_growth month_sin month_cos"
)


@check(
    "write_panel",
    W(*sql.PANEL) + "SELECT customer_state, ds, monthly_revenue, monthly_orders FROM panel",
    doubles="monthly_revenue",
    dates="ds",
)
def write_panel(spark, folder):
    path = scratch_path(spark, "panel-by-state")
    store.write_panel(inputs.panel(spark, folder), path, ["customer_state"])
    return store.read_panel(spark, path).select("customer_state", "ds", "monthly_revenue", "monthly_orders")


@check(
    "read_panel",
    W(*sql.PANEL) + "SELECT customer_state, ds, monthly_revenue FROM panel WHERE customer_state = 'NATION_7'",
    doubles="monthly_revenue",
    dates="ds",
)
def read_panel(spark, folder):
    # one state: the scan reads one partition folder
    path = scratch_path(spark, "panel-by-state")
    store.write_panel(inputs.panel(spark, folder), path, ["customer_state"])
    state = store.read_panel(spark, path).filter(F.col("customer_state") == "NATION_7")
    return state.select("customer_state", "ds", "monthly_revenue")


@check(
    "export_selection_table",
    W(*sql.SERIES)
    + """, u AS (UNPIVOT (SELECT monthly_revenue, CAST(monthly_orders AS DOUBLE) AS monthly_orders, avg_ticket, avg_freight,
        revenue_lag_1, CAST(unique_sellers AS DOUBLE) AS unique_sellers FROM s)
      ON monthly_revenue, monthly_orders, avg_ticket, avg_freight, revenue_lag_1, unique_sellers INTO NAME feature VALUE value)
    SELECT CAST(CASE feature WHEN 'monthly_revenue' THEN 1 WHEN 'monthly_orders' THEN 2 WHEN 'avg_ticket' THEN 3
        WHEN 'avg_freight' THEN 4 WHEN 'revenue_lag_1' THEN 5 ELSE 6 END AS INTEGER) AS "Nro", feature AS "Variable", count(*) AS n_values
    FROM u GROUP BY ALL""",
)
def export_selection_table(spark, folder):
    names = ["monthly_revenue", "monthly_orders", "avg_ticket", "avg_freight", "revenue_lag_1", "unique_sellers"]
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("feature")).cast("int")
    long = features.to_long(inputs.series(spark, folder), names).filter(F.col("value").isNotNull())
    table = long.groupBy(number.alias("Nro"), F.col("feature").alias("Variable")).agg(
        F.count(F.lit(1)).alias("n_values")
    )
    path = store.export_selection_table(table, scratch_path(spark, "selection-table"))
    return spark.read.option("header", True).schema("Nro int, Variable string, n_values long").csv(path)


# ---- joins ----


@check(
    "category_lookup",
    W(*sql.BASE)
    + "SELECT pr.product_id, pr.product_category_name, ct.product_category_name_english FROM pr LEFT JOIN ct USING (product_category_name)",
)
def category_lookup(spark, folder):
    t = inputs.tables(spark, folder)
    return joins.category_lookup(t["products"], t["category_trans"]).select(
        "product_id", "product_category_name", "product_category_name_english"
    )


_FACT_COLUMNS = "order_id order_status order_item_id product_id seller_id price payment_type payment_value review_score".split()


@check(
    "fact_children_join",
    W(sql.TABLES, sql.FACTS) + f"SELECT {', '.join(_FACT_COLUMNS)} FROM facts",
    doubles="price payment_value",
)
def fact_children_join(spark, folder):
    t = inputs.tables(spark, folder)
    joined = joins.fact_children_join(t["orders"], t["order_items"], t["order_payments"], t["order_reviews"])
    return joined.select(*_FACT_COLUMNS)


@check(
    "fact_children_join_salted",
    W(sql.TABLES, sql.FACTS) + f"SELECT {', '.join(_FACT_COLUMNS)} FROM facts",
    doubles="price payment_value",
)
def fact_children_join_salted(spark, folder):
    # a low slice size makes many orders of the test tables hot
    t = inputs.tables(spark, folder)
    hot = joins.hot_orders(t, rows_per_slice=3)
    joined = joins.fact_children_join(t["orders"], t["order_items"], t["order_payments"], t["order_reviews"], hot)
    return joined.select(*_FACT_COLUMNS)


@check(
    "dimension_join",
    W(*sql.BASE)
    + """SELECT i.order_id, i.order_item_id, c.customer_state, c.customer_city, ct.product_category_name_english,
        pr.product_weight_g, sl.seller_state
      FROM i JOIN o USING (order_id) LEFT JOIN c USING (customer_id) LEFT JOIN pr ON pr.product_id = i.product_id
        LEFT JOIN ct ON ct.product_category_name = pr.product_category_name LEFT JOIN sl ON sl.seller_id = i.seller_id""",
    doubles="product_weight_g",
)
def dimension_join(spark, folder):
    t = inputs.tables(spark, folder)
    facts = t["order_items"].join(t["orders"].select("order_id", "customer_id"), "order_id")
    products = joins.category_lookup(t["products"], t["category_trans"])
    return joins.dimension_join(facts, t["customers"], products, t["sellers"]).select(
        "order_id",
        "order_item_id",
        "customer_state",
        "customer_city",
        "product_category_name_english",
        "product_weight_g",
        "seller_state",
    )


_MASTER_COLUMNS = (
    "order_id order_item_id payment_value review_score customer_unique_id customer_state product_category_name_english "
    "product_length_cm seller_state"
).split()


@check(
    "build_master_table",
    W(*sql.MASTERED) + f"SELECT {', '.join(_MASTER_COLUMNS)} FROM m",
    doubles="payment_value product_length_cm",
)
def build_master_table(spark, folder):
    return inputs.master(spark, folder).select(*_MASTER_COLUMNS)


@check(
    "order_grain_master",
    W(*sql.BASE)
    + """, fi AS (SELECT order_id, count(order_item_id) AS items, sum(price) AS price_sum, sum(freight_value) AS freight_sum FROM i GROUP BY 1),
      fp AS (SELECT order_id, count(*) AS payment_rows, sum(payment_value) AS payment_sum FROM p WHERE payment_value > 0 GROUP BY 1),
      fr AS (SELECT order_id, count(*) AS review_rows, CAST(sum(review_score) AS BIGINT) AS review_sum FROM r GROUP BY 1)
    SELECT o.order_id, o.order_status, c.customer_state, items, price_sum, freight_sum, payment_rows, payment_sum, review_rows, review_sum
    FROM o LEFT JOIN fi USING (order_id) LEFT JOIN fp USING (order_id) LEFT JOIN fr USING (order_id) LEFT JOIN c USING (customer_id)""",
    doubles="price_sum freight_sum payment_sum",
)
def order_grain_master(spark, folder):
    return joins.order_grain_master(inputs.tables(spark, folder)).select(
        "order_id",
        "order_status",
        "customer_state",
        "items",
        "price_sum",
        "freight_sum",
        "payment_rows",
        "payment_sum",
        "review_rows",
        "review_sum",
    )


# ---- row features ----


@check(
    "calendar_features",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS order_year, CAST(month(ts) AS INTEGER) AS order_month,
      CAST(quarter(ts) AS INTEGER) AS order_quarter, CAST(week(ts) AS INTEGER) AS order_week,
      CAST(isodow(ts) - 1 AS INTEGER) AS order_dayofweek, CAST(day(ts) AS INTEGER) AS order_dayofmonth,
      CAST(hour(ts) AS INTEGER) AS order_hour, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
      CASE WHEN day(ts) >= 25 THEN 1 ELSE 0 END AS is_end_of_month, CAST(date_trunc('month', ts) AS DATE) AS ds
    FROM events""",
    dates="ds",
)
def calendar_features(spark, folder):
    return features.calendar_features(inputs.events(spark, folder).select("event_id", "ts"), "ts").drop("ts")


_DELIVERY = "delivery_days_actual delivery_days_estimated delivery_delay_days is_late_delivery carrier_days".split()


@check("delivery_features", W(*sql.VALID) + f"SELECT order_id, {', '.join(_DELIVERY)} FROM f")
def delivery_features(spark, folder):
    return features.delivery_features(inputs.master(spark, folder)).select("order_id", *_DELIVERY)


_PAYMENT = "is_credit_card is_boleto is_voucher is_debit_card payment_installments_flag".split()


@check("payment_flags", W(*sql.VALID) + f"SELECT order_id, {', '.join(_PAYMENT)} FROM f")
def payment_flags(spark, folder):
    return features.payment_flags(inputs.master(spark, folder)).select("order_id", *_PAYMENT)


@check(
    "product_features",
    W(*sql.VALID) + "SELECT order_id, order_item_id, product_volume_cm3, freight_ratio FROM f",
    doubles="product_volume_cm3 freight_ratio",
)
def product_features(spark, folder):
    return features.product_features(inputs.master(spark, folder)).select(
        "order_id", "order_item_id", "product_volume_cm3", "freight_ratio"
    )


@check("status_flags", W(*sql.VALID) + "SELECT order_id, is_delivered, is_canceled FROM f")
def status_flags(spark, folder):
    return features.status_flags(inputs.master(spark, folder)).select("order_id", "is_delivered", "is_canceled")


_ALL_ROW_FEATURES = ["order_id", "ds", "order_week", "is_weekend", *_DELIVERY, *_PAYMENT, "freight_ratio", "is_delivered"]


@check(
    "add_transaction_features",
    W(*sql.VALID) + f"SELECT {', '.join(_ALL_ROW_FEATURES)} FROM f",
    doubles="freight_ratio",
    dates="ds",
)
def add_transaction_features(spark, folder):
    return inputs.featured(spark, folder).select(*_ALL_ROW_FEATURES)


@check(
    "valid_orders_filter",
    W(*sql.VALID) + "SELECT order_id, order_item_id, payment_value FROM v",
    doubles="payment_value",
)
def valid_orders_filter(spark, folder):
    return features.valid_orders(inputs.master(spark, folder)).select("order_id", "order_item_id", "payment_value")


@check(
    "cyclical_features",
    """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
      sin(2 * pi() * month(o_orderdate) / 12) AS month_sin, cos(2 * pi() * month(o_orderdate) / 12) AS month_cos,
      CASE WHEN quarter(o_orderdate) = 4 THEN 1 ELSE 0 END AS is_q4,
      CASE WHEN month(o_orderdate) >= 11 THEN 1 ELSE 0 END AS is_nov_dec FROM orders""",
    doubles="month_sin month_cos",
)
def cyclical_features(spark, folder):
    orders = read(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return features.cyclical_features(orders, "o_orderdate").drop("o_orderdate")


_NAMED = [c for c in panel.AGGREGATES] + [
    "revenue_lag_1", "orders_lag_1", "revenue_rolling_mean_3", "revenue_mom_growth", "month", "quarter", "is_q4",
]


def _domain_case() -> str:
    rules = [(n, d) for names, d in features.DOMAIN_RULES for n in names]
    whens = [f"WHEN feature = '{n}' THEN '{d}'" for n, d in rules]
    whens += [f"WHEN starts_with(feature, '{n}') THEN '{d}'" for n, d in rules]
    return f"CASE {' '.join(whens)} ELSE '{features.OTHER_DOMAIN}' END"


LONG_SQL = (
    W(*sql.SERIES)
    + ", u AS (UNPIVOT (SELECT "
    + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in _NAMED)
    + f" FROM s) ON {', '.join(_NAMED)} INTO NAME feature VALUE value), d AS (SELECT feature, {_domain_case()} AS domain, value FROM u)"
)


@check(
    "infer_domain",
    LONG_SQL + " SELECT feature, domain, count(*) AS n_values FROM d GROUP BY ALL",
)
def infer_domain(spark, folder):
    long = features.to_long(inputs.series(spark, folder), _NAMED).filter(F.col("value").isNotNull())
    return features.infer_domain(long).groupBy("feature", "domain").agg(F.count(F.lit(1)).alias("n_values"))


# ---- the monthly feature table ----


@check(
    "monthly_feature_table",
    W(*sql.SERIES) + "SELECT * FROM s",
    doubles=SERIES_DOUBLES,
    dates="ds",
)
def monthly_feature_table(spark, folder):
    table = panel.monthly_panel(inputs.tables(spark, folder), inputs.STATE)
    return timeseries.add_time_series_features(table, inputs.SETTINGS, inputs.STATE)


