"""Row features, the valid-order filter and business-domain rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import rows

#: Business domain rules (fixed values): names, domain. A full name match wins
#: over a prefix match; among prefixes the earlier rule wins.
DOMAIN_RULES = [
    (["monthly_revenue"], "Target"),
    (["monthly_orders", "monthly_items"], "Órdenes"),
    (["monthly_customers"], "Clientes"),
    (["revenue_lag", "revenue_rolling", "revenue_mom", "revenue_yoy"], "Historia del Target (lags)"),
    (["orders_lag"], "Historia de Órdenes (lags)"),
    (
        ["ds", "year_month", "month", "quarter", "year", "month_sin", "month_cos", "is_q4", "is_nov_dec"],
        "Calendario / Estacionalidad",
    ),
    (["avg_ticket", "median_ticket", "avg_price"], "Ticket / Precio"),
    (["avg_freight", "total_freight"], "Flete"),
    (["avg_review_score"], "Satisfacción"),
    (["avg_delivery", "avg_delay", "pct_late"], "Entregas"),
    (["pct_credit", "pct_boleto", "pct_installments", "avg_installments"], "Pagos"),
    (["unique_categories", "unique_sellers", "unique_states"], "Diversidad de Oferta"),
]
OTHER_DOMAIN = "Otros"


def calendar_features(df: DataFrame, ts: str = "order_purchase_timestamp") -> DataFrame:
    return df.withColumns(rows.calendar(F.col(ts)))


def delivery_features(df: DataFrame) -> DataFrame:
    """Day counts first, delay and flag from them: each day count is computed once."""
    days = rows.delivery_days(
        F.col("order_purchase_timestamp"),
        F.col("order_delivered_customer_date"),
        F.col("order_estimated_delivery_date"),
        F.col("order_delivered_carrier_date"),
    )
    delay = rows.delivery_delay(F.col("delivery_days_actual"), F.col("delivery_days_estimated"))
    return df.withColumns(days).withColumns(delay)


def payment_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(rows.payment(F.col("payment_type"), F.col("payment_installments")))


def product_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        rows.product(
            F.col("product_length_cm"),
            F.col("product_height_cm"),
            F.col("product_width_cm"),
            F.col("price"),
            F.col("freight_value"),
        )
    )


def status_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(rows.status(F.col("order_status")))


def add_transaction_features(master: DataFrame) -> DataFrame:
    """All row features. Catalyst merges the blocks into few Projects and keeps
    apart only what would repeat costly expressions."""
    return (
        master.transform(calendar_features)
        .transform(delivery_features)
        .transform(payment_flags)
        .transform(product_features)
        .transform(status_flags)
    )


def valid_orders(df: DataFrame) -> DataFrame:
    """Delivered rows with a positive payment; NULL payments fail the filter."""
    return df.filter((F.col("order_status") == "delivered") & (F.col("payment_value") > 0))


def cyclical_features(df: DataFrame, ds: str = "ds") -> DataFrame:
    return df.withColumns(rows.cyclical(F.col(ds)))


def domain_of(name: Column) -> Column:
    """Business domain of a feature name as one CASE expression."""
    names = [(n, domain) for group, domain in DOMAIN_RULES for n in group]
    case = F.when(name == names[0][0], names[0][1])
    for n, domain in names[1:]:
        case = case.when(name == n, domain)
    for n, domain in names:
        case = case.when(name.startswith(n), domain)
    return case.otherwise(OTHER_DOMAIN)


def infer_domain(df: DataFrame, column: str = "feature") -> DataFrame:
    return df.withColumn("domain", domain_of(F.col(column)))


def to_long(df: DataFrame, features: list[str], ids: list[str] | None = None) -> DataFrame:
    """One (ids, feature, value) row per feature cell, values as double."""
    ids = ids or []
    cast = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return cast.unpivot([F.col(c) for c in ids], [F.col(f) for f in features], "feature", "value")

