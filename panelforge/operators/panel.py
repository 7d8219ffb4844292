"""Aggregation of order rows to a (keys, month) panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import rows
from panelforge.functions.guards import all_known, total
from panelforge.operators.features import delivery_features, valid_orders
from panelforge.operators.joins import (
    CUSTOMER_COLUMNS,
    category_lookup,
    order_children,
)
from panelforge.operators.quantiles import exact_quantiles

#: the 20 aggregates of a period, in output order
AGGREGATES = [
    "monthly_revenue",
    "monthly_orders",
    "monthly_customers",
    "monthly_items",
    "avg_ticket",
    "median_ticket",
    "avg_review_score",
    "avg_delivery_days",
    "avg_delay_days",
    "pct_late_delivery",
    "avg_freight",
    "avg_price",
    "total_freight",
    "pct_credit_card",
    "pct_boleto",
    "pct_installments",
    "avg_installments",
    "unique_categories",
    "unique_sellers",
    "unique_states",
]


def _known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose grouping columns are all present."""
    return df.filter(all_known(columns))


def monthly_aggregate(valid: DataFrame, keys: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """The 20 aggregates per (keys, ds) from rows with transaction features.

    ``approximate`` trades exact distinct counts and the exact median for
    sketches, which need one exchange of small rows.
    """
    group = [*(keys or []), "ds"]
    valid = _known(valid, group)
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    sketched = [F.percentile_approx("payment_value", 0.5).alias("median_ticket")] if approximate else []
    sums = valid.groupBy(*group).agg(
        total(F.col("payment_value")).alias("monthly_revenue"),
        distinct("order_id").alias("monthly_orders"),
        distinct("customer_unique_id").alias("monthly_customers"),
        F.count("order_item_id").alias("monthly_items"),
        F.avg("payment_value").alias("avg_ticket"),
        F.avg("review_score").alias("avg_review_score"),
        F.avg("delivery_days_actual").alias("avg_delivery_days"),
        F.avg("delivery_delay_days").alias("avg_delay_days"),
        F.avg("is_late_delivery").alias("pct_late_delivery"),
        F.avg("freight_value").alias("avg_freight"),
        F.avg("price").alias("avg_price"),
        total(F.col("freight_value")).alias("total_freight"),
        F.avg("is_credit_card").alias("pct_credit_card"),
        F.avg("is_boleto").alias("pct_boleto"),
        F.avg("payment_installments_flag").alias("pct_installments"),
        F.avg("payment_installments").alias("avg_installments"),
        distinct("product_category_name_english").alias("unique_categories"),
        distinct("seller_id").alias("unique_sellers"),
        distinct("customer_state").alias("unique_states"),
        *sketched,
    )
    if approximate:
        return sums.select(*group, *AGGREGATES)
    medians = exact_quantiles(valid, group, "payment_value", [0.5]).select(
        *group, F.col("quantile").alias("median_ticket")
    )
    return sums.join(medians, group, "left").select(*group, *AGGREGATES)


def trim_edge_months(panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drops the first and the last period of each series, by position."""
    window = Window.partitionBy(*(keys or []))
    first = F.row_number().over(window.orderBy(F.asc("ds")))
    n = F.count(F.lit(1)).over(window)
    return (
        panel.withColumns({"_pos": first, "_len": n})
        .filter((F.col("_pos") > 1) & (F.col("_pos") < F.col("_len")))
        .drop("_pos", "_len")
    )


def build_monthly_table(featured: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Panel from the featured master table: filter, aggregate, trim."""
    return trim_edge_months(monthly_aggregate(valid_orders(featured), keys), keys)


def _sold_items(tables: dict[str, DataFrame], item_keys: list[str]) -> DataFrame:
    """Order, product and seller of each item, with the item attributes used as keys."""
    items = tables["order_items"].select("order_id", "product_id", "seller_id")
    if "product_category_name_english" in item_keys:
        products = category_lookup(tables["products"], tables["category_trans"])
        items = items.join(products.select("product_id", "product_category_name_english"), "product_id", "left")
    if {"seller_state", "seller_city"} & set(item_keys):
        items = items.join(tables["sellers"], "seller_id", "left")
    return items


def _distinct_offers(sold: DataFrame, tables: dict[str, DataFrame], group: list[str]) -> DataFrame:
    """Distinct sellers and categories per group.

    Distinct (group, seller) and (group, product) pairs are formed first, so the
    category is looked up on those few rows and not on every item.
    """
    ids = F.array(
        F.struct(F.lit("seller").alias("kind"), F.col("seller_id").cast("string").alias("id")),
        F.struct(F.lit("product").alias("kind"), F.col("product_id").cast("string").alias("id")),
    )
    names = {g: f"_g{i}" for i, g in enumerate(group)}
    pairs = (
        sold.select(*[F.col(g).alias(n) for g, n in names.items()], F.explode(ids).alias("_x"))
        .select(*names.values(), "_x.kind", "_x.id")
        .filter(F.col("id").isNotNull())
        .distinct()
    )
    products = category_lookup(tables["products"], tables["category_trans"]).select(
        F.lit("product").alias("kind"), F.col("product_id").cast("string").alias("id"), "product_category_name_english"
    )
    return (
        pairs.join(products, ["kind", "id"], "left")
        .groupBy(*[F.col(n).alias(g) for g, n in names.items()])
        .agg(
            F.count_distinct("product_category_name_english").alias("unique_categories"),
            # pairs are distinct already
            F.count_if(F.col("kind") == "seller").alias("unique_sellers"),
        )
    )


def monthly_from_orders(
    tables: dict[str, DataFrame], keys: list[str] | None = None, fanout: str = "reference", grain: str = "month"
) -> DataFrame:
    """The same 20 aggregates without building the fan-out rows.

    An order with i items, p payments and r reviews stands for i·p·r master
    rows. Children are folded to one row per order first and the fan-out is
    carried as row weights, so the joins are one-to-one, no child table can
    skew them and the shuffled data does not grow with the fan-out.
    Keys may be order, customer, item, product or seller attributes.

    ``fanout="order"`` sets all weights to one: each payment, item and review
    counts once, so revenue is not multiplied by the number of items.
    """
    if fanout not in ("reference", "order"):
        raise ValueError(f"unknown fan-out: {fanout}")
    keys = keys or []
    group = [*keys, "ds"]
    order_columns = set(tables["orders"].columns) | set(CUSTOMER_COLUMNS)
    item_keys = [k for k in keys if k not in order_columns]
    children = order_children(tables, item_keys)
    items, reviews = children["items"], children["reviews"]
    if fanout == "reference":
        i, p, r = F.coalesce("item_rows", F.lit(1)), F.col("payment_rows"), F.coalesce("review_rows", F.lit(1))
    else:
        i = p = r = F.lit(1)

    orders = (
        tables["orders"]
        .filter(F.col("order_status") == "delivered")
        .withColumn("ds", rows.period_start(F.col("order_purchase_timestamp"), grain))
    )
    customers = tables["customers"].select(
        *[c for c in CUSTOMER_COLUMNS if c in keys or c in ("customer_id", "customer_unique_id", "customer_state")]
    )

    def with_customers(df: DataFrame) -> DataFrame:
        return _known(df.join(customers, "customer_id", "left"), group)

    # every join on the order key comes before the one on the customer key, so
    # each input is exchanged once per key
    facts = (
        orders.transform(delivery_features)
        .join(children["payments"], "order_id")
        .join(reviews, "order_id", "left")
        .join(items, "order_id", "left")
        .transform(with_customers)
        .withColumns({"i": i, "p": p, "r": r})
    )
    copies = i * r
    i, p, r = F.col("i"), F.col("p"), F.col("r")
    ones = i * p * r

    def weighted(amount: str, n: str, weight):
        """Mean of a child column repeated ``weight`` times per row."""
        return F.try_divide(
            F.sum(F.col(amount) * weight).cast("double"), F.sum(F.col(n) * weight).cast("double")
        )

    def mean(column: str):
        known = F.when(F.col(column).isNotNull(), ones)
        return F.try_divide(F.sum(F.col(column) * ones).cast("double"), F.sum(known).cast("double"))

    sums = facts.groupBy(*group).agg(
        total(F.col("payment_sum") * i * r).alias("monthly_revenue"),
        F.count_distinct("order_id").alias("monthly_orders"),
        F.count_distinct("customer_unique_id").alias("monthly_customers"),
        F.coalesce(F.sum(F.col("items") * p * r), F.lit(0)).alias("monthly_items"),
        weighted("payment_sum", "payment_rows", i * r).alias("avg_ticket"),
        weighted("review_sum", "review_n", i * p).alias("avg_review_score"),
        mean("delivery_days_actual").alias("avg_delivery_days"),
        mean("delivery_delay_days").alias("avg_delay_days"),
        mean("is_late_delivery").alias("pct_late_delivery"),
        weighted("freight_sum", "freight_n", p * r).alias("avg_freight"),
        weighted("price_sum", "price_n", p * r).alias("avg_price"),
        total(F.col("freight_sum") * p * r).alias("total_freight"),
        weighted("credit_rows", "payment_rows", i * r).alias("pct_credit_card"),
        weighted("boleto_rows", "payment_rows", i * r).alias("pct_boleto"),
        weighted("installment_rows", "payment_rows", i * r).alias("pct_installments"),
        weighted("installments_sum", "installments_n", i * r).alias("avg_installments"),
        F.count_distinct("customer_state").alias("unique_states"),
    )

    # the median ticket: each valid payment counts items × reviews times
    payments = tables["order_payments"].filter(F.col("payment_value") > 0).select("order_id", "payment_value")
    tickets = (
        orders.select(*dict.fromkeys(["order_id", "customer_id", *[c for c in group if c in orders.columns]]))
        .join(payments, "order_id")
        .join(reviews.select("order_id", "review_rows"), "order_id", "left")
        .join(items.select("order_id", *item_keys, "item_rows"), "order_id", "left")
        .transform(with_customers)
        .withColumn("w", copies)
        .transform(lambda d: exact_quantiles(d, group, "payment_value", [0.5], weight="w"))
        .select(*group, F.col("quantile").alias("median_ticket"))
    )
    # customers join the orders before the more numerous items do
    paid = (
        orders.select(*dict.fromkeys(["order_id", "customer_id", *[c for c in group if c in orders.columns]]))
        .join(children["payments"].select("order_id"), "order_id")
        .join(customers, "customer_id", "left")
        .select(*dict.fromkeys(["order_id", *[g for g in group if g not in item_keys]]))
    )
    sold = _known(_sold_items(tables, item_keys).join(paid, "order_id"), group)
    offers = _distinct_offers(sold, tables, group)
    return (
        sums.join(tickets, group, "left")
        .join(offers, group, "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("unique_categories", "unique_sellers")})
        .select(*group, *AGGREGATES)
    )


def monthly_panel(
    tables: dict[str, DataFrame], keys: list[str] | None = None, fanout: str = "reference", grain: str = "month"
) -> DataFrame:
    """Trimmed panel straight from the order tables."""
    return trim_edge_months(monthly_from_orders(tables, keys, fanout, grain), keys)
