"""Joins of the order tables: fan-out children, dimensions, master table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import scratch_path

# Column names of the raw tables.
CUSTOMER_COLUMNS = ["customer_id", "customer_unique_id", "customer_city", "customer_state"]
PRODUCT_COLUMNS = [
    "product_id",
    "product_category_name_english",
    "product_weight_g",
    "product_length_cm",
    "product_height_cm",
    "product_width_cm",
]
SELLER_COLUMNS = ["seller_id", "seller_city", "seller_state"]
REVIEW_COLUMNS = ["order_id", "review_score", "review_comment_title"]

#: A key with more rows than this in a child is cut into slices of about this size.
ROWS_PER_SLICE = 1_000_000


def hot_keys(children: list[DataFrame], key: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """``(key, spread, n_slices)`` of keys with more than ``rows_per_slice`` rows in a child.

    ``spread`` is the position of the child with most rows of that key. Counting
    reads the key column only and folds map-side. The list has no limit: it is
    an ordinary table, at most one row per ``rows_per_slice`` rows of the children.
    """
    counts = None
    for i, child in enumerate(children):
        part = (
            child.filter(F.col(key).isNotNull())
            .groupBy(key)
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > rows_per_slice)
            .withColumn("spread", F.lit(i))
        )
        counts = part if counts is None else counts.unionByName(part)
    return (
        counts.groupBy(key)
        .agg(F.max("n").alias("n"), F.max_by("spread", F.struct("n", "spread")).alias("spread"))
        .select(key, "spread", F.ceil(F.col("n") / F.lit(rows_per_slice)).cast("int").alias("n_slices"))
    )


def left_join_children(
    parent: DataFrame,
    children: list[DataFrame],
    key: str,
    hot: DataFrame | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Parent left-joined with every combination of its children, balanced under hot keys.

    ``hot`` is the :func:`hot_keys` table, found and written here when not given.
    Without hot keys these are plain joins on one key, so each input is
    exchanged once. Otherwise all joins use (key, slice): ordinary keys have one
    slice, a hot key is cut into several. The rows of its largest child are
    spread over the slices, parent and other children are repeated in each. A
    repeated parent row that meets no row of the spread child is a by-product
    of the cut and is dropped; the key has such rows by definition, so the
    result equals the plain joins.
    """
    cuts = written_hot_keys(children, key, rows_per_slice) if hot is None else hot
    if cuts.isEmpty():
        for child in children:
            parent = parent.join(child, key, "left")
        return parent
    every = F.when(F.col("n_slices").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("n_slices") - 1)
    )
    joined = parent.join(cuts, key, "left").select(*parent.columns, "spread", F.explode(every).alias("_slice"))
    kept = F.col("spread").isNull()
    for i, child in enumerate(children):
        # by content, so a task that runs again deals its rows to the same slices
        one = F.array(F.pmod(F.xxhash64(*child.columns), F.col("n_slices")).cast("int"))
        slices = F.when(F.col("spread") == i, one).otherwise(every)
        sliced = (
            child.join(cuts, key, "left")
            .select(*child.columns, slices.alias("_s"))
            .select(*child.columns, F.explode("_s").alias("_slice"), F.lit(True).alias(f"_met_{i}"))
        )
        joined = joined.join(sliced, [key, "_slice"], "left")
        kept = kept | ((F.col("spread") == i) & F.col(f"_met_{i}"))
    return joined.filter(kept).drop("_slice", "spread", *[f"_met_{i}" for i in range(len(children))])


def category_lookup(products: DataFrame, category_trans: DataFrame) -> DataFrame:
    """Products with the translated category name."""
    return products.join(category_trans, "product_category_name", "left")


def written_hot_keys(children: list[DataFrame], key: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """:func:`hot_keys` as a written table: counted once, and of a known size when Spark plans the joins.

    The counts stay in the tasks that made them: fewer files would need fewer tasks for the whole count.
    """
    spark = children[0].sparkSession
    found, path = hot_keys(children, key, rows_per_slice), scratch_path(spark, "hot-keys")
    found.write.parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def hot_orders(tables: dict[str, DataFrame], rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Orders with very many items, payments or reviews; count them once per set of tables."""
    children = [tables[n] for n in ("order_items", "order_payments", "order_reviews")]
    return written_hot_keys(children, "order_id", rows_per_slice)


def fact_children_join(
    orders: DataFrame,
    items: DataFrame,
    payments: DataFrame,
    reviews: DataFrame,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Orders with every combination of their items, payments and reviews."""
    return left_join_children(orders, [items, payments, reviews.select(*REVIEW_COLUMNS)], "order_id", hot)


def dimension_join(facts: DataFrame, customers: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """Adds customer, product and seller attributes.

    No broadcast is forced: Spark broadcasts a dimension only when its measured
    size is below the threshold, and splits skewed fact partitions otherwise.
    """
    return (
        facts.join(customers.select(*CUSTOMER_COLUMNS), "customer_id", "left")
        .join(products.select(*PRODUCT_COLUMNS), "product_id", "left")
        .join(sellers.select(*SELLER_COLUMNS), "seller_id", "left")
    )


def build_master_table(tables: dict[str, DataFrame], hot: DataFrame | None = None) -> DataFrame:
    """One wide row per order, item, payment and review."""
    facts = fact_children_join(
        tables["orders"], tables["order_items"], tables["order_payments"], tables["order_reviews"], hot
    )
    products = category_lookup(tables["products"], tables["category_trans"])
    return dimension_join(facts, tables["customers"], products, tables["sellers"])


def order_children(tables: dict[str, DataFrame], item_keys: list[str] | None = None) -> dict[str, DataFrame]:
    """Items, valid payments and reviews folded to one row per order.

    Folding happens map-side before the shuffle, so an order with very many
    children is no hot key afterwards. ``item_keys`` keeps item attributes
    (such as the product category) as extra grouping columns.
    """
    item_keys = item_keys or []
    items = tables["order_items"]
    if set(item_keys) - set(items.columns):
        products = category_lookup(tables["products"], tables["category_trans"]).select(*PRODUCT_COLUMNS)
        items = items.join(products, "product_id", "left")
        if set(item_keys) - set(items.columns):
            items = items.join(tables["sellers"].select(*SELLER_COLUMNS), "seller_id", "left")
    folded_items = items.groupBy("order_id", *item_keys).agg(
        F.count(F.lit(1)).alias("item_rows"),
        F.count("order_item_id").alias("items"),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("price_n"),
        F.sum("freight_value").alias("freight_sum"),
        F.count("freight_value").alias("freight_n"),
    )
    valid = tables["order_payments"].filter(F.col("payment_value") > 0)
    folded_payments = valid.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("payment_rows"),
        F.sum("payment_value").alias("payment_sum"),
        F.count_if(F.col("payment_type") == "credit_card").alias("credit_rows"),
        F.count_if(F.col("payment_type") == "boleto").alias("boleto_rows"),
        F.count_if(F.col("payment_installments") > 1).alias("installment_rows"),
        F.sum("payment_installments").alias("installments_sum"),
        F.count("payment_installments").alias("installments_n"),
    )
    folded_reviews = (
        tables["order_reviews"]
        .groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("review_rows"),
            F.sum("review_score").alias("review_sum"),
            F.count("review_score").alias("review_n"),
        )
    )
    return {"items": folded_items, "payments": folded_payments, "reviews": folded_reviews}


def order_grain_master(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per order with its children folded, so money is counted once."""
    children = order_children(tables)
    folded = tables["orders"]
    for child in children.values():
        folded = folded.join(child, "order_id", "left")
    return folded.join(tables["customers"].select(*CUSTOMER_COLUMNS), "customer_id", "left")


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each series."""
    window = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")
