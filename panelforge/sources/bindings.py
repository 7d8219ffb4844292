"""Binding of a TPC-H-like star schema to the order tables of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: order priority -> payment type (fixed values of the binding)
PAYMENT_TYPES = {
    "1-URGENT": "credit_card",
    "2-HIGH": "boleto",
    "3-MEDIUM": "voucher",
    "4-NOT SPECIFIED": "debit_card",
    "5-LOW": "not_defined",
}
#: order status letter -> order status
STATUSES = {"F": "delivered", "P": "canceled", "O": "shipped"}


def _recode(column: str, values: dict[str, str]):
    mapping = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.element_at(mapping, F.col(column))


_schemas: dict[str, StructType] = {}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; its schema is read from the file footers once per process."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def star_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The order tables, each a lazy view over the star schema.

    An order is handed to the carrier when its first line ships and delivered
    when its last line ships; orders without lines are never delivered. The
    review of an order is its line number 1, so an order has none, one or
    several reviews. One product category has no translation.
    """
    orders = read(spark, folder, "orders")
    lines = read(spark, folder, "lineitem")
    nation = read(spark, folder, "nation")
    part = read(spark, folder, "part")

    shipped = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.min("l_shipdate").alias("order_delivered_carrier_date"),
        F.max("l_shipdate").alias("order_delivered_customer_date"),
    )
    return {
        "orders": orders.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            _recode("o_orderstatus", STATUSES).alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("order_estimated_delivery_date"),
        ).join(shipped, "order_id", "left"),
        "order_items": lines.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        ),
        "order_payments": orders.select(
            F.col("o_orderkey").alias("order_id"),
            _recode("o_orderpriority", PAYMENT_TYPES).alias("payment_type"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("payment_installments"),
            F.col("o_totalprice").alias("payment_value"),
        ),
        "order_reviews": lines.filter(F.col("l_linenumber") == 1).select(
            F.col("l_orderkey").alias("order_id"),
            (F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("review_score"),
            F.col("l_returnflag").alias("review_comment_title"),
        ),
        "customers": read(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_custkey").alias("customer_unique_id"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        ),
        "products": part.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("product_category_name"),
            F.col("p_retailprice").alias("product_weight_g"),
            F.col("p_size").cast("double").alias("product_length_cm"),
            F.col("p_size").cast("double").alias("product_height_cm"),
            F.col("p_size").cast("double").alias("product_width_cm"),
        ),
        "sellers": read(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_name").alias("seller_city"),
            F.col("n_name").alias("seller_state"),
        ),
        "category_trans": part.filter(F.col("p_type") != "MEDIUM")
        .select(F.col("p_type").alias("product_category_name"))
        .distinct()
        .withColumn("product_category_name_english", F.lower("product_category_name")),
    }
