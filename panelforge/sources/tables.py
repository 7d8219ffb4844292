"""Reading the relational input tables, date parsing and quality report."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.config import RAW_FILES
from panelforge.functions.rows import month_start
from panelforge.sources.quoted_csv import read_quoted_csv

log = logging.getLogger(__name__)

ORDER_DATES = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]
ITEM_DATES = ["shipping_limit_date"]
#: Tables with line breaks inside quoted text; their CSV files are read in two passes.
MULTI_LINE = {"order_reviews"}



def raw_schemas() -> dict[str, str]:
    """DDL of every raw table; dates stay text until :func:`parse_dates`."""
    dates = ", ".join(f"{c} string" for c in ORDER_DATES)
    return {
        "orders": f"order_id string, customer_id string, order_status string, {dates}",
        "order_items": "order_id string, order_item_id int, product_id string, seller_id string, "
        "shipping_limit_date string, price double, freight_value double",
        "order_payments": "order_id string, payment_sequential int, payment_type string, "
        "payment_installments int, payment_value double",
        "order_reviews": "review_id string, order_id string, review_score int, review_comment_title string, "
        "review_comment_message string, review_creation_date string, review_answer_timestamp string",
        "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix string, "
        "customer_city string, customer_state string",
        "products": "product_id string, product_category_name string, product_name_lenght double, "
        "product_description_lenght double, product_photos_qty double, product_weight_g double, "
        "product_length_cm double, product_height_cm double, product_width_cm double",
        "sellers": "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string",
        "category_trans": "product_category_name string, product_category_name_english string",
        "geolocation": "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double, "
        "geolocation_city string, geolocation_state string",
    }


def load_tables(
    spark: SparkSession,
    path: str,
    files: dict[str, str] | None = None,
    schemas: dict[str, str] | None = None,
    fmt: str = "csv",
) -> dict[str, DataFrame]:
    """Read the configured files; a missing one is skipped with a warning.

    Schemas are explicit, so no inference pass runs over the data. Parquet
    files carry their own schema.
    """
    schemas = raw_schemas() if schemas is None else schemas
    tables: dict[str, DataFrame] = {}
    for name, file in (files or RAW_FILES).items():
        reader = spark.read.format(fmt)
        if fmt == "csv":
            # the header is checked against the schema
            reader = reader.options(header=True, escape='"', enforceSchema=False)
        if name in schemas and fmt != "parquet":
            reader = reader.schema(schemas[name])
        try:
            if fmt == "csv" and name in MULTI_LINE and name in schemas:
                tables[name] = read_quoted_csv(spark, f"{path.rstrip('/')}/{file}", schemas[name])
            else:
                tables[name] = reader.load(f"{path.rstrip('/')}/{file}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            log.warning("table %s not found: %s/%s", name, path, file)
    return tables


def _parse(df: DataFrame, columns: list[str]) -> DataFrame:
    present = {
        c: F.try_to_timestamp(F.col(c)) if isinstance(df.schema[c].dataType, T.StringType) else F.col(c)
        for c in columns
        if c in df.columns
    }
    return df.withColumns(present) if present else df


def parse_dates(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Text dates become timestamps; an unreadable date becomes NULL."""
    parsed = dict(tables)
    for name, columns in (("orders", ORDER_DATES), ("order_items", ITEM_DATES)):
        if name in parsed:
            parsed[name] = _parse(parsed[name], columns)
    return parsed


def date_range(orders: DataFrame, column: str = "order_purchase_timestamp") -> DataFrame:
    """First and last date and the number of distinct months."""
    ts = F.col(column)
    return orders.agg(
        F.to_date(F.min(ts)).alias("first_date"),
        F.to_date(F.max(ts)).alias("last_date"),
        F.count_distinct(month_start(ts)).alias("n_months"),
    )


#: JSON cuts timestamps to milliseconds unless told otherwise.
_WHOLE_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


def data_quality_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, mean null percentage and duplicate rows of each table.

    Copies are folded by a grouped count before the shuffle, so many copies of
    one row cost no more than one. Rows are grouped by a SHA-256 digest of all
    their values, so the shuffle moves a digest per row whatever the row's width.
    """
    reports = []
    for name, df in tables.items():
        cells = [F.col(f"`{c}`") for c in df.columns]
        nulls = reduce(lambda a, b: a + b, [c.isNull().cast("int") for c in cells])
        digest = F.unhex(F.sha2(F.to_json(F.struct(*cells), _WHOLE_TIMES), 256))
        rows = df.select(digest.alias("row"), nulls.alias("null_cells"))
        distinct = rows.groupBy("row").agg(F.count(F.lit(1)).alias("copies"), F.first("null_cells").alias("null_cells"))
        reports.append(
            distinct.agg(
                F.lit(name).alias("dataset"),
                F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
                F.lit(len(df.columns)).alias("cols"),
                F.bround(
                    F.try_divide(
                        F.sum(F.col("copies") * F.col("null_cells")) * 100.0,
                        F.sum("copies") * len(df.columns),
                    ),
                    2,
                ).alias("null_pct"),
                F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("dup_rows"),
            )
        )
    return reduce(DataFrame.unionByName, reports)
