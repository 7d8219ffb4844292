"""Inputs the queries share: order tables and the written panel of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.operators.features import add_transaction_features, valid_orders
from panelforge.operators.joins import build_master_table, hot_orders
from panelforge.operators.panel import monthly_panel
from panelforge.operators.timeseries import add_time_series_features
from panelforge.session import scratch_path, tune
from panelforge.sources.bindings import read, star_tables

STATE = ["customer_state"]

#: Time splits of the test tables (1995-01 … 2001-08 before the edge trim).
SETTINGS = Settings(train_end="2000-06", val_end="2000-12", live_month="2001-07")

_written: dict[tuple[str, str, str], str] = {}
_hot: dict[tuple[str, str], DataFrame] = {}


def prepare(spark: SparkSession) -> None:
    """Session settings of the checks; DuckDB timestamps have no time zone."""
    tune(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    prepare(spark)
    return star_tables(spark, folder)


def master(spark: SparkSession, folder: str) -> DataFrame:
    """Master table; the hot orders of a folder are counted once per session."""
    found = tables(spark, folder)
    key = (spark.sparkContext.applicationId, folder)
    if key not in _hot:
        _hot[key] = hot_orders(found)
    return build_master_table(found, _hot[key])


def featured(spark: SparkSession, folder: str) -> DataFrame:
    return add_transaction_features(master(spark, folder))


def valid(spark: SparkSession, folder: str) -> DataFrame:
    return valid_orders(featured(spark, folder))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "events")


def _stored(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """Writes a derived table to the shared folder once per session and reads it back.

    The panel is the hand-over between data preparation and everything after
    it; writing it cuts the lineage, so later jobs survive lost executors
    without repeating the joins.
    """
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _written:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly panel per customer state."""
    return _stored(spark, folder, "panel", lambda: monthly_panel(tables(spark, folder), STATE))


def panel0(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly panel of the whole business."""
    return _stored(spark, folder, "panel0", lambda: monthly_panel(tables(spark, folder)))


def series(spark: SparkSession, folder: str) -> DataFrame:
    """State panel with time-series features."""
    return add_time_series_features(panel(spark, folder), SETTINGS, STATE)


def series0(spark: SparkSession, folder: str) -> DataFrame:
    return add_time_series_features(panel0(spark, folder), SETTINGS)


def split_series(spark: SparkSession, folder: str) -> DataFrame:
    from panelforge.operators.splits import split_data

    return split_data(series(spark, folder), SETTINGS)


def train_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")
