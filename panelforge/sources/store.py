"""Written tables: panels, fitted models and their parameters, reports, run records."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

RUN_SCHEMA = """
    run_id string, project string, version string, model_type string, granularity string, trained_at timestamp,
    params map<string,string>, metrics map<string,double>, business map<string,double>, features array<string>,
    training_range struct<first_ds: date, last_ds: date>, n_train_months bigint,
    overfit_gap struct<rmse_train: double, rmse_backtest: double, gap_rmse_ratio: double>,
    challengers map<string,double>,
    selection_cost array<struct<estado: string, n_features: bigint, rmse: double, mape: double>>,
    versions map<string,string>
"""


def write_panel(panel: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Writes a panel; rows of one partition value go to one place first.

    The exchange keeps the number of files near the number of partition values
    instead of tasks × values; AQE still splits an oversized partition.
    """
    writer = panel
    if partition_by:
        writer = panel.hint("rebalance", *[F.col(c) for c in partition_by])
    out = writer.write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise


def save_model(models: dict[int, PipelineModel], params: DataFrame, path: str) -> None:
    """One MLlib model folder per horizon and one small parameter table."""
    for horizon, model in models.items():
        model.write().overwrite().save(f"{path}/horizon={horizon}")
    params.coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load_model(spark: SparkSession, path: str) -> tuple[dict[int, PipelineModel], DataFrame]:
    params = read_panel(spark, f"{path}/params")
    horizons = [int(r["label"]) for r in params.filter(F.col("param") == "horizon").collect()]
    return {h: PipelineModel.load(f"{path}/horizon={h}") for h in horizons}, params


def export_selection_table(table: DataFrame, path: str) -> str:
    """One UTF-8 CSV file with byte order mark and header; the table has one row per column of the panel."""
    first = table.columns[0]
    table.orderBy("Nro").withColumnRenamed(first, f"\ufeff{first}").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def log_run(runs: DataFrame, path: str) -> bool:
    """Appends run records; a failure is reported and does not stop the plan.

    Fields of ``RUN_SCHEMA`` that the records lack are stored as NULL.
    """
    try:
        spark = runs.sparkSession
        empty = spark.createDataFrame([], RUN_SCHEMA)
        full = empty.unionByName(runs, allowMissingColumns=True).select(*empty.columns)
        full.write.mode("append").parquet(path)
        return True
    except Exception as error:  # run records must never break a training run
        log.warning("run not recorded: %s", error)
        return False


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return read_panel(spark, path)
