"""Time splits and expanding folds, cut on distinct periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.config import Settings


def _month(text: str):
    return F.to_date(F.lit(f"{text}-01"))


def split_data(panel: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``split`` (train, val, backtest, or NULL after the live month) and ``is_live``."""
    ds = F.col("ds")
    live = _month(settings.live_month)
    split = (
        F.when(ds <= _month(settings.train_end), "train")
        .when(ds <= _month(settings.val_end), "val")
        .when(ds <= live, "backtest")
    )
    return panel.withColumns({"split": split, "is_live": F.coalesce(ds == live, F.lit(False))})


def union_test_splits(split: DataFrame) -> DataFrame:
    """Validation and backtest rows together."""
    return split.filter(F.col("split").isin("val", "backtest"))


def period_folds(panel: DataFrame, k: int = 3) -> DataFrame:
    """``(ds, block)`` of the distinct periods; block 0 is the first training
    window and blocks 1…k are the successive test windows.

    With n periods a test block has n // (k + 1) of them.
    """
    # one row per period, so the unpartitioned window is bounded by the calendar
    every = Window.partitionBy(F.lit(1))
    periods = panel.select("ds").distinct().withColumns(
        {"_pos": F.row_number().over(every.orderBy("ds")) - 1, "_n": F.count(F.lit(1)).over(every)}
    )
    size = F.floor(F.col("_n") / (k + 1))
    first_test = F.col("_n") - k * size
    block = F.when(F.col("_pos") < first_test, F.lit(0)).otherwise(
        F.floor(F.try_divide(F.col("_pos") - first_test, size)) + 1
    )
    return periods.select("ds", block.cast("int").alias("block"))


def time_series_folds(panel: DataFrame, k: int = 3) -> DataFrame:
    """Panel rows repeated per fold with their role: train before the test block."""
    folds = period_folds(panel, k).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k))))
    roles = folds.filter(F.col("block") <= F.col("fold")).select(
        "ds", "fold", F.when(F.col("block") == F.col("fold"), "test").otherwise("train").alias("role")
    )
    return panel.join(roles, "ds")


def holdout_last_n(panel: DataFrame, n: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Adds ``is_test`` for the last n periods of each series."""
    last = F.row_number().over(Window.partitionBy(*(keys or [])).orderBy(F.desc("ds")))
    return panel.withColumn("_r", last).withColumn("is_test", F.col("_r") <= n).drop("_r")


def union_history(history: DataFrame, arrived: DataFrame) -> DataFrame:
    """History with the newly arrived periods; features missing there are NULL."""
    return history.unionByName(arrived, allowMissingColumns=True)
