"""Forecast error aggregates over (actual, predicted) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rmse(y: Column, yhat: Column) -> Column:
    return F.sqrt(F.avg((y - yhat) * (y - yhat)))


def mae(y: Column, yhat: Column) -> Column:
    return F.avg(F.abs(y - yhat))


def mape(y: Column, yhat: Column) -> Column:
    """Percent error over the rows with a non-zero actual."""
    return F.avg(F.when(y != 0, F.abs(F.try_divide(y - yhat, y)))) * 100


def smape(y: Column, yhat: Column) -> Column:
    return F.avg(F.abs(y - yhat) / ((F.abs(y) + F.abs(yhat)) / 2 + 1e-9)) * 100


def all_metrics(y: str = "y", yhat: str = "yhat") -> list[Column]:
    a, b = F.col(y).cast("double"), F.col(yhat).cast("double")
    return [
        rmse(a, b).alias("rmse"),
        mae(a, b).alias("mae"),
        mape(a, b).alias("mape"),
        smape(a, b).alias("smape"),
    ]
