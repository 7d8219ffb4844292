"""Null, zero and range guards shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 when the condition holds, 0 when it fails or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def finite(column: Column) -> Column:
    """Double value, with NaN and infinities turned into NULL."""
    x = column.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def clip(column: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """Limit to [low, high]; NULL stays NULL and a NULL bound does not limit."""
    x = column
    if low is not None:
        lo = low if isinstance(low, Column) else F.lit(float(low))
        x = F.when(column.isNull(), None).otherwise(F.greatest(x, lo))
    if high is not None:
        hi = high if isinstance(high, Column) else F.lit(float(high))
        x = F.when(column.isNull(), None).otherwise(F.least(x, hi))
    return x


def zero_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def total(column: Column) -> Column:
    """Sum that is 0, not NULL, over nothing."""
    return F.coalesce(F.sum(column), F.lit(0.0))


def all_known(columns: list[str]) -> Column:
    """True where none of the columns is NULL."""
    return reduce(lambda a, c: a & F.col(c).isNotNull(), columns, F.lit(True))
