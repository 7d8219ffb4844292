"""Register of queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sums of money and other large numbers keep two decimals, all else four.
COARSE = {
    "monthly_revenue", "total_freight", "avg_ticket", "median_ticket", "avg_freight", "avg_price",
    "payment_value", "price", "freight_value", "y", "yhat", "rmse", "mae", "label", "value", "observed",
    "trend", "seasonal", "resid", "revenue_diff", "revenue_total",
}
PLACES = 4


@dataclass
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    places: dict[str, int] = field(default_factory=dict)

    def digits(self, column: str) -> int:
        if column in self.places:
            return self.places[column]
        money = column in COARSE or column.startswith(("revenue_lag", "revenue_rolling"))
        return 2 if money else PLACES

    def _nudge(self, column: str) -> float:
        # moves exact ties (x.xx5) off the rounding boundary, where the two
        # engines and different summation orders could round apart
        return 0.0137 * 10.0 ** -self.digits(column)

    def spark_query(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.run(spark, folder)
        doubles = self.doubles or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
        dates = self.dates or [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
        changes = {
            c: F.round(F.col(c).cast("double") + F.lit(self._nudge(c)), self.digits(c)) for c in doubles
        }
        changes |= {c: F.date_format(c, "yyyy-MM-dd") for c in dates}
        return df.withColumns(changes) if changes else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        parts = [
            f"round(CAST({c} AS DOUBLE) + {self._nudge(c):.10f}, {self.digits(c)}) AS {c}" for c in self.doubles
        ]
        parts += [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in self.dates]
        if not parts:
            return self.sql
        return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({self.sql})"


CHECKS: dict[str, Check] = {}


def check(name: str, sql: str | None = None, doubles: str = "", dates: str = "", **places: int):
    """Registers a query; ``doubles`` and ``dates`` name its rounded and formatted columns."""

    def wrap(run):
        assert name not in CHECKS, name
        CHECKS[name] = Check(run, sql, doubles.split(), dates.split(), places)
        return run

    return wrap
