"""Time-series features of a stream of period rows, from state of bounded size.

Every series keeps the periods that may still change, and before them as many closed
ones as the features look back. A period may be corrected until the watermark passes it; an
event-time timer then closes it, writes its features once, and drops what no
later feature needs. No stored panel is read again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelforge.config import Settings
from panelforge.functions.rows import cyclical

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_YEAR = 12


def feature_names(settings: Settings) -> list[str]:
    names = [f"{kind}_lag_{n}" for n in settings.lag_periods for kind in ("revenue", "orders")]
    names += [f"revenue_rolling_{kind}_{n}" for n in settings.rolling_windows for kind in ("mean", "std")]
    return [*names, "revenue_mom_growth", "revenue_yoy_growth"]


def features_at(y: list[float | None], orders: list[float | None], at: int, settings: Settings) -> dict[str, float | None]:
    """Features of the period at place ``at`` of a series; they count rows, and windows must be known in full."""

    def before(values: list, n: int):
        return values[at - n] if at >= n else None

    def change(n: int):
        old = before(y, n)
        return y[at] / old - 1 if y[at] is not None and old else None

    out: dict[str, float | None] = {}
    for n in settings.lag_periods:
        out[f"revenue_lag_{n}"], out[f"orders_lag_{n}"] = before(y, n), before(orders, n)
    for n in settings.rolling_windows:
        window = y[max(at - n, 0) : at]
        known = len(window) == n and None not in window
        out[f"revenue_rolling_mean_{n}"] = float(np.mean(window)) if known else None
        out[f"revenue_rolling_std_{n}"] = float(np.std(window, ddof=1)) if known and n > 1 else None
    return out | {"revenue_mom_growth": change(1), "revenue_yoy_growth": change(_YEAR)}


def _millis(ds: dt.date) -> int:
    return int(dt.datetime(ds.year, ds.month, ds.day, tzinfo=dt.timezone.utc).timestamp() * 1000)


class PeriodFeatures(StatefulProcessor):
    """State of one series: a list of ``ds, y, orders, rank, closed``, oldest first."""

    SCHEMA = "ds date, y double, orders double, rank long, closed boolean"

    def __init__(self, keys: list[str], settings: Settings = Settings()):
        self.keys, self.settings = keys, settings
        #: Closed periods that the next feature may look back at.
        self.reach = max([*settings.lag_periods, *settings.rolling_windows, _YEAR])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("periods", self.SCHEMA)

    def _periods(self) -> dict[dt.date, list]:
        return {r[0]: list(r) for r in self.held.get()} if self.held.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Keeps the last arrival of every open period; arrivals for closed ones are too late."""
        passed = timerValues.getCurrentWatermarkInMs()
        held = self._periods()
        for part in rows:
            part = part.astype(object).where(part.notna(), None)
            for ds, y, orders, rank in part[["ds", "y", "orders", "rank"]].itertuples(index=False):
                old = held.get(ds)
                if _millis(ds) <= passed or (old and (old[4] or old[3] > rank)):
                    continue
                if old is None:
                    self.handle.registerTimer(_millis(ds))
                held[ds] = [ds, y, orders, int(rank), False]
        self.held.put([tuple(held[ds]) for ds in sorted(held)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes the periods of the timer: their features are final."""
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = self._periods()
        order = sorted(held)
        y, orders = [held[d][1] for d in order], [held[d][2] for d in order]
        closing = [i for i, d in enumerate(order) if _millis(d) == due and not held[d][4]]
        for i in closing:
            held[order[i]][4] = True
        first_open = next((i for i, d in enumerate(order) if not held[d][4]), len(order))
        self.held.put([tuple(held[d]) for d in order[max(first_open - self.reach, 0) :]])
        out = [
            {**dict(zip(self.keys, key)), "ds": order[i], "monthly_revenue": y[i], "monthly_orders": orders[i]}
            | features_at(y, orders, i, self.settings)
            for i in closing
        ]
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_period_features(
    stream: DataFrame, keys: list[str], settings: Settings = Settings(), delay: str = "0 days", rank: str | None = None
) -> DataFrame:
    """``keys…, ds, monthly_revenue, monthly_orders`` and their features, of every period once the watermark has passed it.

    Of several arrivals of a period the one with the highest ``rank`` counts, the
    later one on a tie. The features equal those of the batch operator over all
    rows that were not too late. Writes in append mode; the state store is RocksDB.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = stream.select(
        *keys,
        F.col("ds").cast("date").alias("ds"),
        F.col("monthly_revenue").cast("double").alias("y"),
        F.col("monthly_orders").cast("double").alias("orders"),
        (F.col(rank).cast("long") if rank else F.lit(0).cast("long")).alias("rank"),
        F.col("ds").cast("timestamp").alias("_time"),
    ).withWatermark("_time", delay)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(
        [*[f"`{k}` {types[k]}" for k in keys], "ds date, monthly_revenue double, monthly_orders double"]
        + [f"{name} double" for name in feature_names(settings)]
    )
    closed = rows.groupBy(*keys).transformWithStateInPandas(
        PeriodFeatures(keys, settings), schema, outputMode="Append", timeMode="EventTime"
    )
    return closed.withColumns(cyclical(F.col("ds")))
