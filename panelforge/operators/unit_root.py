"""Unit-root test of every series: is a series stationary, or must it be differenced first?

The change of a series is regressed on its level one row before and on earlier
changes. The cross products of the largest regression hold those of every smaller
one, so one grouped aggregate serves all lag orders of all series; the order is
chosen by Akaike's criterion, on the same rows for every order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.guards import all_known, finite
from panelforge.operators.gram import column_means
from panelforge.operators.per_key import cross_products, moments

#: Critical values of the test with a constant by sample size T, as polynomials of 1 / T (fixed values, MacKinnon 2010).
CRITICAL = {
    0.01: (-3.43035, -6.5393, -16.786, -79.433),
    0.05: (-2.86154, -2.8903, -4.234, -40.040),
    0.10: (-2.56677, -1.5384, -2.809, 0.0),
}

RESULT = "n long, lags int, statistic double, crit_1 double, crit_5 double, crit_10 double, p_value double, stationary boolean"


def regression_rows(panel: DataFrame, keys: list[str], target: str, max_lags: int) -> tuple[DataFrame, list[str]]:
    """``keys…`` with the level before, ``max_lags`` earlier changes and the change; rows where one is missing are left out."""
    w = Window.partitionBy(*keys).orderBy("ds")
    rows = panel.select(*keys, "ds", finite(F.col(target)).alias("_y")).withColumn("_level", F.lag("_y").over(w))
    rows = rows.withColumn("_change", F.col("_y") - F.col("_level"))
    names = ["_level", *[f"_change_{i}" for i in range(1, max_lags + 1)], "_change"]
    rows = rows.withColumns({f"_change_{i}": F.lag("_change", i).over(w) for i in range(1, max_lags + 1)})
    return rows.select(*keys, *names).filter(all_known(names)), names


def _orders(square: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """t statistic of the level and information criterion, by key and lag order; not a number where rows are too few."""
    statistic, criterion = [], []
    for lags in range(square.shape[-1] - 1):
        used = np.arange(lags + 1)
        xx, xy, yy = square[:, used[:, None], used], square[:, used, -1], square[:, -1, -1]
        spread = np.sqrt(np.einsum("kii->ki", xx).clip(0))
        spread[spread == 0] = 1.0
        inverse = np.linalg.pinv(xx / (spread[:, :, None] * spread[:, None, :]), hermitian=True, rcond=1e-10)
        scaled = np.einsum("kij,kj->ki", inverse, xy / spread)
        left = yy - np.einsum("ki,ki->k", scaled, xy / spread)
        free = n - lags - 2
        fits = (free > 0) & (left > 1e-12 * yy) & (inverse[:, 0, 0] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            error = np.sqrt(left / free * inverse[:, 0, 0])
            statistic.append(np.where(fits, scaled[:, 0] / error, np.nan))
            criterion.append(np.where(fits, n * np.log(left / n) + 2 * (lags + 2), np.nan))
    return np.stack(statistic, 1), np.stack(criterion, 1)


def critical_value(level: float, n: np.ndarray) -> np.ndarray:
    return sum(c / n**i for i, c in enumerate(CRITICAL[level]))


def unit_root_test(panel: DataFrame, keys: list[str] | None = None, target: str = "monthly_revenue", max_lags: int = 3) -> DataFrame:
    """``keys…`` and :data:`RESULT` of every series.

    ``p_value`` lies between the critical values of 1, 5 and 10 %, interpolated;
    0.01 and 0.1 stand for anything beyond. Series too short, constant, or without
    any error have no statistic and no verdict.
    """
    keys = keys or []
    rows, names = regression_rows(panel, keys, target, max_lags)
    means = column_means(rows, names)
    centred = rows.select(*keys, *[(F.col(c) - F.lit(means[c])).alias(c) for c in names])
    sums = cross_products(centred, keys, names)

    def test(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part[part["n"] > 0]
            if not len(part):
                continue
            n = part["n"].to_numpy(float)
            _, square = moments(np.stack(part["sums"].to_numpy()), n, len(names))
            statistic, criterion = _orders(square, n)
            lags = np.where(np.isnan(criterion), np.inf, criterion).argmin(1)
            chosen = statistic[np.arange(len(n)), lags]
            crit = np.stack([critical_value(level, n) for level in CRITICAL], 1)
            known = ~np.isnan(chosen)
            out = part[keys].copy()
            out["n"], out["lags"] = part["n"], pd.array(np.where(known, lags, 0), "Int32")
            out.loc[~known, "lags"] = pd.NA
            out["statistic"] = pd.Series(chosen, part.index).astype(object).where(known, None)
            out["crit_1"], out["crit_5"], out["crit_10"] = crit.T
            p = [np.interp(t, c, list(CRITICAL)) if k else None for t, c, k in zip(chosen, crit, known)]
            out["p_value"] = pd.Series(p, part.index, dtype=object)
            out["stationary"] = pd.Series(chosen < crit[:, 1], part.index).astype(object).where(known, None)
            yield out

    types = {f.name: f.dataType.simpleString() for f in panel.schema.fields}
    return sums.mapInPandas(test, ", ".join([*[f"`{k}` {types[k]}" for k in keys], RESULT]))
