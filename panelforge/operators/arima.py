"""Seasonal autoregressive moving-average models of every series, in two regressions.

A long autoregression of each (differenced) series gives its shocks; a second
regression has lags of the series and of the shocks, near ones and the one a season
ago. Both are linear, so a series needs its cross products only: one grouped
aggregate serves every order of every series, and the order is chosen by Akaike's
criterion on the same rows for all orders. Nothing loops over keys.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.guards import all_known, finite
from panelforge.operators.gram import column_means
from panelforge.operators.joins import latest_per_key
from panelforge.operators.per_key import cross_products, fit_linear, linear_value, moments, ridge_equations

#: Columns of a table of fitted models, besides the keys.
MODEL = "n long, p int, q int, seasonal_p int, seasonal_q int, intercept double, coefficients array<double>, sigma double, aic double"
FORECAST = "horizon int, yhat double, yhat_lower double, yhat_upper double"

#: A variance below this share of the mean square is taken for none.
FLAT = 1e-12

#: Lags of the series, lags of its shocks, and whether the lag a season ago of either is in.
Order = tuple[int, int, int, int]


def difference_weights(d: int, seasonal_d: int, period: int) -> np.ndarray:
    """Weights of a row and the rows before it in the differenced series."""
    weights = np.ones(1)
    for lag in [1] * d + [period] * seasonal_d:
        step = np.zeros(lag + 1)
        step[0], step[-1] = 1.0, -1.0
        weights = np.convolve(weights, step)
    return weights


@dataclass
class SeasonalArima:
    """One model for every series; lags count rows in the order of ``ds``.

    All orders up to ``most`` are compared, or ``order`` alone is fitted. A series with too few rows for the
    smallest order has no model and no forecast; one with a gap among the values that its forecast starts from has a
    null forecast. A series that moves by less than a millionth of its level has the mean as its model, whatever the order.
    """

    most: Order = (3, 2, 1, 1)
    order: Order | None = None
    d: int = 0
    seasonal_d: int = 1
    period: int = 12
    long_lags: int = 6
    models: DataFrame | None = None
    ends: DataFrame | None = field(default=None, repr=False)

    def orders(self) -> list[Order]:
        return [self.order] if self.order else list(itertools.product(*(range(m + 1) for m in self.most)))

    def _terms(self) -> list[tuple[str, int]]:
        """The lags of the largest order: of the series ``_z`` and of the shocks ``_e``."""
        p, q, sp, sq = (max(o[i] for o in self.orders()) for i in range(4))
        if max(p, q) >= self.period and sp + sq:
            raise ValueError("near lags reach the seasonal one")
        near = [("_z", i + 1) for i in range(p)] + [("_e", i + 1) for i in range(q)]
        return near + [("_z", self.period)] * sp + [("_e", self.period)] * sq

    def _places(self, order: Order) -> list[int]:
        p, q, sp, sq = order
        wanted = {("_z", i + 1) for i in range(p)} | {("_e", i + 1) for i in range(q)}
        wanted |= {("_z", self.period)} if sp else set()
        wanted |= {("_e", self.period)} if sq else set()
        return [i for i, term in enumerate(self._terms()) if term in wanted]

    def _with_shocks(self, panel: DataFrame, keys: list[str], target: str) -> DataFrame:
        """``keys…, ds, _y, _z, _e``: the series, its differences, and what a long autoregression leaves of them."""
        w = Window.partitionBy(*keys).orderBy("ds")
        weights = difference_weights(self.d, self.seasonal_d, self.period)
        z = sum((F.lag("_y", i).over(w) * float(c) for i, c in enumerate(weights) if i and c), F.col("_y"))
        rows = panel.select(*keys, "ds", finite(F.col(target)).alias("_y")).withColumn("_z", z)
        if not any(name == "_e" for name, _ in self._terms()):
            return rows.withColumn("_e", F.lit(None).cast("double"))
        lags = [f"_l{i + 1}" for i in range(self.long_lags)]
        rows = rows.withColumns({c: F.lag("_z", i + 1).over(w) for i, c in enumerate(lags)})
        known = all_known(["_z", *lags])
        long = fit_linear(rows.filter(known), keys, lags, "_z", alpha=0.0).select(*keys, "intercept", "coefficients")
        # one row for each series, or one in all
        met = rows.join(long, keys, "left") if keys else rows.crossJoin(F.broadcast(long))
        return met.select(*keys, "ds", "_y", "_z", F.when(known, F.col("_z") - linear_value(lags)).alias("_e"))

    def fit(self, panel: DataFrame, keys: list[str] | None = None, target: str = "monthly_revenue") -> SeasonalArima:
        keys, terms = keys or [], self._terms()
        rows = self._with_shocks(panel, keys, target)
        w = Window.partitionBy(*keys).orderBy("ds")
        names = [f"_x{i}" for i in range(len(terms))]
        lagged = rows.withColumns({c: F.lag(name, lag).over(w) for c, (name, lag) in zip(names, terms, strict=True)})
        columns = [*names, "_z"]
        lagged = lagged.select(*keys, *columns).filter(all_known(columns))
        means = column_means(lagged, columns)
        # a table without a usable row has no means
        centre = np.array([means[c] or 0.0 for c in columns])
        centred = lagged.select(*keys, *[(F.col(c) - F.lit(float(m))).alias(c) for c, m in zip(columns, centre, strict=True)])
        sums = cross_products(centred, keys, columns).filter("n > 0")
        types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
        schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], MODEL])
        orders, places = self.orders(), [self._places(o) for o in self.orders()]

        def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if not len(part):
                    continue
                out = part[[*keys, "n"]].reset_index(drop=True)
                n = out["n"].to_numpy(float)
                mean, square = moments(np.stack(part["sums"].to_numpy()), n, len(columns))
                at = mean + centre
                # what centring leaves of a flat series are rounding errors
                level = n * at[:, -1] ** 2 + square[:, -1, -1]
                moves = np.einsum("kii->ki", square) > FLAT * level[:, None]
                square = np.where(moves[:, :, None] & moves[:, None, :], square, 0.0)
                beta, aic, spread, best = _chosen(square, n, places)
                picked = np.array(orders)[best]
                for i, name in enumerate(["p", "q", "seasonal_p", "seasonal_q"]):
                    out[name] = picked[:, i].astype(np.int32)
                out["intercept"] = at[:, -1] - np.einsum("ki,ki->k", beta, at[:, :-1])
                out["coefficients"], out["sigma"], out["aic"] = list(beta), spread, aic
                yield out[np.isfinite(aic)]

        self.models = sums.mapInPandas(choose, schema)
        # what a forecast starts from: a bounded stretch of each series
        reach = max([lag for _, lag in terms], default=1)
        back = max(1, len(difference_weights(self.d, self.seasonal_d, self.period)) - 1)
        tails = {"_ys": ("_y", back), "_zs": ("_z", reach), "_es": ("_e", reach)}
        tailed = rows.withColumns({c: F.array(*[F.lag(name, i).over(w) for i in range(m)]) for c, (name, m) in tails.items()})
        self.ends = latest_per_key(tailed.select(*keys, "ds", *tails), keys, "ds")
        return self

    def forecast(self, horizon: int = 3, keys: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
        """``keys…, ds, horizon, yhat, yhat_lower, yhat_upper`` from the last row of each series."""
        keys, terms = keys or [], self._terms()
        weights = difference_weights(self.d, self.seasonal_d, self.period)
        wide = NormalDist().inv_cdf(1 - alpha / 2)
        met = self.ends.join(self.models, keys) if keys else self.ends.crossJoin(F.broadcast(self.models))  # one row
        given = met.select(*keys, "ds", "_ys", "_zs", "_es", "intercept", "coefficients", "sigma")
        types = {f.name: f.dataType.simpleString() for f in given.schema.fields}
        schema = ", ".join([*[f"`{k}` {types[k]}" for k in [*keys, "ds"]], FORECAST])

        def ahead(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if not len(part):
                    continue
                # oldest first, so that a forecast is put at the end
                past = {c: np.stack([np.asarray(x, float)[::-1] for x in part[f"{c}s"]]) for c in ("_y", "_z", "_e")}
                beta, intercept = np.stack(part["coefficients"].to_numpy()).reshape(len(part), -1), part["intercept"].to_numpy()
                moved = np.cumsum(_shock_weights(beta, terms, weights, horizon) ** 2, axis=1)
                spread = part["sigma"].to_numpy()[:, None] * np.sqrt(moved)
                for h in range(1, horizon + 1):
                    z = intercept.copy()
                    for i, (name, lag) in enumerate(terms):
                        z += np.where(beta[:, i] != 0, beta[:, i] * past[name][:, -lag], 0.0)
                    y = z - sum((c * past["_y"][:, -i] for i, c in enumerate(weights) if i and c), np.zeros(len(part)))
                    for name, value in (("_y", y), ("_z", z), ("_e", np.zeros(len(part)))):
                        past[name] = np.c_[past[name], value]
                    out = part[[*keys, "ds"]].copy()
                    out["horizon"], out["yhat"] = np.int32(h), y
                    out["yhat_lower"], out["yhat_upper"] = y - wide * spread[:, h - 1], y + wide * spread[:, h - 1]
                    yield out

        found = given.mapInPandas(ahead, schema)
        return found.withColumns({c: finite(F.col(c)) for c in ("yhat", "yhat_lower", "yhat_upper")})


def _chosen(square: np.ndarray, n: np.ndarray, places: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (0 for absent terms), criterion, spread and place of the best order, for a batch of series.

    The criterion is infinite where no order leaves a row over; of equal ones the first order is taken.
    """
    total = np.maximum(square[:, -1, -1], 0.0)
    series, terms = len(square), square.shape[-1] - 1
    best, criterion = np.zeros(series, np.int64), np.full(series, np.inf)
    beta, spread = np.zeros((series, terms)), np.zeros(series)
    solve = ridge_equations(0.0)
    for at, place in enumerate(places):
        mine = np.zeros((series, terms))
        rss = total.copy()
        if place:
            xx, xy = square[:, place][:, :, place], square[:, place, -1]
            got = solve(xx, xy)
            mine[:, place] = got
            rss = rss - 2 * np.einsum("ki,ki->k", got, xy) + np.einsum("ki,kij,kj->k", got, xx, got)
        # a perfect fit has a rest of rounding errors only
        share = np.maximum(rss, 1e-14 * total)
        with np.errstate(divide="ignore"):
            value = np.where(share > 0, n * np.log(np.maximum(share, 1e-300) / n), 0.0) + 2 * (len(place) + 2)
        value = np.where(n > len(place) + 2, value, np.inf)
        better = value < criterion
        best[better], criterion[better], beta[better] = at, value[better], mine[better]
        spread[better] = np.sqrt(np.maximum(rss, 0.0) / n)[better]
    return beta, criterion, spread, best


def _shock_weights(beta: np.ndarray, terms: list[tuple[str, int]], weights: np.ndarray, horizon: int) -> np.ndarray:
    """How much a shock moves the undifferenced series 0, 1, … rows later."""
    own, moving = np.zeros((len(beta), horizon)), np.zeros((len(beta), horizon))
    moving[:, 0] = 1.0
    for i, (name, lag) in enumerate(terms):
        if lag < horizon:
            (own if name == "_z" else moving)[:, lag] += beta[:, i]
    differenced, out = np.zeros((len(beta), horizon)), np.zeros((len(beta), horizon))
    for h in range(horizon):
        differenced[:, h] = moving[:, h] + sum(own[:, i] * differenced[:, h - i] for i in range(1, h + 1))
        out[:, h] = differenced[:, h] - sum(weights[i] * out[:, h - i] for i in range(1, min(h, len(weights) - 1) + 1))
    return out
