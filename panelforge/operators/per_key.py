"""Linear models of their own for every series, from one grouped aggregate.

A row's cross products are one vector; vectors are summed per key on the map side
first, so the only shuffle moves one vector per key and task. The normal equations
of a batch of keys are then solved as one stack of matrices, inside the tasks
that hold the sums. Nothing loops over keys, and no series comes together in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.guards import finite, zero_if_null
from panelforge.operators.forecast import PARAM_SCHEMA, direct_multistep_dataset, interval_columns
from panelforge.operators.gram import column_means
from panelforge.operators.joins import latest_per_key
from panelforge.sources.store import read_panel

#: Columns of a table of fitted equations, besides the keys.
FITTED = "n long, intercept double, coefficients array<double>, resid_std double"


def _places(p: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the expansion of degree two holds each value, and each product, of ``p`` values.

    It lists a value, then its products with all values up to itself.
    """
    i = np.arange(p)
    first = i * (i + 3) // 2
    high, low = np.maximum.outer(i, i), np.minimum.outer(i, i)
    return first, first[high] + 1 + low


def cross_products(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys…, n, sums``: sums of ``columns`` and of their products per key, missing values counted as 0."""
    values = F.array(*[zero_if_null(finite(F.col(c))) for c in columns])
    expand = PolynomialExpansion(degree=2, inputCol="_x", outputCol="_xx")
    expanded = expand.transform(rows.select(*keys, array_to_vector(values).alias("_x")))
    summed = expanded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("_xx")).alias("_sum"))
    return summed.select(*keys, "n", vector_to_array("_sum").alias("sums"))


def moments(sums: np.ndarray, n: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and centred cross products of a batch of keys, ``(keys, p)`` and ``(keys, p, p)``."""
    first, product = _places(p)
    mean = sums[:, first] / n[:, None]
    return mean, sums[:, product] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]


def ridge_equations(alpha: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Coefficients with a penalty on all but the intercept.

    Without a penalty they are the shortest of the best, on features of equal spread.
    """

    def solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
        if alpha > 0:
            return np.linalg.solve(xx + alpha * np.eye(xx.shape[-1]), xy[..., None])[..., 0]
        spread = np.sqrt(np.einsum("kii->ki", xx).clip(0))
        spread[spread == 0] = 1.0
        even = xx / (spread[:, :, None] * spread[:, None, :])
        return (np.linalg.pinv(even, hermitian=True, rcond=1e-12) @ (xy / spread)[..., None])[..., 0] / spread

    return solve


def solve_keys(
    sums: DataFrame, keys: list[str], p: int, solve: Callable[[np.ndarray, np.ndarray], np.ndarray], centre: np.ndarray
) -> DataFrame:
    """``keys…`` and :data:`FITTED` from :func:`cross_products` of ``p - 1`` centred features and the centred target."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = part[keys].copy()
            out["n"] = part["n"]
            if len(part):
                n = part["n"].to_numpy(float)
                mean, square = moments(np.stack(part["sums"].to_numpy()), n, p)
                xx, xy, yy = square[:, :-1, :-1], square[:, :-1, -1], square[:, -1, -1]
                beta = solve(xx, xy)
                left = yy - 2 * np.einsum("ki,ki->k", beta, xy) + np.einsum("ki,kij,kj->k", beta, xx, beta)
                at = mean + centre
                out["intercept"] = at[:, -1] - np.einsum("ki,ki->k", beta, at[:, :-1])
                out["coefficients"] = list(beta)
                spread = np.sqrt(np.maximum(left, 0.0) / np.maximum(n - 1, 1))
                out["resid_std"] = np.where(n > 1, spread, np.nan)
            else:
                out["intercept"] = out["coefficients"] = out["resid_std"] = None
            yield out

    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], FITTED])
    return sums.mapInPandas(batches, schema).withColumn("resid_std", finite(F.col("resid_std")))


def fit_linear(
    rows: DataFrame,
    keys: list[str],
    features: list[str],
    target: str,
    alpha: float = 1.0,
    least_rows: int = 0,
    pool_by: list[str] | None = None,
) -> DataFrame:
    """``keys…`` and :data:`FITTED`: a linear model for every key.

    Keys with fewer than ``least_rows`` rows take the model of all rows (of the
    same ``pool_by`` values), whose products are the sums of the keys' ones.
    Values are centred on the means of all rows before they are multiplied.
    """
    known = rows.filter(finite(F.col(target)).isNotNull())
    columns = [*features, target]
    means = column_means(known.withColumns({f: zero_if_null(finite(F.col(f))) for f in features}), columns)
    centre = np.array([means[c] for c in columns])
    centred = known.select(*keys, *[(zero_if_null(finite(F.col(c))) - F.lit(means[c])).alias(f"_c{i}") for i, c in enumerate(columns)])
    sums = cross_products(centred, keys, [f"_c{i}" for i in range(len(columns))])
    own = solve_keys(sums, keys, len(columns), ridge_equations(alpha), centre)
    if not least_rows:
        return own
    pool_by = pool_by or []
    flat = sums.select(*pool_by, "n", F.posexplode("sums").alias("place", "value"))
    total = flat.groupBy(*pool_by, "place").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    total = total.groupBy(*pool_by).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "value"))).alias("_s"))
    pooled = solve_keys(total.select(*pool_by, "n", F.col("_s.value").alias("sums")), pool_by, len(columns), ridge_equations(alpha), centre)
    names = ["intercept", "coefficients", "resid_std"]
    pooled = pooled.select(*pool_by, *[F.col(c).alias(f"_{c}") for c in names])
    joined = own.join(pooled, pool_by) if pool_by else own.crossJoin(F.broadcast(pooled))  # one row
    few = F.col("n") < least_rows
    return joined.withColumns({c: F.when(few, F.col(f"_{c}")).otherwise(F.col(c)) for c in names}).drop(*[f"_{c}" for c in names])


def linear_value(features: list[str], intercept: Column | None = None, coefficients: str = "coefficients") -> Column:
    """The linear model's value for a row that carries its equation."""
    total = F.col("intercept") if intercept is None else intercept
    for i, f in enumerate(features):
        total = total + F.col(coefficients)[i] * zero_if_null(finite(F.col(f)))
    return total


@dataclass
class PerKeyRidge:
    """One ridge model for every series and horizon; fits and predicts like :class:`DirectForecaster`.

    ``equations`` is a table of ``keys…, horizon`` and :data:`FITTED`. ``alpha=0`` gives plain least squares.
    A series without a row in the training data has no prediction.
    """

    name: str = "Ridge_per_key"
    alpha: float = 1.0
    horizon: int = 3
    offset: str = "reference"
    least_rows: int = 0
    features: list[str] = field(default_factory=list)
    equations: DataFrame | None = None

    def fit(
        self,
        train: DataFrame,
        features: list[str],
        target: str = "monthly_revenue",
        keys: list[str] | None = None,
        val: DataFrame | None = None,
    ) -> PerKeyRidge:
        """``val`` is taken for the sake of the common interface and not used: nothing stops early here."""
        self.features = list(features)
        data = direct_multistep_dataset(train, self.features, target, self.horizon, keys, self.offset)
        self.equations = fit_linear(
            data, [*(keys or []), "horizon"], self.features, "label", self.alpha, self.least_rows, ["horizon"]
        )
        return self

    def _scored(self, rows: DataFrame, equations: DataFrame, name: str) -> DataFrame:
        on = [c for c in equations.columns if c in rows.columns]
        met = rows.join(equations, on) if on else rows.crossJoin(F.broadcast(equations))  # one row per horizon
        return met.withColumn(name, linear_value(self.features))

    def score(self, rows: DataFrame, h: int, name: str = "yhat") -> DataFrame:
        """Adds the prediction of horizon ``h`` to every row of a known series."""
        if not 1 <= h <= self.horizon:
            raise ValueError(f"horizon {h} not available; fitted horizons: {list(range(1, self.horizon + 1))}")
        one = self.equations.filter(F.col("horizon") == h).drop("horizon")
        return self._scored(rows, one, name).select(*rows.columns, name)

    def predict(self, panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """``keys…, ds, horizon, yhat`` from the last row of each series."""
        last = latest_per_key(panel, keys or [], "ds")
        return self._scored(last, self.equations, "yhat").select(*(keys or []), "ds", "horizon", "yhat")

    def predict_with_intervals(
        self, panel: DataFrame, keys: list[str] | None = None, alpha: float = 0.05, inflation: float = 1.5
    ) -> DataFrame:
        """Intervals from each series' own residuals."""
        last = latest_per_key(panel, keys or [], "ds")
        lower, upper = interval_columns(F.col("resid_std"), alpha, inflation)
        scored = self._scored(last, self.equations, "yhat").withColumns({"yhat_lower": lower, "yhat_upper": upper})
        return scored.select(*(keys or []), "ds", "horizon", "yhat", "yhat_lower", "yhat_upper")

    def importance(self, h: int = 1) -> DataFrame:
        """``feature, importance``: mean absolute coefficient over the series, largest first."""
        one = self.equations.filter(F.col("horizon") == h)
        flat = one.select(F.posexplode("coefficients").alias("_i", "_b"))
        names = F.array(*[F.lit(f) for f in self.features])
        mean = flat.groupBy("_i").agg(F.avg(F.abs("_b")).alias("importance"))
        return mean.select(names[F.col("_i")].alias("feature"), "importance").orderBy(F.desc("importance"), "feature")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("name", self.name, None), ("offset", self.offset, None), ("alpha", "", self.alpha)]
        rows += [("horizon", "", float(self.horizon)), ("least_rows", "", float(self.least_rows))]
        rows += [("feature", f, float(i)) for i, f in enumerate(self.features)]
        spark.createDataFrame(rows, PARAM_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/params")
        self.equations.write.mode("overwrite").parquet(f"{path}/equations")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PerKeyRidge:
        rows = read_panel(spark, f"{path}/params").collect()
        one = {r["param"]: r for r in rows if r["param"] != "feature"}
        features = [r["label"] for r in sorted((r for r in rows if r["param"] == "feature"), key=lambda r: r["value"])]
        return cls(
            one["name"]["label"], one["alpha"]["value"], int(one["horizon"]["value"]), one["offset"]["label"],
            int(one["least_rows"]["value"]), features, read_panel(spark, f"{path}/equations"),
        )
