"""Sufficient statistics for correlation and linear models in one distributed pass.

Every task folds its rows to a p × p block of sums with one matrix product per
batch; the blocks are then added up. What reaches the driver depends on the
number of features only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.guards import finite, zero_if_null

_SCHEMA = "segment int, i int, j int, n double, si double, sj double, sii double, sjj double, sij double"


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(finite(F.col(c))).alias(c) for c in columns]).first()
    return {c: (row[c] or 0.0) for c in columns}


def pair_moments(df: DataFrame, columns: list[str], segment: str | None = None) -> DataFrame:
    """``(segment, i, j, n, si, sj, sii, sjj, sij)`` over rows where both columns are known.

    Values are centred on the column means first, which keeps the sums of
    products accurate for large values with small spread.
    """
    means = column_means(df, columns)
    centre = np.array([means[c] for c in columns])
    p = len(columns)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, part in batch.groupby("segment"):
                x = part[columns].to_numpy(dtype=float) - centre
                known = ~np.isnan(x)
                x = np.where(known, x, 0.0)
                m = known.astype(float)
                squares = x * x
                block = np.stack([m.T @ m, x.T @ m, squares.T @ m, x.T @ x])
                sums[seg] = sums.get(seg, 0.0) + block
        i, j = np.meshgrid(np.arange(p), np.arange(p), indexing="ij")
        for seg, (n, s, ss, cross) in sums.items():
            yield pd.DataFrame(
                {
                    "segment": np.int32(seg),
                    "i": i.ravel().astype("int32"),
                    "j": j.ravel().astype("int32"),
                    "n": n.ravel(),
                    "si": s.ravel(),
                    "sj": s.T.ravel(),
                    "sii": ss.ravel(),
                    "sjj": ss.T.ravel(),
                    "sij": cross.ravel(),
                }
            )

    seg = F.col(segment).cast("int") if segment else F.lit(0)
    rows = df.select(seg.alias("segment"), *[finite(F.col(c)).alias(c) for c in columns])
    return (
        rows.mapInPandas(fold, _SCHEMA)
        .groupBy("segment", "i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")])
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature_i, feature_j, pos_i, pos_j, n, r)``, pairwise complete.

    ``r`` is NULL where a column is constant over the shared rows.
    """
    names = F.array(*[F.lit(c) for c in columns])
    var_i = F.greatest(F.col("n") * F.col("sii") - F.col("si") * F.col("si"), F.lit(0.0))
    var_j = F.greatest(F.col("n") * F.col("sjj") - F.col("sj") * F.col("sj"), F.lit(0.0))
    cov = F.col("n") * F.col("sij") - F.col("si") * F.col("sj")
    # relative floor: rounding leaves a tiny positive variance in constant columns
    flat_i = var_i <= 1e-12 * F.col("n") * F.col("sii")
    flat_j = var_j <= 1e-12 * F.col("n") * F.col("sjj")
    r = F.when(flat_i | flat_j, None).otherwise(F.try_divide(cov, F.sqrt(var_i) * F.sqrt(var_j)))
    return pair_moments(df, columns).select(
        names[F.col("i")].alias("feature_i"),
        names[F.col("j")].alias("feature_j"),
        F.col("i").alias("pos_i"),
        F.col("j").alias("pos_j"),
        F.col("n").cast("long").alias("n"),
        r.alias("r"),
    )


@dataclass
class Gram:
    """Cross-product matrix of (1, features…, target) rows of one segment."""

    matrix: np.ndarray

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.matrix + other.matrix)

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def ridge(self, chosen: list[int], alpha: float) -> tuple[float, np.ndarray]:
        """Intercept and coefficients; the intercept is not penalised."""
        idx = [c + 1 for c in chosen]
        n = self.n
        mean_x = self.matrix[0, idx] / n
        mean_y = self.matrix[0, -1] / n
        xx = self.matrix[np.ix_(idx, idx)] - n * np.outer(mean_x, mean_x)
        xy = self.matrix[idx, -1] - n * mean_x * mean_y
        beta = np.linalg.solve(xx + alpha * np.eye(len(idx)), xy)
        return float(mean_y - mean_x @ beta), beta

    def rmse(self, chosen: list[int], intercept: float, beta: np.ndarray) -> float:
        """Error of a linear model on the rows of this segment."""
        w = np.zeros(self.matrix.shape[0])
        w[0] = -intercept
        w[[c + 1 for c in chosen]] = -beta
        w[-1] = 1.0
        return float(np.sqrt(max(w @ self.matrix @ w, 0.0) / self.n))


def gram_segments(df: DataFrame, features: list[str], target: str, segment: str) -> dict[int, Gram]:
    """Gram matrix per segment with missing features as 0; p × p numbers each."""
    rows = df.filter(F.col(target).isNotNull()).select(
        F.col(segment).alias("_segment"),
        *[zero_if_null(finite(F.col(f))).alias(f) for f in features],
        finite(F.col(target)).alias(target),
    )
    columns = [*features, target]
    means = column_means(rows, columns)
    centre = np.array([means[c] for c in columns])
    p = len(columns)
    blocks: dict[int, list] = {}
    for r in pair_moments(rows, columns, "_segment").collect():
        blocks.setdefault(r["segment"], []).append(r)
    out = {}
    for seg, rs in blocks.items():
        m = np.zeros((p + 1, p + 1))
        for r in rs:
            i, j = r["i"], r["j"]
            m[i + 1, j + 1] = r["sij"] + centre[i] * r["sj"] + centre[j] * r["si"] + r["n"] * centre[i] * centre[j]
            if i == j:
                m[0, 0] = r["n"]
                m[0, i + 1] = m[i + 1, 0] = r["si"] + r["n"] * centre[i]
        out[int(seg)] = Gram(m)
    return out
