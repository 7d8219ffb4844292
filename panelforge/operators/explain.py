"""Attribution of predictions to features: linear and tree models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions.guards import finite, zero_if_null
from panelforge.operators.forecast import DirectForecaster
from panelforge.session import scratch_path


def shap_linear(df: DataFrame, coefficients: dict[str, float], intercept: float, ids: list[str]) -> DataFrame:
    """``(ids…, feature, shap_value, base_value)`` of a linear model.

    The value is coefficient · (x − mean); the base is the mean prediction, so
    base plus the values of a row give its prediction.
    """
    names = list(coefficients)
    x = df.select(*ids, *[zero_if_null(finite(F.col(f))).alias(f) for f in names])
    means = x.agg(*[F.avg(f).alias(f"_m_{f}") for f in names]).withColumn("_one", F.lit(1))
    base = F.lit(float(intercept))
    for f in names:
        base = base + F.col(f"_m_{f}") * F.lit(float(coefficients[f]))
    values = {f: (F.col(f) - F.col(f"_m_{f}")) * F.lit(float(coefficients[f])) for f in names}
    # the means are one row
    wide = x.withColumn("_one", F.lit(1)).join(F.broadcast(means), "_one").select(
        *ids, base.alias("base_value"), *[v.alias(f) for f, v in values.items()]
    )
    return wide.unpivot(
        [*[F.col(c) for c in ids], F.col("base_value")], [F.col(f) for f in names], "feature", "shap_value"
    )


@dataclass
class _Leaf:
    """A leaf as the box of its path: per feature used, the interval and the share of rows that stay inside."""

    value: float
    features: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def _leaves(nodes: dict[int, object], scale: float) -> tuple[list[_Leaf], float]:
    """Leaves of one tree and its mean prediction under the training rows."""
    out: list[_Leaf] = []
    expected = 0.0

    def walk(node_id: int, box: dict[int, tuple[float, float, float]], weight: float) -> None:
        nonlocal expected
        node = nodes[node_id]
        if node.leftChild < 0:
            value = node.prediction * scale
            expected += value * weight
            if box:
                used = sorted(box)
                low, high, share = (np.array([box[f][k] for f in used]) for k in range(3))
                out.append(_Leaf(value, used, low, high, share))
            return
        feature, threshold = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
        low, high, share = box.get(feature, (-np.inf, np.inf, 1.0))
        for child, bounds in (
            (node.leftChild, (low, min(high, threshold))),
            (node.rightChild, (max(low, threshold), high)),
        ):
            kept = nodes[child].rawCount / node.rawCount
            walk(child, {**box, feature: (*bounds, share * kept)}, weight * kept)

    walk(0, {}, 1.0)
    return out, expected


def _leaf_values(leaf: _Leaf, x: np.ndarray, out: np.ndarray) -> None:
    """Adds the exact Shapley values of one leaf for all rows of ``x``.

    The worth of a known feature set is value · Π inside(known) · Π share(rest).
    For each feature a short polynomial sums the products of the others by set size.
    """
    d = len(leaf.features)
    cells = x[:, leaf.features]
    inside = ((cells > leaf.low) & (cells <= leaf.high)).astype(float)
    for k, feature in enumerate(leaf.features):
        poly = np.zeros((d, len(x)))
        poly[0] = 1.0
        size = 0
        for m in range(d):
            if m == k:
                continue
            grown = poly * leaf.share[m]
            grown[1 : size + 2] += poly[: size + 1] * inside[:, m]
            poly, size = grown, size + 1
        weights = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
        out[:, feature] += leaf.value * (inside[:, k] - leaf.share[k]) * (weights @ poly)


def tree_table(model: PipelineModel, spark: SparkSession) -> tuple[DataFrame, dict[int, float]]:
    """Node rows of a fitted tree ensemble and the weight of each tree.

    Read from the saved model, whose layout is part of the MLlib file format.
    The size is trees × nodes, set by the model and not by the data.
    """
    stage = model.stages[-1]
    path = scratch_path(spark, "trees")
    stage.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weights = dict(enumerate(stage.treeWeights))
    if "RandomForest" in type(stage).__name__:
        total = sum(weights.values())
        weights = {t: w / total for t, w in weights.items()}
    return nodes, weights


def shap_tree(
    forecaster: DirectForecaster, df: DataFrame, ids: list[str], horizon: int = 1
) -> DataFrame:
    """``(ids…, feature, shap_value, base_value)`` of a tree forecaster, for many rows.

    The trees travel to the tasks as a broadcast variable; rows stay where they are.
    """
    spark = df.sparkSession
    features = forecaster.features
    leaves: list[_Leaf] = []
    base = 0.0
    for model in [forecaster._model(horizon), *forecaster.extras.get(horizon, [])]:
        nodes, weights = tree_table(model, spark)
        trees: dict[int, dict[int, object]] = {}
        for r in nodes.collect():
            trees.setdefault(r["treeID"], {})[r["id"]] = r
        for t, rows in trees.items():
            found, expected = _leaves(rows, weights[t])
            leaves += found
            base += expected
    shared = spark.sparkContext.broadcast(leaves)
    x = df.select(*ids, *[zero_if_null(finite(F.col(f))).alias(f) for f in features])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.zeros((len(batch), len(features)))
            cells = batch[features].to_numpy(dtype=float)
            for leaf in shared.value:
                _leaf_values(leaf, cells, values)
            yield pd.concat([batch[ids].reset_index(drop=True), pd.DataFrame(values, columns=features)], axis=1)

    wide = x.mapInPandas(explain, x.schema)
    return wide.withColumn("base_value", F.lit(base)).unpivot(
        [*[F.col(c) for c in ids], F.col("base_value")], [F.col(f) for f in features], "feature", "shap_value"
    )


def shap_summary(values: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return (
        values.groupBy("feature")
        .agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )


def local_contributions(values: DataFrame, ids: list[str], order: str = "ds") -> DataFrame:
    """Attributions of the last row of each series, by magnitude."""
    keys = [c for c in ids if c != order]
    latest = F.max(order).over(Window.partitionBy(*keys))
    return (
        values.withColumn("_last", latest)
        .filter(F.col(order) == F.col("_last"))
        .select(*ids, "feature", "shap_value")
        .orderBy(*keys, F.desc(F.abs("shap_value")), "feature")
    )
