"""Direct multi-step forecasters: one MLlib model per horizon on the pooled panel."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from statistics import NormalDist

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.functions.guards import finite, zero_if_null
from panelforge.functions.metrics import mape, rmse
from panelforge.operators.joins import latest_per_key
from panelforge.operators.splits import period_folds
from panelforge.session import use_checkpoints
from panelforge.sources.store import load_model, save_model

PARAM_SCHEMA = "param string, label string, value double"


# ---- data set -----------------------------------------------------------


def target_step(h: int, offset: str = "reference") -> int:
    """Rows ahead of the label: h − 1 (horizon 1 is the same period) or h ("ahead")."""
    if offset not in ("reference", "ahead"):
        raise ValueError(f"unknown target offset: {offset}")
    return h - 1 if offset == "reference" else h


def direct_multistep_dataset(
    panel: DataFrame,
    features: list[str],
    target: str = "monthly_revenue",
    horizon: int = 3,
    keys: list[str] | None = None,
    offset: str = "reference",
) -> DataFrame:
    """``(keys…, ds, horizon, label, features…)``; rows without a label are dropped, gaps are 0."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy("ds")
    y = finite(F.col(target))
    labels = F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.lead(y, target_step(h, offset)).over(w).alias("label"))
            for h in range(1, horizon + 1)
        ]
    )
    return (
        panel.withColumn("_l", labels)
        .select(*keys, "ds", F.explode("_l").alias("_l"), *[zero_if_null(finite(F.col(f))).alias(f) for f in features])
        .select(*keys, "ds", "_l.horizon", "_l.label", *features)
        .filter(F.col("label").isNotNull())
    )


def _prepared(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: zero_if_null(finite(F.col(f))) for f in features})


# ---- estimators ---------------------------------------------------------


def gbt(params: dict | None = None, seed: int = 42) -> Callable[[DataFrame], GBTRegressor]:
    """Boosted trees; ``params`` are MLlib names."""
    defaults = {
        "maxIter": 300,
        "stepSize": 0.05,
        "maxDepth": 5,
        "subsamplingRate": 0.8,
        "minInstancesPerNode": 5,
    }
    chosen = {**defaults, **(params or {})}
    chosen = {k: str(v) if k == "featureSubsetStrategy" else v for k, v in chosen.items() if k != "featureFraction"}
    if params and "featureFraction" in params:
        chosen["featureSubsetStrategy"] = str(float(params["featureFraction"]))
    return lambda train: GBTRegressor(
        featuresCol="features_vec", labelCol="label", seed=seed, cacheNodeIds=False, checkpointInterval=10, **chosen
    )


def xgb_like(seed: int = 42) -> Callable[[DataFrame], GBTRegressor]:
    """The second boosted candidate: depth 4 with column sampling."""
    return gbt({"maxDepth": 4, "minInstancesPerNode": 1, "featureFraction": 0.8}, seed)


def random_forest(trees: int = 300, depth: int = 5, seed: int = 42) -> Callable[[DataFrame], RandomForestRegressor]:
    return lambda train: RandomForestRegressor(
        featuresCol="features_vec", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed
    )


def ridge(alpha: float = 1.0) -> Callable[[DataFrame], LinearRegression]:
    """Least squares with a penalty ``alpha`` on the raw coefficients.

    MLlib divides the penalty by n and scales it by the label deviation, which
    is undone here from one aggregate over the training rows.
    """

    def build(train: DataFrame) -> LinearRegression:
        s = train.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("sd")).first()
        reg = alpha * (s["sd"] or 1.0) / max(s["n"], 1)
        return LinearRegression(
            featuresCol="features_vec",
            labelCol="label",
            elasticNetParam=0.0,
            standardization=False,
            regParam=reg,
            solver="normal",
        )

    return build


# ---- forecaster ---------------------------------------------------------


@dataclass
class DirectForecaster:
    """One model per horizon with its in-sample residual deviation."""

    name: str
    make: Callable[[DataFrame], object] | None = None
    horizon: int = 3
    offset: str = "reference"
    features: list[str] = field(default_factory=list)
    models: dict[int, PipelineModel] = field(default_factory=dict)
    resid_std: dict[int, float] = field(default_factory=dict)
    extras: dict[int, list[PipelineModel]] = field(default_factory=dict)

    def fit(
        self,
        train: DataFrame,
        features: list[str],
        target: str = "monthly_revenue",
        keys: list[str] | None = None,
        val: DataFrame | None = None,
    ) -> "DirectForecaster":
        """Fits every horizon; ``val`` rows only decide when boosting stops."""
        use_checkpoints(train.sparkSession)
        self.features = list(features)
        data = direct_multistep_dataset(train, features, target, self.horizon, keys, self.offset).withColumn(
            "is_val", F.lit(False)
        )
        if val is not None:
            held = direct_multistep_dataset(val, features, target, self.horizon, keys, self.offset)
            data = data.unionByName(held.withColumn("is_val", F.lit(True)))
        data = data.persist()
        try:
            for h in range(1, self.horizon + 1):
                rows = data.filter(F.col("horizon") == h).drop("horizon")
                fitted = rows.filter(~F.col("is_val"))
                estimator = self.make(fitted)
                if val is not None and isinstance(estimator, GBTRegressor):
                    estimator = estimator.setValidationIndicatorCol("is_val")
                    used = rows
                else:
                    used = fitted
                assembler = VectorAssembler(inputCols=self.features, outputCol="features_vec")
                model = Pipeline(stages=[assembler, estimator]).fit(used)
                self.models[h] = model
                self.resid_std[h] = _resid_std(model.transform(fitted))
        finally:
            data.unpersist()
        return self

    def _model(self, h: int) -> PipelineModel:
        if h not in self.models:
            raise ValueError(f"horizon {h} not available; fitted horizons: {sorted(self.models)}")
        return self.models[h]

    def score(self, rows: DataFrame, h: int, name: str = "yhat") -> DataFrame:
        """Adds the prediction of horizon ``h`` to every row."""
        keep = rows.columns
        out = _prepared(rows, self.features)
        parts = []
        for i, model in enumerate([self._model(h), *self.extras.get(h, [])]):
            out = model.transform(out).withColumnRenamed("prediction", f"_p{i}").drop("features_vec")
            parts.append(F.col(f"_p{i}"))
        return out.withColumn(name, reduce(lambda a, b: a + b, parts)).select(*keep, name)

    def predict_rows(self, rows: DataFrame, ids: list[str]) -> DataFrame:
        """``(ids…, horizon, yhat)`` for every row and horizon."""
        out = None
        for h in sorted(self.models):
            part = self.score(rows, h).select(*ids, F.lit(h).alias("horizon"), "yhat")
            out = part if out is None else out.unionByName(part)
        return out

    def predict(self, panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """``(keys…, ds, horizon, yhat)`` from the last row of each series."""
        keys = keys or []
        return self.predict_rows(latest_per_key(panel, keys, "ds"), [*keys, "ds"])

    def residual_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(h, float(s)) for h, s in sorted(self.resid_std.items())], "horizon int, resid_std double"
        )

    def predict_with_intervals(self, panel: DataFrame, keys=None, alpha: float = 0.05, inflation: float = 1.5):
        predictions = self.predict(panel, keys)
        return prediction_intervals(predictions, self.residual_frame(panel.sparkSession), alpha, inflation)

    def update(
        self, window: DataFrame, target: str = "monthly_revenue", keys=None, extra_trees: int = 20, seed: int = 42
    ) -> "DirectForecaster":
        """Continues boosting on recent rows: new trees fit the residual of the old model.

        The label is the target of the row itself for every horizon, as in a
        refresh with a single new period.
        """
        use_checkpoints(window.sparkSession)
        rows = window.filter(F.col(target).isNotNull()).persist()
        try:
            if rows.isEmpty():
                return self
            for h in sorted(self.models):
                scored = self.score(_prepared(rows, self.features), h, "_old")
                residual = scored.withColumn("label", finite(F.col(target)) - F.col("_old"))
                stage = GBTRegressor(
                    featuresCol="features_vec", labelCol="label", seed=seed, maxIter=extra_trees, stepSize=0.05, maxDepth=5
                )
                assembler = VectorAssembler(inputCols=self.features, outputCol="features_vec")
                self.extras.setdefault(h, []).append(Pipeline(stages=[assembler, stage]).fit(residual))
        finally:
            rows.unpersist()
        return self

    def n_trees(self, h: int) -> int:
        stages = [self._model(h), *self.extras.get(h, [])]
        return sum(getattr(m.stages[-1], "getNumTrees", 0) for m in stages)

    def importance(self, spark: SparkSession, h: int = 1) -> DataFrame:
        """``(feature, importance)`` of one horizon, largest first."""
        stage = self._model(h).stages[-1]
        if hasattr(stage, "featureImportances"):
            values = stage.featureImportances.toArray()
        else:
            values = abs(stage.coefficients.toArray())
        rows = [(f, float(v)) for f, v in zip(self.features, values)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [("name", self.name, None), ("offset", self.offset, None)]
        rows += [("horizon", str(h), None) for h in self.models]
        rows += [("resid_std", str(h), float(s)) for h, s in self.resid_std.items()]
        rows += [("feature", f, float(i)) for i, f in enumerate(self.features)]
        rows += [("extras", str(h), float(len(m))) for h, m in self.extras.items()]
        save_model(self.models, spark.createDataFrame(rows, PARAM_SCHEMA), path)
        for h, models in self.extras.items():
            for i, model in enumerate(models):
                model.write().overwrite().save(f"{path}/extra={h}-{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DirectForecaster":
        models, params = load_model(spark, path)
        rows = params.collect()

        def named(param):
            return [r for r in rows if r["param"] == param]

        out = cls(named("name")[0]["label"], horizon=len(models), offset=named("offset")[0]["label"], models=models)
        out.resid_std = {int(r["label"]): r["value"] for r in named("resid_std")}
        out.features = [r["label"] for r in sorted(named("feature"), key=lambda r: r["value"])]
        out.extras = {
            int(r["label"]): [PipelineModel.load(f"{path}/extra={r['label']}-{i}") for i in range(int(r["value"]))]
            for r in named("extras")
        }
        return out


def _resid_std(scored: DataFrame) -> float:
    value = scored.agg(F.stddev_samp(F.col("label") - F.col("prediction")).alias("s")).first()["s"]
    return float(value) if value is not None and value == value else 0.0


def residual_std(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(horizon, resid_std)`` of in-sample predictions; 0 for a single row."""
    deviation = F.coalesce(F.stddev_samp(F.col(label) - F.col(prediction)), F.lit(0.0))
    return scored.groupBy("horizon").agg(deviation.alias("resid_std"))


def interval_columns(deviation: Column, alpha: float = 0.05, inflation: float = 1.5) -> tuple[Column, Column]:
    """Bounds around ``yhat``: z · inflation · deviation, or ±15 % without a deviation."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    std = F.coalesce(deviation, F.lit(0.0)) * inflation
    margin = F.when(std > 0, std * z).otherwise(F.abs("yhat") * 0.15)
    return F.col("yhat") - margin, F.col("yhat") + margin


def prediction_intervals(
    predictions: DataFrame, resid: DataFrame, alpha: float = 0.05, inflation: float = 1.5
) -> DataFrame:
    """Adds ``yhat_lower`` and ``yhat_upper`` from one deviation per horizon."""
    lower, upper = interval_columns(F.col("resid_std"), alpha, inflation)
    joined = predictions.join(F.broadcast(resid), "horizon", "left")
    return joined.withColumns({"yhat_lower": lower, "yhat_upper": upper}).drop("resid_std")


def forecast(
    forecaster: DirectForecaster,
    panel: DataFrame,
    keys: list[str] | None = None,
    horizon: int | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """``(keys…, horizon, ds, yhat, yhat_lower, yhat_upper, mape_target)`` of the coming months.

    A horizon beyond the fitted ones is cut to them.
    """
    keys = keys or []
    wanted = min(horizon or settings.horizon, len(forecaster.models))
    points = forecaster.predict_with_intervals(panel, keys).filter(F.col("horizon") <= wanted)
    future = F.trunc(F.add_months("ds", F.col("horizon")), "month")
    return points.select(
        *keys,
        "horizon",
        future.alias("ds"),
        "yhat",
        "yhat_lower",
        "yhat_upper",
        F.lit(settings.target_mape).alias("mape_target"),
    )


def ensemble(predictions: DataFrame, weights: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Weighted sum of the models' predictions per series and horizon.

    Without weights all models count the same; a model without a weight counts 0.
    """
    by = by or ["horizon"]
    if weights is None:
        weights = predictions.select("model").distinct()
        n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))  # one row per model
        weights = weights.withColumn("weight", 1.0 / n)
    weighted = predictions.join(weights, "model", "left")
    return weighted.groupBy(*by).agg(F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("yhat")).alias("yhat"))


# ---- scenarios ----------------------------------------------------------


def scenario_rows(requests: DataFrame, features: list[str], column: str = "features") -> DataFrame:
    """Feature columns from a map column; a missing feature is 0."""
    values = {f: F.coalesce(F.try_element_at(F.col(column), F.lit(f)), F.lit(0.0)) for f in features}
    return requests.withColumns(values)


def score_scenarios(
    forecaster: DirectForecaster, requests: DataFrame, ids: list[str], column: str = "features"
) -> DataFrame:
    """``(ids…, horizon, yhat)`` for rows of custom feature maps."""
    rows = scenario_rows(requests, forecaster.features, column)
    return forecaster.predict_rows(rows, ids)


def what_if(panel: DataFrame, scenarios: DataFrame, keys: list[str] | None = None, overrides=None) -> DataFrame:
    """Last row of each series under every scenario; NULL overrides keep the base value.

    ``scenarios`` has one row per scenario with columns named like the features
    they replace. Every series meets every scenario, so both sides are all of the
    result's size; which of them is sent to the tasks, if any, Spark chooses by size.
    """
    keys = keys or []
    overrides = overrides or [c for c in scenarios.columns if c in panel.columns]
    named = scenarios.select(
        *[c for c in scenarios.columns if c not in overrides], *[F.col(c).alias(f"_o_{c}") for c in overrides]
    )
    out = latest_per_key(panel, keys, "ds").select(*panel.columns).crossJoin(named)
    return out.withColumns({c: F.coalesce(F.col(f"_o_{c}"), F.col(c).cast("double")) for c in overrides}).drop(
        *[f"_o_{c}" for c in overrides]
    )


# ---- tuning -------------------------------------------------------------

INTEGER_PARAMS = {"maxIter", "maxDepth", "minInstancesPerNode", "maxBins"}
LOG_PARAMS = {"stepSize"}


def sample_params(space: dict[str, tuple[float, float]], trials: int, seed: int = 42) -> list[dict]:
    """Seeded random points of the search space."""
    rng = random.Random(seed)
    points = []
    for _ in range(trials):
        point = {}
        for name, (lo, hi) in space.items():
            if name in LOG_PARAMS:
                point[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            elif name in INTEGER_PARAMS:
                point[name] = rng.randint(int(lo), int(hi))
            else:
                point[name] = rng.uniform(lo, hi)
        points.append(point)
    return points


@dataclass
class TuningResult:
    best_params: dict
    best_value: float
    trials: list[tuple[dict, float]]


def tune(
    train: DataFrame,
    features: list[str],
    target: str = "monthly_revenue",
    settings: Settings = Settings(),
    seed: int = 42,
    parallel: int = 4,
) -> TuningResult:
    """Random search over expanding time folds; the lowest mean error wins.

    Trials are independent Spark jobs submitted from a few threads over one
    persisted data set. No trial starts after the time budget is used up.
    """
    use_checkpoints(train.sparkSession)
    k = settings.tune_folds
    data = (
        train.join(period_folds(train, k), "ds")
        .select("block", finite(F.col(target)).alias("label"), *[zero_if_null(finite(F.col(f))).alias(f) for f in features])
        .filter(F.col("label").isNotNull())
        .transform(VectorAssembler(inputCols=features, outputCol="features_vec").transform)
        .select("block", "label", "features_vec")
        .persist()
    )
    metric = rmse if settings.tune_metric == "rmse" else mape
    deadline = time.monotonic() + settings.tune_seconds

    def evaluate(params: dict) -> float | None:
        if time.monotonic() > deadline:
            return None
        errors = []
        for fold in range(1, k + 1):
            fit_rows = data.filter(F.col("block") <= fold).withColumn("is_val", F.col("block") == fold)
            model = gbt(params, seed)(fit_rows).setValidationIndicatorCol("is_val").fit(fit_rows)
            scored = model.transform(data.filter(F.col("block") == fold))
            errors.append(scored.agg(metric(F.col("label"), F.col("prediction")).alias("e")).first()["e"])
        known = [e for e in errors if e is not None]
        return sum(known) / len(known) if known else None

    points = sample_params(settings.tune_space, settings.tune_trials, seed)
    try:
        with ThreadPoolExecutor(parallel) as pool:
            values = list(pool.map(evaluate, points))
    finally:
        data.unpersist()
    done = [(p, v) for p, v in zip(points, values) if v is not None]
    if not done:
        raise RuntimeError("no trial finished within the time budget")
    best = min(done, key=lambda pv: pv[1])
    return TuningResult(best[0], best[1], done)


def train_final(
    history: DataFrame,
    features: list[str],
    params: dict | None = None,
    target: str = "monthly_revenue",
    keys: list[str] | None = None,
    horizon: int = 3,
    offset: str = "reference",
) -> DirectForecaster:
    """Boosted trees with the chosen parameters on the whole history."""
    return DirectForecaster("GBT", gbt(params), horizon, offset).fit(history, features, target, keys)
