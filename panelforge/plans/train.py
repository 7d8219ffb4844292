"""Training, forecast and refresh plans composed from the operators."""

from __future__ import annotations

import datetime as dt
import platform
import uuid
from dataclasses import dataclass, field

import pyspark
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.functions.metrics import all_metrics
from panelforge.operators import baselines, cleaning, evaluation, forecast, kpi, per_key, selection, splits
from panelforge.operators.features import add_transaction_features, valid_orders
from panelforge.operators.joins import build_master_table
from panelforge.operators.panel import monthly_panel
from panelforge.operators.timeseries import add_time_series_features
from panelforge.operators.stages import PanelCleanerModel, ZeroFill
from panelforge.session import scratch_path
from panelforge.sources import store, tables as source_tables
from panelforge.sources.panel_store import PanelStore

#: Boosting parameters used without tuning (fixed values).
DEFAULT_PARAMS = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 5, "minInstancesPerNode": 5}


@dataclass
class TrainPlan:
    """The ten training steps over one global series or a keyed panel.

    ``feature_panel`` stays raw; cleaning is applied on read, so a refresh never
    scales a row twice.
    """

    spark: SparkSession
    settings: Settings = Settings()
    keys: list[str] = field(default_factory=list)
    path: str | None = None
    leakage_free: bool = True

    tables: dict[str, DataFrame] = field(default_factory=dict)
    panel: DataFrame | None = None
    cleaned: DataFrame | None = None
    cleaning_model: cleaning.CleaningModel | None = None
    selected: list[str] = field(default_factory=list)
    selection: selection.SelectionResult | None = None
    params: dict = field(default_factory=lambda: dict(DEFAULT_PARAMS))
    forecaster: forecast.DirectForecaster | None = None
    reports: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        self.path = self.path or scratch_path(self.spark, "plan")
        self.raw = PanelStore(self.spark, f"{self.path}/panel", self.keys)
        self.clean_store = PanelStore(self.spark, f"{self.path}/cleaned", self.keys)

    # 1
    def load(self, data: dict[str, DataFrame] | str) -> "TrainPlan":
        raw = source_tables.load_tables(self.spark, data) if isinstance(data, str) else data
        self.tables = source_tables.parse_dates(raw)
        self.reports["date_range"] = source_tables.date_range(self.tables["orders"])
        self.reports["quality"] = source_tables.data_quality_report(self.tables)
        return self

    # 2
    def build_features(self) -> "TrainPlan":
        return self.start_from(monthly_panel(self.tables, self.keys))

    def start_from(self, panel: DataFrame) -> "TrainPlan":
        """Stores a raw panel and derives its features."""
        self.raw.create(panel)
        self.panel = self._featured(self.raw.read())
        return self

    # 3
    def split(self, panel: DataFrame) -> DataFrame:
        return splits.split_data(panel, self.settings)

    def part(self, name: str) -> DataFrame:
        return self.split(self.cleaned).filter(F.col("split") == name).drop("split", "is_live")

    # 4
    def baseline(self) -> "TrainPlan":
        parts = self.split(self.panel)
        train = parts.filter(F.col("split") == "train")
        test = splits.union_test_splits(parts)
        self.reports["baseline"] = baselines.evaluate_baselines(
            train, test, self.keys, self.settings.horizon, self.settings.target
        )
        return self

    # 5
    def clean(self) -> "TrainPlan":
        raw = self.panel
        fit_on = self.split(raw).filter(F.col("split") == "train").drop("split", "is_live") if self.leakage_free else raw
        self.cleaning_model = cleaning.fit_cleaning(fit_on, self.settings, self.keys)
        self.cleaning_model.to_frame(self.spark).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cleaning")
        self.clean_store.create(self.cleaning_model.transform(self.panel, self.keys), self.raw.manifest().n_buckets)
        self.cleaned = self.clean_store.read()
        return self

    # 6
    def select_features(self) -> "TrainPlan":
        train, val = self.part("train"), self.part("val")
        if val.isEmpty():
            val = splits.holdout_last_n(train, 3, self.keys).filter("is_test").drop("is_test")
        features = [c for c in self.cleaned.columns if c not in {*self.keys, *cleaning.NOT_CLEANED, self.settings.target}]
        self.selection = selection.run_feature_selection(train, val, features, self.settings)
        self.selected = self.selection.selected
        self.reports["selection"] = self.selection.summary(self.spark)
        return self

    # 7
    def tune(self) -> "TrainPlan":
        found = forecast.tune(self.part("train"), self.selected, self.settings.target, self.settings)
        self.params = found.best_params
        return self

    # 8
    def backtest(self, candidates: dict | None = None) -> "TrainPlan":
        """Candidates fitted on the training split predict from its last row."""
        candidates = dict(candidates) if candidates else {
            "GBT": forecast.gbt(self.params),
            "XGB": forecast.xgb_like(),
            "RandomForest": forecast.random_forest(),
            "Ridge_Regression": forecast.ridge(),
        }
        if self.keys:
            candidates.setdefault("Ridge_per_key", per_key.PerKeyRidge)
        s, train = self.settings, self.part("train")
        test = baselines.numbered_test(
            splits.union_test_splits(self.split(self.cleaned)), self.keys, s.horizon, s.target
        )
        rows, inside = [], []
        for name, make in candidates.items():
            if make is per_key.PerKeyRidge:
                model = make(name, horizon=s.horizon)
            else:
                model = forecast.DirectForecaster(name, make, s.horizon)
            model.fit(train, self.selected, s.target, self.keys)
            predicted = model.predict(train, self.keys).drop("ds").withColumn("model", F.lit(name))
            rows.append(predicted.join(test, [*self.keys, "horizon"]).select("model", "y", "yhat"))
            fitted = model.score(train, 1).select(
                F.lit(name).alias("model"), F.col(s.target).cast("double").alias("y"), "yhat"
            )
            inside.append(fitted)
        out, ins = rows[0], inside[0]
        for r, i in zip(rows[1:], inside[1:]):
            out, ins = out.unionByName(r), ins.unionByName(i)
        scored = out.withColumn("split", F.lit("backtest")).unionByName(ins.withColumn("split", F.lit("train")))
        metrics = out.groupBy("model").agg(*all_metrics()).unionByName(self.reports["baseline"])
        self.reports["comparison"] = evaluation.rank_models(metrics, target_mape=s.target_mape)
        self.reports["gap"] = evaluation.gap_summary(evaluation.train_backtest_gap(scored))
        return self

    def train_final(self) -> "TrainPlan":
        self.forecaster = forecast.train_final(
            self.cleaned, self.selected, self.params, self.settings.target, self.keys, self.settings.horizon
        )
        self.forecaster.save(self.spark, f"{self.path}/model")
        return self

    # 9
    def business(self) -> "TrainPlan":
        valid = valid_orders(add_transaction_features(build_master_table(self.tables)))
        whole = self.panel if not self.keys else monthly_panel(self.tables)
        self.reports["business"] = kpi.business_kpis(valid, whole)
        return self

    # 10
    def record(self, project: str = "revenue_forecast", version: str = "1.0.0") -> bool:
        """Appends a run record from the reports; failures do not stop the plan."""
        s = self.settings
        comparison = self.reports.get("comparison")
        metrics = {}
        if comparison is not None:
            row = comparison.filter(F.col("model") == "GBT").first()
            metrics = {k: float(row[k]) for k in ("rmse", "mae", "mape", "smape")} if row else {}
        business = {}
        if "business" in self.reports:
            row = self.reports["business"].first().asDict()
            business = {f"biz_{k}": float(v) for k, v in row.items() if v is not None}
        span = self.cleaned.agg(F.min("ds"), F.max("ds"), F.count_distinct("ds")).first()
        record = {
            "run_id": uuid.uuid4().hex,
            "project": project,
            "version": version,
            "model_type": self.forecaster.name,
            "granularity": "monthly",
            "trained_at": dt.datetime.now(),
            "params": {k: str(v) for k, v in self.params.items()},
            "metrics": metrics,
            "business": business,
            "features": self.selected,
            "training_range": {"first_ds": span[0], "last_ds": span[1]},
            "n_train_months": span[2],
            "overfit_gap": None,
            "challengers": None,
            "selection_cost": None,
            "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
        }
        if "gap" in self.reports:
            gap = self.reports["gap"].filter(F.col("model") == "GBT").first()
            if gap:
                record["overfit_gap"] = {k: gap[k] for k in ("rmse_train", "rmse_backtest", "gap_rmse_ratio")}
            record["challengers"] = {
                r["model"]: r["mape"] for r in comparison.filter(F.col("model") != "GBT").collect() if r["mape"] is not None
            }
        return store.log_run(self.spark.createDataFrame([record], store.RUN_SCHEMA), f"{self.path}/runs")

    def run(self, data, tune: bool = False, track: bool = False, candidates: dict | None = None) -> "TrainPlan":
        self.load(data).build_features().baseline().clean().select_features()
        if tune:
            self.tune()
        self.backtest(candidates).train_final().business()
        if track:
            self.record()
        return self

    # later
    def forecast(self, horizon: int | None = None, arrived: DataFrame | None = None) -> DataFrame:
        """Coming months from the raw panel, optionally with newly arrived periods."""
        raw = self.panel if arrived is None else self._with(arrived)
        cleaned = self.cleaning_model.transform(raw, self.keys)
        return forecast.forecast(self.forecaster, cleaned, self.keys, horizon, self.settings)

    def _featured(self, raw: DataFrame) -> DataFrame:
        return add_time_series_features(raw, self.settings, self.keys)

    def raw_panel(self) -> DataFrame:
        """The stored panel with all refreshes; a later row of a period replaces an earlier one."""
        return self.raw.read()

    def keep_arrived(self, arrived: DataFrame) -> list[int]:
        """Stores newly arrived periods and cleans the buckets of their series anew; gives these buckets."""
        touched = self.raw.upsert(arrived)
        rows = self._featured(self.raw.read(buckets=touched))
        self.clean_store.replace(self.cleaning_model.transform(rows, self.keys), touched)
        self.panel, self.cleaned = self._featured(self.raw.read()), self.clean_store.read()
        return touched

    def pipeline(self, h: int = 1) -> PipelineModel:
        """Cleaning and the model of a horizon as one pipeline: raw feature rows in, ``prediction`` out."""
        model, parts, stages = self.forecaster, [], []
        for i, fitted in enumerate([model._model(h), *model.extras.get(h, [])]):
            last = fitted.stages[-1]
            parts.append(f"_p{i}")
            stages.append(last.copy({last.predictionCol: parts[-1]}))
        total = SQLTransformer(statement=f"SELECT *, {' + '.join(parts)} AS prediction FROM __THIS__")
        lead = [PanelCleanerModel.of(self.cleaning_model, self.keys), ZeroFill(inputCols=model.features), model._model(h).stages[0]]
        return PipelineModel([*lead, *stages, total])

    def _with(self, arrived: DataFrame) -> DataFrame:
        return self._featured(splits.union_history(self.raw_panel(), arrived))

    def incremental_refresh(self, arrived: DataFrame, window: int = 3, extra_trees: int = 20) -> DataFrame:
        """New periods: recompute features, clean without refitting, boost on recent rows, score again."""
        if self.cleaning_model is None or self.forecaster is None:
            raise RuntimeError("train the plan before refreshing it")
        return refresh(self, arrived, window, extra_trees)


def refresh(plan: TrainPlan, arrived: DataFrame, window: int = 3, extra_trees: int = 20) -> DataFrame:
    s = plan.settings
    plan.keep_arrived(arrived)
    recent = splits.holdout_last_n(plan.cleaned, max(window, 2), plan.keys).filter("is_test").drop("is_test")
    plan.forecaster.update(recent, s.target, plan.keys, extra_trees)
    plan.forecaster.save(plan.spark, f"{plan.path}/model")
    train = plan.part("train")
    test = baselines.numbered_test(plan.part("backtest"), plan.keys, s.horizon, s.target)
    predicted = plan.forecaster.predict(train, plan.keys).drop("ds").withColumn("model", F.lit("GBT_incremental"))
    return baselines.score(predicted, test, plan.keys)


def load_plan(spark: SparkSession, path: str, settings: Settings = Settings(), keys: list[str] | None = None) -> TrainPlan:
    """A trained plan from its folder: panel, cleaning parameters and models."""
    plan = TrainPlan(spark, settings, keys or [], path)
    plan.panel = plan._featured(plan.raw_panel())
    plan.cleaning_model = cleaning.CleaningModel.from_frame(store.read_panel(spark, f"{path}/cleaning"))
    plan.cleaned = plan.clean_store.read()
    plan.forecaster = forecast.DirectForecaster.load(spark, f"{path}/model")
    plan.selected = plan.forecaster.features
    return plan
