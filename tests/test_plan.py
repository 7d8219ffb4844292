import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.operators import forecast
from panelforge.plans.train import DEFAULT_PARAMS, TrainPlan, load_plan
from panelforge.sources import store
from panelforge.sources.bindings import star_tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan(spark):
    settings = Settings(train_end="2000-06", val_end="2000-12", live_month="2001-07", horizon=2)
    out = TrainPlan(spark, settings)
    out.params = {**DEFAULT_PARAMS, "maxIter": 5, "maxDepth": 2}
    candidates = {"GBT": forecast.gbt(out.params), "Ridge_Regression": forecast.ridge()}
    return out.run(star_tables(spark, FOLDER), track=True, candidates=candidates)


def test_all_steps_report(plan):
    assert {"quality", "baseline", "selection", "comparison", "gap", "business"} <= set(plan.reports)
    assert plan.reports["comparison"].count() == 6 and len(plan.selected) >= 3
    assert plan.reports["business"].first()["revenue_total"] > 0
    run = store.read_runs(plan.spark, f"{plan.path}/runs").first()
    assert run["metrics"]["mape"] > 0 and run["features"] == plan.selected and run["overfit_gap"] is not None


def test_forecast_and_reload(spark, plan):
    points = plan.forecast(horizon=6).orderBy("horizon").collect()
    assert len(points) == 2
    again = load_plan(spark, plan.path, plan.settings)
    same = again.forecast().orderBy("horizon").collect()
    assert [r["yhat"] for r in same] == pytest.approx([r["yhat"] for r in points])


def test_refresh_appends_and_boosts(spark, plan):
    base = plan.raw_panel()
    arrived = base.orderBy(F.desc("ds")).limit(1).withColumn("ds", F.add_months("ds", 1).cast("date"))
    before, n = plan.forecaster.n_trees(1), base.count()
    metrics = plan.incremental_refresh(arrived, extra_trees=3).collect()
    assert plan.panel.count() == n + 1 and plan.forecaster.n_trees(1) == before + 3
    assert len(metrics) == 1 and metrics[0]["model"] == "GBT_incremental"
    # a second refresh and a reload keep the first one's month
    later = arrived.withColumn("ds", F.add_months("ds", 1).cast("date"))
    plan.incremental_refresh(later, extra_trees=2).collect()
    months = {r["ds"] for r in plan.panel.select("ds").collect()}
    assert {r["ds"] for r in arrived.unionByName(later).collect()} <= months and len(months) == n + 2
    again = load_plan(spark, plan.path, plan.settings)
    assert {r["ds"] for r in again.panel.select("ds").collect()} == months
    assert again.cleaned.count() == plan.cleaned.count()
    # one bucket is written per refresh, however many came before
    assert len(plan.raw.read().inputFiles()) == len(plan.clean_store.read().inputFiles()) == 1
    with pytest.raises(RuntimeError):
        TrainPlan(spark).incremental_refresh(arrived)


def test_pipeline_predicts_like_the_plan_and_is_saved(spark, plan, tmp_path):
    """Also with the trees that refreshes added."""
    plan.pipeline(1).write().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    got = {r["ds"]: r["prediction"] for r in loaded.transform(plan.panel).collect()}
    want = {r["ds"]: r["yhat"] for r in plan.forecaster.score(plan.cleaned, 1).collect()}
    assert got == pytest.approx(want) and len(got) > 20
