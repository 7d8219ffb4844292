import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.operators.cleaning import clean_panel
from panelforge.operators.stages import PanelCleaner, PanelCleanerModel, ZeroFill


@pytest.fixture(scope="module")
def panel(monthly):
    season = F.when(F.month("ds") > 9, "peak").when(F.month("ds") == 2, None).otherwise("base")
    gap = F.when(F.month("ds") == 5, None).otherwise(F.col("avg_ticket"))
    return monthly.withColumns({"season": season, "avg_ticket": gap})


def test_stage_equals_the_functions(spark, panel, tmp_path):
    train = panel.filter("ds < '2018-07-01'")
    want = clean_panel(panel, fit_on=train)[0]
    fitted = PanelCleaner(fitOn="ds < '2018-07-01'").fit(panel)
    fitted.write().overwrite().save(str(tmp_path / "m"))
    for model in (fitted, PanelCleanerModel.load(str(tmp_path / "m"))):
        got = model.transform(panel)
        assert got.columns == want.columns and got.exceptAll(want).count() == 0
    assert PanelCleaner(fitOn="ds < '2018-07-01'").getOrDefault("scaling") == Settings().scaling


def test_parameters_are_kept(tmp_path):
    settings = Settings(clip_low=0.1, clip_high=0.8, fill_strategy="mean", rare_threshold=0.3, scaling="minmax")
    PanelCleaner.of(settings, ["a", "b"], "x > 1").save(str(tmp_path / "e"))
    again = PanelCleaner.load(str(tmp_path / "e"))
    assert again.settings() == settings and again.getOrDefault("keys") == ["a", "b"] and again.getOrDefault("fitOn") == "x > 1"


def test_pipeline_with_a_model_is_saved_whole(spark, panel, tmp_path):
    names = ["monthly_orders", "avg_ticket", "season__base"]
    stages = [
        PanelCleaner(fillStrategy="mean"), ZeroFill(inputCols=names), VectorAssembler(inputCols=names, outputCol="v"),
        LinearRegression(featuresCol="v", labelCol="monthly_revenue"),
    ]
    fitted = Pipeline(stages=stages).fit(panel)
    fitted.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    want = {r["ds"]: r["prediction"] for r in fitted.transform(panel).collect()}
    assert {r["ds"]: r["prediction"] for r in again.transform(panel).collect()} == want and len(want) == 24


def test_zero_fill(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (2.0,)], "x double")
    assert [r["x"] for r in ZeroFill(inputCols=["x"]).transform(df).collect()] == [0.0, 0.0, 0.0, 2.0]
