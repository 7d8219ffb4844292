import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.functions.metrics import all_metrics
from panelforge.operators import baselines, forecast
from panelforge.session import scratch_path


def metrics(spark, pairs):
    return spark.createDataFrame(pairs, "y double, yhat double").agg(*all_metrics()).first()


def test_metrics(spark):
    assert metrics(spark, [(100.0, 110.0), (200.0, 190.0)])["rmse"] == 10
    assert metrics(spark, [(100.0, 110.0)])["mape"] == pytest.approx(10)
    assert metrics(spark, [(100.0, 110.0), (200.0, 210.0)])["mae"] == 10
    perfect = metrics(spark, [(100.0, 100.0), (0.0, 0.0)])
    assert (perfect["rmse"], perfect["mape"], perfect["smape"]) == (0, 0, 0)
    assert metrics(spark, [(0.0, 5.0)])["mape"] is None


def test_baselines(spark, monthly):
    train = monthly.orderBy("ds").limit(18)
    y = [r["monthly_revenue"] for r in train.orderBy("ds").collect()]
    out = {}
    for r in baselines.all_baselines(train, horizon=14).collect():
        out.setdefault(r["model"], {})[r["horizon"]] = r["yhat"]
    assert all(len(v) == 14 for v in out.values())
    assert set(out["Naive"].values()) == {y[17]}
    assert out["MovingAverage_3M"][1] == pytest.approx(np.mean(y[15:18]))
    assert out["SeasonalNaive"][1] == y[6] and out["SeasonalNaive"][12] == y[17] and out["SeasonalNaive"][13] == y[6]
    slope, intercept = np.polyfit(np.arange(18), y, 1)
    assert out["LinearTrend"][2] == pytest.approx(intercept + slope * 19) and slope > 0
    short = baselines.baseline_seasonal_naive(train.limit(3)).collect()
    assert {round(r["yhat"], 6) for r in short} == {round(float(np.mean([r["monthly_revenue"] for r in train.limit(3).collect()])), 6)}
    for single in (baselines.baseline_naive, baselines.baseline_moving_average, baselines.baseline_seasonal_naive, baselines.baseline_linear_trend):
        rows = single(train, horizon=14).collect()
        assert {r["horizon"]: pytest.approx(r["yhat"]) for r in rows} == out[rows[0]["model"]]


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(42)
    rows = []
    for t in range(36):
        orders = 2000 + 4000 * t / 35 + rng.normal(0, 100)
        rows.append((dt.date(2015 + t // 12, t % 12 + 1, 1), float(orders), float(t % 12 + 1), float(300 * orders + rng.normal(0, 5000))))
    return spark.createDataFrame(rows, "ds date, monthly_orders double, month double, monthly_revenue double")


FEATURES = ["monthly_orders", "month"]


def test_dataset_offsets(spark, xy):
    reference = forecast.direct_multistep_dataset(xy, FEATURES)
    assert [reference.filter(F.col("horizon") == h).count() for h in (1, 2, 3)] == [36, 35, 34]
    ahead = forecast.direct_multistep_dataset(xy, FEATURES, offset="ahead")
    assert [ahead.filter(F.col("horizon") == h).count() for h in (1, 2, 3)] == [35, 34, 33]
    with pytest.raises(ValueError):
        forecast.target_step(1, "other")


def test_ridge_equals_closed_form(spark, xy):
    model = forecast.DirectForecaster("Ridge", forecast.ridge(5.0)).fit(xy, FEATURES)
    rows = xy.orderBy("ds").collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    y = np.array([r["monthly_revenue"] for r in rows])
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(2), xc.T @ yc)
    assert model.models[1].stages[-1].coefficients.toArray() == pytest.approx(beta, rel=1e-5)
    out = model.predict(xy).collect()
    assert len(out) == 3 and all(np.isfinite(r["yhat"]) for r in out) and set(model.resid_std) == {1, 2, 3}
    importance = model.importance(spark).collect()
    assert len(importance) == 2 and importance[0]["importance"] >= importance[1]["importance"]
    with pytest.raises(ValueError):
        model.score(xy, 99)


def test_forecast_caps_horizon(spark, xy):
    model = forecast.DirectForecaster("Ridge", forecast.ridge(), 2).fit(xy, FEATURES)
    out = forecast.forecast(model, xy, horizon=12, settings=Settings()).orderBy("horizon").collect()
    assert [r["ds"] for r in out] == [dt.date(2018, 1, 1), dt.date(2018, 2, 1)]
    assert all(r["yhat_lower"] < r["yhat"] < r["yhat_upper"] and r["mape_target"] == 10.0 for r in out)


def test_intervals(spark):
    p = spark.createDataFrame([(1, 100.0), (2, -200.0), (3, 50.0)], "horizon int, yhat double")
    resid = spark.createDataFrame([(1, 10.0), (2, 0.0)], "horizon int, resid_std double")
    out = {r["horizon"]: r for r in forecast.prediction_intervals(p, resid).collect()}
    assert out[1]["yhat_upper"] == pytest.approx(100 + 1.959964 * 15, rel=1e-6)
    assert out[2]["yhat_lower"] == pytest.approx(-230) and out[3]["yhat_upper"] == pytest.approx(57.5)


def test_ensemble(spark):
    p = spark.createDataFrame([("a", 1, 10.0), ("b", 1, 30.0)], "model string, horizon int, yhat double")
    assert forecast.ensemble(p).first()["yhat"] == 20.0
    w = spark.createDataFrame([("a", 0.7)], "model string, weight double")
    assert forecast.ensemble(p, w).first()["yhat"] == pytest.approx(7.0)


def test_update_adds_trees_and_reloads(spark, xy):
    model = forecast.DirectForecaster("GBT", forecast.gbt({"maxIter": 5, "maxDepth": 2}), 1).fit(xy, FEATURES)
    before, error = model.n_trees(1), _rmse(model, xy)
    model.update(xy, extra_trees=4)
    assert model.n_trees(1) == before + 4 and _rmse(model, xy) < error
    path = scratch_path(spark, "model")
    model.save(spark, path)
    again = forecast.DirectForecaster.load(spark, path)
    assert again.n_trees(1) == before + 4 and _rmse(again, xy) == pytest.approx(_rmse(model, xy))
    assert again.features == FEATURES and again.resid_std == model.resid_std
    assert model.update(xy.limit(0)).n_trees(1) == before + 4


def _rmse(model, df):
    return model.score(df, 1).agg(F.sqrt(F.avg((F.col("monthly_revenue") - F.col("yhat")) ** 2))).first()[0]


def test_scenarios_default_to_zero(spark):
    rows = spark.createDataFrame([(1, {"a": 2.0}), (2, {})], "id int, features map<string,double>")
    out = {r["id"]: (r["a"], r["b"]) for r in forecast.scenario_rows(rows, ["a", "b"]).collect()}
    assert out == {1: (2.0, 0.0), 2: (0.0, 0.0)}


def test_what_if_overrides(spark, xy):
    s = spark.createDataFrame([("more", 9999.0), ("same", None)], "scenario string, monthly_orders double")
    out = {r["scenario"]: r["monthly_orders"] for r in forecast.what_if(xy, s).collect()}
    last = xy.orderBy(F.desc("ds")).first()["monthly_orders"]
    assert out == {"more": 9999.0, "same": last}


def test_tuning_is_seeded(spark, xy):
    space = {"maxIter": (2, 4), "stepSize": (0.05, 0.5), "maxDepth": (1, 2)}
    assert forecast.sample_params(space, 5) == forecast.sample_params(space, 5)
    full = forecast.sample_params(Settings().tune_space, 20)
    assert all(0.01 <= p["stepSize"] <= 0.1 and isinstance(p["maxDepth"], int) for p in full)
    found = forecast.tune(xy, FEATURES, settings=Settings(tune_trials=2, tune_folds=2, tune_space=space), parallel=2)
    assert found.best_value == min(v for _, v in found.trials) and len(found.trials) == 2
    with pytest.raises(RuntimeError):
        forecast.tune(xy, FEATURES, settings=Settings(tune_trials=1, tune_seconds=-1, tune_space=space))
