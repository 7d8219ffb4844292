import datetime as dt
import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.operators import evaluation, explain, forecast, kpi


def test_roi(spark, monthly):
    f = spark.createDataFrame([(1.0e6,), (2.0e6,)], "yhat double")
    good = evaluation.roi(f, monthly, 5.0).first()
    assert good["time_saving_per_year"] == 15360.0 and good["mape_improvement_pts"] == pytest.approx(2.12)
    assert good["projected_revenue_horizon"] == 3.0e6 and good["forecast_horizon_months"] == 2
    assert good["total_benefit_per_year"] == pytest.approx(15360 + good["accuracy_saving_per_year"])
    assert evaluation.roi(f, monthly, 12.0).first()["accuracy_saving_per_year"] == 0
    assert evaluation.roi(f, monthly, None).first()["mape_improvement_pts"] == 0


def test_gap(spark):
    rows = [("m", "train", 10.0, 9.0), ("m", "train", 10.0, 11.0), ("m", "backtest", 100.0, 105.0), ("p", "train", 1.0, 1.0), ("p", "backtest", 1.0, 2.0)]
    out = {r["model"]: r for r in evaluation.gap_summary(evaluation.train_backtest_gap(spark.createDataFrame(rows, "model string, split string, y double, yhat double"))).collect()}
    assert out["m"]["mape_backtest"] == pytest.approx(5.0) and out["m"]["gap_rmse_ratio"] == pytest.approx(5.0)
    assert out["p"]["gap_rmse_ratio"] == float("inf") and out["p"]["is_worst_gap"] and not out["m"]["is_worst_gap"]
    assert list(out) == ["p", "m"]


def test_selection_cost(spark):
    out = evaluation.selection_cost({"rmse": 2.0, "mape": 8.0}, {"rmse": 3.0, "mape": 9.5}, 41, 5, spark).orderBy(F.desc("n_features")).collect()
    assert len(out) == 2 and out[1]["delta_mape"] == pytest.approx(1.5) and out[0]["delta_mape"] is None


def test_rank_models(spark):
    m = spark.createDataFrame([("a", 10.0), ("b", 3.0), ("c", None)], "model string, mape double")
    out = evaluation.rank_models(m).collect()
    assert [r["model"] for r in out] == ["b", "a", "c"] and [r["meets_target"] for r in out] == [True, False, False]


def test_latest_run_and_fallback(spark):
    schema = "run_id string, trained_at timestamp, model_type string, metrics map<string,double>"
    runs = spark.createDataFrame([("1", dt.datetime(2020, 1, 1), "A", {"mape": 4.0}), ("2", dt.datetime(2020, 2, 1), "B", {"rmse": 1.0})], schema)
    last = evaluation.latest_run_metrics(runs).first()
    assert last["model"] == "B" and last["mape"] == 10.0 and not last["meets_target"]
    assert evaluation.latest_run_metrics(runs.filter("run_id = '1'")).first()["meets_target"]
    assert evaluation.latest_run_metrics(runs.limit(0)).first()["mape"] == 10.0


def test_promotion_gate(spark):
    rows = [(1, "1", 9.0, True), (2, "2", 9.5, True), (3, "3", 8.0, False), (4, "4", 8.5, True), (5, "5", None, True)]
    out = evaluation.promotion_gate(spark.createDataFrame(rows, "trained_at int, run_id string, mape double, filters_passed boolean")).orderBy("trained_at").collect()
    assert [r["promote"] for r in out] == [True, False, False, True, False]


def test_champion_challenger(spark):
    champion, challenger = [9, 9, 11, 12], [10, 8, 9, 13]
    rows = [(t, "c", float(v)) for t, v in enumerate(champion)] + [(t, "d", float(v)) for t, v in enumerate(challenger)]
    out = evaluation.champion_challenger(spark.createDataFrame(rows, "period int, model string, mape double"), "c", "d").orderBy("period").collect()
    assert [r["promote"] for r in out] == [False, False, True, False] and [r["retrain"] for r in out] == [False, False, False, True]


def test_null_analysis_and_pareto(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, 1.0)], "a double, b double")
    assert [tuple(r) for r in kpi.null_analysis(df).collect()] == [("b", 2, 66.67)]
    v = spark.createDataFrame([("x", 80.0), ("y", 15.0), ("z", 5.0), (None, 99.0)], "product_category_name_english string, payment_value double")
    out = kpi.pareto(v).orderBy("cumulative_pct").collect()
    assert [(r["category"], r["cumulative_pct"], r["in_80_pct"]) for r in out] == [("x", 80.0, True), ("y", 95.0, False), ("z", 100.0, False)]


# ---- attribution ----


@pytest.fixture(scope="module")
def trees(spark):
    rng = np.random.default_rng(0)
    rows = []
    for t in range(60):
        a, b, c = rng.normal(size=3)
        rows.append((dt.date(2015 + t // 12, t % 12 + 1, 1), float(a), float(b), float(c), float(9 * a + 5 * (b > 0) * a + rng.normal() * 0.1)))
    df = spark.createDataFrame(rows, "ds date, a double, b double, c double, monthly_revenue double")
    make = {"gbt": forecast.gbt({"maxIter": 4, "maxDepth": 3, "minInstancesPerNode": 1}), "rf": forecast.random_forest(5, 4)}
    return df, {n: forecast.DirectForecaster(n, m, 1).fit(df, ["a", "b", "c"]) for n, m in make.items()}


@pytest.mark.parametrize("name", ["gbt", "rf"])
def test_tree_attributions_add_up(spark, trees, name):
    df, models = trees
    values = explain.shap_tree(models[name], df, ["ds"])
    assert values.count() == 60 * 3
    total = values.groupBy("ds").agg((F.sum("shap_value") + F.max("base_value")).alias("s"))
    gap = models[name].score(df, 1).join(total, "ds").agg(F.max(F.abs(F.col("yhat") - F.col("s")))).first()[0]
    assert gap < 1e-9
    summary = explain.shap_summary(values).collect()
    assert summary[0]["feature"] == "a" and all(x["mean_abs_shap"] >= y["mean_abs_shap"] for x, y in zip(summary, summary[1:]))
    local = explain.local_contributions(values, ["ds"]).collect()
    assert len(local) == 3 and {r["feature"] for r in local} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        explain.shap_tree(models[name], df, ["ds"], horizon=99)


def test_tree_attributions_equal_subset_enumeration(spark, trees):
    df, models = trees
    model = models["gbt"]
    nodes, weights = explain.tree_table(model.models[1], spark)
    table = {}
    for r in nodes.collect():
        table.setdefault(r["treeID"], {})[r["id"]] = r

    def worth(x, known):
        def walk(tree, i):
            n = tree[i]
            if n.leftChild < 0:
                return n.prediction
            f, t = n.split.featureIndex, n.split.leftCategoriesOrThreshold[0]
            if f in known:
                return walk(tree, n.leftChild if x[f] <= t else n.rightChild)
            left, right = tree[n.leftChild].rawCount, tree[n.rightChild].rawCount
            return (left * walk(tree, n.leftChild) + right * walk(tree, n.rightChild)) / (left + right)

        return sum(weights[t] * walk(tree, 0) for t, tree in table.items())

    rows = df.orderBy("ds").limit(5)
    out = {(r["ds"], r["feature"]): r["shap_value"] for r in explain.shap_tree(model, rows, ["ds"]).collect()}
    for r in rows.collect():
        x = [r["a"], r["b"], r["c"]]
        for i, name in enumerate("abc"):
            others = [j for j in range(3) if j != i]
            phi = 0.0
            for k in range(3):
                for s in itertools.combinations(others, k):
                    w = factorial(k) * factorial(2 - k) / factorial(3)
                    phi += w * (worth(x, {*s, i}) - worth(x, set(s)))
            assert out[(r["ds"], name)] == pytest.approx(phi, abs=1e-9)


def test_linear_attributions_add_up(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(20)], "id int, a double, b double")
    values = explain.shap_linear(df, {"a": 2.0, "b": -3.0}, 4.0, ["id"])
    out = {r["id"]: r["s"] for r in values.groupBy("id").agg((F.sum("shap_value") + F.max("base_value")).alias("s")).collect()}
    assert all(out[i] == pytest.approx(4 + 2 * i - 3 * (i * i % 7)) for i in range(20))
