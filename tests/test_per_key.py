import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators.per_key import PerKeyRidge, cross_products, fit_linear, moments


def ridge(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    xc = x - mx
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - my))
    return my - mx @ beta, beta


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for k in range(40):
        n = int(rng.integers(6, 30))
        x = rng.normal(1e6, 1e4, (n, 4)) * [1, 1e-3, 1e-6, 1]
        y = x @ [0.5 * k, 3.0, -200.0 * k, 0.1] + rng.normal(0, 50, n) + 1e7
        out += [(f"k{k}", k % 3, t, *map(float, r), float(v)) for t, (r, v) in enumerate(zip(x, y))]
    return out


NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, part int, t int, a double, b double, c double, d double, y double").repartition(7)


def test_products_are_the_plain_sums(spark, frame, rows):
    got = {r["key"]: (r["n"], np.array(r["sums"])) for r in cross_products(frame, ["key"], [*NAMES, "y"]).collect()}
    for k in ("k0", "k39"):
        z = np.array([r[3:] for r in rows if r[0] == k])
        n, sums = got[k]
        assert n == len(z)
        mean, square = moments(sums[None], np.array([float(n)]), 5)
        assert np.allclose(mean[0], z.mean(0))
        scale = np.sqrt(np.outer((z**2).sum(0), (z**2).sum(0)))
        assert np.all(np.abs(square[0] - (z - z.mean(0)).T @ (z - z.mean(0))) < 1e-12 * scale)


@pytest.mark.parametrize("alpha", [0.0, 1.0, 1e6])
def test_every_key_has_its_closed_form(spark, frame, rows, alpha):
    got = {r["key"]: r for r in fit_linear(frame, ["key"], NAMES, "y", alpha).collect()}
    assert len(got) == 40
    for k, r in got.items():
        z = np.array([v[3:] for v in rows if v[0] == k])
        x, y = z[:, :4], z[:, 4]
        _, beta = ridge(x, y, alpha)
        resid = y - r["intercept"] - x @ np.array(r["coefficients"])
        assert r["resid_std"] == pytest.approx(resid.std(ddof=1), rel=1e-4)
        if alpha:
            assert np.allclose(r["coefficients"], beta, rtol=1e-5, atol=1e-6)
        else:  # the shortest of the best: no error below it
            best = np.linalg.lstsq(np.c_[np.ones(len(x)), (x - x.mean(0)) / x.std(0)], y, rcond=None)
            assert resid @ resid <= (best[1][0] if len(best[1]) else 0.0) * (1 + 1e-6) + 1e-2


def test_short_series_take_the_pooled_model(spark, frame, rows):
    got = {r["key"]: r for r in fit_linear(frame, ["key", "part"], NAMES, "y", 1.0, 15, ["part"]).collect()}
    sizes = {k: sum(r[0] == k for r in rows) for k in got}
    for k, r in got.items():
        part = int(k[1:]) % 3
        z = np.array([v[3:] for v in rows if (v[1] == part if sizes[k] < 15 else v[0] == k)])
        assert np.allclose(r["coefficients"], ridge(z[:, :4], z[:, 4], 1.0)[1], rtol=1e-4, atol=1e-5)


def test_odd_keys(spark):
    rows = [("one", 1.0, 5.0), ("flat", 2.0, 7.0), ("flat", 2.0, 9.0), (None, 1.0, 1.0), (None, 2.0, 3.0), ("gap", None, 4.0), ("gap", 1.0, None)]
    df = spark.createDataFrame(rows, "key string, x double, y double")
    for alpha in (0.0, 1.0):
        got = {r["key"]: r for r in fit_linear(df, ["key"], ["x"], "y", alpha).collect()}
        assert got["one"]["coefficients"] == [0.0] and got["one"]["intercept"] == 5.0 and got["one"]["resid_std"] is None
        assert got["flat"]["coefficients"] == [0.0] and got["flat"]["resid_std"] == pytest.approx(np.sqrt(2))
        assert got["gap"]["n"] == 1 and got[None]["n"] == 2
    assert got[None]["coefficients"][0] == pytest.approx(1.0 / 1.5)
    assert fit_linear(df.limit(0), ["key"], ["x"], "y").count() == 0


def test_forecaster_fits_predicts_and_reloads(spark, monthly, tmp_path):
    names = ["monthly_orders", "avg_ticket"]
    panel = monthly.crossJoin(spark.createDataFrame([("n", 1.0), ("s", 3.0)], "region string, f double")).withColumn(
        "monthly_revenue", F.col("monthly_revenue") * F.col("f")
    )
    model = PerKeyRidge(alpha=0.5).fit(panel, names, keys=["region"])
    out = {(r["region"], r["horizon"]): r for r in model.predict_with_intervals(panel, ["region"]).collect()}
    assert len(out) == 6
    for h in (1, 2, 3):
        assert out["s", h]["yhat"] == pytest.approx(3 * out["n", h]["yhat"])
        assert out["s", h]["yhat_lower"] < out["s", h]["yhat"] < out["s", h]["yhat_upper"]
    model.save(spark, str(tmp_path / "m"))
    again = PerKeyRidge.load(spark, str(tmp_path / "m"))
    assert {(r["region"], r["horizon"]): r["yhat"] for r in again.predict(panel, ["region"]).collect()} == {k: r["yhat"] for k, r in out.items()}
    assert again.score(panel, 2).count() == 48 and again.features == names
    assert {r["feature"] for r in again.importance().collect()} == set(names)
    with pytest.raises(ValueError):
        again.score(panel, 4)
    # no keys: the same equations as for one key
    whole = PerKeyRidge(alpha=0.5).fit(monthly, names).predict(monthly).collect()
    assert [r["yhat"] for r in sorted(whole, key=lambda r: r["horizon"])] == pytest.approx([out["n", h]["yhat"] for h in (1, 2, 3)])


def test_one_shuffle_between_rows_and_equations(frame):
    plan = fit_linear(frame, ["key"], NAMES, "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
