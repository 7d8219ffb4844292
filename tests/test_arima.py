import datetime as dt

import numpy as np
import pytest

from panelforge.operators.arima import SeasonalArima, difference_weights

SCHEMA = "key string, ds date, monthly_revenue double"
START = dt.date(1900, 1, 1)


def simulate(seed, n, ar=(), ma=(), mean=0.0, far=0.0):
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1, n + 100)
    z = np.zeros(n + 100)
    for t in range(12, n + 100):
        z[t] = e[t] + sum(a * z[t - i - 1] for i, a in enumerate(ar)) + sum(b * e[t - i - 1] for i, b in enumerate(ma)) + far * z[t - 12]
    return z[100:] + mean


def rows(key, z):
    return [(key, START + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(z)]


def test_known_coefficients_of_many_series(spark):
    data = []
    for k in range(10):
        data += rows(f"ar{k}", simulate(k, 1500, ar=(0.6, -0.3), mean=50))
        data += rows(f"ma{k}", simulate(100 + k, 1500, ar=(0.5,), ma=(0.4,)))
    frame = spark.createDataFrame(data, SCHEMA).repartition(5)
    two = SeasonalArima(order=(2, 0, 0, 0), seasonal_d=0).fit(frame, ["key"])
    got = {r["key"]: r for r in two.models.collect()}
    assert len(got) == 20
    ar = np.array([r["coefficients"] for k, r in got.items() if k.startswith("ar")])
    assert np.allclose(ar.mean(axis=0), [0.6, -0.3], atol=0.03) and np.allclose(ar, [0.6, -0.3], atol=0.12)
    assert all(abs(r["sigma"] - 1) < 0.1 for k, r in got.items() if k.startswith("ar"))
    one = SeasonalArima(order=(1, 1, 0, 0), seasonal_d=0, long_lags=10).fit(frame, ["key"])
    ma = np.array([r["coefficients"] for r in one.models.collect() if r["key"].startswith("ma")])
    assert np.allclose(ma.mean(axis=0), [0.5, 0.4], atol=0.04)


def test_order_is_the_one_of_least_criterion(spark):
    data = rows("a", simulate(3, 800, ar=(0.6, -0.3))) + rows("s", simulate(4, 800, far=0.7)) + rows("w", simulate(5, 800))
    model = SeasonalArima(most=(3, 0, 1, 0), seasonal_d=0).fit(spark.createDataFrame(data, SCHEMA), ["key"])
    got = {r["key"]: r for r in model.models.collect()}
    for key, z in (("a", simulate(3, 800, ar=(0.6, -0.3))), ("s", simulate(4, 800, far=0.7)), ("w", simulate(5, 800))):
        best = None
        for p in range(4):
            for far in range(2):
                lags = [*range(1, p + 1), *[12] * far]
                x = np.column_stack([np.ones(788), *[z[12 - lag : 800 - lag] for lag in lags]])
                beta, *_ = np.linalg.lstsq(x, z[12:], rcond=None)
                aic = 788 * np.log(((z[12:] - x @ beta) ** 2).mean()) + 2 * (len(lags) + 2)
                if best is None or aic < best[0]:
                    best = aic, p, far, beta
        aic, p, far, beta = best
        r = got[key]
        assert (r["n"], r["p"], r["q"], r["seasonal_p"], r["seasonal_q"]) == (788, p, 0, far, 0)
        assert r["aic"] == pytest.approx(aic) and r["intercept"] == pytest.approx(beta[0], abs=1e-8)
        assert np.allclose([c for c in r["coefficients"] if c], beta[1:])
    assert got["s"]["seasonal_p"] == 1 and got["a"]["p"] >= 2


def test_forecast_goes_on_by_hand(spark):
    rng = np.random.default_rng(2)
    y = np.cumsum(1 + rng.normal(0, 1, 60)) + 10 * np.sin(np.arange(60) * np.pi / 6)
    model = SeasonalArima(order=(1, 0, 0, 0), d=1, seasonal_d=1).fit(spark.createDataFrame(rows("k", y), SCHEMA), ["key"])
    z = (y[1:] - y[:-1])[12:] - (y[1:] - y[:-1])[:-12]
    b, a = np.polyfit(z[:-1], z[1:], 1)
    sigma = np.sqrt(((z[1:] - a - b * z[:-1]) ** 2).mean())
    long, last = list(y), z[-1]
    got = sorted(model.forecast(14, ["key"]).collect(), key=lambda r: r["horizon"])
    assert [r["horizon"] for r in got] == list(range(1, 15))
    # weights of 1 / ((1 - b B)(1 - B)(1 - B^12))
    psi = np.cumsum(b ** np.arange(14))
    psi[12:] += psi[:2]
    for h, r in enumerate(got):
        last = a + b * last
        long.append(last + long[-1] + long[-12] - long[-13])
        margin = 1.959963984540054 * sigma * np.sqrt((psi[: h + 1] ** 2).sum())
        assert r["ds"] == START + dt.timedelta(days=59)
        assert r["yhat"] == pytest.approx(long[-1]) and r["yhat_upper"] - r["yhat"] == pytest.approx(margin)


def test_one_series_without_keys_and_moving_average_forecast(spark):
    z = simulate(9, 3000, ma=(0.8,), mean=5.0)
    frame = spark.createDataFrame(rows("k", z), SCHEMA).drop("key")
    got = SeasonalArima(order=(0, 1, 0, 0), seasonal_d=0, long_lags=12).fit(frame).forecast(3)
    by = {r["horizon"]: r for r in got.collect()}
    # a shock is forgotten after one row
    assert by[2]["yhat"] == pytest.approx(by[3]["yhat"]) and by[2]["yhat"] == pytest.approx(5.0, abs=0.2)
    assert by[1]["yhat_upper"] - by[1]["yhat"] == pytest.approx(1.96, abs=0.1)
    assert by[2]["yhat_upper"] - by[2]["yhat"] == pytest.approx(1.96 * np.sqrt(1.64), abs=0.15)


def test_short_flat_and_broken_series(spark):
    data = rows("short", [1.0, 2.0]) + rows("flat", [7.0] * 40)
    data += rows("gap", [*simulate(1, 50), None]) + rows("nan", [float("nan")] * 20)
    model = SeasonalArima(most=(1, 1, 0, 0), seasonal_d=0, long_lags=2).fit(spark.createDataFrame(data, SCHEMA), ["key"])
    got = {(r["key"], r["horizon"]): r for r in model.forecast(2, ["key"]).collect()}
    assert {k for k, _ in got} <= {"flat", "gap"}
    assert got["flat", 2]["yhat"] == pytest.approx(7.0) and got["flat", 2]["yhat_upper"] == pytest.approx(7.0)
    empty = SeasonalArima().fit(spark.createDataFrame([], SCHEMA), ["key"])
    assert empty.models.count() == 0 and empty.forecast(2, ["key"]).count() == 0


def test_weights_of_differences():
    assert difference_weights(0, 0, 12).tolist() == [1.0]
    assert difference_weights(1, 1, 2).tolist() == [1.0, -1.0, -1.0, 1.0]
