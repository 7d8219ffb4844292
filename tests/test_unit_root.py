import numpy as np
import pytest

from panelforge.operators.unit_root import critical_value, unit_root_test


def plain(y, max_lags):
    """Statistic and order by one least-squares fit per order, on the rows that the largest order has."""
    d = np.diff(y)
    at = np.arange(max_lags, len(d))
    best = None
    for lags in range(max_lags + 1):
        x = np.column_stack([np.ones(len(at)), y[at], *[d[at - i] for i in range(1, lags + 1)]])
        beta, *_ = np.linalg.lstsq(x, d[at], rcond=None)
        left = d[at] - x @ beta
        n, k = x.shape
        error = np.sqrt(left @ left / (n - k) * np.linalg.inv(x.T @ x)[1, 1])
        criterion = n * np.log(left @ left / n) + 2 * k
        if best is None or criterion < best[0]:
            best = (criterion, lags, beta[1] / error, n)
    return best[1:]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(11)
    out = {}
    for i in range(12):
        e = rng.normal(size=150)
        y = np.zeros(150)
        for t in range(2, 150):
            y[t] = y[t - 1] + 0.5 * (y[t - 1] - y[t - 2]) + e[t] if i % 2 else 0.3 * y[t - 1] + e[t]
        out[f"k{i}"] = 1e6 + 1e4 * y
    return out


def test_same_as_a_fit_per_series(spark, series):
    import datetime as dt

    rows = [(k, dt.date(1990, 1, 1) + dt.timedelta(days=31 * t), float(v)) for k, y in series.items() for t, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, ds date, monthly_revenue double").repartition(5)
    got = {r["k"]: r for r in unit_root_test(df, ["k"], max_lags=3).collect()}
    for k, y in series.items():
        lags, statistic, n = plain(y, 3)
        assert (got[k]["lags"], got[k]["n"]) == (lags, n) and got[k]["statistic"] == pytest.approx(statistic, rel=1e-6)
        assert got[k]["stationary"] == (statistic < critical_value(0.05, np.array(float(n))))
    assert all(got[f"k{i}"]["stationary"] for i in range(0, 12, 2))
    assert sum(got[f"k{i}"]["stationary"] for i in range(1, 12, 2)) <= 1
    whole = unit_root_test(df.filter("k = 'k0'").drop("k"), max_lags=3).first()
    assert whole["statistic"] == pytest.approx(got["k0"]["statistic"])


def test_critical_values_of_long_series():
    n = np.array(1e9)
    assert [round(float(critical_value(level, n)), 2) for level in (0.01, 0.05, 0.10)] == [-3.43, -2.86, -2.57]


def test_short_constant_and_broken_series(spark):
    import datetime as dt

    day = lambda t: dt.date(2020, 1, 1) + dt.timedelta(days=t)
    rows = [("short", day(0), 1.0), ("short", day(1), 2.0)] + [("flat", day(t), 5.0) for t in range(20)]
    rows += [("gap", day(t), None if t % 7 == 3 else float(t % 5)) for t in range(40)] + [("line", day(t), 2.0 * t) for t in range(20)]
    df = spark.createDataFrame(rows, "k string, ds date, monthly_revenue double")
    got = {r["k"]: r for r in unit_root_test(df, ["k"], max_lags=1).collect()}
    assert "short" not in got
    for k in ("flat", "line"):
        assert got[k]["statistic"] is None and got[k]["stationary"] is None and got[k]["lags"] is None and got[k]["p_value"] is None
    assert got["gap"]["statistic"] is not None and got["gap"]["n"] < 30
    assert unit_root_test(df.limit(0), ["k"]).count() == 0
