import datetime as dt

import numpy as np
import pytest

from panelforge.config import Settings
from panelforge.operators import splits
from panelforge.operators.timeseries import (
    acf,
    add_time_series_features,
    calendar_densify,
    forward_fill,
    growth_features,
    pacf,
    rolling_features,
    seasonal_decompose,
)


def frame(spark, values, key="k"):
    rows = [(key, dt.date(2015 + t // 12, t % 12 + 1, 1), v, 1) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ds date, monthly_revenue double, monthly_orders int")


def column(df, name):
    return [r[name] for r in df.orderBy("ds").collect()]


def test_lag_is_the_previous_row(spark, monthly):
    out = add_time_series_features(monthly)
    y, lag = column(out, "monthly_revenue"), column(out, "revenue_lag_1")
    assert lag[0] is None and lag[1:] == y[:-1] and len(out.columns) > len(monthly.columns)


def test_rolling_needs_a_full_window(spark):
    out = rolling_features(frame(spark, [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0]))
    assert column(out, "revenue_rolling_mean_3") == [None, None, None, None, None, None, 5.0]
    assert column(out, "revenue_rolling_std_3")[-1] == pytest.approx(1.0)


def test_growth_on_zero_is_null(spark):
    assert column(growth_features(frame(spark, [0.0, 5.0, 10.0])), "revenue_mom_growth") == [None, None, 1.0]


def test_calendar_lags_count_months(spark):
    df = frame(spark, [1.0, 2.0, 3.0, 4.0]).filter("month(ds) != 2")
    rows = add_time_series_features(df, keys=["k"])
    assert column(rows, "revenue_lag_1") == [None, 1.0, 3.0]
    dense = add_time_series_features(df, keys=["k"], calendar=True)
    assert column(dense, "revenue_lag_1") == [None, 1.0, None, 3.0] and calendar_densify(df, ["k"]).count() == 4


def test_forward_fill_then_back(spark):
    out = forward_fill(frame(spark, [None, 1.0, None, None, 5.0, None]), ["monthly_revenue"], ["k"])
    assert column(out, "monthly_revenue") == [1.0, 1.0, 1.0, 1.0, 5.0, 5.0]


def test_acf_and_pacf(spark):
    y = np.sin(np.arange(40) / 3) + np.random.default_rng(0).normal(0, 0.3, 40)
    d = y - y.mean()
    r = [float((d[k:] * d[: 40 - k]).sum() / (d * d).sum()) for k in range(13)]
    df = frame(spark, [float(v) for v in y])
    assert [x["acf"] for x in acf(df, ["k"]).orderBy("lag").collect()] == pytest.approx(r)
    expected = []
    for k in range(1, 13):  # last coefficient of the Yule-Walker system of order k
        m = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        expected.append(np.linalg.solve(m, np.array(r[1 : k + 1]))[-1])
    assert [x["pacf"] for x in pacf(df, ["k"]).orderBy("lag").collect()] == pytest.approx(expected)


def test_short_series_limit_lags(spark):
    df = frame(spark, [1.0, 3.0, 2.0, 5.0, 4.0, 6.0])
    assert acf(df).count() == 6 and pacf(df).count() == 2


def test_decomposition(spark):
    season = np.array([5, 3, 1, 0, -1, -3, -5, -3, -1, 0, 1, 3], dtype=float)
    y = np.arange(36) * 2.0 + np.tile(season, 3)
    out = seasonal_decompose(frame(spark, [float(v) for v in y]), ["k"])
    trend, resid = column(out, "trend"), column(out, "resid")
    assert trend[:6] == [None] * 6 and trend[-6:] == [None] * 6
    assert trend[6:-6] == pytest.approx(list(np.arange(36)[6:-6] * 2.0))
    assert column(out, "seasonal")[:12] == pytest.approx(list(season - season.mean()))
    assert [v for v in resid if v is not None] == pytest.approx([0.0] * 24, abs=1e-9)
    assert seasonal_decompose(frame(spark, [1.0] * 23)).count() == 0


def test_splits_and_live(spark):
    s = Settings(train_end="2015-03", val_end="2015-05", live_month="2015-06")
    out = splits.split_data(frame(spark, [1.0] * 8), s).orderBy("ds").collect()
    assert [r["split"] for r in out] == ["train"] * 3 + ["val"] * 2 + ["backtest"] + [None] * 2
    assert [r["is_live"] for r in out].index(True) == 5


def test_folds_expand(spark):
    out = splits.time_series_folds(frame(spark, [1.0] * 11), 3)
    sizes = {(r["fold"], r["role"]): r["count"] for r in out.groupBy("fold", "role").count().collect()}
    assert sizes == {(1, "train"): 5, (1, "test"): 2, (2, "train"): 7, (2, "test"): 2, (3, "train"): 9, (3, "test"): 2}
