import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.operators.timeseries import add_time_series_features
from panelforge.session import scratch_path
from panelforge.streaming.live import run_to_table
from panelforge.streaming.period_features import feature_names, features_at, stream_period_features

SCHEMA = "k string, ds date, monthly_revenue double, monthly_orders double, v int"
SETTINGS = Settings(lag_periods=(1, 3), rolling_windows=(3,))


def month(t):
    return dt.date(2015 + t // 12, t % 12 + 1, 1)


def rows_of(df, names):
    return {(r["k"], r["ds"]): [None if r[c] is None else round(r[c], 6) for c in names] for r in df.collect()}


def test_late_corrected_and_dropped_rows(spark):
    """Two open months; what comes later than that is dropped, what comes in time replaces."""
    path, checkpoint = scratch_path(spark, "in"), scratch_path(spark, "state")
    y = lambda k, t: float(1000 + 37 * t * (k == "a") + 11 * (t % 5))
    parts = [
        [("a", month(t), y("a", t), float(t), 0) for t in range(14)] + [("b", month(t), None if t == 5 else y("b", t), 1.0, 0) for t in (0, 5, 6, 13)],
        [("a", month(13), -5.0, 0.5, 1), ("a", month(13), 77.0, 0.5, 0), ("a", month(2), 99.0, 9.0, 9), (None, month(14), 3.0, 3.0, 0)]
        + [("a", month(t), y("a", t), float(t), 0) for t in range(14, 40)],
        [("a", month(45), 1.0, 1.0, 0), ("b", month(44), 2.0, 2.0, 0), ("b", month(45), 3.0, 3.0, 0)],
    ]
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "out")
    run_to_table(stream_period_features(stream, ["k"], SETTINGS, "59 days", "v"), out, checkpoint=checkpoint)
    kept = [r for part in parts for r in part if (r[0], r[1], r[4]) != ("a", month(2), 9) and not (r[1] == month(13) and r[0] == "a" and r[4] == 0)]
    batch = add_time_series_features(spark.createDataFrame(kept, SCHEMA), SETTINGS, ["k"]).filter(F.col("ds") <= month(43))
    names = ["monthly_revenue", "monthly_orders", *feature_names(SETTINGS), "month_sin"]
    got = spark.read.parquet(out)
    names = [c for c in names if c in got.columns]
    assert rows_of(got, names) == rows_of(batch, names) and got.count() == batch.count()
    # a second drain goes on from the state
    spark.createDataFrame([("a", month(50), 4.0, 4.0, 0)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    run_to_table(stream_period_features(stream, ["k"], SETTINGS, "59 days", "v"), out, checkpoint=checkpoint)
    new = {r["ds"]: r for r in spark.read.parquet(out).filter("k = 'a'").collect()}
    assert new[month(45)]["revenue_lag_1"] == y("a", 39) and month(50) not in new
    # of a series of 42 periods the state holds what a year's look back and the open months need
    state = spark.read.format("statestore").option("stateVarName", "periods").load(checkpoint)
    held = {r["key"]["k"]: r["n"] for r in state.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert held["a"] <= 12 + 1 and held["b"] <= 12 + 2


def test_features_of_one_period():
    y, orders = [1.0, 2.0, None, 4.0, 0.0, 8.0], [1.0] * 6
    got = features_at(y, orders, 5, SETTINGS)
    assert got["revenue_lag_1"] == 0.0 and got["revenue_lag_3"] is None and got["revenue_mom_growth"] is None
    assert got["revenue_rolling_mean_3"] is None and got["revenue_yoy_growth"] is None
    assert features_at([3.0, 6.0], [1.0, 2.0], 1, SETTINGS)["revenue_mom_growth"] == pytest.approx(1.0)
