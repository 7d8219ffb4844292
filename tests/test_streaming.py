import datetime as dt

from pyspark.sql import functions as F

from panelforge.operators.timeseries import add_time_series_features
from panelforge.session import scratch_path
from panelforge.streaming import live


def rows(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def source(spark, days):
    data = [(i, dt.datetime(2024, 1, d, h), f"k{i % 2}", float(i)) for i, (d, h) in enumerate((d, h) for d in days for h in (1, 13, 23))]
    return spark.createDataFrame(data, "id int, ts timestamp, kind string, value double")


def test_stream_equals_batch_over_several_files(spark):
    path = scratch_path(spark, "in")
    batch = source(spark, [1, 2, 3, 5])
    for d in (1, 2, 3, 5):
        batch.filter(F.dayofmonth("ts") == d).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "out")
    live.run_to_table(live.stream_period_aggregate(stream, "ts", ["kind"], "value", "id"), out, "complete")
    expected = batch.groupBy("kind", F.to_date("ts").alias("ds")).agg(F.sum("value").alias("revenue"), F.count("*").alias("orders"))
    columns = ["kind", "ds", "revenue", "orders"]
    assert rows(spark.read.parquet(out), columns) == rows(expected, columns)


def test_repeats_are_dropped_across_files(spark):
    path = scratch_path(spark, "in")
    batch = source(spark, [1, 2])
    for _ in range(2):
        batch.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "out")
    live.run_to_table(live.stream_dedup_events(stream, "ts", ["id"], "10 days"), out)
    assert rows(spark.read.parquet(out), ["id", "value"]) == rows(batch, ["id", "value"])


def test_refresh_upserts_and_replays(spark):
    months = [(k, dt.date(2020 + m // 12, m % 12 + 1, 1), 100.0 * m + len(k), m) for k in ("a", "bb") for m in range(30)]
    months = [r for r in months if r[1].month != 7]  # gaps: lags count rows
    panel = spark.createDataFrame(months, "k string, ds date, monthly_revenue double, monthly_orders int")
    path = scratch_path(spark, "refresh")
    cut = dt.date(2022, 4, 1)
    refresher = live.PanelRefresher(spark, path, ["k"]).start_from(panel.filter(F.col("ds") < cut))
    newer = panel.filter((F.col("ds") >= cut) & (F.col("k") == "a"))
    corrected = panel.filter((F.col("ds") == dt.date(2022, 3, 1)) & (F.col("k") == "a")).withColumn("monthly_revenue", F.lit(1.0))
    arriving = newer.unionByName(corrected)
    refresher(arriving, 0)
    first = rows(refresher.current(), panel.columns)
    refresher(arriving, 0)
    assert rows(refresher.current(), panel.columns) == first
    assert len(first) == panel.count() - panel.filter((F.col("ds") >= cut) & (F.col("k") == "bb")).count()
    whole = add_time_series_features(refresher.current(), keys=["k"]).filter((F.col("k") == "a") & (F.col("ds") >= dt.date(2022, 3, 1)))
    columns = ["k", "ds", "revenue_lag_1", "revenue_lag_12", "revenue_rolling_mean_6"]
    assert rows(refresher.features(), columns) == rows(whole, columns)


def test_a_second_drain_adds_what_arrived(spark):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    batch = source(spark, [1, 2, 3])
    for k in (1, 2):
        batch.filter(F.dayofmonth("ts") <= k).filter(F.dayofmonth("ts") > k - 1).coalesce(1).write.mode("append").parquet(path)
        live.run_to_table(spark.readStream.schema(batch.schema).parquet(path), out)
    expected = batch.filter(F.dayofmonth("ts") <= 2)
    assert rows(spark.read.parquet(out), ["id", "value"]) == rows(expected, ["id", "value"])


def test_update_mode_keeps_one_row_per_key(spark):
    path, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    data = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 1), 1.0), ("a", dt.datetime(2024, 1, 1, 2), 2.0)], "k string, ts timestamp, value double")
    for v in (1.0, 2.0):
        data.filter(F.col("value") == v).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(path)
    live.run_to_table(live.stream_period_aggregate(stream, "ts", ["k"], "value"), out, "update")
    assert rows(live.read_updates(spark, out, ["k", "ds"]), ["k", "revenue", "orders"]) == [("a", 3.0, 2)]


def test_corrections_reach_later_periods(spark):
    from panelforge.config import Settings

    settings = Settings(lag_periods=(1, 24))
    panel = spark.createDataFrame(
        [("a", dt.date(2018 + m // 12, m % 12 + 1, 1), 100.0 + m * m, m) for m in range(60)], "k string, ds date, monthly_revenue double, monthly_orders int"
    )
    path = scratch_path(spark, "refresh")
    refresher = live.PanelRefresher(spark, path, ["k"], settings, arrival="seen").start_from(panel)
    month = panel.filter(F.col("ds") == dt.date(2019, 6, 1))
    twice = month.withColumn("monthly_revenue", F.lit(9.0)).withColumn("seen", F.lit(2)).unionByName(
        month.withColumn("monthly_revenue", F.lit(5.0)).withColumn("seen", F.lit(1))
    )
    refresher(twice, 0)
    assert refresher.current().count() == 60
    whole = add_time_series_features(refresher.current(), settings, ["k"])
    assert whole.filter("monthly_revenue = 9.0").count() == 1
    got = refresher.features()
    assert got.count() == 25
    columns = ["ds", "revenue_lag_1", "revenue_lag_24", "revenue_yoy_growth", "revenue_rolling_mean_6"]
    assert rows(got, columns) == rows(whole.join(got.select("ds"), "ds", "left_semi"), columns)
