"""Streaming queries, drained with the available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.queries.data import SERIES_DOUBLES
from checks.registry import check
from panelforge.session import scratch_path
from panelforge.streaming import live
from panelforge.streaming.period_features import feature_names, stream_period_features

W = sql.with_ctes


def _stream(spark, folder, name):
    """File stream over one table of the folder."""
    inputs.prepare(spark)
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _events(spark, folder):
    # watermarks need a timestamp with time zone
    return _stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@check(
    "stream_period_aggregate",
    """SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS ds, sum(value) AS revenue, count(*) AS orders, avg(value) AS avg_ticket,
      true AS customers_within FROM events GROUP BY ALL""",
    doubles="revenue avg_ticket",
    dates="ds",
    revenue=2,
)
def stream_period_aggregate(spark, folder):
    path = scratch_path(spark, "live")
    totals = live.stream_period_aggregate(_events(spark, folder), "ts", ["event_type"], "value", "user_id")
    live.run_to_table(totals, path, "complete")
    exact = inputs.events(spark, folder).groupBy("event_type", F.to_date("ts").alias("ds")).agg(F.count_distinct("user_id").alias("_n"))
    # the sketch's standard error is 5 %; some hundred of them are held against three of it
    off = F.abs(F.col("approx_customers") - F.col("_n")) <= 0.15 * F.col("_n") + 1
    totals = spark.read.parquet(path).join(exact, ["event_type", "ds"])
    return totals.withColumn("customers_within", off).drop("approx_customers", "_n")


@check(
    "stream_month_aggregate",
    """SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, sum(o_totalprice) AS revenue, count(*) AS orders,
      avg(o_totalprice) AS avg_ticket FROM orders GROUP BY ALL""",
    doubles="revenue avg_ticket",
    dates="ds",
    revenue=2,
)
def stream_month_aggregate(spark, folder):
    stream = _stream(spark, folder, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    path = scratch_path(spark, "live")
    totals = live.stream_period_aggregate(stream, "o_orderdate", ["o_orderstatus"], "o_totalprice", period="month")
    live.run_to_table(totals, path, "complete")
    return spark.read.parquet(path)


@check(
    "stream_dedup_events",
    "SELECT event_id, event_type, value FROM events",
    doubles="value",
)
def stream_dedup_events(spark, folder):
    # every event arrives twice
    twice = _events(spark, folder).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    path = scratch_path(spark, "dedup")
    live.run_to_table(live.stream_dedup_events(twice, "ts", ["event_id"]), path)
    return spark.read.parquet(path).select("event_id", "event_type", "value")


_OPEN = "62 days"


@check(
    "stream_period_features",
    W(*sql.SERIES)
    + f"""SELECT customer_state, ds, monthly_revenue, CAST(monthly_orders AS DOUBLE) AS monthly_orders,
      {", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c.startswith("orders") else c for c in feature_names(inputs.SETTINGS))}
      FROM s WHERE ds <= (SELECT max(ds) FROM s) - INTERVAL {_OPEN}""",
    doubles="monthly_revenue monthly_orders " + " ".join(feature_names(inputs.SETTINGS)),
    dates="ds",
)
def stream_period_features_query(spark, folder):
    """Panel rows arrive in four parts; the last month of each is wrong at first and corrected with the next part."""
    panel = inputs.panel(spark, folder).select("customer_state", "ds", "monthly_revenue", "monthly_orders")
    path = scratch_path(spark, "periods")
    cuts = ["1994-01-01", "1996-12-01", "1998-11-01", "2000-10-01", "2002-01-01"]
    for low, high in zip(cuts, cuts[1:]):
        day = F.to_date(F.lit(high))
        fresh = panel.filter((F.col("ds") > F.to_date(F.lit(low))) & (F.col("ds") <= day))
        wrong = F.when(F.col("ds") == day, F.col("monthly_revenue") / 2).otherwise(F.col("monthly_revenue"))
        part = fresh.withColumns({"monthly_revenue": wrong, "version": F.lit(0)})
        corrected = panel.filter(F.col("ds") == F.to_date(F.lit(low))).withColumn("version", F.lit(1))
        part.unionByName(corrected).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch_path(spark, "period-features")
    live.run_to_table(stream_period_features(stream, inputs.STATE, inputs.SETTINGS, _OPEN, "version"), out)
    names = feature_names(inputs.SETTINGS)
    return spark.read.parquet(out).select("customer_state", "ds", "monthly_revenue", "monthly_orders", *names)


@check(
    "stream_panel_refresh",
    W(*sql.SERIES) + "SELECT * FROM s WHERE ds >= DATE '2001-04-01'",
    doubles=SERIES_DOUBLES,
    dates="ds",
)
def stream_panel_refresh(spark, folder):
    """The last months arrive as a stream of panel rows; their features equal the batch ones."""
    panel = inputs.panel(spark, folder)
    path = scratch_path(spark, "refresh")
    cut = F.to_date(F.lit("2001-04-01"))
    refresher = live.PanelRefresher(spark, path, inputs.STATE, inputs.SETTINGS)
    refresher.start_from(panel.filter(F.col("ds") < cut))
    panel.filter(F.col("ds") >= cut).coalesce(1).write.parquet(f"{path}-in")
    stream = spark.readStream.schema(panel.schema).parquet(f"{path}-in")
    live.stream_panel_refresh(stream, refresher)
    return refresher.features()


def _in_parts(spark, folder, name, column):
    """The table as three files that arrive one after the other, the first of them before the rest."""
    inputs.prepare(spark)
    path = scratch_path(spark, "arriving")
    rows = spark.read.parquet(f"{folder}/{name}.parquet").withColumn("_part", F.pmod(F.xxhash64(column), F.lit(3)))
    parts = [rows.filter(F.col("_part") == k).drop("_part").coalesce(1) for k in range(3)]
    parts[0].write.parquet(path)
    return path, parts[1:], lambda: spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


@check(
    "stream_two_drains",
    "SELECT event_id, event_type, value FROM events",
    doubles="value",
)
def stream_two_drains(spark, folder):
    """A second drain adds what has arrived since the first one."""
    path, later, stream = _in_parts(spark, folder, "events", "event_id")
    out = scratch_path(spark, "drained")
    live.run_to_table(stream().select("event_id", "event_type", "value"), out)
    for part in later:
        part.write.mode("append").parquet(path)
    live.run_to_table(stream().select("event_id", "event_type", "value"), out)
    return spark.read.parquet(out)


@check(
    "stream_update_mode",
    """SELECT o_orderstatus, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, sum(o_totalprice) AS revenue, count(*) AS orders,
      avg(o_totalprice) AS avg_ticket FROM orders GROUP BY ALL""",
    doubles="revenue avg_ticket",
    dates="ds",
    revenue=2,
)
def stream_update_mode(spark, folder):
    """Totals that several micro-batches correct; one row per status and month is left."""
    path, later, stream = _in_parts(spark, folder, "orders", "o_orderkey")
    out = scratch_path(spark, "updated")
    for part in [None, *later]:
        if part is not None:
            part.write.mode("append").parquet(path)
        marked = stream().withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
        totals = live.stream_period_aggregate(marked, "o_orderdate", ["o_orderstatus"], "o_totalprice", period="month", delay="4000 days")
        live.run_to_table(totals, out, "update")
    return live.read_updates(spark, out, ["o_orderstatus", "ds"])


@check(
    "stream_panel_corrections",
    W(*sql.SERIES) + "SELECT * FROM s WHERE ds >= DATE '2000-02-01'",
    doubles=SERIES_DOUBLES,
    dates="ds",
)
def stream_panel_corrections(spark, folder):
    """Wrong early values are corrected by later batches; all features that they reach equal the batch ones."""
    panel = inputs.panel(spark, folder)
    path = scratch_path(spark, "refresh")
    first = F.to_date(F.lit("2000-02-01"))
    refresher = live.PanelRefresher(spark, path, inputs.STATE, inputs.SETTINGS, arrival="arrival")
    refresher.start_from(panel.filter(F.col("ds") < first))
    late = panel.filter(F.col("ds") >= first).withColumn("arrival", F.lit(2))
    wrong = late.withColumn("monthly_revenue", F.col("monthly_revenue") * 3).withColumn("arrival", F.lit(1))
    middle = F.to_date(F.lit("2000-06-01"))
    # the first batch has a wrong month next to its correction, and another month only wrong
    refresher(late.filter(F.col("ds") != middle).unionByName(wrong.filter(F.col("ds") <= middle)), 0)
    refresher(late.filter(F.col("ds") == middle), 1)
    return refresher.features()
