"""CSV files, the panel that is changed in parts, and tables of sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs, sql
from checks.registry import check
from panelforge.operators import sketches
from panelforge.session import scratch_path
from panelforge.sources.panel_store import PanelStore
from panelforge.sources.quoted_csv import read_quoted_csv
from panelforge.sources.tables import load_tables, parse_dates

W = sql.with_ctes
STATE = inputs.STATE


# ---- CSV ----------------------------------------------------------------


def _write_csv(df, path):
    df.write.option("header", True).option("escape", '"').csv(path)


@check("csv_quoted_load", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_quoted_load(spark, folder):
    """Texts with quotes and line breaks, written as CSV and read back by many tasks."""
    inputs.prepare(spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    path = scratch_path(spark, "documents-csv")
    _write_csv(docs, path)
    return read_quoted_csv(spark, path, "doc_id long, text string, lang string, source string, n_chars long")


@check(
    "load_tables_csv",
    W(sql.TABLES)
    + """SELECT o.order_id, o.order_status, CAST(o.order_purchase_timestamp AS TIMESTAMP) AS order_purchase_timestamp,
        CAST(o.order_delivered_customer_date AS TIMESTAMP) AS order_delivered_customer_date, r.review_score, d.text AS review_comment_message
      FROM o LEFT JOIN r USING (order_id) LEFT JOIN documents d ON d.doc_id = o.order_id""",
    dates="order_purchase_timestamp order_delivered_customer_date",
)
def load_tables_csv(spark, folder):
    """The order tables as raw CSV files with text dates and comments of several lines, loaded and parsed."""
    tables = inputs.tables(spark, folder)
    comments = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("order_id"), F.col("text").alias("review_comment_message"))
    tables["order_reviews"] = tables["order_reviews"].join(comments, "order_id", "left")
    path = scratch_path(spark, "raw")
    schemas = {}
    for name in ("orders", "order_reviews"):
        df = tables[name]
        df = df.select(*[F.col(c).cast("string").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes])
        _write_csv(df, f"{path}/{name}.csv")
        schemas[name] = ", ".join(f"{c} {t}" for c, t in df.dtypes)
    loaded = parse_dates(load_tables(spark, path, {n: f"{n}.csv" for n in schemas}, schemas))
    comments = comments.select("order_id", F.col("review_comment_message").alias("_missing"))
    joined = loaded["orders"].join(loaded["order_reviews"], "order_id", "left").join(comments, "order_id", "left")
    # an order without a review has no comment in the files
    message = F.coalesce("review_comment_message", F.when(F.col("review_score").isNull(), F.col("_missing")))
    return joined.select(
        "order_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date", "review_score",
        message.alias("review_comment_message"),
    )


# ---- panel store ---------------------------------------------------------


@check(
    "panel_store_upsert",
    W(*sql.PANEL)
    + """SELECT customer_state, ds, CASE WHEN ds = DATE '2000-03-01' THEN monthly_revenue * 2 ELSE monthly_revenue END AS monthly_revenue,
      monthly_orders FROM panel""",
    doubles="monthly_revenue",
    dates="ds",
)
def panel_store_upsert(spark, folder):
    """Months arrive one by one, the last of them with a correction of an old one."""
    panel = inputs.panel(spark, folder).select(*STATE, "ds", "monthly_revenue", "monthly_orders")
    cut = F.to_date(F.lit("2001-05-01"))
    store = PanelStore(spark, scratch_path(spark, "store"), STATE).create(panel.filter(F.col("ds") < cut), n_buckets=8)
    months = [r["ds"] for r in panel.filter(F.col("ds") >= cut).select("ds").distinct().orderBy("ds").collect()]
    for month in months:
        store.upsert(panel.filter(F.col("ds") == month))
    old = panel.filter(F.col("ds") == F.to_date(F.lit("2000-03-01")))
    store.upsert(old.withColumn("monthly_revenue", F.col("monthly_revenue") * 2))
    store.vacuum()
    return store.read()


# ---- sketches ------------------------------------------------------------

#: Three standard errors of the id sketches, and the rank error of the value sketches with room for ties.
_IDS_OFF, _RANK_OFF = 0.05, 0.02


@check(
    "sketch_months_from_days",
    """SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS ds, count(*) AS n, sum(value) AS sum_value, avg(value) AS mean_value,
      true AS ids_within, true AS median_within, true AS p90_within FROM events GROUP BY ALL""",
    doubles="sum_value mean_value",
    dates="ds",
    sum_value=2,
)
def sketch_months_from_days(spark, folder):
    """Days are stored as sketches one after the other; months are merged from them and held against the rows."""
    rows = inputs.events(spark, folder)
    days = sketches.sketch_table(rows, ["event_type"], "ts", ["value"], ["user_id"])
    store = PanelStore(spark, scratch_path(spark, "sketches"), ["event_type"])
    late = F.dayofmonth("ds") > 20
    store.create(days.filter(~late), n_buckets=2).upsert(days.filter(late))
    months = sketches.estimates(sketches.merge_sketches(store.read(), ["event_type"], "month"), (0.5, 0.9))
    month = F.to_date(F.date_trunc("month", "ts")).alias("ds")
    marked = rows.join(months.select("event_type", F.col("ds").alias("_ds"), "p50_value", "p90_value"), "event_type")
    marked = marked.filter(F.to_date(F.date_trunc("month", "ts")) == F.col("_ds"))
    share = lambda q, below: F.avg((F.col("value") < F.col(q)).cast("int") if below else (F.col("value") <= F.col(q)).cast("int"))
    exact = marked.groupBy("event_type", month).agg(
        F.count_distinct("user_id").alias("ids"),
        *[share(f"{p}_value", below).alias(f"{p}_{below}") for p in ("p50", "p90") for below in (True, False)],
    )

    def within(p, target):
        return (F.col(f"{p}_True") <= target + _RANK_OFF) & (F.col(f"{p}_False") >= target - _RANK_OFF)

    return months.join(exact, ["event_type", "ds"]).select(
        "event_type", "ds", "n", "sum_value", "mean_value",
        (F.abs(F.col("approx_user_id") - F.col("ids")) <= _IDS_OFF * F.col("ids") + 1).alias("ids_within"),
        within("p50", 0.5).alias("median_within"), within("p90", 0.9).alias("p90_within"),
    )


_BINS = 5


@check(
    "sketch_drift_monitor",
    """WITH d AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, CAST(o_totalprice AS DOUBLE) AS v, o_orderdate < TIMESTAMP '2000-07-01' AS base FROM orders),
    e AS (SELECT min(v) AS lo, max(v) AS hi FROM d WHERE base),
    b AS (SELECT *, CASE WHEN v < lo - 1e-9 OR v > hi + 1e-9 THEN NULL ELSE least(4, greatest(0, CAST(floor((v - lo) / (hi - lo) * 5) AS INTEGER))) END AS bin FROM d, e),
    g AS (SELECT unnest(range(5)) AS bin), bc AS (SELECT bin, count(*) AS k FROM b WHERE base GROUP BY 1),
    bs AS (SELECT g.bin, coalesce(k, 0) / (SELECT count(*) FROM b WHERE base) + 1e-6 AS q FROM g LEFT JOIN bc USING (bin)),
    m AS (SELECT ds, count(*) AS n FROM b WHERE NOT base GROUP BY 1),
    cc AS (SELECT ds, bin, count(*) AS k FROM b WHERE NOT base GROUP BY ALL),
    cs AS (SELECT m.ds, bs.bin, q, coalesce(k, 0) / n + 1e-6 AS p FROM m CROSS JOIN bs LEFT JOIN cc ON cc.ds = m.ds AND cc.bin = bs.bin)
    SELECT ds, m.n, sum((p - q) * ln(p / q)) > 0.25 AS drifted FROM cs JOIN m USING (ds) GROUP BY ALL HAVING m.n >= 100""",
    dates="ds",
)
def sketch_drift_monitor(spark, folder):
    """Order values of later months against the training period, from day sketches only."""
    orders = inputs.read(spark, folder, "orders")
    days = sketches.sketch_table(orders, [], "o_orderdate", ["o_totalprice"])
    drift = sketches.sketch_drift(days, "o_totalprice", "2000-06-30", bins=_BINS)
    # in a month of few orders an empty bin alone passes the threshold
    return drift.filter(F.col("n") >= 100).select("ds", "n", "drifted")
