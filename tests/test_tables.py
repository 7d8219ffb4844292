import datetime as dt

import pytest

from panelforge.config import RAW_FILES
from panelforge.session import scratch_path
from panelforge.sources import store, tables


@pytest.fixture()
def raw(tmp_path):
    (tmp_path / "orders.csv").write_text(
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,"
        "order_delivered_customer_date,order_estimated_delivery_date\n"
        "a,c1,delivered,2018-01-05 10:00:00,2018-01-05 11:00:00,2018-01-06 00:00:00,2018-01-09 09:00:00,2018-01-20 00:00:00\n"
        "b,c2,canceled,2018-03-05 10:00:00,not a date,,,2018-04-20 00:00:00\n"
        "b,c2,canceled,2018-03-05 10:00:00,not a date,,,2018-04-20 00:00:00\n"
    )
    (tmp_path / "order_reviews.csv").write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
        'r1,a,5,"good, very","two\nlines ""quoted""",2018-01-10,2018-01-11\n'
    )
    return str(tmp_path)


def test_load_skips_missing_files_and_parses_dates(spark, raw):
    loaded = tables.load_tables(spark, raw)
    assert set(loaded) == {"orders", "order_reviews"} and set(loaded) < set(RAW_FILES)
    review = loaded["order_reviews"].first()
    assert review["review_score"] == 5 and review["review_comment_message"] == 'two\nlines "quoted"'
    orders = tables.parse_dates(loaded)["orders"]
    rows = {r["order_id"]: r for r in orders.collect()}
    assert rows["a"]["order_approved_at"] == dt.datetime(2018, 1, 5, 11)
    assert rows["b"]["order_approved_at"] is None and rows["b"]["order_delivered_customer_date"] is None
    span = tables.date_range(orders).first()
    assert (span["first_date"], span["last_date"], span["n_months"]) == (dt.date(2018, 1, 5), dt.date(2018, 3, 5), 2)


def test_quality_report_counts_copies_and_nulls(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (1, None), (1, None), (2, "")], "a int, b string")
    row = tables.data_quality_report({"t": df}).first()
    assert (row["rows"], row["cols"], row["null_pct"], row["dup_rows"]) == (6, 2, 25.0, 3)


def test_quality_report_tells_microseconds_and_nulls_apart(spark):
    base = dt.datetime(2020, 1, 1, 12)
    rows = [(base, None, "x"), (base + dt.timedelta(microseconds=1), None, "x"), (base, "x", None), (base, None, "x")]
    row = tables.data_quality_report({"t": spark.createDataFrame(rows, "t timestamp, a string, b string")}).first()
    assert (row["rows"], row["dup_rows"]) == (4, 1)


def test_panel_round_trip_and_missing_path(spark, monthly):
    path = scratch_path(spark, "t")
    store.write_panel(monthly, path)
    assert store.read_panel(spark, path).count() == 24
    with pytest.raises(FileNotFoundError):
        store.read_panel(spark, path + "-none")


def test_run_log_appends_and_survives_bad_records(spark):
    path = scratch_path(spark, "runs")
    good = spark.createDataFrame([("1", {"mape": 5.0})], "run_id string, metrics map<string,double>")
    assert store.log_run(good, path) and store.log_run(good, path)
    assert store.read_runs(spark, path).count() == 2
    assert not store.log_run(spark.createDataFrame([("1", "x")], "run_id string, metrics string"), path)
