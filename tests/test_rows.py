import datetime as dt

from pyspark.sql import functions as F

from panelforge.functions import rows
from panelforge.functions.guards import clip, finite, flag, ratio
from panelforge.operators.features import OTHER_DOMAIN, delivery_features, domain_of, valid_orders


def first(df):
    return df.first().asDict()


def test_unknown_condition_counts_as_zero(spark):
    df = spark.createDataFrame([(None,), (1,), (-1,)], "x int")
    assert [r[0] for r in df.select(flag(F.col("x") > 0)).collect()] == [0, 1, 0]


def test_whole_days_round_down(spark):
    base = dt.datetime(2020, 1, 10, 12, 0, 0)
    cases = [
        (dt.timedelta(hours=-6), -1),
        (dt.timedelta(hours=6), 0),
        (dt.timedelta(days=1), 1),
        (dt.timedelta(hours=23, minutes=59), 0),
        (dt.timedelta(days=-1), -1),
        (dt.timedelta(days=-1, microseconds=-1), -2),
        (dt.timedelta(days=3, microseconds=-1), 2),
    ]
    df = spark.createDataFrame([(base, base + d, e) for d, e in cases] + [(base, None, None)], "a timestamp, b timestamp, e int")
    out = df.select(rows.whole_days(F.col("b"), F.col("a")).alias("d"), "e").collect()
    assert all(r["d"] == r["e"] for r in out)


def test_undelivered_rows_are_on_time(spark):
    t = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame(
        [(t, None, t, None)],
        "order_purchase_timestamp timestamp, order_delivered_customer_date timestamp, "
        "order_estimated_delivery_date timestamp, order_delivered_carrier_date timestamp",
    )
    out = first(delivery_features(df))
    assert out["is_late_delivery"] == 0 and out["delivery_delay_days"] is None and out["carrier_days"] is None


def test_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 3, 23, 5),), (dt.datetime(2021, 12, 27),)], "t timestamp")
    out = [r.asDict() for r in df.select(*[x.alias(n) for n, x in rows.calendar(F.col("t")).items()]).collect()]
    assert out[0]["order_dayofweek"] == 6 and out[0]["is_weekend"] == 1 and out[0]["order_week"] == 53
    assert out[1]["order_dayofweek"] == 0 and out[1]["is_end_of_month"] == 1 and out[1]["order_quarter"] == 4
    assert out[0]["ds"] == dt.date(2021, 1, 1) and out[0]["order_hour"] == 23


def test_payment_and_product(spark):
    df = spark.createDataFrame(
        [("boleto", 2, 2.0, 3.0, 4.0, 90.0, 10.0), (None, None, None, 3.0, 4.0, None, 10.0)],
        "k string, i int, l double, h double, w double, p double, f double",
    )
    cols = {**rows.payment(F.col("k"), F.col("i")), **rows.product(*[F.col(c) for c in "lhwpf"])}
    a, b = df.select(*[x.alias(n) for n, x in cols.items()]).collect()
    assert (a["is_boleto"], a["is_credit_card"], a["payment_installments_flag"]) == (1, 0, 1)
    assert (b["is_boleto"], b["payment_installments_flag"]) == (0, 0)
    assert a["product_volume_cm3"] == 24 and abs(a["freight_ratio"] - 0.1) < 1e-9
    assert b["product_volume_cm3"] is None and b["freight_ratio"] is None


def test_guards(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (5.0,)], "x double")
    assert [r[0] for r in df.select(finite(F.col("x"))).collect()] == [None, None, None, 5.0]
    assert [r[0] for r in df.select(clip(finite(F.col("x")), 0.0, 2.0)).collect()] == [None, None, None, 2.0]
    assert [r[0] for r in df.select(clip(finite(F.col("x")), None, None)).collect()] == [None, None, None, 5.0]
    assert first(df.limit(1).select(ratio(F.lit(1.0), F.lit(0.0)).alias("q")))["q"] is None


def test_valid_orders(spark):
    df = spark.createDataFrame(
        [("delivered", 1.0), ("delivered", 0.0), ("delivered", None), ("canceled", 5.0), (None, 5.0)],
        "order_status string, payment_value double",
    )
    assert valid_orders(df).count() == 1


def test_domains(spark):
    names = {
        "monthly_orders": "Órdenes",
        "month": "Calendario / Estacionalidad",
        "monthly_revenue": "Target",
        "revenue_lag_12": "Historia del Target (lags)",
        "pct_late_delivery": "Entregas",
        "unique_sellers": "Diversidad de Oferta",
        "something": OTHER_DOMAIN,
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["d"] for r in df.select("n", domain_of(F.col("n")).alias("d")).collect()} == names
