import datetime as dt
import random

from pyspark.sql import functions as F

from panelforge.operators.features import add_transaction_features, valid_orders
from panelforge.operators.joins import (
    build_master_table,
    hot_keys,
    left_join_children,
    order_grain_master,
    written_hot_keys,
)
from panelforge.operators.panel import AGGREGATES, monthly_aggregate, monthly_from_orders, trim_edge_months


def make_tables(spark, n_orders=60, seed=1, hot_order=None):
    """Small tables with missing children, missing values and repeated payments."""
    rng = random.Random(seed)

    def maybe(x, p=0.1):
        return None if rng.random() < p else x

    orders, items, payments, reviews = [], [], [], []
    for i in range(n_orders):
        oid = f"o{i}"
        t = dt.datetime(2018, rng.randint(1, 5), rng.randint(1, 28), rng.randint(0, 23))
        done = maybe(t + dt.timedelta(days=rng.randint(0, 30), hours=rng.randint(0, 23)))
        status = rng.choice(["delivered", "delivered", "delivered", "canceled"])
        orders.append((oid, maybe(f"c{rng.randint(0, 9)}", 0.05), status, t, done, done, t + dt.timedelta(days=15)))
        for k in range(rng.randint(0, 3) if oid != hot_order else 40):
            items.append((oid, k + 1, maybe(f"p{rng.randint(0, 5)}"), f"s{rng.randint(0, 3)}", maybe(rng.randint(1, 90) / 1.0), maybe(rng.randint(0, 9) / 2)))
        for _ in range(rng.randint(0, 2)):
            payments.append((oid, rng.choice(["credit_card", "boleto", None]), maybe(rng.randint(1, 4)), rng.choice([0.0, 12.5, 30.0, 47.25, None])))
        for _ in range(rng.randint(0, 2)):
            reviews.append((oid, maybe(rng.randint(1, 5)), "t"))
    return {
        "orders": spark.createDataFrame(
            orders,
            "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, "
            "order_delivered_customer_date timestamp, order_delivered_carrier_date timestamp, order_estimated_delivery_date timestamp",
        ),
        "order_items": spark.createDataFrame(
            items, "order_id string, order_item_id int, product_id string, seller_id string, price double, freight_value double"
        ),
        "order_payments": spark.createDataFrame(
            payments, "order_id string, payment_type string, payment_installments int, payment_value double"
        ),
        "order_reviews": spark.createDataFrame(reviews, "order_id string, review_score int, review_comment_title string"),
        "customers": spark.createDataFrame(
            [(f"c{i}", f"u{i // 2}", "x", ["A", "B", None][i % 3]) for i in range(10)],
            "customer_id string, customer_unique_id string, customer_city string, customer_state string",
        ),
        "products": spark.createDataFrame(
            [(f"p{i}", f"k{i % 3}", 1.0, 1.0, 2.0, 3.0) for i in range(5)],
            "product_id string, product_category_name string, product_weight_g double, product_length_cm double, "
            "product_height_cm double, product_width_cm double",
        ),
        "sellers": spark.createDataFrame([(f"s{i}", "y", f"S{i % 2}") for i in range(3)], "seller_id string, seller_city string, seller_state string"),
        "category_trans": spark.createDataFrame([("k0", "toys"), ("k1", "books")], "product_category_name string, product_category_name_english string"),
    }


def bag(df, columns):
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


def test_hot_keys_pick_the_largest_child(spark):
    a = spark.createDataFrame([("x",)] * 5 + [("y",)] + [(None,)] * 9, "k string")
    b = spark.createDataFrame([("x",)] * 3 + [("z",)] * 7, "k string")
    rows = {r["k"]: (r["spread"], r["n_slices"]) for r in hot_keys([a, b], "k", 2).collect()}
    assert rows == {"x": (0, 3), "z": (1, 4)}


def test_balanced_join_equals_plain_join(spark):
    tables = make_tables(spark, hot_order="o7")
    children = [tables["order_items"], tables["order_payments"], tables["order_reviews"]]
    plain = left_join_children(tables["orders"], children, "order_id", hot=spark.createDataFrame([], "order_id string, spread int, n_slices int"))
    for size in (1, 2, 10):
        cut = left_join_children(tables["orders"], children, "order_id", rows_per_slice=size)
        assert bag(cut, sorted(plain.columns)) == bag(plain, sorted(plain.columns))


def panel_rows(df, keys):
    return {
        tuple(r[k] for k in [*keys, "ds"]): [None if r[c] is None else round(float(r[c]), 8) for c in AGGREGATES]
        for r in df.collect()
    }


def test_folded_panel_equals_row_level_panel(spark):
    for seed in (1, 2):
        tables = make_tables(spark, seed=seed, hot_order="o3")
        valid = valid_orders(add_transaction_features(build_master_table(tables)))
        for keys in ([], ["customer_state"], ["product_category_name_english"], ["seller_state"], ["seller_id"]):
            assert panel_rows(monthly_from_orders(tables, keys), keys) == panel_rows(monthly_aggregate(valid, keys), keys)


def test_no_key_panel_equals_one_key_panel(spark):
    tables = make_tables(spark)
    tables["customers"] = tables["customers"].withColumn("customer_state", F.lit("A"))
    tables["orders"] = tables["orders"].withColumn("customer_id", F.lit("c1"))
    whole = panel_rows(monthly_from_orders(tables), [])
    keyed = panel_rows(monthly_from_orders(tables, ["customer_state"]), ["customer_state"])
    assert whole == {k[1:]: v for k, v in keyed.items()}


def test_partition_count_does_not_change_results(spark):
    tables = make_tables(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(panel_rows(monthly_from_orders(tables, ["customer_state"]), ["customer_state"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_trim_drops_first_and_last_row_of_each_series(spark):
    rows = [("a", m) for m in (1, 2, 3, 4)] + [("b", 1), ("b", 9), ("c", 5)]
    df = spark.createDataFrame([(k, dt.date(2020, m, 1)) for k, m in rows], "k string, ds date")
    assert sorted((r["k"], r["ds"].month) for r in trim_edge_months(df, ["k"]).collect()) == [("a", 2), ("a", 3)]


def test_order_grain_counts_money_once(spark):
    tables = make_tables(spark, hot_order="o3")
    total = tables["order_payments"].filter("payment_value > 0").agg(F.sum("payment_value")).first()[0]
    master = order_grain_master(tables)
    assert master.count() == tables["orders"].count()
    assert abs(master.agg(F.sum("payment_sum")).first()[0] - total) < 1e-9


def test_more_hot_keys_than_any_fixed_list(spark):
    parent = spark.range(600).select(F.col("id").alias("k"))
    child = spark.range(2400).select((F.col("id") % 600).alias("k"), F.col("id").alias("v"))
    other = spark.range(1200).select((F.col("id") % 600).alias("k"), F.col("id").alias("w"))
    assert hot_keys([child, other], "k", 2).count() == 600
    cut = left_join_children(parent, [child, other], "k", rows_per_slice=2)
    plain = parent.join(child, "k", "left").join(other, "k", "left")
    assert bag(cut, ["k", "v", "w"]) == bag(plain, ["k", "v", "w"])


def test_counting_hot_keys_is_not_left_to_one_task(spark):
    # a folded write would count every key in the one task that writes
    rows = spark.createDataFrame([(f"o{k}",) for k in range(200) for _ in range(1 + k % 3)], "order_id string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = written_hot_keys([rows, rows.limit(9)], "order_id", rows_per_slice=1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert hot.count() == 133
    assert len(hot.inputFiles()) > 1
