import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.sources.panel_store import PanelStore

SCHEMA = "key string, ds date, y double, note string"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def rows(store, **where):
    return {(r["key"], r["ds"]): r["y"] for r in store.read(**where).collect()}


@pytest.fixture
def store(spark, tmp_path):
    panel = spark.createDataFrame([(f"k{k}", day(t), float(k * 100 + t), "n") for k in range(20) for t in range(10)], SCHEMA)
    return PanelStore(spark, str(tmp_path / "store"), ["key"]).create(panel, n_buckets=6)


def test_upsert_replaces_adds_and_keeps_versions(spark, store):
    before = rows(store)
    arrived = [("k1", day(3), -1.0, None), ("k1", day(30), 7.0, "new"), ("new", day(0), 8.0, "x"), (None, day(0), 9.0, "x")]
    store.upsert(spark.createDataFrame(arrived, SCHEMA))
    want = before | {(k, d): y for k, d, y, _ in arrived}
    assert rows(store) == want and rows(store, version=1) == before
    store.upsert(spark.createDataFrame([(None, day(0), 10.0, "y")], SCHEMA))
    assert rows(store) == want | {(None, day(0)): 10.0}
    assert store.upsert(spark.createDataFrame([], SCHEMA)) == [] and store.versions() == [1, 2, 3]


def test_last_arrival_counts(spark, store):
    arrived = [("k2", day(1), 1.0, "a", 2), ("k2", day(1), 5.0, "b", 1), ("k3", day(1), 1.0, "a", 0)]
    store.upsert(spark.createDataFrame(arrived, f"{SCHEMA}, seen int"), ["seen"])
    got = rows(store)
    assert got["k2", day(1)] == 1.0 and got["k3", day(1)] == 1.0 and store.read().columns == ["key", "ds", "y", "note"]


def test_only_touched_buckets_are_written_and_read(spark, store):
    def files(version=None):
        return {f.rsplit("/store/", 1)[1] for f in store.read(version).inputFiles()}

    one = spark.createDataFrame([("k5", day(3), 0.5, "c")], SCHEMA)
    sizes = []
    for n in range(6):
        old = files()
        (bucket,) = store.upsert(one.withColumn("y", F.lit(float(n))))
        changed = files() - old
        assert {f.split("/")[2] for f in changed} == {f"bucket={bucket}"}
        sizes.append((len(changed), len(files()), len(store.read(buckets=[bucket]).inputFiles())))
    assert len(set(sizes)) == 1  # as many after six changes as after one
    assert store.vacuum(keep=2) == [1, 2, 3, 4, 5] and store.versions() == [6, 7]
    assert rows(store)["k5", day(3)] == 5.0 and rows(store, version=6)["k5", day(3)] == 4.0 and len(rows(store)) == 200


def test_a_change_that_failed_before_its_manifest_leaves_the_panel(spark, store):
    before = rows(store)
    half = store.read().withColumn("y", F.lit(0.0)).withColumn("bucket", F.lit(0))
    half.write.partitionBy("bucket").parquet(f"{store.path}/data/version=2")
    assert rows(store) == before
    store.upsert(spark.createDataFrame([("k1", day(0), 1.5, "n")], SCHEMA))
    assert rows(store) == before | {("k1", day(0)): 1.5}


def test_no_keys_empty_and_missing(spark, tmp_path, store):
    whole = PanelStore(spark, str(tmp_path / "whole"), []).create(store.read().filter("key = 'k0'").drop("key"))
    whole.upsert(spark.createDataFrame([(day(2), 99.0, "n")], "ds date, y double, note string"))
    assert {r["ds"]: r["y"] for r in whole.read().collect()}[day(2)] == 99.0 and whole.read().count() == 10
    none = PanelStore(spark, str(tmp_path / "none"), ["key"]).create(spark.createDataFrame([], SCHEMA))
    assert none.read().count() == 0 and none.read().columns == ["key", "ds", "y", "note"]
    none.upsert(store.read())
    assert rows(none) == rows(store)
    with pytest.raises(FileNotFoundError):
        PanelStore(spark, str(tmp_path / "missing"), ["key"]).read()
    with pytest.raises(FileNotFoundError):
        store.read(version=9)
