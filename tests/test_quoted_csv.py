import random

import pytest

from panelforge.sources.quoted_csv import read_quoted_csv

SCHEMA = "id long, text string, `a b` string, n double"


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    for k, v in before.items():
        spark.conf.set(k, v)


def whole_files(spark, path):
    return spark.read.schema(SCHEMA).options(header=True, escape='"', multiLine=True, enforceSchema=False).csv(path)


def same(a, b):
    return a.exceptAll(b).count() == b.exceptAll(a).count() == 0


@pytest.mark.parametrize("size", ["300", "128m"])
def test_like_the_reader_of_whole_files(spark, tmp_path, small_splits, size):
    rng = random.Random(3)
    texts = ["plain", "", None, 'said "so"', "two\nlines", "\n\n", '"', '",\n"', "a,b", "é€\n漢", "x" * 300 + "\n" + "y" * 300, "  spaced  "]
    rows = [(i, rng.choice(texts), rng.choice(texts), rng.choice([None, 1.5])) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "rows")
    df.coalesce(2).write.option("header", True).option("escape", '"').csv(path)
    small_splits(size)
    assert same(read_quoted_csv(spark, path, SCHEMA), whole_files(spark, path))
    assert same(read_quoted_csv(spark, path, SCHEMA).select("id", "n"), df.select("id", "n"))


def test_line_ends_headers_and_odd_files(spark, tmp_path, small_splits):
    small_splits("8")
    path = tmp_path / "odd"
    path.mkdir()
    (path / "a.csv").write_bytes(b'id,text,a b,n\r\n1,"x\r\ny",,2.5\r\n\r\nid,text,a b,n\r\n3,"open')
    (path / "b.csv").write_bytes(b"id,text,a b,n\n")
    got = {(r["id"], r["text"], r["n"]) for r in read_quoted_csv(spark, str(path), SCHEMA).collect()}
    assert {r for r in got if r[0] == 1} == {(1, "x\r\ny", 2.5)} and len(got) == 3
    assert (None, "text", None) in got  # a data row that reads like the header stays
    with pytest.raises(ValueError):
        read_quoted_csv(spark, str(path), "id long, other string")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.csv").write_bytes(b"")
    assert read_quoted_csv(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_many_tasks_read_one_file(spark, tmp_path, small_splits):
    df = spark.range(1500).selectExpr("id", "concat('line\n', repeat('z', 50)) AS text", "'q\"q' AS `a b`", "cast(id AS double) AS n")
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "one"))
    small_splits("10k")
    got = read_quoted_csv(spark, str(tmp_path / "one"), SCHEMA)
    assert got.rdd.getNumPartitions() > 10 and same(got, df)
