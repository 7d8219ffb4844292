import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators.quantiles import column_quantiles, exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def test_equals_linear_interpolation(spark):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(0, 1e6, 501),
        "narrow": 1e9 + rng.normal(0, 1, 300),
        "one bucket": 1e12 + np.arange(3_000.0),
        "discrete": rng.integers(-3, 4, 400).astype(float),
        "single": np.array([7.0]),
        "pair": np.array([-1.0, 1.0]),
        "hot": np.r_[np.full(900, 5.0), rng.random(100)],
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    rows += [("normal", None), ("normal", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", PROBS).collect()}
    assert len(out) == len(groups) * len(PROBS)
    for g, values in groups.items():
        for p in PROBS:
            assert out[(g, p)] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)


def test_weights_repeat_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (10.0, 2), (4.0, 1)], "v double, w int")
    out = exact_quantiles(df, [], "v", [0.5, 0.75], weight="w").collect()
    expected = np.quantile([1, 1, 1, 10, 10, 4], [0.5, 0.75])
    assert sorted(r["quantile"] for r in out) == pytest.approx(sorted(expected))


def test_many_columns_and_empty(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("a"), (F.col("id") * -2).alias("b"), F.lit(None).cast("double").alias("c"))
    out = {r["feature"]: r["quantile"] for r in column_quantiles(df, ["a", "b", "c"], [0.5]).collect()}
    assert out == {"a": 50.0, "b": -100.0}


def test_agrees_with_builtin_percentile(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), F.round(F.rand(5) * 1000, 2).alias("v"))
    mine = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5]).collect()}
    for r in df.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).collect():
        assert [mine[(r["g"], 0.1)], mine[(r["g"], 0.5)]] == pytest.approx(r["q"], abs=1e-9)
