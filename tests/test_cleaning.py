import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.operators import cleaning


def values(df, c, order=None):
    df = df.orderBy(order) if order else df
    return [r[c] for r in df.select(*( [c] if not order else [order, c])).collect()]


def test_clip_pulls_in_extremes_and_keeps_null(spark):
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 101), 9999, -9999]] + [(None,)], "x double")
    out = values(cleaning.outlier_clip(df, ["x"], 0.05, 0.95), "x")
    known = [v for v in out if v is not None]
    assert max(known) < 9999 and min(known) > -9999 and out.count(None) == 1


def test_impute(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 5.0])], "idx int, x double")
    assert values(cleaning.impute(df, ["x"], "median"), "x", "idx")[2] == 3.0
    assert values(cleaning.impute(df, ["x"], "mean"), "x", "idx")[2] == 3.0
    assert values(cleaning.impute(df, ["x"], "zero"), "x", "idx")[2] == 0.0
    gaps = spark.createDataFrame([(i, v) for i, v in enumerate([None, 1.0, None, 5.0])], "idx int, x double")
    assert values(cleaning.apply_impute(gaps, ["x"], "forward_fill", {}, ds="idx"), "x", "idx") == [1.0, 1.0, 1.0, 5.0]
    with pytest.raises(ValueError):
        cleaning.impute(df, ["x"], "other")


def test_rare_and_missing_become_other(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)] + [(None,)] * 5, "x string")
    out = values(cleaning.rare_category_group(df, ["x"], 0.3), "x")
    assert (out.count("a"), out.count("b"), out.count("other")) == (6, 3, 6)


def test_one_hot(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0), (None, 4.0)], "cat string, x double")
    out = cleaning.one_hot(df, ["cat"])
    assert out.columns == ["x", "cat__a", "cat__b", "cat__nan"]
    assert [sum(values(out, c)) for c in out.columns[1:]] == [2, 1, 1]
    assert cleaning.one_hot(df, ["cat"], drop_first=True).columns == ["x", "cat__b", "cat__nan"]
    fitted = cleaning.fit_one_hot(df, ["cat"])
    unseen = cleaning.apply_one_hot(spark.createDataFrame([("z", 1.0)], df.schema), fitted).first()
    assert (unseen["cat__a"], unseen["cat__b"], unseen["cat__nan"]) == (0, 0, 0)
    assert cleaning.one_hot_long(df, ["cat"], ["x"]).count() == 4


def test_scale(spark):
    df = spark.createDataFrame([(float(i), i % 2, 3.0) for i in range(1, 21)], "x double, flag int, same double")
    out = cleaning.scale(df, ["x", "flag", "same"]).agg(F.avg("x"), F.stddev_pop("x"), F.sum("flag"), F.max("same")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(1) and out[2] == 10 and out[3] == 3.0
    both = cleaning.scale(df, ["same"], exclude_binary=False).agg(F.max("same")).first()[0]
    assert both == 0.0
    ranged = cleaning.scale(df, ["x"], "minmax").agg(F.min("x"), F.max("x")).first()
    assert tuple(ranged) == (0.0, 1.0)
    assert values(cleaning.scale(df, ["x"], "none"), "x") == values(df, "x")


@pytest.fixture()
def panel(spark):
    rows = [(dt.date(2020, m, 1), 1000.0 * m, None if m == 4 else float(m), m % 2, "red" if m < 9 else "blue") for m in range(1, 11)]
    return spark.createDataFrame(rows, "ds date, monthly_revenue double, x1 double, x2 int, colour string")


def test_clean_panel_keeps_target_and_reloads(spark, panel):
    cleaned, model = cleaning.clean_panel(panel, Settings())
    assert cleaned.columns == ["ds", "monthly_revenue", "x1", "x2", "colour__blue", "colour__red"]
    assert cleaned.agg(F.avg("x1")).first()[0] == pytest.approx(0, abs=1e-9)
    assert values(cleaned, "monthly_revenue", "ds") == values(panel, "monthly_revenue", "ds")
    again = cleaning.CleaningModel.from_frame(model.to_frame(spark))
    assert sorted(map(tuple, again.transform(panel).collect())) == sorted(map(tuple, cleaned.collect()))
    with pytest.raises(ValueError):
        cleaning.clean_panel(panel, fit=False)


def test_fit_on_train_ignores_later_rows(spark, panel):
    train = panel.filter(F.month("ds") <= 6)
    _, a = cleaning.clean_panel(panel, fit_on=train)
    changed = panel.withColumn("x1", F.when(F.month("ds") > 6, 1e9).otherwise(F.col("x1")))
    _, b = cleaning.clean_panel(changed, fit_on=changed.filter(F.month("ds") <= 6))
    assert a.scales == b.scales and a.clip == b.clip


def test_any_number_of_categories_is_encoded(spark):
    df = spark.range(2100).select(F.format_string("c%04d", "id").alias("cat"), F.col("id").alias("n"))
    encoded = cleaning.one_hot(df, ["cat"])
    assert len(encoded.columns) == 2101
    assert encoded.filter("n = 2099").select("cat__c2099", "cat__c0000").first()[:] == (1, 0)


def test_threshold_zero_keeps_all_but_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert sorted(r["x"] for r in cleaning.rare_category_group(df, ["x"], 0.0).collect()) == ["a", "b", "other"]


def test_one_hot_refuses_more_categories_than_columns(spark, monkeypatch):
    df = spark.range(30).selectExpr("cast(id AS string) AS cat")
    monkeypatch.setattr(cleaning, "MOST_CATEGORIES", 30)
    assert len(cleaning.fit_one_hot(df, ["cat"])["cat"]) == 30
    monkeypatch.setattr(cleaning, "MOST_CATEGORIES", 29)
    with pytest.raises(ValueError, match="one_hot_long"):
        cleaning.fit_one_hot(df, ["cat"])
    assert cleaning.one_hot_long(df, ["cat"], []).count() == 30
