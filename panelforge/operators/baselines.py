"""Baseline forecasts of every series of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.guards import finite
from panelforge.functions.metrics import all_metrics

NAIVE, SEASONAL, TREND = "Naive", "SeasonalNaive", "LinearTrend"


def moving_average_name(window: int) -> str:
    return f"MovingAverage_{window}M"


def _history(train: DataFrame, keys: list[str], target: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return train.select(*keys, "ds", finite(F.col(target)).alias("y")).withColumns(
        {"pos": F.row_number().over(w.orderBy("ds")) - 1, "n": F.count(F.lit(1)).over(w)}
    )


def _horizons(df: DataFrame, horizon: int) -> DataFrame:
    return df.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def baseline_naive(train: DataFrame, keys=None, horizon: int = 3, target: str = "monthly_revenue") -> DataFrame:
    """The last value."""
    keys = keys or []
    last = train.groupBy(*keys).agg(F.max_by(finite(F.col(target)), F.col("ds")).alias("yhat"))
    return _horizons(last, horizon).select(*keys, F.lit(NAIVE).alias("model"), "horizon", "yhat")


def baseline_moving_average(
    train: DataFrame, keys=None, horizon: int = 3, target: str = "monthly_revenue", window: int = 3
) -> DataFrame:
    """Mean of the last ``window`` values, or of fewer in a shorter series."""
    keys = keys or []
    recent = _history(train, keys, target).filter(F.col("pos") >= F.col("n") - window)
    mean = recent.groupBy(*keys).agg(F.avg("y").alias("yhat"))
    name = F.lit(moving_average_name(window)).alias("model")
    return _horizons(mean, horizon).select(*keys, name, "horizon", "yhat")


def baseline_seasonal_naive(
    train: DataFrame, keys=None, horizon: int = 3, target: str = "monthly_revenue", period: int = 12
) -> DataFrame:
    """The value one season before; the mean where the series is too short."""
    keys = keys or []
    start = F.col("n") - period
    season = F.map_from_entries(
        # at most one season per series
        F.collect_list(F.when(F.col("pos") >= start, F.struct((F.col("pos") - start).cast("int"), F.col("y"))))
    )
    fitted = _history(train, keys, target).groupBy(*keys).agg(season.alias("season"), F.avg("y").alias("mean"))
    step = ((F.col("horizon") - 1) % period).cast("int")
    return _horizons(fitted, horizon).select(
        *keys,
        F.lit(SEASONAL).alias("model"),
        "horizon",
        F.coalesce(F.try_element_at("season", step), F.col("mean")).alias("yhat"),
    )


def baseline_linear_trend(train: DataFrame, keys=None, horizon: int = 3, target: str = "monthly_revenue") -> DataFrame:
    """Straight line over the row number, extrapolated."""
    keys = keys or []
    x = F.col("pos").cast("double")
    line = _history(train, keys, target).groupBy(*keys).agg(
        F.regr_slope(F.col("y"), x).alias("slope"),
        F.regr_intercept(F.col("y"), x).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )
    at = F.col("n") - 1 + F.col("horizon")
    return _horizons(line, horizon).select(
        *keys, F.lit(TREND).alias("model"), "horizon", (F.col("intercept") + F.col("slope") * at).alias("yhat")
    )


def all_baselines(train: DataFrame, keys=None, horizon: int = 3, target: str = "monthly_revenue") -> DataFrame:
    """The four baselines together, from one sorted pass over the history."""
    keys = keys or []
    history = _history(train, keys, target)
    x, start = F.col("pos").cast("double"), F.col("n") - 12
    season = F.map_from_entries(
        F.collect_list(F.when(F.col("pos") >= start, F.struct((F.col("pos") - start).cast("int"), F.col("y"))))
    )
    fitted = history.groupBy(*keys).agg(
        F.max_by("y", "pos").alias("last"),
        F.avg(F.when(F.col("pos") >= F.col("n") - 3, F.col("y"))).alias("ma"),
        season.alias("season"),
        F.avg("y").alias("mean"),
        F.regr_slope(F.col("y"), x).alias("slope"),
        F.regr_intercept(F.col("y"), x).alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )
    step = ((F.col("horizon") - 1) % 12).cast("int")
    guesses = {
        NAIVE: F.col("last"),
        moving_average_name(3): F.col("ma"),
        SEASONAL: F.coalesce(F.try_element_at("season", step), F.col("mean")),
        TREND: F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("horizon")),
    }
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), g.alias("yhat")) for m, g in guesses.items()])
    return _horizons(fitted, horizon).select(*keys, "horizon", F.explode(pairs).alias("_g")).select(
        *keys, "_g.model", "horizon", "_g.yhat"
    )


def numbered_test(test: DataFrame, keys=None, n_test: int = 3, target: str = "monthly_revenue") -> DataFrame:
    """First ``n_test`` test rows of each series as horizons 1…n."""
    keys = keys or []
    step = F.row_number().over(Window.partitionBy(*keys).orderBy("ds"))
    return (
        test.select(*keys, "ds", finite(F.col(target)).alias("y"))
        .withColumn("horizon", step)
        .filter(F.col("horizon") <= n_test)
    )


def score(forecasts: DataFrame, test: DataFrame, keys=None, by=("model",)) -> DataFrame:
    """Error metrics of forecasts against numbered test rows."""
    joined = forecasts.join(test.select(*(keys or []), "horizon", "y"), [*(keys or []), "horizon"])
    return joined.groupBy(*by).agg(*all_metrics())


def evaluate_baselines(
    train: DataFrame, test: DataFrame, keys=None, n_test: int = 3, target: str = "monthly_revenue"
) -> DataFrame:
    """Metrics of the four baselines, best MAPE first."""
    forecasts = all_baselines(train, keys, n_test, target)
    return score(forecasts, numbered_test(test, keys, n_test, target), keys).orderBy("mape", "model")


def rolling_baselines(
    panel: DataFrame, origins: list[str], keys=None, horizon: int = 3, target: str = "monthly_revenue"
) -> DataFrame:
    """``(origin, keys…, model, horizon, yhat, y)``: the baselines refitted at every origin.

    All origins run as one job: a row is repeated for each origin that uses it
    and the origin becomes one more series key. A few dozen origins are usual.
    """
    keys = keys or []
    dates = F.array(*[F.to_date(F.lit(o)) for o in origins])
    rows = panel.select(*keys, "ds", target)
    ds = F.col("ds")
    history = rows.withColumn("origin", F.explode(F.filter(dates, lambda o: o >= ds)))
    future = rows.withColumn("origin", F.explode(F.filter(dates, lambda o: o < ds)))
    series = ["origin", *keys]
    forecasts = all_baselines(history, series, horizon, target)
    return forecasts.join(numbered_test(future, series, horizon, target), [*series, "horizon"]).select(
        *series, "model", "horizon", "yhat", "y"
    )
