"""Model comparison, overfit gap, value of a forecast and promotion rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.functions.guards import flag, total
from panelforge.functions.metrics import all_metrics, mape, rmse


def forecast_metrics(scored: DataFrame, by: list[str] | None = None, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """RMSE, MAE, MAPE and sMAPE per group."""
    return scored.groupBy(*(by or ["model"])).agg(*all_metrics(y, yhat))


def rank_models(metrics: DataFrame, sort_by: str = "mape", target_mape: float = 10.0) -> DataFrame:
    return metrics.withColumn("meets_target", F.coalesce(F.col("mape") < target_mape, F.lit(False))).orderBy(
        F.asc_nulls_last(sort_by), F.asc("model")
    )


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), F.asc("feature")).limit(n)


def train_backtest_gap(scored: DataFrame, split: str = "split") -> DataFrame:
    """In-sample against backtest error per model, from ``(model, split, y, yhat)`` rows.

    One aggregate holds both sides; a zero training error gives an infinite ratio.
    """
    y, yhat = F.col("y"), F.col("yhat")

    def on(side, column):
        return F.when(F.col(split) == side, column)

    train = rmse(on("train", y), on("train", yhat))
    back = rmse(on("backtest", y), on("backtest", yhat))
    return (
        scored.groupBy("model")
        .agg(
            train.alias("rmse_train"),
            back.alias("rmse_backtest"),
            mape(on("backtest", y), on("backtest", yhat)).alias("mape_backtest"),
        )
        .withColumn(
            "gap_rmse_ratio",
            F.when(F.col("rmse_train") > 0, F.col("rmse_backtest") / F.col("rmse_train")).otherwise(
                F.lit(float("inf"))
            ),
        )
        .select("model", "rmse_train", "rmse_backtest", "gap_rmse_ratio", "mape_backtest")
    )


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Gaps by backtest error, best first, with the model of the worst ratio marked."""
    worst = F.max_by("model", F.struct("gap_rmse_ratio", "model")).over(Window.partitionBy(F.lit(1)))
    return gaps.withColumn("is_worst_gap", F.col("model") == worst).orderBy("rmse_backtest", "model")


def selection_cost(all_metrics_row: dict, selected_row: dict, n_all: int, n_selected: int, spark) -> DataFrame:
    """Error with all features against error with the selected ones."""
    rows = [
        (1, f"Todas las features ({n_all})", n_all, float(all_metrics_row["rmse"]), float(all_metrics_row["mape"])),
        (2, f"Seleccionadas ({n_selected})", n_selected, float(selected_row["rmse"]), float(selected_row["mape"])),
    ]
    table = spark.createDataFrame(rows, "pos int, estado string, n_features int, rmse double, mape double")
    previous = F.lag("mape", 1).over(Window.partitionBy(F.lit(1)).orderBy("pos"))
    return table.withColumn("delta_mape", F.col("mape") - previous).drop("pos")


def roi(forecast: DataFrame, panel: DataFrame, model_mape: float | None, settings: Settings = Settings()) -> DataFrame:
    """Time saved, accuracy gain and projected revenue per year in one row."""
    error = settings.target_mape if model_mape is None else float(model_mape)
    hours = settings.manual_hours_per_month * 12
    gain = max(settings.baseline_mape - error, 0.0)
    time_saving = hours * settings.analyst_hourly_cost
    revenue = panel.agg(F.avg("monthly_revenue").alias("avg_revenue")).withColumn("_one", F.lit(1))
    projected = forecast.agg(
        total(F.col("yhat")).alias("projected_revenue_horizon"),
        F.count(F.lit(1)).alias("forecast_horizon_months"),
    ).withColumn("_one", F.lit(1))
    accuracy = F.col("avg_revenue") * (gain / 100.0) * settings.planning_error_cost_rate * 12
    return revenue.join(projected, "_one").select(
        F.lit(hours).alias("time_saved_hours_per_year"),
        F.lit(time_saving).alias("time_saving_per_year"),
        F.lit(gain).alias("mape_improvement_pts"),
        accuracy.alias("accuracy_saving_per_year"),
        (F.lit(time_saving) + accuracy).alias("total_benefit_per_year"),
        "projected_revenue_horizon",
        "forecast_horizon_months",
    )


def latest_run_metrics(runs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Backtest metrics of the newest run; without any the target MAPE stands in."""
    last = runs.agg(F.max_by(F.struct("model_type", "metrics"), F.struct("trained_at", "run_id")).alias("r"))

    def metric(name):
        return F.try_element_at(F.col("r.metrics"), F.lit(name))

    error = F.coalesce(metric("mape"), F.lit(settings.target_mape))
    return last.select(
        F.col("r.model_type").alias("model"),
        metric("rmse").alias("rmse"),
        error.alias("mape"),
        metric("mae").alias("mae"),
        metric("smape").alias("smape"),
        F.coalesce(metric("mape") < settings.target_mape, F.lit(False)).alias("meets_target"),
        F.lit(settings.target_mape).alias("mape_target"),
    )


def promotion_gate(runs: DataFrame, target_mape: float = 10.0, series: list[str] | None = None) -> DataFrame:
    """Marks runs that may be promoted: below the target, not worse than the best
    earlier approved run, and with the selection filters passed.

    ``runs`` has ``(series…, trained_at, run_id, mape, filters_passed)``.
    """
    w = (
        Window.partitionBy(*(series or [F.lit(1)]))
        .orderBy("trained_at", "run_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    eligible = F.coalesce((F.col("mape") < target_mape) & F.col("filters_passed"), F.lit(False))
    champion = F.min(F.when(eligible, F.col("mape"))).over(w)
    return runs.withColumn("champion_mape", champion).withColumn(
        "promote", eligible & (F.col("champion_mape").isNull() | (F.col("mape") <= F.col("champion_mape")))
    )


def champion_challenger(
    errors: DataFrame, champion: str, challenger: str, target_mape: float = 10.0, period: str = "period"
) -> DataFrame:
    """Per period: promote a challenger that won twice running, retrain a champion
    that missed the target twice running. ``errors`` is ``(period, model, mape)``."""

    def of(name):
        return F.max(F.when(F.col("model") == name, F.col("mape")))

    sides = errors.groupBy(period).agg(of(champion).alias("champion_mape"), of(challenger).alias("challenger_mape"))
    w = Window.partitionBy(F.lit(1)).orderBy(period)  # one row per period
    won = flag(F.col("challenger_mape") < F.col("champion_mape"))
    missed = flag(F.col("champion_mape") > target_mape)
    return (
        sides.withColumns({"won": won, "missed": missed})
        .withColumns(
            {
                "promote": (F.col("won") == 1) & F.coalesce(F.lag("won", 1).over(w) == 1, F.lit(False)),
                "retrain": (F.col("missed") == 1) & F.coalesce(F.lag("missed", 1).over(w) == 1, F.lit(False)),
            }
        )
        .drop("won", "missed")
    )


def segment_residuals(scored: DataFrame, segment: list[str]) -> DataFrame:
    """Error metrics per model and segment with the mean signed error."""
    return scored.groupBy("model", *segment).agg(
        *all_metrics(), F.avg(F.col("y") - F.col("yhat")).alias("bias"), F.count(F.lit(1)).alias("n")
    )
