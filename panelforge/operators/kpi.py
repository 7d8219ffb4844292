"""Business indicators and exploratory reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.guards import flag, ratio, total
from panelforge.functions.rows import month_start
from panelforge.operators.features import to_long
from panelforge.operators.quantiles import column_quantiles, exact_quantiles, wide_quantiles


def _side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """One row from several one-row reports, joined on a constant."""
    first, *rest = [f.withColumn("_one", F.lit(1)) for f in one_row_frames]
    for f in rest:
        first = first.join(f, "_one", "left")
    return first.drop("_one")


def business_kpis(valid: DataFrame, panel: DataFrame) -> DataFrame:
    """Revenue, satisfaction, delivery and customer indicators in one row.

    ``valid`` holds featured valid rows; ``panel`` is the period table of the
    whole business (one row per period).
    """
    score, delay = F.col("review_score"), F.col("delivery_delay_days")
    sums = {
        "revenue": F.sum("payment_value"),
        "n": F.count(F.lit(1)),
        "score": F.sum(score),
        "score_n": F.count(score),
        "five": F.count_if(score == 5),
        "one": F.count_if(score == 1),
        "days": F.sum("delivery_days_actual"),
        "days_n": F.count("delivery_days_actual"),
        "on_time": F.count_if(F.col("is_late_delivery") == 0),
        "late": F.sum(F.when(delay > 0, delay)),
        "late_n": F.count_if(delay > 0),
    }
    # one pass over the rows: fold per customer, then fold the customers
    per_customer = valid.groupBy("customer_unique_id").agg(
        F.count_distinct("order_id").alias("orders"), *[x.alias(n) for n, x in sums.items()]
    )

    def share(part: str, whole: str, factor: float = 1.0):
        return ratio(F.sum(part), F.sum(whole)) * factor

    known = F.col("customer_unique_id").isNotNull()
    rows = per_customer.agg(
        total(F.col("revenue")).alias("revenue_total"),
        share("score", "score_n").alias("avg_review_score"),
        share("five", "n", 100).alias("pct_5star"),
        share("one", "n", 100).alias("pct_1star"),
        share("days", "days_n").alias("avg_delivery_days"),
        share("on_time", "n", 100).alias("pct_on_time"),
        share("late", "late_n").alias("avg_late_delay_days"),
        F.count_if(known).alias("total_unique_customers"),
        (ratio(F.count_if(known & (F.col("orders") > 1)), F.count_if(known)) * 100).alias("repeat_customer_rate"),
    )
    # the calendar bounds the number of rows here
    periods = panel.agg(
        F.avg("monthly_revenue").alias("avg_monthly_revenue"),
        F.median("monthly_revenue").alias("median_monthly_revenue"),
        F.max("monthly_revenue").alias("max_monthly_revenue"),
        F.min("monthly_revenue").alias("min_monthly_revenue"),
    )
    return _side_by_side(rows, periods)


def cancellation_rate(featured: DataFrame) -> DataFrame:
    return featured.agg((F.avg("is_canceled") * 100).alias("cancellation_rate"))


def null_analysis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count and percentage of the columns that have nulls, worst first."""
    columns = columns or df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return (
        counts.unpivot([F.col("_n")], [F.col(c) for c in columns], "feature", "null_count")
        .filter(F.col("null_count") > 0)
        .select(
            "feature",
            "null_count",
            F.bround(F.col("null_count") * 100.0 / F.col("_n"), 2).alias("null_pct"),
        )
        .orderBy(F.desc("null_pct"), F.asc("feature"))
    )


def describe_target(df: DataFrame, target: str = "monthly_revenue") -> DataFrame:
    """Count, mean, deviation, extremes and quartiles."""
    y = F.col(target)
    basic = df.agg(
        F.count(y).alias("count"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("std"),
        F.min(y).alias("min"),
        F.max(y).alias("max"),
    )
    quartiles = wide_quantiles(
        column_quantiles(df, [target], [0.25, 0.5, 0.75]), [], {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    )
    return _side_by_side(basic, quartiles)


def pareto(valid: DataFrame, category: str = "product_category_name_english", top: int = 15) -> DataFrame:
    """Revenue of the top categories, their share of the shown total and its running sum."""
    revenue = (
        valid.filter(F.col(category).isNotNull())
        .groupBy(F.col(category).alias("category"))
        .agg(total(F.col("payment_value")).alias("revenue_total"))
        .orderBy(F.desc("revenue_total"), F.asc("category"))
        .limit(top)
    )
    # at most `top` rows from here on
    whole = Window.partitionBy(F.lit(1))
    ordered = whole.orderBy(F.desc("revenue_total"), F.asc("category"))
    return (
        revenue.withColumn(
            "pct_revenue", F.bround(ratio(F.col("revenue_total") * 100, F.sum("revenue_total").over(whole)), 2)
        )
        .withColumn(
            "cumulative_pct", F.sum("pct_revenue").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        )
        .withColumn("in_80_pct", F.col("cumulative_pct") <= 80)
    )


def iqr_outliers(valid: DataFrame, columns: list[str]) -> DataFrame:
    """Upper quartile fence and the rows beyond it, per column."""
    long = to_long(valid, columns).filter(F.col("value").isNotNull())
    fences = wide_quantiles(
        exact_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75]),
        ["feature"],
        {0.25: "q1", 0.5: "median", 0.75: "q3"},
    ).withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    beyond = flag(F.col("value") > F.col("upper_fence"))
    return (
        # one fence row per named column
        long.join(F.broadcast(fences), "feature")
        .groupBy("feature", "q1", "q3", "upper_fence", "median")
        .agg(
            F.sum(beyond).alias("n_outliers"),
            (F.avg(beyond) * 100).alias("pct_outliers"),
            F.max("value").alias("max_value"),
        )
    )


def seasonality_by_month(panel: DataFrame) -> DataFrame:
    """Mean revenue per calendar month with the best and worst month and the Q4 uplift."""
    months = panel.groupBy(F.month("ds").alias("month")).agg(F.avg("monthly_revenue").alias("avg_revenue"))
    q4 = F.quarter("ds") == 4
    uplift = panel.agg(
        F.avg(F.when(q4, F.col("monthly_revenue"))).alias("q4_avg"),
        F.avg(F.when(~q4, F.col("monthly_revenue"))).alias("rest_avg"),
    ).withColumn("q4_uplift_pct", (ratio(F.col("q4_avg"), F.col("rest_avg")) - 1) * 100)
    extremes = months.agg(
        F.max_by("month", F.struct(F.col("avg_revenue"), -F.col("month"))).alias("best_month"),
        F.min_by("month", F.struct("avg_revenue", "month")).alias("worst_month"),
    )
    return _side_by_side(months, extremes, uplift)


def payment_type_by_month(valid: DataFrame) -> DataFrame:
    """Payment mix and average ticket per month and payment type."""
    mix = (
        valid.filter(F.col("payment_type").isNotNull())
        .groupBy("ds", "payment_type")
        .agg(F.count(F.lit(1)).alias("n_payments"), F.avg("payment_value").alias("avg_ticket"))
    )
    share = ratio(F.col("n_payments") * 100, F.sum("n_payments").over(Window.partitionBy("ds")))
    return mix.withColumn("share_pct", share)


def repeat_customers_by_period(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Monthly cohorts by first order: customers and the share that ordered again."""
    per_customer = (
        orders.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .filter(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(
            F.min(month_start(F.col("order_purchase_timestamp"))).alias("cohort"),
            F.count_distinct("order_id").alias("orders"),
        )
    )
    cohorts = per_customer.filter(F.col("cohort").isNotNull()).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum(flag(F.col("orders") > 1)).alias("repeat_customers"),
        (F.avg(flag(F.col("orders") > 1)) * 100).alias("repeat_rate_pct"),
    )
    # one row per month
    previous = F.lag("customers", 1).over(Window.partitionBy(F.lit(1)).orderBy("cohort"))
    return cohorts.withColumn("customer_growth", ratio(F.col("customers"), previous) - 1)


def delay_quartiles_vs_review(valid: DataFrame) -> DataFrame:
    """Mean review score per quartile of the delivery delay."""
    known = valid.filter(F.col("delivery_delay_days").isNotNull() & F.col("review_score").isNotNull()).select(
        F.col("delivery_delay_days").cast("double").alias("delay"), "review_score"
    )
    fences = wide_quantiles(
        exact_quantiles(known, [], "delay", [0.25, 0.5, 0.75]),
        [],
        {0.25: "q1", 0.5: "q2", 0.75: "q3"},
    )
    quartile = (
        F.when(F.col("delay") <= F.col("q1"), 1)
        .when(F.col("delay") <= F.col("q2"), 2)
        .when(F.col("delay") <= F.col("q3"), 3)
        .otherwise(4)
    )
    return (
        known.withColumn("_one", F.lit(1))
        .join(F.broadcast(fences.withColumn("_one", F.lit(1))), "_one")
        .groupBy(quartile.alias("delay_quartile"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg("review_score").alias("avg_review_score"),
            F.avg("delay").alias("avg_delay_days"),
        )
    )


def domain_summary(flags: DataFrame, domain: str = "domain", selected: str = "flag_selected") -> DataFrame:
    return flags.groupBy(domain).agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(selected), F.lit(0)).alias("selected")
    )


def overview_totals(panel: DataFrame) -> DataFrame:
    """Totals of the period table; its length is bounded by the calendar."""
    return panel.agg(
        total(F.col("monthly_revenue")).alias("total_revenue"),
        F.avg("monthly_revenue").alias("avg_revenue"),
        F.median("monthly_revenue").alias("median_revenue"),
        F.count(F.lit(1)).alias("n_months"),
    )
