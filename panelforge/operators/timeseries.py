"""Window features of a panel: lags, rolling statistics, growth, decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelforge.config import Settings
from panelforge.functions import rows
from panelforge.functions.guards import ratio


def series(keys: list[str] | None = None, ds: str = "ds") -> WindowSpec:
    """Window over one series in time order."""
    return Window.partitionBy(*(keys or [])).orderBy(ds)


def lag_columns(w: WindowSpec, periods, target="monthly_revenue", orders="monthly_orders") -> dict[str, Column]:
    out = {}
    for n in periods:
        out[f"revenue_lag_{n}"] = F.lag(target, n).over(w)
        out[f"orders_lag_{n}"] = F.lag(orders, n).over(w)
    return out


def rolling_columns(w: WindowSpec, sizes, target="monthly_revenue") -> dict[str, Column]:
    """Mean and sample deviation of the n rows before; NULL unless all n are known."""
    out = {}
    for n in sizes:
        frame = w.rowsBetween(-n, -1)
        full = F.count(target).over(frame) == n
        out[f"revenue_rolling_mean_{n}"] = F.when(full, F.avg(target).over(frame))
        out[f"revenue_rolling_std_{n}"] = F.when(full, F.stddev_samp(target).over(frame))
    return out


def growth_columns(w: WindowSpec, target="monthly_revenue") -> dict[str, Column]:
    def change(n):
        return ratio(F.col(target), F.lag(target, n).over(w)) - 1

    return {"revenue_mom_growth": change(1), "revenue_yoy_growth": change(12)}


def lag_features(panel: DataFrame, keys=None, periods=(1, 2, 3, 6, 12)) -> DataFrame:
    return panel.withColumns(lag_columns(series(keys), periods))


def rolling_features(panel: DataFrame, keys=None, sizes=(3, 6)) -> DataFrame:
    return panel.withColumns(rolling_columns(series(keys), sizes))


def growth_features(panel: DataFrame, keys=None) -> DataFrame:
    return panel.withColumns(growth_columns(series(keys)))


def calendar_densify(panel: DataFrame, keys: list[str] | None = None, ds: str = "ds", grain: str = "1 MONTH") -> DataFrame:
    """Adds the missing periods of each series between its first and last one; ``grain`` is their length."""
    keys = keys or []
    spine = (
        panel.groupBy(*keys)
        .agg(F.min(ds).alias("_a"), F.max(ds).alias("_b"))
        .filter(F.col("_a").isNotNull())
        .select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {grain}"))).alias(ds))
    )
    return spine.join(panel, [*keys, ds], "left")


def add_time_series_features(
    panel: DataFrame,
    settings: Settings = Settings(),
    keys: list[str] | None = None,
    calendar: bool = False,
) -> DataFrame:
    """Lags, rolling statistics, growth and calendar columns in one sorted pass.

    Lags count rows; with ``calendar=True`` missing months are filled in first,
    so that they count months.
    """
    if calendar:
        panel = calendar_densify(panel, keys)
    w = series(keys)
    return panel.withColumns(
        {
            **lag_columns(w, settings.lag_periods),
            **rolling_columns(w, settings.rolling_windows),
            **growth_columns(w),
            **rows.cyclical(F.col("ds")),
        }
    )


def forward_fill(df: DataFrame, columns: list[str], keys: list[str] | None = None, ds: str = "ds") -> DataFrame:
    """Last known value; leading gaps take the next known one."""
    w = series(keys, ds)
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after))
            for c in columns
        }
    )


def difference(panel: DataFrame, keys=None, target="monthly_revenue") -> DataFrame:
    return panel.withColumn("revenue_diff", F.col(target) - F.lag(target, 1).over(series(keys)))


def cumulative_share(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Share of the total in percent and its running sum, largest value first, ties in the order of the other columns."""
    whole = Window.partitionBy(*(keys or []))
    ties = [c for c in df.columns if c != value and c not in (keys or [])]
    running = whole.orderBy(F.desc(value), *ties).rowsBetween(Window.unboundedPreceding, 0)
    share = ratio(F.col(value) * 100, F.sum(value).over(whole))
    return df.withColumn("share_pct", share).withColumn("cumulative_pct", F.sum("share_pct").over(running))


def acf(panel: DataFrame, keys: list[str] | None = None, target="monthly_revenue", max_lag: int = 12) -> DataFrame:
    """Autocorrelation of lags 0…min(max_lag, n−1) of each series."""
    keys = keys or []
    w = series(keys)
    whole = Window.partitionBy(*keys)
    known = panel.filter(F.col(target).isNotNull()).select(*keys, "ds", F.col(target).cast("double").alias("y"))
    centred = known.withColumns({"_d": F.col("y") - F.avg("y").over(whole), "_n": F.count("y").over(whole)})
    products = centred.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(w) for k in range(1, max_lag + 1)})
    sums = products.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.sum(F.col("_d") * F.col("_d")).alias("_p0"),
        *[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(1, max_lag + 1)],
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_p{k}").alias("p")) for k in range(max_lag + 1)])
    return (
        sums.select(*keys, "n", F.col("_p0"), F.explode(pairs).alias("_x"))
        .filter(F.col("_x.lag") < F.col("n"))
        .select(*keys, "n", F.col("_x.lag").alias("lag"), F.try_divide(F.col("_x.p"), F.col("_p0")).alias("acf"))
    )


def pacf(panel: DataFrame, keys: list[str] | None = None, target="monthly_revenue", max_lag: int = 12) -> DataFrame:
    """Partial autocorrelation by the Durbin–Levinson recursion.

    The recursion runs on the at most ``max_lag + 1`` autocorrelations of each
    series, held in one array per series, as column expressions.
    """
    keys = keys or []
    table = acf(panel, keys, target, max_lag)
    rho = (
        table.groupBy(*keys, "n")
        .agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("_a"))
        .withColumn("_r", F.expr("transform(_a, x -> x.acf)"))
    )
    out = rho.withColumn("_phi1", F.array(F.try_element_at("_r", F.lit(2))))
    for k in range(2, max_lag + 1):
        prev = f"_phi{k - 1}"
        # phi_kk = (r_k - sum phi_{k-1,j} r_{k-j}) / (1 - sum phi_{k-1,j} r_j)
        numerator = f"aggregate(sequence(1, {k - 1}), 0D, (s, j) -> s + try_element_at({prev}, j) * try_element_at(_r, {k} - j + 1))"
        denominator = f"aggregate(sequence(1, {k - 1}), 0D, (s, j) -> s + try_element_at({prev}, j) * try_element_at(_r, j + 1))"
        out = out.withColumn("_kk", F.expr(f"try_divide(try_element_at(_r, {k + 1}) - {numerator}, 1D - {denominator})"))
        out = out.withColumn(
            f"_phi{k}",
            F.expr(
                f"concat(transform(sequence(1, {k - 1}), j -> try_element_at({prev}, j) - _kk * try_element_at({prev}, {k} - j)), array(_kk))"
            ),
        )
    values = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_element_at(f"_phi{k}", F.lit(k)).alias("pacf")) for k in range(1, max_lag + 1)])
    return (
        out.select(*keys, "n", F.explode(values).alias("_x"))
        .filter(F.col("_x.lag") <= F.floor(F.col("n") / 2) - 1)
        .select(*keys, F.col("_x.lag").alias("lag"), F.col("_x.pacf").alias("pacf"))
    )


def seasonal_decompose(
    panel: DataFrame, keys: list[str] | None = None, target="monthly_revenue", period: int = 12
) -> DataFrame:
    """Additive trend, seasonal and residual parts; series under two periods are left out.

    The trend is the centred moving average with half weights at both ends.
    """
    keys = keys or []
    w = series(keys)
    whole = Window.partitionBy(*keys)
    half = period // 2
    rows_in = panel.select(*keys, "ds", F.col(target).cast("double").alias("observed")).withColumns(
        {"_pos": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole)}
    ).filter(F.col("_n") >= 2 * period)
    if period % 2 == 0:
        inner = F.sum("observed").over(w.rowsBetween(-(half - 1), half - 1))
        ends = F.lag("observed", half).over(w) + F.lead("observed", half).over(w)
        trend = (inner + ends * 0.5) / period
    else:
        trend = F.avg("observed").over(w.rowsBetween(-half, half))
    reach = (F.col("_pos") >= half) & (F.col("_pos") < F.col("_n") - half)
    trended = rows_in.withColumn("trend", F.when(reach, trend)).withColumn("_phase", F.col("_pos") % period)
    phase_mean = F.avg(F.col("observed") - F.col("trend")).over(Window.partitionBy(*keys, "_phase"))
    # phases weigh equally in the re-centring, however many rows they have
    first_of_phase = F.when(F.col("_pos") < period, F.col("_s"))
    return (
        trended.withColumn("_s", phase_mean)
        .withColumn("seasonal", F.col("_s") - F.avg(first_of_phase).over(whole))
        .withColumn("resid", F.col("observed") - F.col("trend") - F.col("seasonal"))
        .select(*keys, "ds", "observed", "trend", "seasonal", "resid")
    )
