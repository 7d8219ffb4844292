"""Exact quantiles with linear interpolation, spread over many tasks.

The built-in exact ``percentile`` keeps every distinct value of a group in one
task. Here equal values are first folded to one (group, value, count) row, the
bucket that holds each wanted rank is found on bucket counts, that bucket is cut
once more, and only the values of one slice are ranked. No task holds a whole
group, also if its values lie close together, and the answer equals
``percentile``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.guards import all_known, finite
from panelforge.operators.features import to_long

#: Buckets per doubling of the value: a bucket spans 0.004 % of its value.
LOG_STEPS = 16384
#: Equal slices of a bucket in the second cut.
LINEAR_STEPS = 65536


def _log_bucket(v: Column) -> Column:
    """Bucket number that never decreases as the value grows."""
    size = F.floor((F.log2(F.abs(v)) + 1100) * LOG_STEPS)
    return F.when(v == 0, F.lit(0).cast("long")).otherwise((F.signum(v) * size).cast("long"))


def _below(group: list[str], order: str) -> Column:
    """Rows of the group in earlier buckets (or with smaller values)."""
    running = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum("_n").over(running) - F.col("_n")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probabilities: list[float],
    weight: str | None = None,
) -> DataFrame:
    """``(keys…, prob, quantile)`` for each probability; key columns must not be NULL.

    ``weight`` is a row multiplicity: a row counts as that many equal rows.
    """
    n = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    # the joins below imply the key and bucket filters on one side; stating them
    # here keeps both uses of the counts identical, so Spark ships them once
    counts = (
        df.select(*keys, finite(F.col(value)).alias("_v"), *([weight] if weight else []))
        .groupBy(*keys, "_v")
        .agg(n.cast("long").alias("_n"))
        .withColumn("_b", _log_bucket(F.col("_v")))
        .filter(all_known([*keys, "_v", "_b"]))
    )

    # the bucket of each wanted rank; a probability asks for its two neighbours
    in_bucket = (F.col("_below") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_n"))
    position = F.col("_prob") * (F.col("_total") - 1)
    wanted = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumns({"_below": _below(keys, "_b"), "_total": F.sum("_n").over(Window.partitionBy(*keys))})
        .withColumn("_prob", F.explode(probs))  # after the window sums, or they would count each row per probability
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
        .filter(in_bucket)
        .groupBy(*keys, "_b", "_rank")
        .agg(
            F.first("_below").alias("_base"),
            F.first("_total").alias("_total"),
            F.first("_lo").alias("_lo"),
            F.first("_hi").alias("_hi"),
        )
    )
    inside = F.col("_rank") - F.col("_base")
    in_slice = (F.col("_below") <= inside) & (inside < F.col("_below") + F.col("_n"))
    width = F.col("_hi") - F.col("_lo")
    slice_of = F.floor(F.try_divide(F.col("_v") - F.col("_lo"), width) * LINEAR_STEPS)
    wanted = (
        counts.join(wanted, [*keys, "_b"])
        .groupBy(*keys, "_b", "_rank", "_base", "_total", F.coalesce(slice_of, F.lit(0)).alias("_s"))
        .agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_below", _below([*keys, "_rank"], "_s"))
        .filter(in_slice)
        .withColumn("_base", F.col("_base") + F.col("_below"))
        .select(*keys, "_b", "_rank", "_base", "_total", "_lo", "_hi")
    )

    # rank the values inside, then bring the neighbours of a probability together
    at = F.col("prob") * (F.col("_total") - 1)
    low = F.max(F.when(F.col("_rank") == F.floor(at), F.col("_v")))
    high = F.max(F.when(F.col("_rank") == F.ceil(at), F.col("_v")))
    return (
        counts.join(wanted, [*keys, "_b"])
        .filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        .withColumn("_below", _below([*keys, "_rank"], "_v"))
        .select("*", F.explode(probs).alias("prob"))
        .filter(in_slice)
        .filter((F.col("_rank") == F.floor(at)) | (F.col("_rank") == F.ceil(at)))
        .groupBy(*keys, "prob")
        .agg((low + (high - low) * F.max(at - F.floor(at))).alias("quantile"))
    )


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """``(feature, prob, quantile)`` for many columns in one job."""
    return exact_quantiles(to_long(df, columns), ["feature"], "value", probabilities)


def wide_quantiles(quantiles: DataFrame, keys: list[str], names: dict[float, str]) -> DataFrame:
    """Quantile rows turned into one named column per probability."""
    return quantiles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n) for p, n in names.items()]
    )
