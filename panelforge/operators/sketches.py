"""Sketches of rows per key and day, merged to any coarser grain instead of reading the rows again.

A table of sketches has a row per key and day, whatever the number of rows of that
day: their number, sums, a HyperLogLog sketch of each column of ids and a KLL
sketch of each column of values. Months, quarters, whole periods and keys together are
merges of its rows. A new day is one more row, written by upsert.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the sketches. A HyperLogLog sketch of 2 ** 12 slots has a standard error of 1.6 %;
#: ranks by a KLL sketch of 400 are right to 0.7 % in 99 of 100 cases.
HLL_BITS, KLL_SIZE = 12, 400


def _period(ts: str, grain: str) -> Column:
    return F.to_date(F.date_trunc(grain, F.col(ts)))


def sketch_table(
    rows: DataFrame, keys: list[str], ts: str, values: list[str], ids: list[str] | None = None, grain: str = "day"
) -> DataFrame:
    """``keys…, ds, n, sum_v, kll_v…, hll_i…``. Missing values and ids are in no sketch; rows without a time are left out.

    Takes a stream with a watermark as well.
    """
    aggregates = [F.count(F.lit(1)).alias("n")]
    for v in values:
        value = F.col(v).cast("double")
        known = F.when(~F.isnan(value), value)
        aggregates += [F.coalesce(F.sum(known), F.lit(0.0)).alias(f"sum_{v}"), F.kll_sketch_agg_double(known, F.lit(KLL_SIZE)).alias(f"kll_{v}")]
    aggregates += [F.hll_sketch_agg(F.col(i), F.lit(HLL_BITS)).alias(f"hll_{i}") for i in ids or []]
    return rows.filter(F.col(ts).isNotNull()).groupBy(*keys, _period(ts, grain).alias("ds")).agg(*aggregates)


def merge_sketches(table: DataFrame, by: list[str], grain: str | None = None) -> DataFrame:
    """Rows of a sketch table merged to ``by`` and a coarser ``grain``, or over all time."""
    aggregates = []
    for c in table.columns:
        if c == "n" or c.startswith("sum_"):
            aggregates.append(F.sum(c).alias(c))
        elif c.startswith("kll_"):
            aggregates.append(F.kll_merge_agg_double(F.col(c)).alias(c))
        elif c.startswith("hll_"):
            aggregates.append(F.hll_union_agg(c).alias(c))
    groups = [*by, *([_period("ds", grain).alias("ds")] if grain else [])]
    return table.groupBy(*groups).agg(*aggregates)


def _known(sketch: str) -> Column:
    return F.kll_sketch_get_n_double(F.col(sketch))


def quantile(sketch: str, p: float) -> Column:
    """Approximate quantile; NULL of a sketch without values."""
    return F.when(_known(sketch) > 0, F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(p)))


def rank(sketch: str, value: float) -> Column:
    """Approximate share of values up to ``value``."""
    return F.when(_known(sketch) > 0, F.kll_sketch_get_rank_double(F.col(sketch), F.lit(float(value))))


def estimates(table: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Readable columns of a sketch table: ``n, sum_v, mean_v, p25_v…, approx_i``."""
    out = [F.col(c) for c in table.columns if not c.startswith(("kll_", "hll_"))]
    for c in table.columns:
        name = c[4:]
        if c.startswith("kll_"):
            out.append(F.try_divide(F.col(f"sum_{name}"), _known(c)).alias(f"mean_{name}"))
            out += [quantile(c, p).alias(f"p{round(p * 100):02d}_{name}") for p in quantiles]
        elif c.startswith("hll_"):
            out.append(F.hll_sketch_estimate(c).alias(f"approx_{name}"))
    return table.select(*out)


def sketch_psi(base: DataFrame, current: DataFrame, value: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """``current``'s own columns without sketches, and ``psi`` of a value against the one-row ``base``.

    Bins are of equal width over the base's range, which a KLL sketch keeps exactly,
    as for the rows; shares are differences of ranks. A side without values gives 0.
    The driver reads the base's range and its shares, a number per bin.
    """
    sketch = f"kll_{value}"
    plain = [F.col(c) for c in current.columns if not c.startswith(("kll_", "hll_"))]
    ends = base.select(quantile(sketch, 0.0).alias("low"), quantile(sketch, 1.0).alias("high")).first()
    if ends is None or ends["low"] is None:
        return current.select(*plain, F.lit(0.0).alias("psi"))
    edges = [ends["low"] + (ends["high"] - ends["low"]) * i / bins for i in range(bins + 1)]
    # ranks count values up to the point; the outer edges are widened by 1e-9
    edges[0], edges[-1] = edges[0] - 1e-9, edges[-1] + 1e-9

    def shares() -> list[Column]:
        below = [rank(sketch, e) for e in edges]
        return [(F.greatest(b - a, F.lit(0.0)) + eps) for a, b in zip(below, below[1:])]

    held = base.select(*shares()).first()
    terms = [(c - b) * F.log(c / b) for c, b in zip(shares(), held)]
    return current.select(*plain, F.coalesce(reduce(lambda a, b: a + b, terms), F.lit(0.0)).alias("psi"))


def sketch_drift(table: DataFrame, value: str, train_end: str, grain: str = "month", bins: int = 10, threshold: float = 0.25) -> DataFrame:
    """``ds, n, psi, drifted`` of every later period against all days up to ``train_end``, from sketches only."""
    end = F.to_date(F.lit(train_end))
    base = merge_sketches(table.filter(F.col("ds") <= end), [])
    later = merge_sketches(table.filter(F.col("ds") > end), [], grain)
    scored = sketch_psi(base, later, value, bins)
    return scored.select("ds", "n", "psi", (F.col("psi") > threshold).alias("drifted"))
