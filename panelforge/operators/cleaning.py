"""Cleaning of a panel: clip, impute, group rare categories, encode, scale.

Fitting reads the data once per step and keeps a few numbers per column; the
fitted parameters are a small ``(step, column, param, value, label)`` table.
Applying them is one projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.config import Settings
from panelforge.functions.guards import clip, ratio
from panelforge.operators.features import to_long
from panelforge.operators.quantiles import column_quantiles
from panelforge.operators.timeseries import forward_fill

NOT_CLEANED = ("year_month", "ds", "monthly_revenue")
PARAM_SCHEMA = "step string, column string, param string, value double, label string"


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


# ---- clip ---------------------------------------------------------------


def fit_clip(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """``(column, low, high)`` quantile bounds."""
    q = column_quantiles(df, columns, [low, high])
    return q.groupBy(F.col("feature").alias("column")).agg(
        F.min("quantile").alias("low"), F.max("quantile").alias("high")
    )


def apply_clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns})


def outlier_clip(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    return apply_clip(df, {r["column"]: (r["low"], r["high"]) for r in fit_clip(df, columns, low, high).collect()})


# ---- impute -------------------------------------------------------------


def fit_impute(df: DataFrame, columns: list[str], strategy: str) -> DataFrame:
    """``(column, fill)``; nothing to fit for forward_fill and zero."""
    if strategy == "median":
        return column_quantiles(df, columns, [0.5]).select(F.col("feature").alias("column"), F.col("quantile").alias("fill"))
    if strategy == "mean":
        means = df.agg(*[F.avg(c).alias(c) for c in columns])
        return to_long(means, columns).select(F.col("feature").alias("column"), F.col("value").alias("fill"))
    if strategy in ("forward_fill", "zero"):
        return df.sparkSession.createDataFrame([], "column string, fill double")
    raise ValueError(f"unknown fill strategy: {strategy}")


def apply_impute(
    df: DataFrame, columns: list[str], strategy: str, fills: dict[str, float], keys=None, ds: str = "ds"
) -> DataFrame:
    if strategy == "forward_fill":
        return forward_fill(df, columns, keys, ds)
    values = {c: 0.0 for c in columns} if strategy == "zero" else fills
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items() if c in df.columns and v is not None}
    )


def impute(df: DataFrame, columns: list[str], strategy: str = "median", keys=None) -> DataFrame:
    fills = {r["column"]: r["fill"] for r in fit_impute(df, columns, strategy).collect()}
    return apply_impute(df, columns, strategy, fills, keys)


# ---- rare categories ----------------------------------------------------


def category_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, category, share)`` over the non-null values of each column."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    counts = (
        text.unpivot([], [F.col(c) for c in columns], "column", "category")
        .filter(F.col("category").isNotNull())
        .groupBy("column", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("column").agg(F.sum("n").alias("n_total"))
    return counts.join(totals, "column").select("column", "category", ratio(F.col("n"), F.col("n_total")).alias("share"))


def fit_rare(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """Categories to keep; at most 1 / threshold per column."""
    return category_shares(df, columns).filter(F.col("share") >= threshold)


def apply_rare(df: DataFrame, keep: dict[str, list[str]]) -> DataFrame:
    """Categories outside the list, and NULL, become "other"."""
    return df.withColumns(
        {
            c: F.when(F.col(c).isin(values), F.col(c)).otherwise(F.lit("other"))
            for c, values in keep.items()
            if c in df.columns
        }
    )


def rare_category_group(df: DataFrame, columns: list[str], threshold: float = 0.02) -> DataFrame:
    if threshold <= 0:
        # every category stays, without a list of them; NULL is "other" as always
        return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("other")) for c in columns})
    keep: dict[str, list[str]] = {c: [] for c in columns}
    for r in fit_rare(df, columns, threshold).collect():
        keep[r["column"]].append(r["category"])
    return apply_rare(df, keep)


# ---- one-hot ------------------------------------------------------------


#: Columns that a wide table can have, and so categories that the driver reads.
MOST_CATEGORIES = 10_000


def fit_one_hot(df: DataFrame, columns: list[str], drop_first: bool = False) -> dict[str, list[str]]:
    """The categories of each column, one per column of the wide table.

    More than :data:`MOST_CATEGORIES` make no table and are refused; :func:`one_hot_long`
    takes any number, and grouping rare categories first makes them fewer.
    """
    text = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in columns])
    values = text.unpivot([], [F.col(c) for c in columns], "column", "category").distinct()
    found: dict[str, list[str]] = {c: [] for c in columns}
    listed = values.limit(MOST_CATEGORIES + 1).collect()
    if len(listed) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories in {columns}: use one_hot_long, or group rare ones first")
    for r in listed:
        found[r["column"]].append(r["category"])
    out = {}
    for c, categories in found.items():
        categories.sort()
        out[c] = categories[1:] if drop_first and len(categories) > 1 else categories
    return out


def apply_one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    dummies = {
        f"{c}__{v}": F.when(F.coalesce(F.col(c).cast("string"), F.lit("nan")) == v, 1).otherwise(0)
        for c, values in categories.items()
        if c in df.columns
        for v in values
    }
    if not dummies:
        return df
    return df.select(*[c for c in df.columns if c not in categories], *[e.alias(n) for n, e in dummies.items()])


def one_hot(df: DataFrame, columns: list[str], drop_first: bool = False) -> DataFrame:
    return apply_one_hot(df, fit_one_hot(df, columns, drop_first))


def one_hot_long(df: DataFrame, columns: list[str], ids: list[str]) -> DataFrame:
    """The non-zero dummies as ``(ids…, feature, value)`` rows, for any number of categories."""
    text = df.select(*ids, *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(f"_{c}") for c in columns])
    pairs = F.array(*[F.concat(F.lit(f"{c}__"), F.col(f"_{c}")) for c in columns])
    return text.select(*ids, F.explode(pairs).alias("feature"), F.lit(1).alias("value"))


# ---- scale --------------------------------------------------------------


def fit_scale(df: DataFrame, columns: list[str], method: str, exclude_binary: bool = True) -> DataFrame:
    """``(column, shift, scale)``; columns with at most two distinct values are left out.

    Two values are found by comparing each value with the extremes, which needs
    no distinct count. A constant column gets scale 1.
    """
    if method == "none":
        return df.sparkSession.createDataFrame([], "column string, shift double, scale double")
    if method not in ("standard", "minmax"):
        raise ValueError(f"unknown scaling method: {method}")
    spread = df.agg(
        *[
            F.struct(
                F.avg(c).alias("avg"),
                F.stddev_pop(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in columns
        ]
    )
    stats = spread.unpivot([], [F.col(c) for c in columns], "column", "s").select("column", "s.*")
    if exclude_binary:
        # continuous = some value lies strictly between the extremes
        ends = stats.select(F.col("column").alias("feature"), "min", "max")
        between = (
            to_long(df, columns)
            .join(F.broadcast(ends), "feature")  # one row per column
            .groupBy(F.col("feature").alias("column"))
            .agg(F.bool_or((F.col("value") > F.col("min")) & (F.col("value") < F.col("max"))).alias("many"))
            .filter("many")
            .drop("many")
        )
        stats = stats.join(between, "column")
    shift, scale = ("avg", F.col("std")) if method == "standard" else ("min", F.col("max") - F.col("min"))
    return stats.select(
        "column", F.col(shift).alias("shift"), F.when(scale == 0, 1.0).otherwise(scale).alias("scale")
    )


def apply_scale(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {c: (F.col(c).cast("double") - F.lit(a)) / F.lit(b) for c, (a, b) in scales.items() if c in df.columns}
    )


def scale(df: DataFrame, columns: list[str], method: str = "standard", exclude_binary: bool = True) -> DataFrame:
    rows = fit_scale(df, columns, method, exclude_binary).collect()
    return apply_scale(df, {r["column"]: (r["shift"], r["scale"]) for r in rows})


# ---- the whole chain ----------------------------------------------------


@dataclass
class CleaningModel:
    """Fitted cleaning parameters; ``transform`` never refits."""

    strategy: str
    clip: dict[str, tuple[float, float]] = field(default_factory=dict)
    numeric: list[str] = field(default_factory=list)
    fill: dict[str, float] = field(default_factory=dict)
    keep: dict[str, list[str]] = field(default_factory=dict)
    categories: dict[str, list[str]] = field(default_factory=dict)
    scales: dict[str, tuple[float, float]] = field(default_factory=dict)

    def _head(self, panel: DataFrame, keys) -> DataFrame:
        df = apply_clip(panel, self.clip)
        df = apply_impute(df, self.numeric, self.strategy, self.fill, keys)
        return apply_one_hot(apply_rare(df, self.keep), self.categories)

    def transform(self, panel: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """Keys, period and target first, then the cleaned features in a fixed order."""
        cleaned = apply_scale(self._head(panel, keys), self.scales)
        lead = [c for c in [*(keys or []), *NOT_CLEANED] if c in cleaned.columns]
        return cleaned.select(*lead, *[c for c in cleaned.columns if c not in lead])

    def rows(self) -> list[tuple]:
        out: list[tuple] = [("impute", "*", "strategy", None, self.strategy)]
        for c, (lo, hi) in self.clip.items():
            out += [("clip", c, "low", lo, None), ("clip", c, "high", hi, None)]
        out += [("numeric", c, "column", None, None) for c in self.numeric]
        out += [("impute", c, "fill", v, None) for c, v in self.fill.items()]
        for step, table in (("rare", self.keep), ("one_hot", self.categories)):
            for c, values in table.items():
                out.append((step, c, "column", None, None))
                out += [(step, c, "category", float(i), v) for i, v in enumerate(values)]
        for c, (a, b) in self.scales.items():
            out += [("scale", c, "shift", a, None), ("scale", c, "scale", b, None)]
        return out

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), PARAM_SCHEMA)

    @classmethod
    def from_frame(cls, params: DataFrame) -> "CleaningModel":
        return cls.from_rows([(r["step"], r["column"], r["param"], r["value"], r["label"]) for r in params.collect()])

    @classmethod
    def from_rows(cls, rows: list[tuple]) -> "CleaningModel":
        model = cls(strategy="median")
        pairs: dict[tuple[str, str], dict[str, float]] = {}
        listed: dict[tuple[str, str], list[tuple[float, str]]] = {}
        for step, column, param, value, label in rows:
            if param == "strategy":
                model.strategy = label
            elif step == "numeric":
                model.numeric.append(column)
            elif step == "impute":
                model.fill[column] = value
            elif step in ("rare", "one_hot"):
                values = listed.setdefault((step, column), [])
                if param == "category":
                    values.append((value, label))
            else:
                pairs.setdefault((step, column), {})[param] = value
        for (step, column), p in pairs.items():
            if step == "clip":
                model.clip[column] = (p["low"], p["high"])
            else:
                model.scales[column] = (p["shift"], p["scale"])
        for (step, column), values in listed.items():
            target = model.keep if step == "rare" else model.categories
            target[column] = [v for _, v in sorted(values)]
        return model


def fit_cleaning(train: DataFrame, settings: Settings = Settings(), keys: list[str] | None = None) -> CleaningModel:
    """Fits the five steps in order, each on the output of the steps before it."""
    exclude = {*(keys or []), *NOT_CLEANED}
    numeric = numeric_columns(train, exclude)
    text = text_columns(train, exclude)
    model = CleaningModel(strategy=settings.fill_strategy, numeric=numeric)
    bounds = fit_clip(train, numeric, settings.clip_low, settings.clip_high).collect()
    model.clip = {r["column"]: (r["low"], r["high"]) for r in bounds}
    clipped = apply_clip(train, model.clip)
    model.fill = {r["column"]: r["fill"] for r in fit_impute(clipped, numeric, settings.fill_strategy).collect()}
    if text:
        model.keep = {c: [] for c in text}
        for r in fit_rare(train, text, settings.rare_threshold).collect():
            model.keep[r["column"]].append(r["category"])
        # encoding follows grouping, so the categories are the kept ones and "other"
        model.categories = fit_one_hot(apply_rare(train, model.keep), text)
    head = model._head(train, keys)
    model.scales = {
        r["column"]: (r["shift"], r["scale"])
        for r in fit_scale(head, numeric_columns(head, exclude), settings.scaling).collect()
        if r["shift"] is not None
    }
    return model


def clean_panel(
    panel: DataFrame,
    settings: Settings = Settings(),
    keys: list[str] | None = None,
    model: CleaningModel | None = None,
    fit: bool = True,
    fit_on: DataFrame | None = None,
) -> tuple[DataFrame, CleaningModel]:
    """Cleaned panel and the fitted parameters.

    ``fit_on`` names the rows to fit on (the training split); by default all.
    """
    if not fit and model is None:
        raise ValueError("a fitted model is needed when fit=False")
    if fit:
        model = fit_cleaning(panel if fit_on is None else fit_on, settings, keys)
    return model.transform(panel, keys), model
