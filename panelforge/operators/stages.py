"""Panel cleaning as MLlib stages, to sit in a ``Pipeline`` with a model and be saved with it."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.config import Settings
from panelforge.functions.guards import finite, zero_if_null
from panelforge.operators.cleaning import CleaningModel, fit_cleaning


class _CleaningParams(Params):
    keys = Param(Params._dummy(), "keys", "columns that identify a series", TypeConverters.toListString)
    clipLow = Param(Params._dummy(), "clipLow", "lower quantile to clip at", TypeConverters.toFloat)
    clipHigh = Param(Params._dummy(), "clipHigh", "upper quantile to clip at", TypeConverters.toFloat)
    fillStrategy = Param(Params._dummy(), "fillStrategy", "median, mean, forward_fill or zero", TypeConverters.toString)
    rareThreshold = Param(Params._dummy(), "rareThreshold", "share below which a category is other", TypeConverters.toFloat)
    scaling = Param(Params._dummy(), "scaling", "standard, minmax or none", TypeConverters.toString)
    fitOn = Param(Params._dummy(), "fitOn", "SQL condition of the rows to fit on, all if empty", TypeConverters.toString)

    def __init__(self, *args):
        super().__init__(*args)
        plain = Settings()
        self._setDefault(
            keys=[],
            clipLow=plain.clip_low,
            clipHigh=plain.clip_high,
            fillStrategy=plain.fill_strategy,
            rareThreshold=plain.rare_threshold,
            scaling=plain.scaling,
            fitOn="",
        )

    def settings(self) -> Settings:
        return Settings(
            clip_low=self.getOrDefault("clipLow"),
            clip_high=self.getOrDefault("clipHigh"),
            fill_strategy=self.getOrDefault("fillStrategy"),
            rare_threshold=self.getOrDefault("rareThreshold"),
            scaling=self.getOrDefault("scaling"),
        )


class PanelCleaner(Estimator, _CleaningParams, DefaultParamsReadable, DefaultParamsWritable):
    """Clips, imputes, groups rare categories, encodes and scales; target, period and keys stay as they are."""

    @keyword_only
    def __init__(self, *, keys=None, clipLow=None, clipHigh=None, fillStrategy=None, rareThreshold=None, scaling=None, fitOn=None):
        super().__init__()
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, keys=None, clipLow=None, clipHigh=None, fillStrategy=None, rareThreshold=None, scaling=None, fitOn=None):
        return self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, settings: Settings, keys: list[str] | None = None, fit_on: str = "") -> PanelCleaner:
        return cls(
            keys=keys or [],
            clipLow=settings.clip_low,
            clipHigh=settings.clip_high,
            fillStrategy=settings.fill_strategy,
            rareThreshold=settings.rare_threshold,
            scaling=settings.scaling,
            fitOn=fit_on,
        )

    def _fit(self, dataset: DataFrame) -> PanelCleanerModel:
        condition = self.getOrDefault("fitOn")
        rows = dataset.filter(F.expr(condition)) if condition else dataset
        fitted = fit_cleaning(rows, self.settings(), self.getOrDefault("keys"))
        return self._copyValues(PanelCleanerModel.of(fitted))


class PanelCleanerModel(Model, _CleaningParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted cleaning; ``state`` holds the rows of its parameter table, a few for every column of the panel."""

    state = Param(Params._dummy(), "state", "fitted parameters as JSON rows", TypeConverters.toString)

    def __init__(self):
        super().__init__()

    @classmethod
    def of(cls, fitted: CleaningModel, keys: list[str] | None = None) -> PanelCleanerModel:
        model = cls()
        model._set(state=json.dumps(fitted.rows()))
        return model if keys is None else model._set(keys=keys)

    def cleaning(self) -> CleaningModel:
        return CleaningModel.from_rows(json.loads(self.getOrDefault("state")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.cleaning().transform(dataset, self.getOrDefault("keys"))


class ZeroFill(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Missing, not-a-number and infinite values of ``inputCols`` become 0, as the models take them."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({c: zero_if_null(finite(F.col(c))) for c in self.getInputCols()})
