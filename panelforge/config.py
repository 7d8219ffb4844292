"""Settings of the analytics and forecasting plans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Settings:
    """Fixed default values; override with :func:`dataclasses.replace`."""

    target: str = "monthly_revenue"
    horizon: int = 3
    target_mape: float = 10.0

    # time splits, inclusive upper bounds, "yyyy-MM"
    train_end: str = "2018-04"
    val_end: str = "2018-07"
    live_month: str = "2018-08"

    # time-series features
    lag_periods: tuple[int, ...] = (1, 2, 3, 6, 12)
    rolling_windows: tuple[int, ...] = (3, 6)

    # cleaning
    clip_low: float = 0.01
    clip_high: float = 0.99
    fill_strategy: str = "median"
    rare_threshold: float = 0.02
    scaling: str = "standard"

    # feature selection
    missing_threshold: float = 0.60
    psi_threshold: float = 0.25
    psi_bins: int = 5
    correlation_threshold: float = 0.95
    univariate_threshold: float = 0.10
    wrapper_folds: int = 3
    min_features: int = 5
    mi_bins: int = 8

    # tuning: inclusive ranges, the learning rate is drawn on a log scale
    tune_trials: int = 50
    tune_seconds: float = 600.0
    tune_metric: str = "rmse"
    tune_folds: int = 3
    tune_space: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {
            "maxIter": (100, 1000),
            "stepSize": (0.01, 0.1),
            "maxBins": (15, 63),
            "maxDepth": (3, 8),
            "minInstancesPerNode": (5, 30),
            "subsamplingRate": (0.6, 1.0),
            "featureFraction": (0.6, 1.0),
            "minInfoGain": (0.0, 1.0),
            "minWeightFractionPerNode": (0.0, 0.05),
        }
    )

    # business assumptions
    manual_hours_per_month: float = 16.0
    analyst_hourly_cost: float = 80.0
    planning_error_cost_rate: float = 0.10
    baseline_mape: float = 7.12

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)


#: One-to-one mapping of raw file names; a missing file is skipped on load.
RAW_FILES = {
    "orders": "orders.csv",
    "order_items": "order_items.csv",
    "order_payments": "order_payments.csv",
    "order_reviews": "order_reviews.csv",
    "customers": "customers.csv",
    "products": "products.csv",
    "sellers": "sellers.csv",
    "category_trans": "category_trans.csv",
    "geolocation": "geolocation.csv",
}
