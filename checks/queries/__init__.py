"""All registered queries; importing a module registers its queries."""

from checks.queries import data, reports, series, cleaning, selection, models, per_key, arima, governance, live, stored  # noqa: F401
