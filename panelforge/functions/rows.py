"""Row features of an order line: calendar, delivery, payment, product, status.

Each function returns ``{column name: expression}`` so that callers can add a
whole block with one ``withColumns`` (a single Project).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.guards import flag

#: payment flag -> payment type (fixed values)
PAYMENT_FLAGS = {
    "is_credit_card": "credit_card",
    "is_boleto": "boleto",
    "is_voucher": "voucher",
    "is_debit_card": "debit_card",
}


def _second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts)


def whole_days(end: Column, start: Column) -> Column:
    """Elapsed whole 24-hour periods, rounded towards minus infinity.

    Works on wall-clock time: calendar-day difference, less one when the end
    has an earlier time of day.
    """
    borrow = F.when(_second_of_day(end) < _second_of_day(start), 1).otherwise(0)
    return F.datediff(end, start) - borrow


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "month")


def period_start(ts: Column, grain: str = "month") -> Column:
    """First day of the period; ``grain`` is day, week, month, quarter or year."""
    return F.to_date(F.date_trunc(grain, ts))


def calendar(ts: Column) -> dict[str, Column]:
    return {
        "order_year": F.year(ts),
        "order_month": F.month(ts),
        "order_quarter": F.quarter(ts),
        "order_week": F.weekofyear(ts),
        "order_dayofweek": F.weekday(ts),
        "order_dayofmonth": F.dayofmonth(ts),
        "order_hour": F.hour(ts),
        "is_weekend": flag(F.weekday(ts) >= 5),
        "is_end_of_month": flag(F.dayofmonth(ts) >= 25),
        "ds": month_start(ts),
    }


def delivery_days(purchase: Column, delivered: Column, estimated: Column, carrier: Column) -> dict[str, Column]:
    return {
        "delivery_days_actual": whole_days(delivered, purchase),
        "delivery_days_estimated": whole_days(estimated, purchase),
        "carrier_days": whole_days(carrier, purchase),
    }


def delivery_delay(actual: Column, estimated: Column) -> dict[str, Column]:
    """Delay and late flag from day counts that are already columns."""
    return {"delivery_delay_days": actual - estimated, "is_late_delivery": flag(actual - estimated > 0)}


def payment(kind: Column, installments: Column) -> dict[str, Column]:
    flags = {name: flag(kind == value) for name, value in PAYMENT_FLAGS.items()}
    flags["payment_installments_flag"] = flag(installments > 1)
    return flags


def product(length: Column, height: Column, width: Column, price: Column, freight: Column) -> dict[str, Column]:
    return {
        "product_volume_cm3": length * height * width,
        "freight_ratio": freight / (price + freight + 1e-9),
    }


def status(order_status: Column) -> dict[str, Column]:
    return {
        "is_delivered": flag(order_status == "delivered"),
        "is_canceled": flag(order_status == "canceled"),
    }


def cyclical(ds: Column) -> dict[str, Column]:
    angle = 2 * F.pi() * F.month(ds) / 12
    return {
        "month": F.month(ds),
        "quarter": F.quarter(ds),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
        "is_q4": flag(F.quarter(ds) == 4),
        "is_nov_dec": flag(F.month(ds) >= 11),
    }
