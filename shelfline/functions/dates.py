"""Date and time labels as native column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday short names, Sunday first (day index 0 = Sunday).
DAY_SHORT = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
DAY_LONG = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def month_label(ts) -> Column:
    """TO_CHAR(ts, 'YYYY-MM')."""
    return F.date_format(_c(ts), "yyyy-MM")


def month_start(ts) -> Column:
    """DATE_TRUNC('month', ts) as a DATE."""
    return F.trunc(_c(ts).cast("date"), "month")


def dow(ts) -> Column:
    """Day of week, 0 = Sunday (Spark's dayofweek is 1 = Sunday)."""
    return (F.dayofweek(_c(ts)) - F.lit(1)).cast("bigint")


def hour(ts) -> Column:
    return F.hour(_c(ts)).cast("bigint")


def day_short(dow_col) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_SHORT]), _c(dow_col).cast("int") + F.lit(1))


def day_long(dow_col) -> Column:
    """Name of a day of week, 0 = Sunday."""
    return F.element_at(F.array(*[F.lit(d) for d in DAY_LONG]), _c(dow_col).cast("int") + F.lit(1))


def day_name(ts) -> Column:
    """TO_CHAR(ts, 'Day') without the blank padding (callers strip it anyway)."""
    return F.date_format(_c(ts), "EEEE")


def hour_label(h) -> Column:
    """'HH:00', zero padded."""
    return F.concat(F.lpad(_c(h).cast("string"), 2, "0"), F.lit(":00"))


def hour_label_unpadded(h) -> Column:
    return F.concat(_c(h).cast("string"), F.lit(":00"))


def ampm_label(h) -> Column:
    """0 -> 0AM, 11 -> 11AM, 12 -> 12PM, 17 -> 5PM."""
    h = _c(h)
    return (F.when(h < 12, F.concat(h.cast("string"), F.lit("AM")))
            .when(h == 12, F.lit("12PM"))
            .otherwise(F.concat((h - 12).cast("string"), F.lit("PM"))))


def hours_between(start, end) -> Column:
    """EXTRACT(EPOCH FROM end - start) / 3600 as a double."""
    return (F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))) / F.lit(3.6e9)


def future_months(last_period, horizon) -> Column:
    """'yyyy-MM' labels of the ``horizon`` calendar months after ``last_period``."""
    last = _c(last_period)
    return F.transform(F.sequence(F.lit(1), _c(horizon) if not isinstance(horizon, int) else F.lit(horizon)),
                       lambda i: F.date_format(F.add_months(last, i), "yyyy-MM"))
