"""Time-of-day and weekday patterns.

Hours come from the ``activity`` role (transactions with a real time of day);
weekday/duration marts on rentals use the rental fact.  Both are read through their stored
cells (:mod:`shelfline.operators.cells`), which hold every count and sum these marts need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day_long, day_short
from ..functions.money import money_out, zero_if_null
from ..operators.cells import facts, transactions
from ..operators.filters import Filters, NO_FILTERS
from ..operators.ranking import top_k
from ..sources.roles import Roles


def pattern_cube(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """The (hour, dow) cells, at most 168: joined rows, bare transactions, revenue."""
    return (transactions(roles, f).groupBy("hour", "dow")
            .agg(F.sum("rentals").alias("rentals"), F.sum("bare").alias("bare"), zero_if_null(F.sum("_rev")).alias("_rev")))


def hour_dow_cube(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q14: rentals and revenue per (hour, dow)."""
    return pattern_cube(roles, f).select("hour", "dow", "rentals", money_out("_rev").alias("revenue"))


def hourly_activity(roles: Roles, f: Filters = NO_FILTERS, bare: bool = False) -> DataFrame:
    """Q15: rentals per hour (roll-up of the cells); ``bare`` counts without the payment join."""
    return pattern_cube(roles, f).groupBy("hour").agg(F.sum("bare" if bare else "rentals").alias("rentals"))


def hourly_revenue(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q15: revenue per hour."""
    return pattern_cube(roles, f).groupBy("hour").agg(money_out(F.sum("_rev")).alias("revenue"))


def dow_revenue(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q15: revenue per weekday with its short name."""
    return (pattern_cube(roles, f).groupBy("dow").agg(F.sum("_rev").alias("_rev"))
            .select("dow", day_short("dow").alias("day"), money_out("_rev").alias("revenue")))


def peaks(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q17: peak hour by rentals and peak weekday by revenue (lowest index on ties)."""
    c = (pattern_cube(roles, f).groupingSets([["hour"], ["dow"]], "hour", "dow")  # expands cells, not transactions
         .agg(F.sum("rentals").alias("rentals"), F.sum("_rev").alias("_rev"), F.grouping("dow").alias("by_hour")))
    ph = F.min(F.when(F.col("by_hour") == 1, F.struct((-F.col("rentals")).alias("k"), F.col("hour").alias("v"))))
    pd_ = F.min(F.when(F.col("by_hour") == 0, F.struct((-F.col("_rev")).alias("k"), F.col("dow").alias("v"))))
    return c.agg(ph.alias("h"), pd_.alias("d")).select(
        F.coalesce(F.col("h.v"), F.lit(0)).alias("peak_hour"),
        F.when(F.col("d").isNotNull(), day_short(F.col("d.v"))).otherwise(F.lit("N/A")).alias("peak_day"))


def avg_duration_by_dow(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q16: mean rental duration in hours per weekday of the rental date.

    Summed as exact microseconds (a decimal), divided once, so the mean does not
    depend on the order partitions are combined in."""
    return (facts(roles, f).where(F.col("returned") > 0).groupBy("dow")
            .agg(F.sum("micros").alias("_us"), F.sum("returned").alias("_n"))
            .select("dow", day_short("dow").alias("day"),
                    F.round(F.col("_us").cast("double") / F.col("_n").cast("double") / F.lit(3.6e9), 6)
                    .alias("avg_hours")))


def peak_hours_all(roles: Roles, k: int = 3) -> DataFrame:
    """Q30: busiest hours over all activity (COUNT(*), no filters)."""
    c = transactions(roles).groupBy("hour").agg(F.sum("bare").alias("rentals"))
    return top_k(c, [F.col("rentals").desc(), F.col("hour")], k)


def best_days_all(roles: Roles, k: int = 3) -> DataFrame:
    """Q30: busiest weekdays over the bare rental fact (COUNT(*), no payment join)."""
    c = (facts(roles, joined=False).groupBy(day_long("dow").alias("day"), "dow")
         .agg(F.sum("bare").alias("rentals")))
    return top_k(c, [F.col("rentals").desc(), F.col("dow")], k)


def peak_hours(roles: Roles, f: Filters = NO_FILTERS, k: int = 5) -> DataFrame:
    """Q30: top k hours by COUNT(*) after the payment join, with revenue."""
    c = (transactions(roles, f).groupBy("hour")
         .agg(F.sum("rentals").alias("rentals"), money_out(zero_if_null(F.sum("_rev"))).alias("revenue")))
    return top_k(c, [F.col("rentals").desc(), F.col("hour")], k)


def days(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q30: per weekday COUNT(*) after the payment join, and revenue."""
    return (facts(roles, f)
            .groupBy(day_long("dow").alias("day_name"), "dow")
            .agg(F.sum("rows").alias("rentals"), money_out(zero_if_null(F.sum("paid"))).alias("revenue")))


def chart_hour(roles: Roles, by_revenue: bool = False) -> DataFrame:
    """Q26: rentals and revenue per hour, label 'H:00'."""
    c = (transactions(roles).groupBy(F.col("hour").alias("h"))
         .agg(F.sum("rentals").alias("rentals"), money_out(zero_if_null(F.sum("_rev"))).alias("revenue")))
    return c.select(F.concat(F.col("h").cast("string"), F.lit(":00")).alias("hour"), "rentals", "revenue")


def chart_day(roles: Roles) -> DataFrame:
    """Q26: rentals (joined rows) and revenue per weekday over rental ⟕ payment."""
    return (facts(roles, joined=False)
            .groupBy(day_long("dow").alias("day"), "dow")
            .agg(F.sum("rows").alias("rentals"), money_out(zero_if_null(F.sum("paid"))).alias("revenue")))
