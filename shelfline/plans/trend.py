"""Month-over-month analytics: change %, peaks, drops, partial months, last periods,
ranked categories, monthly trend, unusual periods and categories.

Every window here runs over an aggregated monthly (or per-category) frame whose
size is the number of months/categories, not the number of rentals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import money_out, zero_if_null
from ..operators.cells import facts
from ..operators.filters import Filters, NO_FILTERS
from ..operators.ranking import top_k
from ..sources.roles import Roles
from .inventory import film_activity, film_categories


def monthly_revenue_all(roles: Roles) -> DataFrame:
    """Revenue per month over rental ⟕ payment; null when nothing was paid that month."""
    return (facts(roles, joined=False).groupBy("month")
            .agg(F.round(F.sum("paid"), 2).alias("revenue")))


def _change(cur, prev):
    """(x - prev) / max(prev, 1) * 100."""
    return (cur - prev) / F.greatest(prev, F.lit(1)) * F.lit(100)


def monthly_revenue(roles: Roles) -> DataFrame:
    """Q31: positive months with change % vs the previous positive month, peak flag."""
    m = monthly_revenue_all(roles).where(F.col("revenue") > 0)
    w = Window.orderBy("month")  # one row per month: bounded
    prev = F.lag("revenue").over(w)
    return m.select(
        "month", F.col("revenue").cast("double").alias("revenue"),
        F.round(_change(F.col("revenue"), prev), 4).cast("double").alias("change_pct"),
        (F.col("revenue") == F.max("revenue").over(Window.partitionBy())).alias("is_peak"))


def revenue_direction(roles: Roles) -> DataFrame:
    """Q31: peak month and the latest change with its direction (one row)."""
    mr = monthly_revenue(roles)
    last = mr.agg(F.max_by(F.struct("month", "change_pct"), "month").alias("l"),
                  F.min(F.struct((-F.col("revenue")).alias("k"), F.col("month").alias("m"))).alias("p"),
                  F.count(F.lit(1)).alias("n"))
    return last.where(F.col("n") >= 2).select(
        F.col("p.m").alias("peak_month"), (-F.col("p.k")).alias("peak_revenue"),
        F.col("l.month").alias("last_month"), F.col("l.change_pct").alias("last_change_pct"),
        F.when(F.col("l.change_pct") > 0, F.lit("increased")).otherwise(F.lit("decreased")).alias("direction"))


def revenue_drops(roles: Roles, threshold: float = -10.0) -> DataFrame:
    """Q32: months falling more than ``threshold`` % vs the previous positive month,
    flagging the largest drop."""
    m = monthly_revenue_all(roles).where(F.col("revenue") > 0)
    w = Window.orderBy("month")
    d = m.select("month", F.lag("month").over(w).alias("prev_month"),
                 _change(F.col("revenue"), F.lag("revenue").over(w)).alias("_chg"))
    d = d.where(F.col("_chg") < threshold)
    return d.select("month", "prev_month", F.round("_chg", 4).cast("double").alias("change_pct"),
                    (F.col("_chg") == F.min("_chg").over(Window.partitionBy())).alias("is_biggest"))


def partial_periods(roles: Roles, threshold: float = 1000.0) -> DataFrame:
    """Q33: positive months with a 'data cutoff' flag when revenue is below ``threshold``."""
    m = monthly_revenue_all(roles).where(F.col("revenue") > 0)
    return m.select("month", F.col("revenue").cast("double").alias("revenue"),
                    (F.col("revenue") < threshold).alias("data_cutoff"))


def last_periods(roles: Roles, k: int = 4) -> DataFrame:
    """Q34: the last k months with change % vs the month before (first one: none)."""
    recent = top_k(monthly_revenue_all(roles), [F.col("month").desc()], k)
    w = Window.orderBy("month")
    return recent.select("month", F.col("revenue").cast("double").alias("revenue"),
                         F.round(_change(F.col("revenue"), F.lag("revenue").over(w)), 4)
                         .cast("double").alias("change_pct"))


def ranked_categories(roles: Roles, k: int = 5) -> DataFrame:
    """Q35: top k categories by revenue (nulls first, as the source database sorts),
    with rank, joined rentals, revenue and share of the top-k total."""
    cats = (film_categories(roles).join(film_activity(roles), "film_id")
            .groupBy(F.col("name").alias("category"))
            .agg(F.sum("film_rows").alias("rentals"), F.round(F.sum("film_paid"), 2).alias("_rev")))
    top = top_k(cats, [F.col("_rev").desc_nulls_first(), F.col("category")], k)
    w = Window.orderBy(F.col("_rev").desc_nulls_first(), F.col("category"))
    return top.select(F.row_number().over(w).cast("bigint").alias("rank"), "category",
                      F.col("_rev").cast("double").alias("revenue"), "rentals",
                      F.round(F.try_divide(F.col("_rev"), F.sum("_rev").over(Window.partitionBy())) * 100, 2)
                      .cast("double").alias("share_pct"))


def monthly_trend(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q36: revenue and joined rentals per month through the inventory join."""
    return (facts(roles, f).groupBy("month")
            .agg(money_out(zero_if_null(F.sum("paid"))).alias("revenue"), F.sum("rows").alias("rentals")))


def recent_trend(roles: Roles, k: int = 3) -> DataFrame:
    """R9 input: last k months, with the change of the latest month vs the one
    before (the latest itself when only one month exists) and its direction."""
    recent = top_k(monthly_revenue_all(roles), [F.col("month").desc()], max(k, 2))
    w = Window.orderBy(F.col("month").desc())
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.first("revenue").over(whole)
    prev = F.coalesce(F.nth_value("revenue", 2).over(whole), last)
    chg = _change(last, prev)
    out = recent.select(F.row_number().over(w).cast("bigint").alias("pos"), "month",
                        F.col("revenue").cast("double").alias("revenue"),
                        F.round(chg, 4).cast("double").alias("change_pct"),
                        F.when(chg > 0, F.lit("growing")).otherwise(F.lit("declining")).alias("direction"))
    return out.where(F.col("pos") <= k)


def unusual(roles: Roles, z: float = 2.0) -> DataFrame:
    """Q40: unusual months (positive-revenue series) and categories by z-score.

    z = (x - mean) / stddev_samp over the monthly or per-category mart; flagged
    when |z| > ``z``."""
    months = monthly_revenue_all(roles).where(F.col("revenue") > 0).select(
        F.lit("month").alias("kind"), F.col("month").alias("label"), F.col("revenue").cast("double").alias("value"))
    cats = (film_categories(roles).join(film_activity(roles), "film_id")
            .groupBy("name").agg(F.sum("film_paid").alias("_r"))
            .select(F.lit("category").alias("kind"), F.col("name").alias("label"),
                    F.round(zero_if_null("_r"), 2).cast("double").alias("value")))
    both = months.unionByName(cats)
    w = Window.partitionBy("kind")  # two groups of bounded size
    # without spread nothing is unusual: z is null and the flag false
    zs = F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w))
    return both.select("kind", "label", "value", F.round(zs, 4).alias("z")).select(
        "kind", "label", "value", "z", F.coalesce(F.abs(F.col("z")) > z, F.lit(False)).alias("unusual"))
