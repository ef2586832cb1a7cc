"""Q18: share-of-total (label, value, percent) for every dashboard chart id.

Each chart is a small aggregated frame (stores, months, categories, segments,
tiers, top countries, hours, weekdays); the percent is a window over that
bounded frame.  The "rentals" variants for store, month and hour count rentals
without the payment join, unlike the trend and cube marts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import day_short, hour_label
from ..functions.money import money_out, zero_if_null
from ..operators.cells import facts
from ..operators.filters import Filters, NO_FILTERS
from ..sources.roles import Roles
from . import customers as cu
from . import geo as ge
from . import inventory as inv
from . import patterns as pa

# Chart identifiers of the dashboard.
CHART_IDS = ["chart-store-rev", "chart-store-rent", "chart-trend-rev", "chart-trend-rent",
             "chart-top-cat", "chart-cat-pie", "chart-rev-inv", "chart-cust-seg", "chart-cust-val",
             "chart-geo-map", "chart-geo-bar", "chart-hourly", "chart-dow", "chart-hourly-rev",
             "chart-avg-dur"]


def _store_lbl():
    return F.concat(F.lit("Store "), F.col("store_id").cast("string"))


def _points(roles: Roles, cid: str, f: Filters) -> DataFrame:
    if cid == "chart-store-rev":
        return (facts(roles, f.without_store()).groupBy("store_id")
                .agg(money_out(zero_if_null(F.sum("paid"))).alias("value"))
                .select(_store_lbl().alias("label"), "value"))
    if cid == "chart-store-rent":
        return (facts(roles, f.without_store()).groupBy("store_id")
                .agg(F.sum("bare").cast("double").alias("value"))
                .select(_store_lbl().alias("label"), "value"))
    if cid == "chart-trend-rev":
        return (facts(roles, f).groupBy(F.col("month").alias("label"))
                .agg(money_out(zero_if_null(F.sum("paid"))).alias("value")))
    if cid == "chart-trend-rent":
        return (facts(roles, f).groupBy(F.col("month").alias("label"))
                .agg(F.sum("bare").cast("double").alias("value")))
    if cid in ("chart-top-cat", "chart-cat-pie", "chart-rev-inv"):
        col = {"chart-top-cat": "revenue", "chart-cat-pie": "rentals", "chart-rev-inv": "rev_per_inv"}[cid]
        return inv.categories(roles, f).select(F.col("category").alias("label"),
                                               F.col(col).cast("double").alias("value"))
    if cid == "chart-cust-seg":
        return cu.customer_segments(roles, f).select(F.col("segment").alias("label"),
                                                     F.col("total_customers").cast("double").alias("value"))
    if cid == "chart-cust-val":
        return cu.customer_value_tiers_pr(roles, f).select(F.col("tier").alias("label"),
                                                           F.col("customers").cast("double").alias("value"))
    if cid in ("chart-geo-map", "chart-geo-bar"):
        return ge.geo_top(roles, f, 10).select(F.col("country").alias("label"), F.col("revenue").alias("value"))
    if cid == "chart-hourly":
        return pa.hourly_activity(roles, f, bare=True).select(hour_label("hour").alias("label"),
                                                   F.col("rentals").cast("double").alias("value"))
    if cid == "chart-hourly-rev":
        return pa.hourly_revenue(roles, f).select(hour_label("hour").alias("label"),
                                                  F.col("revenue").alias("value"))
    if cid == "chart-dow":
        return pa.dow_revenue(roles, f).select(F.col("day").alias("label"), F.col("revenue").alias("value"))
    if cid == "chart-avg-dur":
        return pa.avg_duration_by_dow(roles, f).select(day_short("dow").alias("label"),
                                                       F.col("avg_hours").alias("value"))
    raise ValueError(f"Pie not available for {cid}")


def share(roles: Roles, chart_id: str, f: Filters = NO_FILTERS) -> DataFrame:
    """label, value, percent of the chart's total (rounded to 4 places; null when the total is 0)."""
    pts = _points(roles, chart_id, f)
    total = F.sum("value").over(Window.partitionBy())  # bounded: one row per chart point
    # nothing paid: no share of nothing, so null rather than an error
    return pts.select("label", "value", F.round(F.try_divide(F.col("value"), total) * 100, 4).alias("percent"))
