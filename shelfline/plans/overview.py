"""Overview marts: month list, KPI bundle, store comparison, trend, store summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_start
from ..functions.money import guarded_ratio, money_out, zero_if_null
from ..operators.cells import facts
from ..operators.fact import distinct_rentals, paid_rentals, units
from ..operators.filters import Filters, NO_FILTERS
from ..sources.roles import Roles


def store_label(c="store_id"):
    return F.concat(F.lit("Store "), F.col(c).cast("string"))


def months(roles: Roles) -> DataFrame:
    """Q1: distinct 'yyyy-MM' ascending with the sentinel 'All' first (pos 0).

    The distinct list has one row per calendar month (bounded by the time span,
    not by data volume), so numbering it in one ordered window is safe.
    """
    m = facts(roles, joined=False).select("month").distinct()
    numbered = m.select(F.row_number().over(Window.orderBy("month")).cast("bigint").alias("pos"), "month")
    sentinel = roles.stores.sparkSession.createDataFrame([(0, "All")], "pos bigint, month string")
    return sentinel.unionByName(numbered)


def kpi(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q2: revenue, customers, distinct rentals, then inventory and films under the
    store filter only (the month is ignored for the catalogue), and avg_tx.

    The fact and catalogue aggregates are two one-row frames computed in
    parallel; stacking them and taking max() per column combines them without
    a join of single-row frames."""
    fact = paid_rentals(roles, f)
    facts = fact.agg(
        zero_if_null(F.sum("paid")).alias("_rev"),
        F.countDistinct("customer_id").alias("customers"),
        distinct_rentals(fact).alias("rentals"),
        F.lit(None).cast("bigint").alias("inventory"), F.lit(None).cast("bigint").alias("films"))
    catalogue = units(roles, f.without_month()).agg(
        F.lit(None).cast(facts.schema["_rev"].dataType).alias("_rev"),
        F.lit(None).cast("bigint").alias("customers"), F.lit(None).cast("bigint").alias("rentals"),
        F.countDistinct("inventory_id").alias("inventory"), F.countDistinct("film_id").alias("films"))
    one = facts.unionByName(catalogue).agg(*[F.max(c).alias(c) for c in facts.columns])
    return one.select(
        money_out("_rev").alias("revenue"), "customers", "rentals", "inventory", "films",
        guarded_ratio(F.col("_rev"), F.col("rentals")).cast("double").alias("avg_tx"))


def store_compare(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q3: per store, month filter only; every store present, missing ones zero."""
    fact = paid_rentals(roles, f.without_store())
    agg = (fact.groupBy("store_id")
           .agg(zero_if_null(F.sum("paid")).alias("_rev"),
                distinct_rentals(fact).alias("rentals"),
                F.countDistinct("customer_id").alias("customers")))
    # stores is one row per store: a dimension whose size does not grow with the fact
    return (roles.stores.join(agg, "store_id", "left")
            .select(store_label().alias("store"),
                    money_out(zero_if_null("_rev")).alias("revenue"),
                    zero_if_null("rentals").alias("rentals"),
                    zero_if_null("customers").alias("customers")))


def trend(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q4: rentals (joined rows) and revenue per (period, store); monthly without a
    month filter, daily with one."""
    if f.month is None:
        rows, period = facts(roles, f), month_start(F.concat("month", F.lit("-01")))
    else:
        rows, period = paid_rentals(roles, f), F.col("rental_date").cast("date")
    return (rows
            .groupBy(period.alias("period"), "store_id")
            .agg(F.sum("rows").alias("rentals"), zero_if_null(F.sum("paid")).alias("_rev"))
            .select("period", store_label().alias("store"), "rentals",
                    money_out("_rev").alias("revenue")))


def store_summary(roles: Roles) -> DataFrame:
    """Q29: per store revenue (null when nothing paid), joined rentals, customers,
    share of total, revenue per rental, leader flag and gaps to the leader."""
    agg = (paid_rentals(roles).groupBy("store_id")
           .agg(F.sum("paid").alias("_rev"), F.sum("rows").alias("rentals"),
                F.countDistinct("customer_id").alias("customers")))
    everyone = Window.partitionBy()  # one row per store: bounded
    by_rev = Window.orderBy(F.col("_rev").desc_nulls_first(), F.col("store_id"))
    return agg.select(
        store_label().alias("store"),
        money_out("_rev").alias("revenue"), "rentals", "customers",
        F.round(F.try_divide(F.col("_rev"), F.sum("_rev").over(everyone)) * 100, 1).cast("double").alias("revenue_share"),
        money_out(F.col("_rev") / F.greatest(F.col("rentals"), F.lit(1))).alias("revenue_per_rental"),
        (F.row_number().over(by_rev) == 1).alias("leader"),
        money_out(F.max("_rev").over(everyone) - F.col("_rev")).alias("revenue_gap"),
        (F.max("rentals").over(everyone) - F.col("rentals")).alias("rentals_gap"))
