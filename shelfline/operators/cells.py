"""Stored aggregates of the fact that filters and calendar marts roll up instead of reading the fact.

* ``rental_cells``: one row per (store, month, weekday) with every count and sum those marts use.  All of them are
  additive, so any store/month filter and any coarser grouping is a sum over cells.
* ``activity_cells``: one row per (store, month, hour, weekday) of the timestamped transactions; rows without a store
  are the totals, which also hold transactions that no store has.
* ``rental_sketches``: one row per (store, month) with HLL sketches of customers and rentals.  Distinct counts do not add
  up over months, sketches merge: ``estimate`` answers any filter from a few rows, within ``DISTINCT_ERROR``.

Their sizes follow the calendar and the number of stores, not the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import dow, hour, month_label
from ..sources.monthly import MONTH, month_number
from ..sources.roles import Roles
from .fact import bare_paid_rentals, paid_rentals
from .filters import Filters, NO_FILTERS

#: 2**LG_K registers: a relative standard error of 1.04 / sqrt(2**14) = 0.8 %; DISTINCT_ERROR is three of them
LG_K, DISTINCT_ERROR = 14, 0.025


def _micros():
    # a decimal: a long holds the microseconds of one rental, but not those of some hundred thousand years of them
    return (F.unix_micros(F.col("return_date").cast("timestamp")) - F.unix_micros(F.col("rental_date").cast("timestamp"))).cast("decimal(20,0)")


def rental_cells(fact: DataFrame) -> DataFrame:
    return (fact.groupBy("store_id", MONTH, dow("rental_date").alias("dow"))
            .agg(F.count(F.lit(1)).alias("bare"), F.sum("rows").alias("rows"), F.sum(F.col("rental_first").cast("bigint")).alias("firsts"),
                 F.sum("paid").alias("paid"), F.sum(_micros()).alias("micros"), F.count(_micros()).alias("returned")))


def facts(roles: Roles, f: Filters = NO_FILTERS, joined: bool = True) -> DataFrame:
    """store_id, month (yyyy-MM), dow, bare, rows, paid, micros, returned: additive facts under a filter, from the stored cells or,
    where a provider stores none, one row per rental.  Without ``joined`` rentals need no inventory unit (no store then)."""
    if roles.rental_cells is not None:
        month = F.when(F.col(MONTH) > 0, F.format_string("%04d-%02d", F.expr(f"{MONTH} div 100"), F.col(MONTH) % 100))
        return chosen(roles.rental_cells, f).withColumn("month", month)
    fact = paid_rentals(roles, f) if joined else bare_paid_rentals(roles, f)
    return fact.select(*(c for c in ("store_id",) if joined), month_label("rental_date").alias("month"), dow("rental_date").alias("dow"),
                       F.lit(1).cast("bigint").alias("bare"), "rows", "paid", _micros().alias("micros"), _micros().isNotNull().cast("bigint").alias("returned"))


def rental_sketches(fact: DataFrame) -> DataFrame:
    return (fact.groupBy("store_id", MONTH)
            .agg(F.hll_sketch_agg(F.xxhash64("customer_id"), F.lit(LG_K)).alias("customers"),
                 F.hll_sketch_agg(F.xxhash64("rental_id"), F.lit(LG_K)).alias("rentals")))


def activity_cells(activity: DataFrame, with_store: DataFrame) -> DataFrame:
    """From all transactions (ts, amount, rows) and from those with a store (store_id too)."""
    rows = [activity.withColumn("store_id", F.lit(None).cast("int")), with_store]
    parts = [r.groupBy("store_id", month_number("ts").alias(MONTH), hour("ts").alias("hour"), dow("ts").alias("dow"))
             .agg(F.sum("rows").alias("rentals"), F.count(F.lit(1)).alias("bare"), F.sum("amount").alias("_rev")) for r in rows]
    return parts[0].unionByName(parts[1])


def transactions(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """hour, dow, rentals, bare, _rev: additive facts of the transactions under a filter, stored cells where there are some."""
    if roles.activity_cells is not None:
        own = F.col("store_id").isNull() if f.store is None else F.col("store_id") == f.store
        return chosen(roles.activity_cells.where(own), f.without_store())
    rows = roles.activity if f.store is None else f.apply_store(roles.activity_store)
    return f.apply_month(rows, "ts").select(hour("ts").alias("hour"), dow("ts").alias("dow"), F.col("rows").alias("rentals"),
                                            F.lit(1).cast("bigint").alias("bare"), F.col("amount").alias("_rev"))


def chosen(cells: DataFrame, f: Filters = NO_FILTERS) -> DataFrame:
    """The cells of a filter."""
    kept = f.apply_store(cells)
    return kept if f.month is None else kept.where(F.col(MONTH) == int(f.month.replace("-", "")))


def estimate(sketches: DataFrame, f: Filters = NO_FILTERS, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct customers and rentals under a filter from merged sketches: within ``DISTINCT_ERROR`` of the exact
    counts in all but 0.3 % of cases (three standard errors); small counts are exact up to rounding."""
    return (chosen(sketches, f).groupBy(*by)
            .agg(*(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in ("customers", "rentals"))))
