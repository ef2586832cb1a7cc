"""The rental fact in its three shapes.

* ``rentals``       rental ⋈ inventory                     (no payment: Q8, Q18a)
* ``paid_rentals``  rental ⋈ inventory ⟕ payment, payment pre-aggregated per rental
* ``unit_activity`` per inventory unit: joined rows and revenue of its rentals

Payment is pre-aggregated to ``(rental_id, paid, n_pay)`` before it meets the
rental fact.  Sums are unchanged and the number of rows the reference's
``LEFT JOIN payment`` would produce is ``rows = greatest(n_pay, 1)``, so every
``COUNT(r.rental_id)`` after the payment join is ``sum(rows)``.  The shuffle then
carries one row per rental instead of one per payment, and the aggregation is
partial (map-side) before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.roles import Roles
from .filters import Filters, NO_FILTERS


def pay_per_rental(roles: Roles) -> DataFrame:
    return roles.payment.groupBy("rental_id").agg(F.sum("amount").alias("paid"),
                                                  F.count(F.lit(1)).alias("n_pay"))


def units(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    return f.apply_store(roles.inventory.select("inventory_id", "film_id", "store_id"))


def rentals(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """rental ⋈ inventory with the store and month predicates applied."""
    if roles.rental_paid is not None:
        cols = ["rental_id", "rental_date", "return_date", "inventory_id", "customer_id", "staff_id",
                "film_id", "store_id"]
        return f.apply_store(f.apply_month(roles.rental_paid)).select(*cols)
    r = f.apply_month(roles.rental)
    return r.join(units(roles, f), "inventory_id")


def with_payments(r: DataFrame, roles: Roles) -> DataFrame:
    """Left join of pre-aggregated payments: adds ``paid`` (null when unpaid) and ``rows``."""
    return (r.join(pay_per_rental(roles), "rental_id", "left")
            .withColumn("rows", F.greatest(F.coalesce(F.col("n_pay"), F.lit(0)), F.lit(1)))
            .drop("n_pay"))


def paid_rentals(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    if roles.rental_paid is not None:
        return f.apply_store(f.apply_month(roles.rental_paid))
    return with_payments(rentals(roles, f), roles)


def bare_paid_rentals(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """rental ⟕ payment without the inventory join (month filter only)."""
    if roles.rental_paid is not None and roles.rental_paid_complete:
        return f.apply_month(roles.rental_paid)
    return with_payments(f.apply_month(roles.rental), roles)


def distinct_rentals(fact: DataFrame):
    """COUNT(DISTINCT rental_id) of a paid fact: a sum over the marked first rows where the provider marks them, so
    the nearly unique key is not shuffled."""
    if "rental_first" in fact.columns:
        return F.coalesce(F.sum(F.col("rental_first").cast("bigint")), F.lit(0))
    return F.countDistinct("rental_id")


def bare_rentals(roles: Roles) -> DataFrame:
    """The rental fact alone, from the enriched fact where that holds every rental."""
    if roles.rental_paid is not None and roles.rental_paid_complete:
        return roles.rental_paid.select("rental_id", "rental_date", "return_date", "inventory_id", "customer_id", "staff_id")
    return roles.rental


def per_customer(fact: DataFrame) -> DataFrame:
    """One row per customer: joined rows, payments (null when none) and last rental.  A dimension met after this
    meets each customer once, and a hot customer is combined before the shuffle."""
    return fact.groupBy("customer_id").agg(F.sum("rows").alias("rows"), F.sum("paid").alias("paid"),
                                           F.max("rental_date").alias("last"))


def unit_activity(roles: Roles, month: str | None = None) -> DataFrame:
    """Per inventory unit: ``unit_rows`` (joined rental×payment rows, 0 if never
    rented), ``unit_rentals`` (rental rows, no payment fan-out) and ``unit_paid``
    (null if no payment).

    This is ``inventory ⟕ rental ⟕ payment`` aggregated to the unit before any
    dimension join: the month predicate sits on the rental side (the ON clause),
    so units without a rental in the month survive with zero rows.
    """
    if roles.rental_paid is not None:
        paid = Filters(None, month).apply_month(roles.rental_paid).select("inventory_id", "rows", "paid")
    else:
        r = Filters(None, month).apply_month(roles.rental).select("rental_id", "inventory_id")
        paid = with_payments(r, roles)
    per_unit = (paid.groupBy("inventory_id")
                .agg(F.sum("rows").alias("unit_rows"), F.count(F.lit(1)).alias("unit_rentals"),
                     F.sum("paid").alias("unit_paid")))
    return per_unit


def units_with_activity(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Every unit (store filter in WHERE) with its activity in the month (ON clause)."""
    act = unit_activity(roles, f.month)
    return (units(roles, f).join(act, "inventory_id", "left")
            .withColumn("unit_rows", F.coalesce(F.col("unit_rows"), F.lit(0)))
            .withColumn("unit_rentals", F.coalesce(F.col("unit_rentals"), F.lit(0)))
            # rows the dimension-driven left chain yields for this unit: at least one
            .withColumn("chain_rows", F.greatest(F.col("unit_rows"), F.lit(1))))
