"""Catalogue marts: categories, film utilisation, film/category/rating leaderboards,
overstock and slow-moving titles.

Dimension-driven marts (``film ⋈ inventory ⟕ rental ⟕ payment``) aggregate the
fact to the inventory unit first (:func:`units_with_activity`), then to the film,
and only then meet film-level dimensions.  The fact is reduced before any
dimension join, so the join input is one row per film, not one per payment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import money_out, safe_ratio, zero_if_null
from ..operators.fact import paid_rentals, units, units_with_activity
from ..operators.filters import Filters, NO_FILTERS
from ..operators.ranking import top_k
from ..sources.roles import Roles


def film_categories(roles: Roles, inner: bool = True) -> DataFrame:
    """film_id -> category name (inner bridge, or left when no category filter)."""
    if inner and roles.film_category_named is not None:
        return roles.film_category_named
    how = "inner" if inner else "left"
    return roles.film_category.join(roles.category, "category_id", how).select("film_id", "name")


def categories(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q5: per category distinct units, revenue, joined rentals, revenue per unit."""
    fc = film_categories(roles)
    # a unit belongs to one film: units per film and category add up without meeting again
    per_unit = paid_rentals(roles, f).groupBy("film_id", "inventory_id").agg(F.sum("paid").alias("paid"), F.sum("rows").alias("rows"))
    per_film = per_unit.groupBy("film_id").agg(F.count(F.lit(1)).alias("units"), F.sum("paid").alias("paid"), F.sum("rows").alias("rows"))
    agg = (per_film.join(fc, "film_id")
           .groupBy(F.col("name").alias("category"))
           .agg(F.sum("units").alias("inventory"), zero_if_null(F.sum("paid")).alias("_rev"),
                F.sum("rows").alias("rentals")))
    return agg.select("category", "inventory", money_out("_rev").alias("revenue"), "rentals",
                      safe_ratio(F.col("_rev"), F.col("inventory")).cast("double").alias("rev_per_inv"))


def top_categories(roles: Roles, f: Filters = NO_FILTERS, k: int = 5) -> DataFrame:
    """Q6: the k categories with the highest revenue (then shown ascending)."""
    return top_k(categories(roles, f).select("category", "revenue"),
                 [F.col("revenue").desc(), F.col("category")], k)


def film_activity(roles: Roles, month: str | None = None, store: int | None = None) -> DataFrame:
    """Per film: copies, joined rental rows, plain rental rows, revenue and the
    number of rows the left chain produces (``film_chain_rows``, for row-weighted
    averages).

    Both sides are reduced to the film before they meet: units per film from the
    inventory, activity per film from the fact (month in the ON clause, store on
    the unit).  A unit without rentals contributes one chain row, so
    chain rows = joined rows + copies - rented units."""
    f = Filters(store, month)
    copies = units(roles, f).groupBy("film_id").agg(F.countDistinct("inventory_id").alias("copies"))
    act = (paid_rentals(roles, f).groupBy("film_id")
           .agg(F.sum("rows").alias("film_rows"), F.count(F.lit(1)).alias("film_rentals"),
                F.sum("paid").alias("film_paid"), F.countDistinct("inventory_id").alias("_rented")))
    return (copies.join(act, "film_id", "left")
            .select("film_id", "copies",
                    F.coalesce("film_rows", F.lit(0)).alias("film_rows"),
                    F.coalesce("film_rentals", F.lit(0)).alias("film_rentals"),
                    "film_paid",
                    (F.coalesce("film_rows", F.lit(0)) + F.col("copies") - F.coalesce("_rented", F.lit(0)))
                    .alias("film_chain_rows")))


def utilization_bar(util, full_at: float = 30.0):
    """Bar length in percent, min(100, util / full_at * 100)."""
    return F.least(F.lit(100.0), util / F.lit(full_at) * 100)


def film_utilization(roles: Roles, f: Filters = NO_FILTERS, k: int = 15) -> DataFrame:
    """Q7: per (title, category) copies, times rented, rentals per copy, revenue; top k by
    utilisation.  Month predicate in the ON clause (unrented units stay), store in WHERE."""
    titles = roles.film.select("film_id", "title").join(film_categories(roles), "film_id")
    key = ["title", F.col("name").alias("category")]
    if roles.units_keyed:
        # units and rentals are reduced to the film on their own: neither is sorted or hashed by unit
        copies = units(roles, f).groupBy("film_id").agg(F.count(F.lit(1)).alias("copies"))
        act = (paid_rentals(roles, f).where(F.col("store_id").isNotNull()).groupBy("film_id")
               .agg(F.sum("rows").alias("film_rows"), F.sum("paid").alias("film_paid")))
        # a film's row may repeat: its copies count once under a title and category, its rentals with every row
        per_film = (copies.join(act, "film_id", "left").join(titles, "film_id").groupBy(*key, "film_id")
                    .agg(F.max("copies").alias("copies"), F.sum(F.coalesce("film_rows", F.lit(0))).alias("film_rows"), F.sum("film_paid").alias("film_paid")))
        agg = per_film.groupBy("title", "category").agg(
            F.sum("copies").alias("copies"), F.sum("film_rows").alias("times_rented"), zero_if_null(F.sum("film_paid")).alias("_rev"))
    else:
        agg = (units_with_activity(roles, f).join(titles, "film_id").groupBy(*key)
               .agg(F.countDistinct("inventory_id").alias("copies"),
                    F.sum("unit_rows").alias("times_rented"),
                    zero_if_null(F.sum("unit_paid")).alias("_rev")))
    out = agg.select("title", "category", "copies", "times_rented",
                     safe_ratio(F.col("times_rented").cast("decimal(20,0)"), F.col("copies"))
                     .cast("double").alias("util_rate"),
                     money_out("_rev").alias("revenue"))
    return top_k(out, [F.col("util_rate").desc_nulls_first(), F.col("title"), F.col("category")], k)


def films(roles: Roles, category: str | None = None, rating: str | None = None,
          min_rate: float | None = None, min_rentals: int | None = None,
          max_rentals: int | None = None, overstock: bool = False, slow: bool = False,
          ascending: bool = False, k: int = 25, overstock_copies: int = 4,
          overstock_below: int = 5, slow_below: int = 5) -> DataFrame:
    """Q21 (and Q27 with ``overstock``): film leaderboard with optional filters."""
    fa = film_activity(roles)
    fm = roles.film
    if rating is not None:
        fm = fm.where(F.col("rating") == rating)
    if min_rate is not None:
        fm = fm.where(F.col("rental_rate") > F.lit(min_rate))
    fc = film_categories(roles, inner=category is not None)
    if category is not None:
        fc = fc.where(F.lower("name") == category.lower())
    rows = fm.join(fc, "film_id", "inner" if category is not None else "left").join(fa, "film_id")
    cond = F.lit(True)
    if overstock:
        cond &= (F.col("copies") >= overstock_copies) & (F.col("film_rows") < overstock_below)
    if slow:
        cond &= F.col("film_rows") < slow_below
    if min_rentals is not None:
        cond &= F.col("film_rows") > min_rentals
    if max_rentals is not None:
        cond &= F.col("film_rows") < max_rentals
    out = rows.where(cond).select(
        "title", F.col("name").alias("category"), "rating",
        F.col("rental_rate").cast("double").alias("rental_rate"), "copies",
        F.col("film_rows").alias("total_rentals"),
        money_out(zero_if_null("film_paid")).alias("revenue"), "film_id")
    order = F.col("total_rentals").asc() if ascending else F.col("total_rentals").desc()
    return top_k(out, [order, F.col("film_id"), F.col("category").asc_nulls_first()], k).drop("film_id")


def category_catalog(roles: Roles, min_revenue: float | None = None) -> DataFrame:
    """Q23: per category films, joined rentals, revenue (null if nothing paid) and the
    row-weighted average rental rate of the left chain."""
    fa = film_activity(roles)
    rows = (film_categories(roles).join(roles.film.select("film_id", "rental_rate"), "film_id")
            .join(fa, "film_id"))
    agg = rows.groupBy(F.col("name").alias("category")).agg(
        F.countDistinct("film_id").alias("films"),
        F.sum("film_rows").alias("rentals"),
        F.sum("film_paid").alias("_rev"),
        (F.sum(F.col("rental_rate") * F.col("film_chain_rows")) / F.sum("film_chain_rows")).alias("_avg"))
    if min_revenue is not None:
        agg = agg.where(F.round("_rev", 2) > F.lit(min_revenue))
    return agg.select("category", "films", "rentals", money_out("_rev").alias("revenue"),
                      money_out("_avg").alias("avg_rate"))


def by_rating(roles: Roles) -> DataFrame:
    """Q24: films, joined rentals and revenue per rating."""
    fa = film_activity(roles)
    return (roles.film.select("film_id", "rating").join(fa, "film_id")
            .groupBy("rating")
            .agg(F.countDistinct("film_id").alias("films"), F.sum("film_rows").alias("rentals"),
                 money_out(zero_if_null(F.sum("film_paid"))).alias("revenue")))


def slow_moving(roles: Roles, below: int = 5, k: int = 5) -> DataFrame:
    """Q28: titles rented fewer than ``below`` times (no payment join), least rented first."""
    fa = film_activity(roles)
    out = (roles.film.select("film_id", "title").join(fa, "film_id")
           .where(F.col("film_rentals") < below)
           .select("film_id", "title", "copies", F.col("film_rentals").alias("times_rented")))
    return top_k(out, [F.col("times_rented").asc(), F.col("film_id")], k).drop("film_id")
