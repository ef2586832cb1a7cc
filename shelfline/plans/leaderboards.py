"""Parameterised leaderboards: actors, charts by dimension, store/month charts,
staff performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_label
from ..functions.money import money_out, zero_if_null
from ..operators.fact import bare_paid_rentals, paid_rentals, per_customer
from ..operators.ranking import top_k
from ..sources.roles import Roles
from .customers import full_name
from .inventory import film_activity, film_categories


def _dir(c: str, ascending: bool):
    return F.col(c).asc() if ascending else F.col(c).desc()


def actor_activity(roles: Roles) -> DataFrame:
    """Per actor through the m:n bridge: films, joined rentals, plain rentals, revenue.
    A rental counts once per actor of its film.

    Films are counted by the first row of each pair, in the order the join by film sorts by anyway: a distinct count
    would hold every pair in hash tables."""
    fa = film_activity(roles)
    first = F.row_number().over(Window.partitionBy("film_id").orderBy("actor_id"))  # streams: a hot film is no group in memory
    before = F.lag("actor_id").over(Window.partitionBy("film_id").orderBy("actor_id"))
    pairs = roles.film_actor.where(F.col("film_id").isNotNull()).select(
        "film_id", "actor_id", ((first == 1) | ~before.eqNullSafe(F.col("actor_id"))).cast("bigint").alias("_first"))
    return (pairs.join(fa, "film_id")
            .groupBy("actor_id")
            .agg(F.sum("_first").alias("films"), F.sum("film_rows").alias("total_rentals"),
                 F.sum("film_rentals").alias("plain_rentals"), F.sum("film_paid").alias("_rev")))


def actors(roles: Roles, min_films: int | None = None, min_rentals: int | None = None,
           by_films: bool = False, k: int = 25) -> DataFrame:
    """Q19: actor leaderboard with optional HAVING thresholds."""
    a = actor_activity(roles)
    if min_films:
        a = a.where(F.col("films") > min_films)
    if min_rentals:
        a = a.where(F.col("total_rentals") > min_rentals)
    out = a.join(roles.actor, "actor_id").select(
        "actor_id", full_name().alias("actor"), "films", "total_rentals",
        money_out(zero_if_null("_rev")).alias("revenue"))
    key = "films" if by_films else "total_rentals"
    return top_k(out, [F.col(key).desc(), F.col("actor_id")], k).drop("actor_id")


def chart_actors(roles: Roles, ascending: bool = False, k: int = 15) -> DataFrame:
    """Q25: actors by rentals (no payment join)."""
    out = actor_activity(roles).join(roles.actor, "actor_id").select(
        "actor_id", full_name().alias("actor"), "films", F.col("plain_rentals").alias("total_rentals"))
    return top_k(out, [_dir("total_rentals", ascending), F.col("actor_id")], k).drop("actor_id")


def chart_films(roles: Roles, by_revenue: bool = False, ascending: bool = False, k: int = 15) -> DataFrame:
    """Q25: films by rentals or revenue."""
    out = (roles.film.select("film_id", "title").join(film_activity(roles), "film_id")
           .select("film_id", "title", F.col("film_rows").alias("rentals"),
                   money_out(zero_if_null("film_paid")).alias("revenue")))
    return top_k(out, [_dir("revenue" if by_revenue else "rentals", ascending), F.col("film_id")], k).drop("film_id")


def chart_customers(roles: Roles, by_rentals: bool = False, ascending: bool = False, k: int = 15) -> DataFrame:
    """Q25: customers by spend or rentals over customer ⋈ rental ⟕ payment."""
    agg = (bare_paid_rentals(roles).groupBy("customer_id")
           .agg(F.sum("rows").alias("total_rentals"), zero_if_null(F.sum("paid")).alias("_spent")))
    out = agg.join(roles.customer, "customer_id").select(
        "customer_id", full_name().alias("customer"), "total_rentals",
        money_out("_spent").alias("total_spent"))
    key = "total_rentals" if by_rentals else "total_spent"
    return top_k(out, [_dir(key, ascending), F.col("customer_id")], k).drop("customer_id")


def chart_categories(roles: Roles) -> DataFrame:
    """Q25: rentals and revenue per category over the dimension-driven chain."""
    return (film_categories(roles).join(film_activity(roles), "film_id")
            .groupBy(F.col("name").alias("category"))
            .agg(F.sum("film_rows").alias("rentals"),
                 money_out(zero_if_null(F.sum("film_paid"))).alias("revenue")))


def chart_countries(roles: Roles, by_revenue: bool = False, ascending: bool = False, k: int = 15) -> DataFrame:
    """Q25: countries by rentals or revenue."""
    out = (per_customer(bare_paid_rentals(roles)).join(roles.customer_country, "customer_id")
           .groupBy("country")
           .agg(F.sum("rows").alias("rentals"), money_out(zero_if_null(F.sum("paid"))).alias("revenue")))
    return top_k(out, [_dir("revenue" if by_revenue else "rentals", ascending), F.col("country")], k)


def chart_month(roles: Roles) -> DataFrame:
    """Q26: revenue per month over rental ⟕ payment."""
    return (bare_paid_rentals(roles).groupBy(month_label("rental_date").alias("month"))
            .agg(money_out(zero_if_null(F.sum("paid"))).alias("revenue")))


def chart_store(roles: Roles) -> DataFrame:
    """Q26: joined rentals and revenue per store."""
    return (paid_rentals(roles).groupBy("store_id")
            .agg(F.sum("rows").alias("rentals"), money_out(zero_if_null(F.sum("paid"))).alias("revenue"))
            .select(F.concat(F.lit("Store "), F.col("store_id").cast("string")).alias("store"),
                    "rentals", "revenue"))


def staff_performance(roles: Roles) -> DataFrame:
    """Q37: joined rentals and revenue per staff member and store."""
    agg = (paid_rentals(roles).groupBy("staff_id", "store_id")
           .agg(F.sum("rows").alias("rentals"), money_out(zero_if_null(F.sum("paid"))).alias("revenue")))
    return agg.join(roles.staff, "staff_id").select(
        "staff_id", full_name().alias("staff"), "store_id", "rentals", "revenue")
