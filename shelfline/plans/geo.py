"""Geography marts: revenue by country, top countries, filtered country list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import money_out, zero_if_null
from ..operators.fact import bare_paid_rentals, paid_rentals, per_customer
from ..operators.filters import Filters, NO_FILTERS
from ..operators.ranking import top_k
from ..sources.roles import Roles


def geo(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q13: per country distinct customers, revenue, joined rentals (country not null)."""
    cc = roles.customer_country.where(F.col("country").isNotNull())
    agg = (per_customer(paid_rentals(roles, f)).join(cc, "customer_id")
           .groupBy("country")
           .agg(F.count(F.lit(1)).alias("customers"),
                zero_if_null(F.sum("paid")).alias("_rev"), F.sum("rows").alias("rentals")))
    return agg.select("country", "customers", money_out("_rev").alias("revenue"), "rentals")


def geo_top(roles: Roles, f: Filters = NO_FILTERS, k: int = 10) -> DataFrame:
    """Q13: the k countries with the highest revenue."""
    return top_k(geo(roles, f), [F.col("revenue").desc(), F.col("country")], k)


def geo_headline(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q13: number of countries, the leading country and its revenue (one row).

    min(struct(-revenue, country)) picks the top revenue, ties broken by name,
    in the same single aggregation that counts the countries."""
    g = geo(roles, f)
    pick = F.min(F.struct((-F.col("revenue")).alias("neg_rev"), F.col("country").alias("country")))
    return g.agg(F.count(F.lit(1)).alias("total_countries"), pick.alias("p")).select(
        "total_countries", F.col("p.country").alias("top_country"),
        (-F.col("p.neg_rev")).alias("top_revenue"))


def countries(roles: Roles, min_revenue: float | None = None, min_customers: int | None = None,
              k: int = 25) -> DataFrame:
    """Q22: customers, joined rentals, revenue (null when nothing paid) per country."""
    agg = (per_customer(bare_paid_rentals(roles)).join(roles.customer_country, "customer_id")
           .groupBy("country")
           .agg(F.count(F.lit(1)).alias("customers"), F.sum("rows").alias("rentals"),
                F.sum("paid").alias("_rev")))
    cond = F.lit(True)
    if min_revenue is not None:
        cond &= F.round("_rev", 2) > F.lit(min_revenue)
    if min_customers is not None:
        cond &= F.col("customers") > min_customers
    out = agg.where(cond).select("country", "customers", "rentals", money_out("_rev").alias("revenue"))
    return top_k(out, [F.col("revenue").desc_nulls_first(), F.col("country")], k)
