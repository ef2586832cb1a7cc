"""Customer marts: segments, top customers, value tiers, filtered customer lists,
churn risk and loyal customers per country."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import money_out, zero_if_null
from ..operators.fact import bare_paid_rentals, bare_rentals, paid_rentals, per_customer, rentals
from ..operators.filters import Filters, NO_FILTERS
from ..operators.ranking import approximate_quantiles, quantiles_of, rank_counts, top_k, value_ranks
from ..sources.roles import Roles

# Segment labels and value-tier labels as the dashboard shows them.
SEGMENTS = ["1. Elite (40+)", "2. Frequent (30-40)", "3. Regular (20-29)", "4. Casual (<20)"]
TIERS = ["🥉 Low Value", "🥈 Mid Value", "🥇 High Value"]


def full_name(first="first_name", last="last_name"):
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def segment_of(n, elite: int = 40, frequent: int = 30, regular: int = 20):
    """CASE on a rental count: > elite, frequent..elite, regular..frequent-1, else."""
    n = F.col(n) if isinstance(n, str) else n
    return (F.when(n > elite, F.lit(SEGMENTS[0]))
            .when(n.between(frequent, elite), F.lit(SEGMENTS[1]))
            .when(n.between(regular, frequent - 1), F.lit(SEGMENTS[2]))
            .otherwise(F.lit(SEGMENTS[3])))


def customer_rental_counts(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Rentals per customer through the inventory join, no payment join (no fan-out)."""
    return rentals(roles, f).groupBy("customer_id").agg(F.count("rental_id").alias("rental_count"))


def customer_segments(roles: Roles, f: Filters = NO_FILTERS, **thresholds) -> DataFrame:
    """Q8: customers and rentals per activity segment."""
    return (customer_rental_counts(roles, f)
            .groupBy(segment_of("rental_count", **thresholds).alias("segment"))
            .agg(F.count("customer_id").alias("total_customers"),
                 F.sum("rental_count").alias("total_rentals")))


def customer_value(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Per customer: joined rentals and revenue (0 when nothing paid), exact decimal."""
    return (paid_rentals(roles, f).groupBy("customer_id")
            .agg(F.sum("rows").alias("rentals"), zero_if_null(F.sum("paid")).alias("revenue")))


def top_customers(roles: Roles, f: Filters = NO_FILTERS, k: int = 15) -> DataFrame:
    """Q9: top k customers by revenue with name, joined rentals and last rental date."""
    agg = (paid_rentals(roles, f).groupBy("customer_id")
           .agg(F.sum("rows").alias("rentals"), zero_if_null(F.sum("paid")).alias("_rev"),
                F.max("rental_date").cast("date").alias("last_rental")))
    # customers without a name row do not count: keep known ids (a bare key join), then name only the k that stay
    best = top_k(agg.join(roles.customer.select("customer_id"), "customer_id", "left_semi"), [F.col("_rev").desc(), F.col("customer_id")], k)
    return (best.join(roles.customer, "customer_id").orderBy(F.col("_rev").desc(), "customer_id")
            .select("customer_id", full_name().alias("name"), "rentals", money_out("_rev").alias("revenue"), "last_rental"))


def top_customers_by_name(roles: Roles, f: Filters = NO_FILTERS, k: int = 10) -> DataFrame:
    """Q10: as Q9 but grouped by the name only, so namesakes merge."""
    agg = (per_customer(paid_rentals(roles, f)).join(roles.customer, "customer_id")
           .groupBy(full_name().alias("name"))
           .agg(F.sum("rows").alias("rentals"), zero_if_null(F.sum("paid")).alias("_rev"),
                F.max("last").cast("date").alias("last_rental")))
    return top_k(agg, [F.col("_rev").desc(), F.col("name")], k).select(
        "name", "rentals", money_out("_rev").alias("revenue"), "last_rental")


def half_even_ratio(num: str, den: str, digits: int):
    """Exact ROUND_HALF_EVEN(num / den, digits) for non-negative integer columns, as double."""
    scale = 10 ** digits
    return F.expr(f"""(({scale} * {num}) div {den} + CASE
        WHEN 2 * (({scale} * {num}) % {den}) > {den} THEN 1
        WHEN 2 * (({scale} * {num}) % {den}) = {den} THEN (({scale} * {num}) div {den}) % 2
        ELSE 0 END) / {float(scale)}""").cast("double")


def customer_value_tiers(roles: Roles, f: Filters = NO_FILTERS, approximate: bool = False) -> DataFrame:
    """Q11: three equal-frequency revenue tiers (linear-interpolated edges, right
    closed, lowest included).  Any collapsed edge puts everyone in the middle tier.
    ``approximate`` takes the edges from a merged sketch: within 0.2 % of the customers' ranks,
    without dealing the values to ranges."""
    if approximate:
        values = customer_value(roles, f).withColumn("cnt", F.lit(1).cast("bigint"))
        e = approximate_quantiles(values, "revenue", [1 / 3, 2 / 3])
    else:
        # one row per distinct revenue, with its customers and their rentals
        values = value_ranks(customer_value(roles, f), "revenue", sums=["rentals"])
        e = quantiles_of(values, "revenue", [1 / 3, 2 / 3])
    edges = e.select(F.struct(F.col("q0").alias("e1"), F.col("q1").alias("e2"),
                              F.col("vmin").cast("double").alias("lo"),
                              F.col("vmax").cast("double").alias("hi"))).scalar()
    # attach the one-row edges once (a single scalar subquery), then refer to its fields
    values = values.withColumn("_e", edges)
    e1, e2 = F.col("_e.e1"), F.col("_e.e2")
    ok = (F.col("_e.lo") < e1) & (e1 < e2) & (e2 < F.col("_e.hi"))
    rev = F.col("revenue").cast("double")
    tier_ord = F.when(~ok, F.lit(1)).when(rev <= e1, F.lit(0)).when(rev <= e2, F.lit(1)).otherwise(F.lit(2))
    tiers = F.array(*[F.lit(t) for t in TIERS])
    return (values.withColumn("tier_ord", tier_ord)
            .groupBy("tier_ord")
            .agg(F.sum("cnt").alias("customers"),
                 F.sum(F.col("revenue") * F.col("cnt")).alias("_rev"), F.sum("rentals").alias("_rent"))
            .select(F.element_at(tiers, F.col("tier_ord") + 1).alias("tier"),
                    F.col("tier_ord").cast("bigint").alias("tier_ord"), "customers",
                    F.bround(F.col("_rev") / F.col("customers"), 2).cast("double").alias("avg_revenue"),
                    half_even_ratio("_rent", "customers", 1).alias("avg_rentals")))


def customer_value_tiers_pr(roles: Roles, f: Filters = NO_FILTERS) -> DataFrame:
    """Q12: tiers from PERCENT_RANK()*100 of revenue: <=33 low, <=66 mid, else high."""
    ranked = rank_counts(customer_value(roles, f), "revenue", out="pr")
    pct = F.col("pr") * F.lit(100.0)
    tier = (F.when(pct <= 33, F.lit(TIERS[0])).when(pct <= 66, F.lit(TIERS[1]))
            .otherwise(F.lit(TIERS[2])))
    return ranked.groupBy(tier.alias("tier")).agg(F.sum("cnt").alias("customers"))


def customers_list(roles: Roles, country: str | None = None, min_spent: float | None = None,
                   max_spent: float | None = None, min_rentals: int | None = None,
                   by_rentals: bool = False, k: int = 30) -> DataFrame:
    """Q20: customers with country, joined rentals and spend (null when nothing paid)."""
    agg = (bare_paid_rentals(roles).groupBy("customer_id")
           .agg(F.sum("rows").alias("total_rentals"), F.sum("paid").alias("_spent")))
    rows = (roles.customer.join(roles.customer_country, "customer_id").join(agg, "customer_id"))
    spent2 = F.round("_spent", 2)
    cond = F.lit(True)
    if country is not None:
        cond &= F.lower("country") == country.lower()
    if min_spent is not None:
        cond &= spent2 > F.lit(min_spent)
    if max_spent is not None:
        cond &= spent2 < F.lit(max_spent)
    if min_rentals is not None:
        cond &= F.col("total_rentals") > min_rentals
    out = rows.where(cond).select("customer_id", full_name().alias("customer"), "country",
                                  "total_rentals", money_out("_spent").alias("total_spent"))
    key = "total_rentals" if by_rentals else "total_spent"
    return top_k(out, [F.col(key).desc_nulls_first(), F.col("customer_id")], k).drop("customer_id")


def churn_risk(roles: Roles, cutoff: str) -> DataFrame:
    """Q38: customers whose last rental is before ``cutoff`` (YYYY-MM-DD)."""
    last = bare_rentals(roles).groupBy("customer_id").agg(
        F.max("rental_date").alias("_last"), F.count("rental_id").alias("rentals"))
    return (last.where(F.col("_last") < F.lit(cutoff).cast(last.schema["_last"].dataType))
            .join(roles.customer, "customer_id")
            .select("customer_id", full_name().alias("name"),
                    F.col("_last").cast("date").alias("last_rental"), "rentals"))


def loyal_by_country(roles: Roles, min_rentals: int = 40) -> DataFrame:
    """Q39: number of customers with at least ``min_rentals`` rentals, per country."""
    counts = bare_rentals(roles).groupBy("customer_id").agg(F.count("rental_id").alias("n"))
    return (counts.where(F.col("n") >= min_rentals).join(roles.customer_country, "customer_id")
            .groupBy("country").agg(F.count(F.lit(1)).alias("loyal_customers")))
