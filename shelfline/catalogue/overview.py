from __future__ import annotations

from ..operators.filters import Filters
from ..oracle import with_roles
from ..plans import overview as ov
from ..registry import register
from .sqlbits import TEST_MONTH, TEST_STORE, mc, money, sc, store_lbl

FACT = "FROM rental r JOIN inventory i ON r.inventory_id = i.inventory_id"
PAY = "LEFT JOIN payment p ON p.rental_id = r.rental_id"


@register("months", with_roles("""
SELECT CAST(0 AS BIGINT) AS pos, 'All' AS month
UNION ALL
SELECT CAST(row_number() OVER (ORDER BY month) AS BIGINT), month
FROM (SELECT DISTINCT strftime(rental_date, '%Y-%m') AS month FROM rental) t
"""))
def q_months(roles):
    return ov.months(roles)


def _kpi_sql(store, month):
    return with_roles(f"""
, k AS (SELECT
  (SELECT COALESCE(SUM(p.amount), 0) FROM payment p JOIN rental r ON p.rental_id = r.rental_id
     JOIN inventory i ON r.inventory_id = i.inventory_id WHERE 1=1 {sc(store)} {mc(month)}) AS rev,
  (SELECT COUNT(DISTINCT r.customer_id) {FACT} WHERE 1=1 {sc(store)} {mc(month)}) AS customers,
  (SELECT COUNT(DISTINCT r.rental_id) {FACT} WHERE 1=1 {sc(store)} {mc(month)}) AS rentals,
  (SELECT COUNT(DISTINCT i.inventory_id) FROM inventory i WHERE 1=1 {sc(store)}) AS inventory,
  (SELECT COUNT(DISTINCT i.film_id) FROM inventory i WHERE 1=1 {sc(store)}) AS films)
SELECT {money('rev')} AS revenue, customers, rentals, inventory, films,
       CASE WHEN rentals > 0 THEN CAST(ROUND(rev / rentals, 2) AS DOUBLE) ELSE 0.0 END AS avg_tx
FROM k
""")


@register("kpi", _kpi_sql(None, None))
def q_kpi(roles):
    return ov.kpi(roles)


@register("kpi_store_month", _kpi_sql(TEST_STORE, TEST_MONTH))
def q_kpi_store_month(roles):
    return ov.kpi(roles, Filters.of(TEST_STORE, TEST_MONTH))


def _store_compare_sql(month):
    return with_roles(f"""
, agg AS (
  SELECT i.store_id, COALESCE(SUM(p.amount), 0) AS rev, COUNT(DISTINCT r.rental_id) AS rentals,
         COUNT(DISTINCT r.customer_id) AS customers
  {FACT} {PAY} WHERE 1=1 {mc(month)} GROUP BY i.store_id)
SELECT {store_lbl('s.store_id')} AS store, {money('COALESCE(a.rev, 0)')} AS revenue,
       COALESCE(a.rentals, 0) AS rentals, COALESCE(a.customers, 0) AS customers
FROM stores s LEFT JOIN agg a ON a.store_id = s.store_id
""")


@register("store_compare", _store_compare_sql(None))
def q_store_compare(roles):
    return ov.store_compare(roles)


@register("store_compare_month", _store_compare_sql(TEST_MONTH))
def q_store_compare_month(roles):
    # the store filter is ignored by design: pass one to prove it
    return ov.store_compare(roles, Filters.of(TEST_STORE, TEST_MONTH))


@register("trend_monthly", with_roles(f"""
SELECT CAST(DATE_TRUNC('month', r.rental_date) AS DATE) AS period, {store_lbl()} AS store,
       COUNT(r.rental_id) AS rentals, {money('COALESCE(SUM(p.amount), 0)')} AS revenue
{FACT} {PAY} GROUP BY 1, 2
"""))
def q_trend_monthly(roles):
    return ov.trend(roles)


@register("trend_daily_store_month", with_roles(f"""
SELECT CAST(r.rental_date AS DATE) AS period, {store_lbl()} AS store,
       COUNT(r.rental_id) AS rentals, {money('COALESCE(SUM(p.amount), 0)')} AS revenue
{FACT} {PAY} WHERE strftime(r.rental_date, '%Y-%m') = '{TEST_MONTH}' {sc(TEST_STORE)} GROUP BY 1, 2
"""))
def q_trend_daily(roles):
    return ov.trend(roles, Filters.of(TEST_STORE, TEST_MONTH))


@register("store_summary", with_roles(f"""
, agg AS (
  SELECT i.store_id, SUM(p.amount) AS rev, COUNT(r.rental_id) AS rentals,
         COUNT(DISTINCT r.customer_id) AS customers
  {FACT} {PAY} GROUP BY i.store_id)
SELECT {store_lbl('store_id')} AS store, {money('rev')} AS revenue, rentals, customers,
       CAST(ROUND(rev / SUM(rev) OVER () * 100, 1) AS DOUBLE) AS revenue_share,
       {money('rev / GREATEST(rentals, 1)')} AS revenue_per_rental,
       row_number() OVER (ORDER BY rev DESC NULLS FIRST, store_id) = 1 AS leader,
       {money('MAX(rev) OVER () - rev')} AS revenue_gap,
       MAX(rentals) OVER () - rentals AS rentals_gap
FROM agg
"""))
def q_store_summary(roles):
    return ov.store_summary(roles)
