"""Registered Q18 share charts and the Q41 context row."""

from __future__ import annotations

from ..operators.filters import Filters
from ..oracle import with_roles
from ..plans import context as cx
from ..plans import share as sh
from ..registry import register
from .marts import CATS, CHAIN, FACT, GEO, PAY, TEST_STORE, day_short_sql
from .sqlbits import money, store_lbl

_SEG = """CASE WHEN rc > 40 THEN '1. Elite (40+)' WHEN rc BETWEEN 30 AND 40 THEN '2. Frequent (30-40)'
               WHEN rc BETWEEN 20 AND 29 THEN '3. Regular (20-29)' ELSE '4. Casual (<20)' END"""

_POINTS = {
    "chart-store-rev": f"SELECT {store_lbl()} AS label, {money('COALESCE(SUM(p.amount), 0)')} AS value "
                       f"{FACT} {PAY} GROUP BY i.store_id",
    "chart-store-rent": f"SELECT {store_lbl()} AS label, CAST(COUNT(r.rental_id) AS DOUBLE) AS value "
                        f"{FACT} GROUP BY i.store_id",
    "chart-trend-rev": f"SELECT strftime(r.rental_date, '%Y-%m') AS label, {money('COALESCE(SUM(p.amount), 0)')} AS value "
                       f"{FACT} {PAY} GROUP BY 1",
    "chart-trend-rent": f"SELECT strftime(r.rental_date, '%Y-%m') AS label, CAST(COUNT(r.rental_id) AS DOUBLE) AS value "
                        f"{FACT} GROUP BY 1",
    "chart-top-cat": f"SELECT cat.name AS label, {money('COALESCE(SUM(p.amount), 0)')} AS value "
                     f"{FACT} {CATS} {PAY} GROUP BY cat.name",
    "chart-cat-pie": f"SELECT cat.name AS label, CAST(COUNT(r.rental_id) AS DOUBLE) AS value "
                     f"{FACT} {CATS} {PAY} GROUP BY cat.name",
    "chart-rev-inv": f"SELECT cat.name AS label, CAST(ROUND(COALESCE(SUM(p.amount), 0) / "
                     f"NULLIF(COUNT(DISTINCT i.inventory_id), 0), 2) AS DOUBLE) AS value "
                     f"{FACT} {CATS} {PAY} GROUP BY cat.name",
    "chart-cust-seg": f"SELECT {_SEG} AS label, CAST(COUNT(customer_id) AS DOUBLE) AS value FROM "
                      f"(SELECT r.customer_id, COUNT(r.rental_id) AS rc {FACT} GROUP BY r.customer_id) cs GROUP BY 1",
    "chart-cust-val": "SELECT CASE WHEN pct <= 33 THEN '🥉 Low Value' WHEN pct <= 66 THEN '🥈 Mid Value' "
                      "ELSE '🥇 High Value' END AS label, CAST(COUNT(*) AS DOUBLE) AS value FROM "
                      "(SELECT r.customer_id, PERCENT_RANK() OVER (ORDER BY COALESCE(SUM(p.amount), 0)) * 100 AS pct "
                      f"{FACT} {PAY} GROUP BY r.customer_id) t GROUP BY 1",
    "chart-geo-map": f"SELECT co.country AS label, {money('COALESCE(SUM(p.amount), 0)')} AS value "
                     f"{FACT} JOIN cust c ON r.customer_id = c.customer_id {PAY} {GEO} "
                     "WHERE co.country IS NOT NULL GROUP BY co.country ORDER BY value DESC, label LIMIT 10",
    "chart-hourly": "SELECT lpad(CAST(EXTRACT(HOUR FROM ts) AS VARCHAR), 2, '0') || ':00' AS label, "
                    "CAST(COUNT(*) AS DOUBLE) AS value FROM activity GROUP BY 1",
    "chart-hourly-rev": "SELECT lpad(CAST(EXTRACT(HOUR FROM ts) AS VARCHAR), 2, '0') || ':00' AS label, "
                        f"{money('COALESCE(SUM(amount), 0)')} AS value FROM activity GROUP BY 1",
    "chart-dow": f"SELECT {day_short_sql('EXTRACT(DOW FROM ts)')} AS label, {money('COALESCE(SUM(amount), 0)')} AS value "
                 "FROM activity GROUP BY EXTRACT(DOW FROM ts)",
    "chart-avg-dur": f"SELECT {day_short_sql('EXTRACT(DOW FROM r.rental_date)')} AS label, "
                     "ROUND(CAST(SUM(epoch_us(r.return_date) - epoch_us(r.rental_date)) AS DOUBLE) / COUNT(*) / 3.6e9, 6) AS value "
                     f"{FACT} WHERE r.return_date IS NOT NULL GROUP BY EXTRACT(DOW FROM r.rental_date)",
}
_POINTS["chart-geo-bar"] = _POINTS["chart-geo-map"]  # two charts of the same ten countries


def _share_sql(cid: str) -> str:
    return with_roles(f", pts AS ({_POINTS[cid]}) "
                      "SELECT label, value, ROUND(value / SUM(value) OVER () * 100, 4) AS percent FROM pts")


def _register_share(cid: str) -> None:
    name = "share_" + cid.removeprefix("chart-").replace("-", "_")

    @register(name, _share_sql(cid))
    def q(roles, _cid=cid):
        return sh.share(roles, _cid)


for _cid in _POINTS:
    _register_share(_cid)


@register("share_hourly_store", with_roles(
    f", pts AS ({_POINTS['chart-hourly'].replace('FROM activity', f'FROM activity WHERE store_id = {TEST_STORE}')}) "
    "SELECT label, value, ROUND(value / SUM(value) OVER () * 100, 4) AS percent FROM pts"))
def q_share_hourly_store(roles):
    return sh.share(roles, "chart-hourly", Filters.of(TEST_STORE))


def sales_context_sql(below: int) -> tuple[str, str]:
    """(CTEs, final SELECT) of the Q41 oracle, reusable by report oracles."""
    ctes = f"""
, st AS (SELECT {store_lbl()} AS store, ROUND(SUM(p.amount), 2) AS revenue {FACT} {PAY} GROUP BY i.store_id),
sl AS (SELECT f.film_id, f.title, COUNT(r.rental_id) AS n
       FROM film f JOIN inventory i ON f.film_id = i.film_id LEFT JOIN rental r ON i.inventory_id = r.inventory_id
       GROUP BY f.film_id, f.title HAVING COUNT(r.rental_id) < {below} ORDER BY n, f.film_id LIMIT 3),
ct AS (SELECT row_number() OVER (ORDER BY rev DESC NULLS FIRST, category) AS rnk, category FROM
       (SELECT c.name AS category, ROUND(SUM(p.amount), 2) AS rev
        FROM category c JOIN film_category fc ON c.category_id = fc.category_id JOIN film f ON fc.film_id = f.film_id
        {CHAIN} GROUP BY c.name ORDER BY rev DESC NULLS FIRST, c.name LIMIT 5) t)"""
    select = """
SELECT CAST(ROUND((SELECT SUM(revenue) FROM st), 2) AS DOUBLE) AS total_revenue,
       (SELECT store FROM st ORDER BY revenue DESC NULLS FIRST, store LIMIT 1) AS leading_store,
       COALESCE((SELECT string_agg(title, ', ' ORDER BY n, film_id) FROM sl), 'several titles') AS slow_titles,
       COALESCE((SELECT category FROM ct ORDER BY rnk LIMIT 1), 'n/a') AS top_category,
       CASE WHEN (SELECT COUNT(*) FROM ct) > 1 THEN (SELECT category FROM ct ORDER BY rnk DESC LIMIT 1)
            ELSE 'n/a' END AS low_category"""
    return ctes, select


@register("sales_context", with_roles("".join(sales_context_sql(20))))
def q_sales_context(roles):
    return cx.sales_context(roles, slow_below=20)
