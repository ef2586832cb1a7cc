"""Registered report jobs (R1-R10) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..oracle import with_roles
from ..plans import customers as cu
from ..reports import sections as rp
from ..registry import register
from .extra import sales_context_sql
from .marts import CATS, CHAIN, FACT, GEO, PAY


def m2(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def p2(x: str) -> str:
    return f"format('{{:.2f}}', CAST({x} AS DOUBLE))"


def i0(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def sec(ord_: int, header: str, body_sql: str, line: str, order: str) -> str:
    hdr = header.replace("'", "''")
    return (f"SELECT {ord_} AS section_ord, 0 AS rank, '{hdr}' AS line UNION ALL "
            f"SELECT {ord_}, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER), {line} FROM ({body_sql}) b")


_KPI = f"""(SELECT
  (SELECT COALESCE(SUM(p.amount), 0) FROM payment p JOIN rental r ON p.rental_id = r.rental_id
     JOIN inventory i ON r.inventory_id = i.inventory_id) AS rev,
  (SELECT COUNT(DISTINCT r.customer_id) {FACT}) AS customers,
  (SELECT COUNT(DISTINCT r.rental_id) {FACT}) AS rentals,
  (SELECT COUNT(DISTINCT i.inventory_id) FROM inventory i) AS inv,
  (SELECT COUNT(DISTINCT i.film_id) FROM inventory i) AS films)"""

_STORES = (f"SELECT i.store_id, ROUND(COALESCE(SUM(p.amount), 0), 2) AS rev, COUNT(DISTINCT r.rental_id) AS n, "
           f"COUNT(DISTINCT r.customer_id) AS c {FACT} {PAY} GROUP BY i.store_id")
_MONTHS = (f"SELECT strftime(r.rental_date, '%Y-%m') AS month, ROUND(COALESCE(SUM(p.amount), 0), 2) AS rev, "
           f"COUNT(r.rental_id) AS rentals {FACT} {PAY} GROUP BY 1")
_CATS = (f"SELECT cat.name AS category, ROUND(COALESCE(SUM(p.amount), 0), 2) AS rev, COUNT(r.rental_id) AS rentals, "
         f"ROUND(COALESCE(SUM(p.amount), 0) / NULLIF(COUNT(DISTINCT i.inventory_id), 0), 2) AS rpi "
         f"{FACT} {CATS} {PAY} GROUP BY cat.name")
_TOPC = (f"SELECT c.first_name || ' ' || c.last_name AS name, COUNT(r.rental_id) AS rentals, "
         f"ROUND(COALESCE(SUM(p.amount), 0), 2) AS rev, CAST(MAX(r.rental_date) AS DATE) AS last_rental "
         f"{FACT} JOIN cust c ON r.customer_id = c.customer_id {PAY} GROUP BY c.first_name, c.last_name "
         f"ORDER BY COALESCE(SUM(p.amount), 0) DESC, name LIMIT 10")
_GEO = (f"SELECT co.country, COUNT(DISTINCT r.customer_id) AS customers, ROUND(COALESCE(SUM(p.amount), 0), 2) AS rev "
        f"{FACT} JOIN cust c ON r.customer_id = c.customer_id {PAY} {GEO} WHERE co.country IS NOT NULL "
        f"GROUP BY co.country ORDER BY rev DESC, co.country LIMIT 10")
_HOURS = ("SELECT CAST(EXTRACT(HOUR FROM ts) AS INTEGER) AS h, COUNT(*) AS rentals, "
          "ROUND(COALESCE(SUM(amount), 0), 2) AS rev FROM activity GROUP BY 1 ORDER BY rentals DESC, h LIMIT 5")
_DAYS = (f"SELECT dayname(r.rental_date) AS day_name, EXTRACT(DOW FROM r.rental_date) AS dow, COUNT(*) AS rentals, "
         f"ROUND(COALESCE(SUM(p.amount), 0), 2) AS rev {FACT} {PAY} GROUP BY 1, 2")
_AMPM = "CASE WHEN h < 12 THEN CAST(h AS VARCHAR) || 'AM' WHEN h = 12 THEN '12PM' ELSE CAST(h - 12 AS VARCHAR) || 'PM' END"

_R1 = with_roles(f"""
SELECT 0 AS section_ord, 0 AS rank, '=== REAL-TIME DASHBOARD DATA (Filter: Store=All, Month=All) ===' AS line
UNION ALL SELECT 1, 0, '[KEY PERFORMANCE INDICATORS]'
UNION ALL SELECT 1, CAST(u.pos AS INTEGER), u.line FROM (
  SELECT unnest([
    'Total Revenue: ' || {m2('ROUND(rev, 2)')},
    'Total Customers: ' || {i0('customers')},
    'Total Rentals: ' || {i0('rentals')},
    'Inventory Items: ' || {i0('inv')},
    'Film Titles: ' || CAST(films AS VARCHAR),
    'Avg Revenue per Rental: $' || {p2('CASE WHEN rentals > 0 THEN ROUND(rev / rentals, 2) ELSE 0 END')}]) AS line,
    unnest([1, 2, 3, 4, 5, 6]) AS pos
  FROM {_KPI} k) u
UNION ALL {sec(2, '[STORE COMPARISON — both stores, month filter applied]', _STORES,
               "'  Store ' || CAST(store_id AS VARCHAR) || ': Revenue=' || " + m2('rev') + " || ', Rentals=' || " + i0('n') + " || ', Customers=' || CAST(c AS VARCHAR)",
               'store_id')}
UNION ALL {sec(3, '[MONTHLY REVENUE TREND]', _MONTHS,
               "'  ' || month || ': Revenue=' || " + m2('rev') + " || ', Rentals=' || CAST(rentals AS VARCHAR)", 'month')}
UNION ALL {sec(4, '[CATEGORIES BY REVENUE]', _CATS,
               "'  #' || CAST(row_number() OVER (ORDER BY rev DESC, category) AS VARCHAR) || ' ' || category || ': Revenue=' || "
               + m2('rev') + " || ', Rentals=' || CAST(rentals AS VARCHAR) || ', Rev/Inventory=$' || " + p2('rpi'),
               'rev DESC, category')}
UNION ALL {sec(5, '[TOP 10 CUSTOMERS BY REVENUE]', _TOPC,
               "'  #' || CAST(row_number() OVER (ORDER BY rev DESC, name) AS VARCHAR) || ' ' || name || ': Revenue=' || "
               + m2('rev') + " || ', Rentals=' || CAST(rentals AS VARCHAR) || ', Last Rental=' || CAST(last_rental AS VARCHAR)",
               'rev DESC, name')}
UNION ALL {sec(6, '[TOP 10 COUNTRIES BY REVENUE]', _GEO,
               "'  #' || CAST(row_number() OVER (ORDER BY rev DESC, country) AS VARCHAR) || ' ' || country || ': Revenue=' || "
               + m2('rev') + " || ', Customers=' || CAST(customers AS VARCHAR)", 'rev DESC, country')}
UNION ALL {sec(7, '[PEAK HOURS (by rental count)]', _HOURS,
               "'  ' || " + _AMPM + " || ' (hour ' || CAST(h AS VARCHAR) || '): ' || CAST(rentals AS VARCHAR) || ' rentals, Revenue=' || " + m2('rev'),
               'rentals DESC, h')}
UNION ALL {sec(8, '[REVENUE BY DAY OF WEEK]', _DAYS,
               "'  ' || day_name || ': ' || CAST(rentals AS VARCHAR) || ' rentals, Revenue=' || " + m2('rev'),
               'rentals DESC, dow')}
""")


@register("report_context", _R1)
def q_report_context(roles):
    return rp.context_report(roles)


_SS = f"SELECT 'Store ' || CAST(i.store_id AS VARCHAR) AS store, ROUND(SUM(p.amount), 2) AS rev, COUNT(r.rental_id) AS rentals, COUNT(DISTINCT r.customer_id) AS customers {FACT} {PAY} GROUP BY i.store_id"


@register("report_store_performance", with_roles(f"""
, s AS ({_SS}),
l AS (SELECT * FROM s ORDER BY rev DESC NULLS FIRST, store LIMIT 1)
SELECT 0 AS section_ord, 0 AS rank,
       'Total Revenue: ' || {m2('(SELECT ROUND(SUM(rev), 2) FROM s)')} || ' | Leader: ' || l.store || ' with ' || {m2('l.rev')}
       || ' (' || format('{{:,.1f}}', CAST(l.rev AS DOUBLE) / (SELECT SUM(CAST(rev AS DOUBLE)) FROM s) * 100) || '% of total)' AS line
FROM l
UNION ALL {sec(1, '| Store | Revenue | Rentals | Customers |', 'SELECT * FROM s',
               "'| **' || store || '** | **' || " + m2('rev') + " || '** | ' || " + i0('rentals') + " || ' | ' || " + i0('customers') + " || ' |'",
               'rev DESC NULLS FIRST, store')}"""))
def q_report_store_perf(roles):
    return rp.store_performance(roles)


_MALL = ("SELECT strftime(r.rental_date, '%Y-%m') AS month, ROUND(SUM(p.amount), 2) AS revenue "
         "FROM rental r LEFT JOIN payment p ON r.rental_id = p.rental_id GROUP BY 1")


@register("report_last_months", with_roles(f"""
, l AS (SELECT * FROM ({_MALL}) m ORDER BY month DESC LIMIT 4),
c AS (SELECT month, revenue, ROUND((revenue - LAG(revenue) OVER (ORDER BY month)) /
             GREATEST(LAG(revenue) OVER (ORDER BY month), 1) * 100, 4) AS chg FROM l)
{sec(0, '| Month | Revenue | vs Prev |', 'SELECT * FROM c',
     "CASE WHEN chg IS NULL THEN '| ' || month || ' | ' || " + m2('revenue') + " || ' | — |' ELSE '| **' || month || '** | **' || "
     + m2('revenue') + " || '** | ' || CASE WHEN chg > 0 THEN '▲' ELSE '▼' END || ' ' || format('{:,.1f}', CAST(ABS(chg) AS DOUBLE)) || '% |' END",
     'month')}"""))
def q_report_last_months(roles):
    return rp.last_months(roles, 4)


@register("report_category_ranking", with_roles(f"""
, c AS (SELECT c.name AS category, COUNT(r.rental_id) AS rentals, ROUND(SUM(p.amount), 2) AS rev
        FROM category c JOIN film_category fc ON c.category_id = fc.category_id JOIN film f ON fc.film_id = f.film_id
        {CHAIN} GROUP BY c.name ORDER BY rev DESC NULLS FIRST, c.name LIMIT 5),
r AS (SELECT row_number() OVER (ORDER BY rev DESC NULLS FIRST, category) AS rnk, * FROM c)
{sec(0, '| Rank | Category | Revenue | Rentals |', 'SELECT * FROM r',
     "'| ' || COALESCE(['🥇', '🥈', '🥉', '4️⃣', '5️⃣'][rnk], CAST(rnk AS VARCHAR)) || ' | **' || category || '** | **' || "
     + m2('rev') + " || '** | ' || " + i0('rentals') + " || ' |'", 'rnk')}"""))
def q_report_categories(roles):
    return rp.category_ranking(roles, 5)


@register("report_recent_trend", with_roles(f"""
, m AS ({_MALL}),
l AS (SELECT * FROM m ORDER BY month DESC LIMIT 3),
k AS (SELECT (SELECT revenue FROM m ORDER BY month DESC LIMIT 1) AS last,
             COALESCE((SELECT revenue FROM m ORDER BY month DESC LIMIT 1 OFFSET 1),
                      (SELECT revenue FROM m ORDER BY month DESC LIMIT 1)) AS prev),
d AS (SELECT ROUND((last - prev) / GREATEST(prev, 1) * 100, 4) AS chg FROM k)
SELECT 0 AS section_ord, 0 AS rank, 'Revenue is currently ' || CASE WHEN chg > 0 THEN 'growing' ELSE 'declining' END
       || ' (' || format('{{:,.1f}}', CAST(ABS(chg) AS DOUBLE)) || '% vs previous month)' AS line FROM d
UNION ALL {sec(1, 'Recent trend (last 3 months):', 'SELECT * FROM l',
               "'- **' || month || '**: ' || " + m2('revenue'), 'month')}"""))
def q_report_recent(roles):
    return rp.recent_summary(roles, 3)


@register("report_customers_table", with_roles(f"""
, t AS (SELECT c.first_name || ' ' || c.last_name AS customer, co.country, COUNT(r.rental_id) AS total_rentals,
               CAST(ROUND(SUM(p.amount), 2) AS DOUBLE) AS total_spent, c.customer_id
        FROM cust c {GEO} JOIN rental r ON c.customer_id = r.customer_id LEFT JOIN payment p ON r.rental_id = p.rental_id
        GROUP BY c.customer_id, c.first_name, c.last_name, co.country
        ORDER BY total_spent DESC NULLS FIRST, c.customer_id LIMIT 30)
{sec(0, '| # | Customer | Country | Total Rentals | Total Spent |', 'SELECT * FROM t',
     "'| ' || CAST(row_number() OVER (ORDER BY total_spent DESC NULLS FIRST, customer) AS VARCHAR) || ' | ' || "
     "concat_ws(' | ', COALESCE(customer, '—'), COALESCE(country, '—'), COALESCE(CAST(total_rentals AS VARCHAR), '—'), "
     "COALESCE('**$' || " + p2('total_spent') + " || '**', '—')) || ' |'",
     'total_spent DESC NULLS FIRST, customer')}"""))
def q_report_table(roles):
    t = cu.customers_list(roles)
    order = [F.col("total_spent").desc_nulls_first(), F.col("customer")]
    return rp.render_table(t, order)


def p1(x: str) -> str:
    return f"format('{{:.1f}}', CAST({x} AS DOUBLE))"


_R3_CTES, _R3_SELECT = sales_context_sql(20)


@register("report_recommendations", with_roles(_R3_CTES + f""", sc AS ({_R3_SELECT})
SELECT 0 AS section_ord, 0 AS rank, '## 🎯 5 Recommendations to Increase Sales' AS line
UNION ALL SELECT 0, 1, '**1. 🏆 Double down on ' || top_category || '**' FROM sc
UNION ALL SELECT 0, 2, '   → Titles like ' || CASE WHEN slow_titles = 'several titles' THEN slow_titles
       ELSE '*' || replace(slow_titles, ', ', '*, *') || '*' END || ' have <20 rentals.' FROM sc"""))
def q_report_recommendations(roles):
    return rp.recommendations(roles, slow_below=20)


_H3 = ("SELECT CAST(EXTRACT(HOUR FROM ts) AS BIGINT) AS hour, COUNT(*) AS rentals FROM activity "
       "GROUP BY 1 ORDER BY rentals DESC, hour LIMIT 3")
_D3 = ("SELECT dayname(rental_date) AS day, EXTRACT(DOW FROM rental_date) AS dow, COUNT(*) AS rentals FROM rental "
       "GROUP BY 1, 2 ORDER BY rentals DESC, dow LIMIT 3")


@register("report_patterns", with_roles(f""", h AS ({_H3}), d AS ({_D3})
{sec(1, '| Hour | Rentals |', 'SELECT * FROM h',
     "'| **' || CAST(hour AS VARCHAR) || ':00** | ' || " + i0('rentals') + " || ' |'", 'rentals DESC, hour')}
UNION ALL SELECT 2, 0, '🕐 **Peak time: ' || CAST(hour AS VARCHAR) || ':00–' || CAST(hour + 1 AS VARCHAR) || ':00**'
  FROM (SELECT * FROM h ORDER BY rentals DESC, hour LIMIT 1) x
UNION ALL {sec(3, '| Day | Rentals |', 'SELECT * FROM d',
     "'| **' || day || '** | ' || " + i0('rentals') + " || ' |'", 'rentals DESC, dow')}
UNION ALL SELECT 4, 0, '📅 **Best day: ' || day || '**' FROM (SELECT * FROM d ORDER BY rentals DESC, dow LIMIT 1) y"""))
def q_report_patterns(roles):
    return rp.patterns_report(roles, 3)


@register("report_trend", with_roles(f""", m AS ({_MALL}),
t AS (SELECT month, revenue, revenue = MAX(revenue) OVER () AS pk, LAG(month) OVER (ORDER BY month) AS prev_month,
             (revenue - LAG(revenue) OVER (ORDER BY month)) / GREATEST(LAG(revenue) OVER (ORDER BY month), 1) * 100 AS chg
      FROM m WHERE revenue > 0)
{sec(1, '| Month | Revenue | Note |', 'SELECT * FROM t',
     "'| ' || month || ' | **' || " + m2('revenue') + " || '** | ' || CASE WHEN pk THEN '🏆 Peak' WHEN revenue < 1000 "
     "THEN '⚠️ Data cutoff' ELSE '' END || ' |'", 'month')}
UNION ALL SELECT 2, 0, '**Biggest drop:** ' || month || ' (' || {p1('chg')} || '% vs ' || prev_month || ')'
  FROM (SELECT * FROM t WHERE chg < -10 ORDER BY chg, month LIMIT 1) b
UNION ALL SELECT 3, 0, '**Peak month: ' || month || '** → **' || {m2('revenue')} || '**'
  FROM (SELECT * FROM t ORDER BY revenue DESC, month LIMIT 1) p
UNION ALL SELECT 4, 0, 'Most recent valid month (' || month || ') ' || CASE WHEN chg > 0 THEN '📈 increased' ELSE '📉 decreased' END
  || ' by **' || {p1('ABS(chg)')} || '%** vs previous month.'
  FROM (SELECT * FROM t ORDER BY month DESC LIMIT 1) l WHERE chg IS NOT NULL"""))
def q_report_trend(roles):
    return rp.trend_report(roles)


@register("report_store_difference", with_roles(f""", s AS ({_SS}),
two AS (SELECT row_number() OVER (ORDER BY rev DESC NULLS FIRST, store) AS i, * FROM
        (SELECT * FROM s ORDER BY rev DESC NULLS FIRST, store LIMIT 2) x),
a AS (SELECT * FROM two WHERE i = 1), b AS (SELECT * FROM two WHERE i = 2)
SELECT 0 AS section_ord, CAST(u.pos AS INTEGER) AS rank, u.line FROM (
  SELECT unnest([
    '| | ' || a.store || ' | ' || b.store || ' |',
    '| **Revenue** | ' || {m2('a.rev')} || ' | ' || {m2('b.rev')} || ' |',
    '| **Rentals** | ' || {i0('a.rentals')} || ' | ' || {i0('b.rentals')} || ' |',
    '| **Rev/Rental** | $' || {p2('ROUND(a.rev / GREATEST(a.rentals, 1), 2)')} || ' | $' || {p2('ROUND(b.rev / GREATEST(b.rentals, 1), 2)')} || ' |',
    '**' || CASE WHEN a.rentals > b.rentals THEN a.store ELSE b.store END || '** has more rentals but **'
      || CASE WHEN a.rev > b.rev THEN a.store ELSE b.store END || '** generates more revenue.']) AS line,
    unnest([0, 1, 2, 3, 4]) AS pos
  FROM a, b) u"""))
def q_report_store_difference(roles):
    return rp.store_difference(roles)


@register("film_utilization_bars", with_roles("""
, u AS (SELECT f.title, COUNT(DISTINCT i.inventory_id) AS copies, COUNT(r.rental_id) AS times_rented,
               ROUND(CAST(COUNT(r.rental_id) AS DECIMAL(20,0)) / NULLIF(COUNT(DISTINCT i.inventory_id), 0), 2) AS util
        FROM film f JOIN inventory i ON f.film_id = i.film_id
        JOIN film_category fc ON f.film_id = fc.film_id JOIN category cat ON fc.category_id = cat.category_id
        LEFT JOIN rental r ON i.inventory_id = r.inventory_id LEFT JOIN payment p ON r.rental_id = p.rental_id
        GROUP BY f.title, cat.name ORDER BY util DESC NULLS FIRST, f.title, cat.name LIMIT 15)
SELECT title, CAST(util AS DOUBLE) AS util_rate, LEAST(100.0, CAST(util AS DOUBLE) / 30.0 * 100) AS util_bar FROM u"""))
def q_film_util_bars(roles):
    """Utilisation bar length next to the utilisation rate."""
    from ..plans import inventory as inv
    u = inv.film_utilization(roles)
    return u.select("title", "util_rate", inv.utilization_bar(F.col("util_rate")).alias("util_bar"))


@register("report_result_headings", with_roles("""
, f AS (SELECT 'films' AS label, COUNT(*) AS n FROM film UNION ALL SELECT 'none', COUNT(*) FROM film WHERE title IS NULL
        UNION ALL SELECT 'stores', COUNT(*) FROM stores)
SELECT label, 0 AS rank, CASE WHEN n = 0 THEN '📊 **No results found.**' ELSE '## 👥 ' || label END AS line FROM f
UNION ALL
SELECT label, 1, CASE WHEN n = 0 THEN '*' || label || '*' WHEN n > 30 THEN '*Showing top 30 of ' || n || ' found*'
                      WHEN n = 1 THEN '*1 result found*' ELSE '*' || n || ' results found*' END FROM f"""))
def q_result_headings(roles):
    """The heading of a long, an empty and a short result."""
    from ..reports.sections import result_heading
    parts = [result_heading(df, label).select(F.lit(label).alias("label"), "rank", "line") for label, df in (
        ("films", roles.film), ("none", roles.film.where("title is null")), ("stores", roles.stores))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
