"""DuckDB oracle: the same role views as SQL CTEs over the raw parquet views.

Oracle queries are written the way the marts are specified (plain joins with
the payment fan-out, no pre-aggregation), so they check the Spark rewrites
rather than repeat them.  Pre-registered views: region nation customer supplier
part orders lineitem events conversations (and the rest of the test tables).
"""

from __future__ import annotations

ROLES_CTE = """
inventory AS (
  SELECT DISTINCT l.l_partkey*100000 + l.l_suppkey AS inventory_id, l.l_partkey AS film_id,
         CAST(n.n_regionkey AS INTEGER) AS store_id
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey),
rental AS (
  SELECT (l.l_orderkey*10 + l.l_linenumber)*10000000000 + (l.l_partkey*100000 + l.l_suppkey) AS rental_id,
         o.o_orderdate AS rental_date, l.l_shipdate AS return_date, o.o_custkey AS customer_id,
         l.l_partkey*100000 + l.l_suppkey AS inventory_id, o.o_orderpriority AS staff_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
payment AS (
  SELECT (l_orderkey*10 + l_linenumber)*10000000000 + (l_partkey*100000 + l_suppkey) AS rental_id,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(20,6)) AS amount
  FROM lineitem WHERE l_returnflag <> 'R'
  UNION ALL
  SELECT (l_orderkey*10 + l_linenumber)*10000000000 + (l_partkey*100000 + l_suppkey),
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(20,6))
  FROM lineitem WHERE l_tax > 0 AND l_linestatus = 'F'),
film AS (
  SELECT p_partkey AS film_id, p_name AS title, p_brand AS rating,
         CAST(p_retailprice AS DECIMAL(12,2)) AS rental_rate FROM part),
film_category AS (SELECT p_partkey AS film_id, p_type AS category_id FROM part),
category AS (SELECT DISTINCT p_type AS category_id, p_type AS name FROM part),
film_actor AS (SELECT DISTINCT l_partkey AS film_id, l_suppkey AS actor_id FROM lineitem),
actor AS (
  SELECT s_suppkey AS actor_id, split_part(s_name, '#', 1) AS first_name,
         split_part(s_name, '#', 2) AS last_name FROM supplier),
cust AS (
  SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name, c_nationkey AS address_id FROM customer),
address AS (SELECT n_nationkey AS address_id, n_nationkey AS city_id FROM nation),
city AS (SELECT n_nationkey AS city_id, n_nationkey AS country_id FROM nation),
country AS (SELECT n_nationkey AS country_id, n_name AS country FROM nation),
stores AS (SELECT CAST(r_regionkey AS INTEGER) AS store_id FROM region),
activity AS (
  SELECT e.ts, e.user_id AS customer_id, CAST(e.value AS DECIMAL(12,2)) AS amount, CAST(n.n_regionkey AS INTEGER) AS store_id
  FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)
"""


def with_roles(body: str) -> str:
    """Prefix a query with the role CTEs.  The customer role is named ``cust``
    (``customer`` is the raw table)."""
    return "WITH " + ROLES_CTE.strip() + "\n" + body
