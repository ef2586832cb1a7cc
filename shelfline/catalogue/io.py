"""Registered source/sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..oracle import with_roles
from ..plans import leaderboards as lb
from ..registry import register
from ..reports.bundle import answers
from ..sources import adhoc, sinks

ADHOC_SQL = ("SELECT r.staff_id, i.store_id, COUNT(*) AS n, MAX(r.rental_date) AS last_rental "
             "FROM rental r JOIN inventory i ON r.inventory_id = i.inventory_id GROUP BY r.staff_id, i.store_id")


@register("adhoc_select", with_roles(f"SELECT * FROM ({ADHOC_SQL}) t ORDER BY n DESC, staff_id, store_id LIMIT 50"))
def q_adhoc(roles):
    """Guarded ad-hoc SELECT over the role views, first 50 rows."""
    adhoc.register_views(roles)
    spark = roles.rental.sparkSession
    res = adhoc.run_select(spark, ADHOC_SQL + " ORDER BY n DESC, staff_id, store_id", max_rows=50, count=False)
    return res.rows


@register("chart_points_films", with_roles("""
SELECT title AS x, CAST(rentals AS DOUBLE) AS y FROM (
  SELECT f.title, COUNT(r.rental_id) AS rentals FROM film f JOIN inventory i ON f.film_id = i.film_id
  LEFT JOIN rental r ON i.inventory_id = r.inventory_id LEFT JOIN payment p ON r.rental_id = p.rental_id
  GROUP BY f.film_id, f.title ORDER BY rentals DESC, f.film_id LIMIT 15) t"""))
def q_chart_points(roles):
    """Chart points from a chart query (unknown y column falls back)."""
    return sinks.chart_points(lb.chart_films(roles), "title", "not_a_column")


@register("records_json_store_summary", None)
def q_records(roles):
    """Store summary as JSON records with NaN/Inf cleaned."""
    from ..plans import overview as ov
    return sinks.as_json(ov.store_summary(roles).withColumn("ratio", F.col("rentals") / F.col("customers")))


_STORES = f"""
, agg AS (
  SELECT i.store_id, SUM(p.amount) AS rev, COUNT(r.rental_id) AS rentals, COUNT(DISTINCT r.customer_id) AS customers
  FROM rental r JOIN inventory i ON r.inventory_id = i.inventory_id LEFT JOIN payment p ON p.rental_id = r.rental_id
  GROUP BY i.store_id)
SELECT 'Store ' || CAST(store_id AS VARCHAR) AS store, CAST(ROUND(rev, 2) AS DOUBLE) AS revenue, rentals, customers,
       CAST(ROUND(rev / SUM(rev) OVER () * 100, 1) AS DOUBLE) AS revenue_share,
       CAST(ROUND(rev / GREATEST(rentals, 1), 2) AS DOUBLE) AS revenue_per_rental,
       row_number() OVER (ORDER BY rev DESC NULLS FIRST, store_id) = 1 AS leader,
       CAST(ROUND(MAX(rev) OVER () - rev, 2) AS DOUBLE) AS revenue_gap,
       MAX(rentals) OVER () - rentals AS rentals_gap
FROM agg"""


@register("answer_bundle_store_summary", with_roles(_STORES))
def q_bundle(roles):
    """The store table, read back from the answer bundle of the input version."""
    return answers(roles)["store_summary"]


@register("records_json_round_trip", with_roles(_STORES.replace("AS rentals_gap", "AS rentals_gap, "
                                                                "CASE WHEN rentals > 0 THEN CAST(rentals AS DOUBLE) / customers END AS ratio")))
def q_records_round_trip(roles):
    """The store summary as JSON records, read back; a ratio that is not a finite number comes back as null."""
    from ..plans import overview as ov
    rows = ov.store_summary(roles).withColumn("ratio", F.when(F.col("rentals") > 0, F.col("rentals") / F.col("customers")).otherwise(float("nan")))
    return sinks.as_json(rows).select(F.from_json("record", rows.schema).alias("r")).select("r.*")


BATCH = {
    "stores": "SELECT store_id, COUNT(*) AS n FROM inventory GROUP BY store_id",
    "months": "SELECT date_format(rental_date, 'yyyy-MM') AS m, COUNT(*) AS n FROM rental GROUP BY 1",
    "bad": "UPDATE rental SET staff_id = 'x'",
}


@register("adhoc_batch", with_roles("""
SELECT 'bad' AS label, false AS ok, CAST(0 AS BIGINT) AS preview_rows
UNION ALL SELECT 'months', true, CAST(LEAST(COUNT(*), 30) AS BIGINT)
  FROM (SELECT strftime(rental_date, '%Y-%m') AS m FROM rental GROUP BY 1) t
UNION ALL SELECT 'stores', true, CAST(LEAST(COUNT(*), 30) AS BIGINT)
  FROM (SELECT store_id FROM inventory GROUP BY store_id) t"""))
def q_batch(roles):
    """Labelled batch, 30-row previews, a rejected statement reported without
    stopping the others.  One row per label: ok flag and preview size."""
    adhoc.register_views(roles)
    spark = roles.rental.sparkSession
    res = adhoc.run_batch(spark, BATCH, max_rows=30)
    parts = []
    for label, r in res.items():
        if isinstance(r, Exception):
            parts.append(spark.createDataFrame([(label, False, 0)], "label string, ok boolean, preview_rows bigint"))
        else:
            parts.append(r.rows.agg(F.count(F.lit(1)).alias("preview_rows"))
                         .select(F.lit(label).alias("label"), F.lit(True).alias("ok"), "preview_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
