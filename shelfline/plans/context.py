"""Q41: the facts behind the recommendations text, as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import money_out
from ..sources.roles import Roles
from ..operators.ranking import top_k
from .inventory import film_activity
from .overview import store_summary
from .trend import ranked_categories


def sales_context(roles: Roles, slow_below: int = 5, marts: dict[str, DataFrame] | None = None) -> DataFrame:
    """total revenue, leading store, first three slow titles, top and bottom of the
    top-5 categories.  Each input is already a bounded mart (stores, 5 categories,
    5 titles), combined one row each; ``marts`` may hold stored ones by name."""
    marts = marts or {"store_summary": store_summary(roles), "ranked_categories": ranked_categories(roles, 5)}
    stores = marts["store_summary"].agg(
        F.sum("revenue").alias("_total"),
        F.min(F.struct(F.when(F.col("revenue").isNull(), 0).otherwise(1).alias("nn"),
                       (-F.col("revenue")).alias("neg"), F.col("store").alias("store"))).alias("_lead"))
    slow = (roles.film.select("film_id", "title").join(film_activity(roles), "film_id")
            .where(F.col("film_rentals") < slow_below))
    first3 = top_k(slow, [F.col("film_rentals"), F.col("film_id")], 3)
    slow3 = first3.agg(F.sort_array(F.collect_list(F.struct("film_rentals", "film_id", "title"))).alias("_s"))
    cats = marts["ranked_categories"].agg(F.max_by("category", "rank").alias("low_category"),
                                           F.min_by("category", "rank").alias("top_category"),
                                           F.count(F.lit(1)).alias("_n"))
    # the slow titles and the category pair are one-row scalar subqueries
    row = (stores.withColumn("_sl", slow3.select("_s").scalar())
           .withColumn("_c", cats.select(F.struct("top_category", "low_category", "_n")).scalar())
           .select("*", F.col("_sl").alias("_s"), F.col("_c.top_category").alias("top_category"),
                   F.col("_c.low_category").alias("low_category"), F.col("_c._n").alias("_n")))
    titles = F.transform(F.slice(F.col("_s"), 1, 3), lambda x: x.getField("title"))
    return row.select(
        money_out("_total").alias("total_revenue"),
        F.col("_lead.store").alias("leading_store"),
        F.when(F.size(titles) > 0, F.array_join(titles, ", ")).otherwise(F.lit("several titles")).alias("slow_titles"),
        F.coalesce(F.col("top_category"), F.lit("n/a")).alias("top_category"),
        F.when(F.col("_n") > 1, F.col("low_category")).otherwise(F.lit("n/a")).alias("low_category"))
