"""Role views over a rental-store schema (rental, payment, inventory, film, ...),
read through any table reader: JDBC (``jdbc.py``) or Parquet files with the
same table names (``parquet_tables``).

The address -> city -> country chain becomes the ``customer_country`` role
(J5); staff and store tables give ``staff`` and ``stores``.  ``activity`` is the
rental fact itself with its timestamp and paid amount.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .roles import Roles

Reader = Callable[[str], DataFrame]

# Table names of the rental-store schema.
TABLES = ["rental", "payment", "inventory", "film", "film_category", "category", "film_actor", "actor",
          "customer", "address", "city", "country", "staff", "store"]


def roles_from_tables(read: Reader, conversations: DataFrame | None = None) -> Roles:
    t = {name: read(name) for name in TABLES}
    rental = t["rental"].select("rental_id", "rental_date", "return_date", "inventory_id", "customer_id",
                                F.col("staff_id").cast("string").alias("staff_id"))
    payment = t["payment"].select("rental_id", F.col("amount").cast("decimal(18,6)").alias("amount"))
    geo = (t["customer"].select("customer_id", "address_id")
           .join(t["address"].select("address_id", "city_id"), "address_id")
           .join(t["city"].select("city_id", "country_id"), "city_id")
           .join(t["country"].select("country_id", "country"), "country_id")
           .select("customer_id", "country"))
    paid = payment.groupBy("rental_id").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("rows"))
    act = ["ts", "customer_id", "amount", "rows"]
    units = t["inventory"].select("inventory_id", "film_id", F.col("store_id").cast("int").alias("store_id"))
    joined = (rental.join(paid, "rental_id", "left")
              .select(F.col("rental_date").alias("ts"), "customer_id", "inventory_id",
                      F.coalesce("amount", F.lit(0)).cast("decimal(12,2)").alias("amount"),
                      F.coalesce("rows", F.lit(1)).cast("bigint").alias("rows")))
    activity = joined.select(*act)
    activity_store = joined.join(units, "inventory_id").select(*act, "store_id")
    if conversations is None:
        conversations = rental.sparkSession.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    return Roles(
        rental=rental, payment=payment,
        inventory=units,
        film=t["film"].select("film_id", "title", "rating", F.col("rental_rate").cast("decimal(12,2)").alias("rental_rate")),
        film_category=t["film_category"].select("film_id", "category_id"),
        category=t["category"].select("category_id", "name"),
        film_actor=t["film_actor"].select("film_id", "actor_id"),
        actor=t["actor"].select("actor_id", "first_name", "last_name"),
        customer=t["customer"].select("customer_id", "first_name", "last_name"),
        customer_country=geo,
        staff=t["staff"].select(F.col("staff_id").cast("string").alias("staff_id"), "first_name", "last_name"),
        stores=t["store"].select(F.col("store_id").cast("int").alias("store_id")),
        activity=activity, activity_store=activity_store, conversations=conversations)


def parquet_tables(spark: SparkSession, base: str) -> Reader:
    return lambda name: spark.read.parquet(os.path.join(base, f"{name}.parquet"))
