"""Tiny hand-written rental-store tables (FIXTURES.md section 3) as role bundles."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from shelfline.sources.schema import roles_from_tables

SCHEMAS = {
    "rental": "rental_id bigint, rental_date timestamp, return_date timestamp, inventory_id bigint, customer_id bigint, staff_id string",
    "payment": "rental_id bigint, amount decimal(10,2)",
    "inventory": "inventory_id bigint, film_id bigint, store_id int",
    "film": "film_id bigint, title string, rating string, rental_rate decimal(5,2)",
    "film_category": "film_id bigint, category_id bigint",
    "category": "category_id bigint, name string",
    "film_actor": "film_id bigint, actor_id bigint",
    "actor": "actor_id bigint, first_name string, last_name string",
    "customer": "customer_id bigint, first_name string, last_name string, address_id bigint",
    "address": "address_id bigint, city_id bigint",
    "city": "city_id bigint, country_id bigint",
    "country": "country_id bigint, country string",
    "staff": "staff_id string, first_name string, last_name string",
    "store": "store_id int",
}


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def D(x) -> Decimal:
    return Decimal(str(x))


def base_tables() -> dict:
    return {
        "film": [(1, "Alpha", "PG", D("2.99")), (2, "Beta", "G", D("0.99"))],
        "film_category": [(1, 10), (2, 10)],
        "category": [(10, "Drama")],
        "film_actor": [(1, 100), (1, 101)],
        "actor": [(100, "Ann", "A"), (101, "Bob", "B")],
        "customer": [(1, "Cat", "C", 1), (2, "Dan", "D", 1), (3, "Eve", "E", 1)],
        "address": [(1, 1)], "city": [(1, 1)], "country": [(1, "Testland")],
        "staff": [("s1", "Sam", "S")], "store": [(1,), (2,)],
        "inventory": [(1, 1, 1), (2, 1, 1), (3, 2, 1)],
        "rental": [], "payment": [],
    }


def roles_of(spark, **tables):
    data = base_tables()
    data.update(tables)
    frames = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in data.items()}
    return roles_from_tables(lambda name: frames[name])
