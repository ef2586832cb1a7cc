"""Role views over the TPC-H-ish parquet tables in ``/root/testdata/sf*``.

Mapping (one rental per lineitem row):

* rental    = lineitem ⋈ orders; rental_date = o_orderdate, return_date = l_shipdate,
              customer_id = o_custkey, inventory_id = struct(l_partkey, l_suppkey),
              staff_id = o_orderpriority
* payment   = price payment (l_returnflag <> 'R') UNION ALL tax payment
              (l_tax > 0 AND l_linestatus = 'F'), exact decimals
* inventory = distinct (l_partkey, l_suppkey); film_id = l_partkey,
              store_id = supplier's region
* film      = part (title p_name, rating p_brand, rate p_retailprice);
              category = p_type; film_actor = distinct (l_partkey, l_suppkey),
              actor = supplier
* customer  = customer; country = nation name
* activity  = events (ts, user_id, value)

``rental_id`` and ``inventory_id`` are structs of the keys they are made of: a
number made of several keys would overflow or collide at some scale factor.
"""

from __future__ import annotations

import hashlib
import math
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cells
from ..session import ensure_checkpoint_dir
from . import star
from .monthly import MONTH, MonthStore, Snapshot, month_number
from .roles import Deferred, Roles

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "conversations")

MONEY = "DECIMAL(12,2)"
RATE = "DECIMAL(4,2)"
AMOUNT = "DECIMAL(18,6)"  # long-backed (compact) decimal: same values as (20,6), no BigDecimal per row
#: file bytes of lines that one task sorts by order: some half a million rows, so that a task's memory follows this and not the input
LINE_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _inventory_id(l: DataFrame):
    # a struct: any product of the two keys overflows or collides at some scale factor
    return F.struct(l["l_partkey"].alias("part"), l["l_suppkey"].alias("supplier"))


def _rental_id(l: DataFrame):
    return F.struct(l["l_orderkey"].alias("order"), l["l_linenumber"].alias("line"),
                    l["l_partkey"].alias("part"), l["l_suppkey"].alias("supplier"))


_CACHE: dict = {}


def load_roles(spark: SparkSession, sf_dir: str, materialized: bool = True, refresh: bool = False) -> Roles:
    """Role views over ``sf_dir``, planned once per session.

    The input files are listed once, with the first call of a session; ``refresh`` lists them again, writes the
    months that new files touch and returns views of the new version.  The bundle is a set of lazy
    DataFrames; reusing it across marts only saves planning it again."""
    key = (id(spark), spark.sparkContext.applicationId, os.path.abspath(sf_dir), materialized)
    if refresh or key not in _CACHE:
        _CACHE[key] = _load_roles(spark, sf_dir, materialized)
    return _CACHE[key]


def _supplier_store(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    # supplier -> store (region).  nation is a fixed 25-row TPC table: broadcast is bounded.
    return supplier.join(F.broadcast(nation), supplier["s_nationkey"] == nation["n_nationkey"]) \
        .select(supplier["s_suppkey"], nation["n_regionkey"].alias("store_id"))


def _with_ids(fact: DataFrame) -> DataFrame:
    """The stored columns of the fact with the ids that are made of them."""
    unit = F.struct(F.col("film_id").alias("part"), F.col("_supplier").alias("supplier"))
    rental = F.struct(F.col("_order").alias("order"), F.col("_line").alias("line"), F.col("film_id").alias("part"), F.col("_supplier").alias("supplier"))
    return fact.select(rental.alias("rental_id"), "rental_date", "return_date", unit.alias("inventory_id"), "customer_id", "staff_id",
                       "film_id", "store_id", "paid", "rows", "rental_first", MONTH)


def enriched_fact(li: DataFrame, orders: DataFrame, supplier_store: DataFrame) -> DataFrame:
    return _with_ids(stored_fact(li, orders, supplier_store))


def line_partitions(spark: SparkSession, li: DataFrame) -> int | None:
    """Partitions for the shuffle of the lines by order, where their files ask for more than the session's number."""
    wanted = math.ceil(int(str(li._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / LINE_BYTES)
    return wanted if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def stored_fact(li: DataFrame, orders: DataFrame, supplier_store: DataFrame, partitions: int | None = None) -> DataFrame:
    """rental_paid, each key once (ids are made of them when it is read): payments and the inventory unit of a rental come from its own
    lineitem row, so the fact is enriched without a payment union/aggregate/join
    and without the distinct-units join.  A window over rental_id keeps the
    join semantics exact even when two lineitem rows share a rental_id."""
    price_amt = F.when(li["l_returnflag"] != "R",
                       (li["l_extendedprice"].cast(MONEY) * (F.lit(1) - li["l_discount"].cast(RATE))).cast(AMOUNT))
    tax_amt = F.when((li["l_tax"] > 0) & (li["l_linestatus"] == "F"),
                     (li["l_extendedprice"].cast(MONEY) * li["l_tax"].cast(RATE)).cast(AMOUNT))
    row_paid = F.coalesce(price_amt, F.lit(0)) + F.coalesce(tax_amt, F.lit(0))
    row_npay = price_amt.isNotNull().cast("int") + tax_amt.isNotNull().cast("int")
    # One shuffle of the fact, by order: it serves the window over equal rental keys and the join with the orders.
    lines = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", li["l_shipdate"].alias("return_date"),
                      row_paid.alias("_paid"), row_npay.alias("_npay")).repartition(*([partitions] if partitions else []), "l_orderkey")
    # one ordering for all three, so one sort serves them
    same = Window.partitionBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").orderBy("return_date")
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n_pay = F.sum("_npay").over(whole)
    keyed = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "return_date",
                         F.when(n_pay > 0, F.sum("_paid").over(whole)).alias("paid"),
                         F.greatest(n_pay, F.lit(1)).cast("bigint").alias("rows"),
                         (F.row_number().over(same) == 1).alias("rental_first"))
    return (keyed.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(supplier_store, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("l_orderkey").alias("_order"), F.col("l_linenumber").alias("_line"), F.col("l_suppkey").alias("_supplier"),
                    F.col("o_orderdate").alias("rental_date"), "return_date",
                    F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("staff_id"),
                    F.col("l_partkey").alias("film_id"), F.col("store_id").cast("int").alias("store_id"),
                    F.col("paid").cast(AMOUNT).alias("paid"), "rows", "rental_first",
                    month_number("o_orderdate").alias(MONTH)))


def _touched_months(spark: SparkSession, files: DataFrame, old: DataFrame, orders: DataFrame) -> list[int] | None:
    """Months of the orders that new files hold or add lines to; None when an old file is gone or changed."""
    if old.join(files, files.columns, "left_anti").limit(1).count():
        return None
    # names of the files added since: as many as a refresh brings
    new = [r["path"] for r in files.join(old, files.columns, "left_anti").select("path").collect()]
    keys = []
    for table, column in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        paths = [p for p in new if f"/{table}.parquet" in p]
        if paths:
            keys.append(spark.read.parquet(*paths).select(F.col(column).alias("o_orderkey")))
    if not keys:
        return []
    keys = reduce(DataFrame.unionByName, keys).distinct()
    months = orders.join(keys, "o_orderkey", "left_semi").select(month_number("o_orderdate").alias("m")).distinct()
    return [r["m"] for r in months.collect()]  # one row per calendar month


def monthly_fact(spark: SparkSession, sf_dir: str, li: DataFrame, orders: DataFrame, supplier_store: DataFrame,
                 signatures: dict[str, str], files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The enriched fact, its cells and its sketches, by month; only months that new input files touch are written."""
    partitions = line_partitions(spark, li)
    plan = stored_fact(li, orders, supplier_store, partitions)
    schemas = {"fact": plan.schema, "cells": cells.rental_cells(_with_ids(plan)).schema, "sketches": cells.rental_sketches(_with_ids(plan)).schema}
    # other suppliers or nations put other stores into every month: another family of tables, as for other columns
    marks = [os.path.abspath(sf_dir), signatures["supplier"], signatures["nation"], *(schemas[t].simpleString() for t in schemas)]
    family = hashlib.sha256(":".join(marks).encode()).hexdigest()[:16]
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shelfline-star/fact-{family}"
    store = MonthStore(spark, root)
    signature = f"{signatures['lineitem']}-{signatures['orders']}"
    snapshot = store.published(signature)
    if snapshot is None:
        base = store.newest()
        months = _touched_months(spark, files, spark.read.parquet(base.files), orders) if base else None
        if months is None:
            base, part = Snapshot(), plan
        else:
            some = month_number("o_orderdate").isin(months)
            kept = orders.where(some)
            part = stored_fact(li.join(kept.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi"), kept, supplier_store, partitions)
        snapshot = Snapshot({t: {m: v for m, v in base.months.get(t, {}).items() if m not in (months or [])} for t in schemas},
                            f"{root}/files-{uuid.uuid4().hex}")
        files.write.parquet(snapshot.files)
        written = store.write("fact", part)
        snapshot.months["fact"] |= written
        # the aggregates of these months come from the rows just written
        rows = _with_ids(store.read("fact", written, schemas["fact"]))
        for table, build in (("cells", cells.rental_cells), ("sketches", cells.rental_sketches)):
            snapshot.months[table] |= store.write(table, build(rows))
        snapshot = store.publish(signature, snapshot)
    fact, *stored = (store.read(t, snapshot.months[t], schemas[t]) for t in ("fact", "cells", "sketches"))
    return _with_ids(fact), *stored


def _load_roles(spark: SparkSession, sf_dir: str, materialized: bool = True) -> Roles:
    """Role views over the parquet tables in ``sf_dir``.

    With ``materialized`` the enriched rental fact and the inventory dimension
    are written to the shared checkpoint folder (see :mod:`.star` and :mod:`.monthly`), each when a mart first needs it, and every mart scans them;
    otherwise they are planned from the raw tables on every use."""
    t = {name: read_table(spark, sf_dir, name) for name in TABLES}
    li, orders, supplier, nation = t["lineitem"], t["orders"], t["supplier"], t["nation"]

    rental = (li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
              .select(_rental_id(li).alias("rental_id"),
                      orders["o_orderdate"].alias("rental_date"),
                      li["l_shipdate"].alias("return_date"),
                      _inventory_id(li).alias("inventory_id"),
                      orders["o_custkey"].alias("customer_id"),
                      orders["o_orderpriority"].alias("staff_id")))

    price = li.where(F.col("l_returnflag") != "R").select(
        _rental_id(li).alias("rental_id"),
        (F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast(RATE)))
        .cast(AMOUNT).alias("amount"))
    tax = li.where((F.col("l_tax") > 0) & (F.col("l_linestatus") == "F")).select(
        _rental_id(li).alias("rental_id"),
        (F.col("l_extendedprice").cast(MONEY) * F.col("l_tax").cast(RATE))
        .cast(AMOUNT).alias("amount"))
    payment = price.unionByName(tax)

    supplier_store = _supplier_store(supplier, nation)
    units = li.select("l_partkey", "l_suppkey").distinct()
    inventory = units.join(supplier_store, units["l_suppkey"] == supplier_store["s_suppkey"]) \
        .select(F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).alias("inventory_id"),
                F.col("l_partkey").alias("film_id"), F.col("store_id").cast("int").alias("store_id"))

    part = t["part"]
    film = part.select(F.col("p_partkey").alias("film_id"), F.col("p_name").alias("title"),
                       F.col("p_brand").alias("rating"),
                       F.col("p_retailprice").cast(MONEY).alias("rental_rate"))
    film_category = part.select(F.col("p_partkey").alias("film_id"), F.col("p_type").alias("category_id"))
    category = part.select(F.col("p_type").alias("category_id"), F.col("p_type").alias("name")).distinct()

    film_actor = units.select(F.col("l_partkey").alias("film_id"), F.col("l_suppkey").alias("actor_id"))
    actor = supplier.select(F.col("s_suppkey").alias("actor_id"),
                            F.split(F.col("s_name"), "#").getItem(0).alias("first_name"),
                            F.split(F.col("s_name"), "#").getItem(1).alias("last_name"))

    cust = t["customer"]
    customer = cust.select(F.col("c_custkey").alias("customer_id"),
                           F.split(F.col("c_name"), "#").getItem(0).alias("first_name"),
                           F.split(F.col("c_name"), "#").getItem(1).alias("last_name"))
    customer_country = cust.join(F.broadcast(nation), cust["c_nationkey"] == nation["n_nationkey"]) \
        .select(cust["c_custkey"].alias("customer_id"), nation["n_name"].alias("country"))

    staff = orders.select(F.col("o_orderpriority").alias("staff_id")).distinct() \
        .select("staff_id",
                F.split("staff_id", "-").getItem(1).alias("first_name"),
                F.split("staff_id", "-").getItem(0).alias("last_name"))

    # Every store exists as a region: a fixed 5-row table.
    stores = t["region"].select(F.col("r_regionkey").cast("int").alias("store_id"))

    activity = t["events"].select(F.col("ts"), F.col("user_id").alias("customer_id"),
                                  F.col("value").cast(MONEY).alias("amount"), F.lit(1).cast("bigint").alias("rows"))
    # an event belongs to the store (region) of its customer's nation
    store_of = cust.join(F.broadcast(nation), cust["c_nationkey"] == nation["n_nationkey"]) \
        .select(cust["c_custkey"].alias("customer_id"), nation["n_regionkey"].cast("int").alias("store_id"))
    activity_store = activity.join(store_of, "customer_id")

    rental_paid, rental_cells, rental_sketches, activity_cells = enriched_fact(li, orders, supplier_store), None, None, None
    signature, units_keyed = None, False
    film_category_named = film_category.join(category, "category_id").select("film_id", "name")
    if materialized:
        # the fact and the conformed dimensions (plain scans with true sizes afterwards,
        # so the planner broadcasts the small side, never the fact)
        found = star.input_signatures(spark, [os.path.join(sf_dir, f"{n}.parquet") for n in TABLES])
        signatures = {n: found[os.path.join(sf_dir, f"{n}.parquet")] for n in TABLES}

        def version(*names: str) -> str:
            return hashlib.sha256(":".join([os.path.abspath(sf_dir), *(signatures[n] for n in names)]).encode()).hexdigest()[:16]

        def dimension(name: str, df: DataFrame, *names: str) -> Deferred:
            return Deferred(lambda: star.materialize(spark, name, df, version(*names)))

        # the files are listed now: what is built later is still of this version
        files = star.listing(spark, [os.path.join(sf_dir, f"{n}.parquet") for n in ("lineitem", "orders")])
        fact = Deferred(lambda: monthly_fact(spark, sf_dir, li, orders, supplier_store, signatures, files))
        rental_paid, rental_cells, rental_sketches = (Deferred(lambda k=k: fact.value[k]) for k in range(3))
        activity_cells = dimension("activity_cells", cells.activity_cells(activity, activity_store), "events", "customer", "nation")
        # one distinct pass over lineitem serves both unit dimensions: inventory is
        # the units that have a store (inner-join semantics), film_actor every pair
        units_ext = (units.join(supplier_store, units["l_suppkey"] == supplier_store["s_suppkey"], "left")
                     .select("l_partkey", "l_suppkey", F.col("store_id").cast("int").alias("store_id")))
        units_m = dimension("units", units_ext, "lineitem", "supplier", "nation")
        inventory = Deferred(lambda: units_m.value.where(F.col("store_id").isNotNull()).select(
            F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier")).alias("inventory_id"),
            F.col("l_partkey").alias("film_id"), "store_id"))
        film_actor = Deferred(lambda: units_m.value.select(F.col("l_partkey").alias("film_id"), F.col("l_suppkey").alias("actor_id")))
        # a unit repeats only where its supplier does
        units_keyed = Deferred(lambda: not supplier_store.groupBy("s_suppkey").count().where("count > 1").limit(1).count())
        film_category_named = dimension("film_category_named", film_category_named, "part")
        customer_country = dimension("customer_country", customer_country, "customer", "nation")
        signature = version(*TABLES)

    return Roles(rental=rental, payment=payment, inventory=inventory, film=film,
                 film_category=film_category, category=category, film_actor=film_actor,
                 actor=actor, customer=customer, customer_country=customer_country,
                 staff=staff, stores=stores, activity=activity,
                 activity_store=activity_store, conversations=t["conversations"], rental_paid=rental_paid, rental_paid_complete=True,
                 film_category_named=film_category_named, rental_cells=rental_cells, rental_sketches=rental_sketches,
                 activity_cells=activity_cells, signature=signature, units_keyed=units_keyed)
