"""Month-wise refresh of the star, stored cells and sketches, the answer bundle."""

import dataclasses
import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from shelfline.operators import cells
from shelfline.operators.fact import paid_rentals
from shelfline.operators.filters import Filters
from shelfline.plans import inventory as inv
from shelfline.plans import overview as ov
from shelfline.plans import patterns as pa
from shelfline.reports import bundle
from shelfline.sources import star, testdata
from shelfline.sources.testdata import TABLES, load_roles
from shelfline.text import tagging as tg

SF = "/root/testdata/sf0.001"
FULL = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def written(spark, roles):
    """month -> folder its rows are read from"""
    rows = roles.rental_paid.select("rental_month", F.regexp_extract(F.input_file_name(), r"(version=[^/]+)", 1).alias("v")).distinct().collect()
    return {r.rental_month: r.v for r in rows}


@pytest.fixture
def copy(spark, tmp_path):
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows_of(df, month=None):
    return sorted(map(str, (df if month is None else df.where(F.col("rental_month") == month)).select(*sorted(df.columns)).collect()))


def test_a_new_month_rewrites_one_partition(spark, copy):
    first = load_roles(spark, copy)
    before, all_before = written(spark, first), rows_of(first.rental_paid)
    # an order in a new month with two lines, one more line for an old order
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    new_order = orders.limit(1).withColumn("o_orderkey", F.lit(10**9).cast(orders.schema["o_orderkey"].dataType)).withColumn(
        "o_orderdate", F.lit(dt.datetime(2031, 5, 6)).cast(orders.schema["o_orderdate"].dataType))
    old = orders.join(lines, orders.o_orderkey == lines.l_orderkey).orderBy("o_orderkey").first()
    new_lines = (lines.limit(2).withColumn("l_orderkey", F.lit(10**9).cast(lines.schema["l_orderkey"].dataType))
                 .unionByName(lines.where(F.col("l_orderkey") == old.o_orderkey).limit(1).withColumn("l_linenumber", F.lit(99).cast(lines.schema["l_linenumber"].dataType))))
    new_order.write.mode("append").parquet(f"{copy}/orders.parquet")
    new_lines.write.mode("append").parquet(f"{copy}/lineitem.parquet")
    assert load_roles(spark, copy) is first  # listed once a session
    second = load_roles(spark, copy, refresh=True)
    after = written(spark, second)
    touched = {203105, old.o_orderdate.year * 100 + old.o_orderdate.month}
    assert {m for m in after if after[m] != before.get(m)} == touched
    assert rows_of(first.rental_paid) == all_before  # views made before keep their version
    whole = load_roles(spark, copy, materialized=False)
    assert rows_of(second.rental_paid) == rows_of(whole.rental_paid)
    assert rows_of(second.rental_cells) == rows_of(cells.rental_cells(whole.rental_paid))
    # nothing new: nothing written
    assert written(spark, load_roles(spark, copy, refresh=True)) == after
    # a changed old file: every month is written anew
    spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey % 2 = 0").write.mode("overwrite").parquet(f"{copy}/orders.parquet")
    third = load_roles(spark, copy, refresh=True)
    assert not set(written(spark, third).values()) & set(after.values())
    assert rows_of(third.rental_paid) == rows_of(load_roles(spark, copy, materialized=False, refresh=True).rental_paid)


def test_a_month_query_lists_one_partition(spark):
    df = paid_rentals(load_roles(spark, FULL), Filters.of(None, "1995-03"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*rental_month#\d+ = 199503", plan) and "PushedFilters: [" in plan
    assert {f.split("rental_month=")[1][:6] for (f,) in df.select(F.input_file_name()).distinct().collect()} == {"199503"}


@pytest.mark.parametrize("mart", [pa.pattern_cube, pa.hourly_activity, pa.dow_revenue, pa.peaks, pa.avg_duration_by_dow, pa.days, pa.chart_hour, pa.chart_day,
                                  pa.peak_hours, ov.trend, ov.months])
def test_marts_read_cells_and_no_fact(spark, mart):
    df = mart(load_roles(spark, FULL))
    scans = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation" in x]
    files = {re.sub(r".*/(shelfline-star/[^/]+/[a-z_]+).*", r"\1", f) for f in df.inputFiles()}
    assert scans and all(f.endswith("/cells") or "activity_cells" in f for f in files), files


def test_cells_equal_the_fact(spark):
    stored, plain = load_roles(spark, SF), load_roles(spark, SF, materialized=False)
    for f in (Filters(), Filters.of(1, None), Filters.of(None, "1995-03"), Filters.of(2, "1996-07")):
        for mart in (pa.pattern_cube, pa.days, pa.avg_duration_by_dow, ov.trend):
            assert sorted(mart(stored, f).collect(), key=str) == sorted(mart(plain, f).collect(), key=str)


def test_sketches_answer_any_filter(spark):
    roles = load_roles(spark, FULL)
    for f in (Filters(), Filters.of(1, None), Filters.of(None, "1995-03"), Filters.of(2, "1996-07")):
        exact = paid_rentals(roles, f).groupBy("store_id").agg(F.countDistinct("customer_id").alias("c"), F.countDistinct("rental_id").alias("r"))
        exact = {r.store_id: (r.c, r.r) for r in exact.collect()}
        got = {r.store_id: (r.customers, r.rentals) for r in cells.estimate(roles.rental_sketches, f, by=("store_id",)).collect()}
        assert set(got) == set(exact)
        for s, (c, r) in exact.items():
            assert abs(got[s][0] - c) <= cells.DISTINCT_ERROR * c + 1 and abs(got[s][1] - r) <= cells.DISTINCT_ERROR * r + 1


def test_bundle_follows_every_table(spark, copy):
    first = load_roles(spark, copy)
    hours = bundle.answers(first)["peak_hours"].collect()
    assert bundle.published_bundle(first) == bundle.published_bundle(load_roles(spark, copy))
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.limit(1).crossJoin(spark.range(5000)).drop("id").write.mode("append").parquet(f"{copy}/events.parquet")
    second = load_roles(spark, copy, refresh=True)
    assert bundle.published_bundle(second) != bundle.published_bundle(first)
    assert bundle.answers(second)["peak_hours"].collect() != hours
    assert {n: set(d.columns) for n, d in bundle.answers(second).items()} == {n: set(b(second).columns) for n, b in bundle.MARTS.items()}


def test_signatures_follow_files(spark, tmp_path):
    a, b = f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet"
    spark.range(10).write.parquet(a)
    spark.range(10).write.parquet(b)
    one = star.input_signatures(spark, [a, b])
    assert one == star.input_signatures(spark, [b, a]) and one[a] != one[b]
    spark.range(5).write.mode("append").parquet(a)
    two = star.input_signatures(spark, [a, b])
    assert two[a] != one[a] and two[b] == one[b]


def test_a_mart_builds_what_it_reads(spark, copy, monkeypatch):
    built = []
    fact, materialize = testdata.monthly_fact, star.materialize
    monkeypatch.setattr(testdata, "monthly_fact", lambda *a: built.append("fact") or fact(*a))
    monkeypatch.setattr(star, "materialize", lambda s, name, *a: built.append(name) or materialize(s, name, *a))
    roles = load_roles(spark, copy)
    tg.commands(roles.conversations).collect()
    assert built == []
    pa.hour_dow_cube(roles, Filters.of(1, None)).collect()
    assert built == ["activity_cells"]
    ov.trend(roles).collect()
    pa.days(roles).collect()
    assert built == ["activity_cells", "fact"]
    inv.film_utilization(roles).collect()
    assert sorted(built) == ["activity_cells", "fact", "film_category_named", "units"]


def test_lines_are_sorted_in_parts_that_follow_their_bytes(spark, copy, monkeypatch):
    monkeypatch.setattr(testdata, "LINE_BYTES", 10_000)
    lines = spark.read.parquet(f"{copy}/lineitem.parquet")
    parts = testdata.line_partitions(spark, lines)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    roles = load_roles(spark, copy)
    assert rows_of(roles.rental_paid) == rows_of(load_roles(spark, copy, materialized=False).rental_paid)
    monkeypatch.setattr(testdata, "LINE_BYTES", 1 << 40)
    assert testdata.line_partitions(spark, lines) is None


def test_film_utilization_by_film(spark, copy):
    # some films twice, one of them under another title, one without a category
    part = spark.read.parquet(f"{SF}/part.parquet")
    more = part.where("p_partkey % 3 = 0").withColumn("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit("Other")).otherwise(F.col("p_name")))
    more.unionByName(more.limit(1).withColumn("p_type", F.lit(None).cast("string"))).write.mode("append").parquet(f"{copy}/part.parquet")
    roles = load_roles(spark, copy)
    assert roles.units_keyed
    by_unit = dataclasses.replace(roles, units_keyed=False)
    for f in (Filters(), Filters.of(1, None), Filters.of(None, "1995-03"), Filters.of(2, "1996-07")):
        df = inv.film_utilization(roles, f, k=10_000)
        assert rows_of(df) == rows_of(inv.film_utilization(by_unit, f, k=10_000)) and df.count() > 100
        assert "inventory_id" not in df._jdf.queryExecution().optimizedPlan().toString()
    # a supplier that is there twice has two rows a unit
    spark.read.parquet(f"{SF}/supplier.parquet").limit(1).write.mode("append").parquet(f"{copy}/supplier.parquet")
    assert not load_roles(spark, copy, refresh=True).units_keyed
