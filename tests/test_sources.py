"""Sources and sinks: guard, cleanup, chart points, JDBC options, star reuse."""

import os
import tempfile

import pytest

from shelfline.sources import adhoc, sinks, star
from shelfline.sources.jdbc import JdbcConfig, jdbc_options


@pytest.mark.parametrize("sql", ["delete from rental", "select * from pg_user", "select 1; drop table x", ""])
def test_guard_rejects(sql):
    with pytest.raises(adhoc.RejectedQuery):
        adhoc.check_select(sql)


def test_guard_direct_query_allows_pg_prefix():
    assert adhoc.check_select("select * from pg_tables", block_pg=False)


def test_clean_doubles(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,)], "x double")
    assert [r.x for r in sinks.clean_doubles(df).collect()] == [None, None, 1.5]


def test_chart_points_fallbacks(spark):
    df = spark.createDataFrame([("a", "3"), ("b", "x")], "k string, v string")
    got = [(r.x, r.y) for r in sinks.chart_points(df, "missing", "missing").collect()]
    assert got == [("a", 3.0), ("b", 0.0)]
    with pytest.raises(ValueError):
        sinks.chart_points_checked(df.where("k = 'zzz'"), "k", "v")


def test_jdbc_partitioned_options():
    o = jdbc_options(JdbcConfig(url="jdbc:postgresql://db/x"), "rental")
    assert o["partitionColumn"] == "rental_id" and o["numPartitions"] == "64"
    assert "partitionColumn" not in jdbc_options(JdbcConfig(url="jdbc:postgresql://db/x"), "film")


def test_star_materialised_once(spark):
    d = tempfile.mkdtemp(prefix="star-in-")
    spark.range(10).write.parquet(os.path.join(d, "t.parquet"))
    sig = star.input_signature(spark, [os.path.join(d, "t.parquet")])
    a = star.materialize(spark, "demo", spark.range(5), sig)
    b = star.materialize(spark, "demo", spark.range(7), sig)  # reused, not rewritten
    assert a.count() == 5 and b.count() == 5


def test_batch_keeps_going(spark):
    res = adhoc.run_batch(spark, {"ok": "select 1 as a", "bad": "update x set a = 1"})
    assert isinstance(res["bad"], Exception) and res["ok"].rows.collect()[0].a == 1


def test_large_supplier_keys_do_not_collide(spark, tmp_path):
    """Part 1 / supplier 100005 and part 2 / supplier 5 are two units."""
    from pyspark.sql import functions as F

    from shelfline.plans import overview as ov
    from shelfline.sources.testdata import TABLES, load_roles
    sf = "/root/testdata/sf0.001"
    for name in TABLES:
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "lineitem":
            one = df.limit(1).cache()
            df = (one.withColumn("l_partkey", F.lit(1).cast("long")).withColumn("l_suppkey", F.lit(100005).cast("long"))
                  .unionByName(one.withColumn("l_partkey", F.lit(2).cast("long")).withColumn("l_suppkey", F.lit(5).cast("long"))))
        if name == "supplier":
            one = df.limit(1)
            df = one.withColumn("s_suppkey", F.lit(100005).cast("long")).unionByName(one.withColumn("s_suppkey", F.lit(5).cast("long")))
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    k = ov.kpi(load_roles(spark, str(tmp_path))).first()
    assert (k.inventory, k.rentals, k.films) == (2, 2, 2)


@pytest.mark.parametrize("sql", [
    "SELECT 1 AS a", "/* note */ SELECT store_id FROM inventory -- drop it", "WITH s AS (SELECT store_id FROM stores) SELECT * FROM s JOIN inventory USING (store_id)",
    "SELECT 'please update' AS x, `delete` FROM (SELECT title AS `delete` FROM film) t", "SELECT * FROM film WHERE film_id IN (SELECT film_id FROM inventory)",
    "WITH a AS (SELECT 1 AS x), b AS (SELECT x FROM a) SELECT (SELECT max(x) FROM b) AS m FROM RENTAL UNION ALL SELECT 2 ORDER BY 1 LIMIT 3",
    "SELECT store_id, count(*) OVER (PARTITION BY store_id) FROM inventory WHERE EXISTS (SELECT 1 FROM stores)", "SELECT * FROM VALUES (1), (2) AS t(a)",
    "SELECT store_id, count(*) FROM inventory GROUP BY store_id HAVING count(*) > 1", "SELECT explode(array(1, 2)) AS x", "WITH film AS (SELECT 1 AS a) SELECT a FROM film"])
def test_plan_guard_admits_queries(spark, sql):
    adhoc.check_plan(spark, sql)


@pytest.mark.parametrize("sql", [
    "", "SELEC 1", "DROP TABLE film", "INSERT INTO film SELECT 1", "CREATE VIEW v AS SELECT 1", "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`",
    "SELECT * FROM film JOIN json.`/etc/passwd`", "SELECT * FROM secrets", "SELECT * FROM default.film", "SELECT (SELECT max(a) FROM csv.`/etc/passwd`) AS x FROM film",
    "SELECT * FROM film WHERE film_id IN (SELECT id FROM other)", "WITH s AS (SELECT * FROM text.`/etc/passwd`) SELECT * FROM s", "WITH a AS (SELECT * FROM b), b AS (SELECT 1) SELECT * FROM a",
    "SELECT * FROM range(10)", "SELECT reflect('java.lang.System', 'getenv')", "SELECT title FROM film ORDER BY java_method('java.lang.System', 'exit', 1)",
    "SELECT /* x */ 1; DROP TABLE film", "SET spark.sql.ansi.enabled=false", "EXPLAIN SELECT 1", "SHOW TABLES", "SELECT * FROM film WHERE EXISTS (SELECT 1 FROM orc.`/x`)",
    "FROM film INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT title", "CACHE TABLE x AS SELECT 1", "SELECT * FROM IDENTIFIER('film')"])
def test_plan_guard_rejects(spark, sql):
    with pytest.raises(adhoc.RejectedQuery):
        adhoc.check_plan(spark, sql)


def test_both_guards_apply(spark):
    spark.range(3).withColumnRenamed("id", "film_id").createOrReplaceTempView("film")
    with pytest.raises(adhoc.RejectedQuery):
        adhoc.run_select(spark, "WITH f AS (SELECT * FROM film) SELECT * FROM f")  # the word test wants SELECT first
    got = adhoc.run_select(spark, "WITH f AS (SELECT * FROM film) SELECT * FROM f", max_rows=2, words=False)
    assert (got.total_rows, got.rows.count()) == (3, 2)
    with pytest.raises(adhoc.RejectedQuery):
        adhoc.run_select(spark, "SELECT * FROM parquet.`/root/testdata/sf0.001/orders.parquet`")
