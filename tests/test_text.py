"""Conversation rules on hand-written prompts."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfline.operators.ranking import positions
from shelfline.text import entities as en
from shelfline.text import tagging as tg


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col(F.col("text")).alias("v")).collect()[0].v


@pytest.mark.parametrize("text,expected", [
    ("show revenue", True), ("Revenue?", False), ("hello there", False), ("FORECAST please", True),
])
def test_on_topic(spark, text, expected):
    assert one(spark, text, tg.on_topic) is expected


@pytest.mark.parametrize("text,expected", [
    ("Please EDIT the chart", True), ("éedit something", False), ("editing", False), ("hide it", True),
])
def test_edit_intent(spark, text, expected):
    assert one(spark, text, tg.edit_intent) is expected


@pytest.mark.parametrize("text,route", [
    ("revert that", "revert"),
    ("What is the total revenue?", "instant"),
    ("create a bar chart of top 10 films", "chart"),
    ("show customers in india with spent more than $100k", "direct_query"),
    ("hello there", "off_topic"),
    ("tell me about staff", "agent"),
    ("what is mae", "agent"),  # its rule has no cached answer
    ("explain rmse and compare month", "instant"),  # the next rule is tried
])
def test_routes(spark, text, route):
    assert one(spark, text, tg.route) == route


@pytest.mark.parametrize("text,amount", [
    ("customers spent more than 100k", 100000.0), ("customers spent more than 2m", 2000000.0),
    ("customers spent more than 1,500", 1500.0), ("customers spent more than 3ribu", 3000.0),
])
def test_amounts(spark, text, amount):
    pat = r"(?:more|greater|over|above|lebih)\s+than\s*\$?([\d,]+(?:\.\d+)?)\s*(k|m|juta|ribu)?"
    assert one(spark, text, lambda c: tg.amount(c, pat)) == amount


def test_parameters(spark):
    conv = spark.createDataFrame([(1, 0, "user", "show customers in india with spent more than $100k"),
                                  (1, 1, "user", "list actors with more than 30 films"),
                                  (1, 2, "user", "show pg-13 drama films rented more than 20 times")],
                                 "conv_id bigint, turn bigint, role string, text string")
    rows = {r.turn: r for r in tg.parameters(conv).collect()}
    assert (rows[0].branch, rows[0].min_amount, rows[0].country) == ("customer", 100000.0, "india")
    assert (rows[1].branch, rows[1].min_films) == ("actor", 30.0)
    assert (rows[2].branch, rows[2].rating, rows[2].category, rows[2].min_rentals) == ("film", "PG-13", "drama", 20.0)


def test_topics_default(spark):
    assert one(spark, "zzz", tg.topic_tags) == ["🔍 Analysis"]
    assert one(spark, "revenue by store", tg.topic_tags) == ["📊 Revenue", "🏪 Stores"]


def test_history_windows(spark):
    rows = [(1, i, "user" if i % 2 == 0 else ("system" if i == 3 else "assistant"), f"t{i}") for i in range(16)]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    h = {r.turn: r for r in tg.history(conv).collect()}
    assert h[14].chat_turns == ",".join(str(i) for i in range(2, 14))
    assert h[4].agent_turns == "0,1,2"  # turns 0..3, the system turn dropped after taking 4


def test_truncate(spark):
    assert one(spark, "abcdef", lambda c: tg.truncate(c, 3)) == "abc\n...[truncated 6 chars]"
    assert one(spark, "abc", lambda c: tg.truncate(c, 3)) == "abc"


def test_history_buckets_equal_one_window(spark):
    """Gaps, repeated and missing turn numbers, no conversation id, one conversation with most turns; buckets of 13 rows up."""
    import random

    rng = random.Random(4)
    rows = [(7, rng.choice([None, rng.randrange(900)]), rng.choice(["user", "assistant", "tool", None]), f"t{i}") for i in range(1500)]
    rows += [(c, t, "user" if t % 2 else "assistant", "x") for c in (1, 2, None) for t in range(0, 60, c or 3)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    o = Window.partitionBy("conv_id").orderBy("turn", "role", F.xxhash64("text"))
    last = lambda n: F.collect_list(F.struct("turn", "role")).over(o.rowsBetween(-n, -1))
    one = conv.select("conv_id", "turn", "role", last(12).alias("c"), last(4).alias("a")).where("role = 'user'").collect()
    expected = sorted((str(r.conv_id), str(r.turn), ",".join(str(x.turn) for x in r.c if x.turn is not None),
                       ",".join(str(x.turn) for x in r.a if x.role in ("user", "assistant") and x.turn is not None)) for r in one)
    for bucket in (13, 64, 4096):
        got = tg.history(conv, bucket).collect()
        assert sorted((str(r.conv_id), str(r.turn), r.chat_turns, r.agent_turns) for r in got) == expected
    assert tg.history(conv.limit(0)).collect() == []


def test_positions_spread_a_hot_group(spark):
    df = spark.range(3000).selectExpr("if(id < 2500, null, id % 7) AS g", "(id * 7919) % 3001 AS o").repartition(6)
    got = positions(df, "g", ["o"], ranges=16)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    o = Window.partitionBy("g").orderBy("o")
    assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumn("pos", F.row_number().over(o).cast("bigint") - 1).collect()))
    assert "RepartitionByExpression" in plan
    tasks = {r._range: r.n for r in df.repartitionByRange(16, "g", "o").groupBy(F.spark_partition_id().alias("_range")).agg(F.count("*").alias("n")).collect()}
    assert max(tasks.values()) < 1000  # the group of 2500 rows lies in several ranges

@pytest.mark.parametrize("text,want", [
    ("show top 5 films by revenue", (5, False, True, False, False, None, None)),
    ("least rented slow films", (15, True, False, False, True, None, None)),
    ("films with too many copies", (15, False, False, True, False, None, None)),
    ("set revenue to $2.5m", (15, False, True, False, False, "revenue", 2.5e6)),
    ("ubah total jadi 3,000 k", (15, False, False, False, False, "total", 3e6)),
    ("change customer to 4rb", (15, False, False, False, False, "customer", 4e9)),  # the letters of "rb" hold a "b"
    ("hello", (15, False, False, False, False, None, None)),
])
def test_commands(spark, text, want):
    conv = spark.createDataFrame([(1, 0, "user", text)], "conv_id bigint, turn bigint, role string, text string")
    assert tuple(tg.commands(conv).collect()[0])[2:] == want


def test_entities_come_from_tables(spark):
    import random

    rng = random.Random(8)
    names = [("country", "South Korea"), ("country", "Korea"), ("country", "new-land"), ("category", "Sci-Fi"), ("category", "New"), ("title", "..."),
             ("title", "The Old Man and the Sea"), ("title", "the old"), ("title", "Éa 2")]
    vocabulary = ["south", "Korea", "new", "land", "sci", "fi", "the", "old", "man", "and", "sea", "éa", "2", "korean", "x"]
    texts = [(i, rng.choice([" ", "-", ", ", "... "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(400)] + [(900, None), (901, "")]

    def plain(text):
        return " ".join(w.lower() for w in re.findall(r"[^\W_]+", text or ""))

    expected = set()
    for i, text in texts:
        best = {}
        for kind, name in names:
            at = f" {plain(text)} ".find(f" {plain(name)} ")
            if plain(name) and at >= 0:
                best[kind] = min(best.get(kind, (10**9, 0, "")), (at, -len(plain(name)), name))
        expected |= {(i, kind, name) for kind, (_, _, name) in best.items()}
    roles = type("Names", (), {"customer_country": spark.createDataFrame([(n,) for k, n in names if k == "country"], "country string"),
                               "category": spark.createDataFrame([(n,) for k, n in names if k == "category"], "name string"),
                               "film": spark.createDataFrame([(n,) for k, n in names if k == "title"], "title string")})
    entries = en.names(roles)
    df = spark.createDataFrame(texts, "id long, text string")
    assert {tuple(r) for r in en.spotted(df, entries, ["id"]).collect()} == expected and len(expected) > 200
    assert en.spotted(df, entries.limit(0), ["id"]).collect() == []
    # a hundred thousand titles are a larger table under the same plan
    many = spark.range(100_000).selectExpr("'title' AS kind", "concat('old ', id) AS key", "concat('Old ', id) AS name", "2 AS n").unionByName(entries)
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert size(en.spotted(df, many, ["id"])) <= size(en.spotted(df, entries, ["id"])) + 5
