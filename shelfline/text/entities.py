"""T8 from the catalogue's own tables: countries, categories and titles named in a text.

Texts and names are reduced to their words (letters and digits, lower-cased).  Every run of as many words as some name has
is a candidate; candidates meet the names in one equi-join, so a new country or a hundred thousand titles change a
table and not the plan.  Per text and kind the first name wins: the earliest place, then the longest name, then the alphabet.
A name matches whole words only; a name without letters and digits matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.roles import Roles
from .tagging import user_turns

KINDS = ("country", "category", "title")


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def names(roles: Roles) -> DataFrame:
    """kind, name, key (its words), n (their number): one row per kind and key."""
    found = (roles.customer_country.select(F.lit("country").alias("kind"), F.col("country").alias("name")).distinct()
             .unionByName(roles.category.select(F.lit("category").alias("kind"), "name").distinct())
             .unionByName(roles.film.select(F.lit("title").alias("kind"), F.col("title").alias("name")).distinct()))
    return (found.select("kind", "name", words("name").alias("_words")).where(F.size("_words") > 0)
            .groupBy("kind", F.array_join("_words", " ").alias("key")).agg(F.min("name").alias("name"), F.min(F.size("_words")).alias("n")))


def spotted(texts: DataFrame, entries: DataFrame, ids: list[str]) -> DataFrame:
    """ids, kind, name: the first name of each kind in the ``text`` of each row that has one."""
    sizes = sorted(r["n"] for r in entries.select("n").distinct().collect())  # numbers of words a name can have: a few
    w = F.col("_words")
    runs = [F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), _run(w, n))) for n in sizes]
    none = F.array().cast("array<struct<at:int,key:string>>")
    grams = (texts.select(*ids, words("text").alias("_words"))
             .select(*ids, F.explode(F.concat(none, *(F.coalesce(r.cast("array<struct<at:int,key:string>>"), none) for r in runs))).alias("_g"))
             .select(*ids, "_g.at", "_g.key"))
    return (grams.join(entries, "key").groupBy(*ids, "kind")
            .agg(F.min(F.struct("at", (-F.length("key")).alias("size"), "name")).alias("_first"))
            .select(*ids, "kind", "_first.name"))


def _run(w: Column, n: int):
    return lambda i: F.struct(i.cast("int").alias("at"), F.array_join(F.slice(w, i + 1, n), " ").alias("key"))


def catalogue_entities(roles: Roles) -> DataFrame:
    """Per user turn that names one: the first country, category and title of the catalogue."""
    hits = spotted(user_turns(roles.conversations), names(roles), ["conv_id", "turn"])
    return hits.groupBy("conv_id", "turn").agg(*(F.max(F.when(F.col("kind") == k, F.col("name"))).alias(k) for k in KINDS))
