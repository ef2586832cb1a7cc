"""Benchmark passages in documents: windows placed by shared shingles, exact verification of every one.

Only DataFrame functions run on the rows.  Words are lower-cased runs without white space; a text's shingles are
its five-word sequences, weighted by how often they occur.  The similarity of a window and an item is the
weighted Jaccard of their shingles, the sum of the lesser weights over the sum of the greater ones.

1. *Windows.*  A window has the size of an item, and starts where a shingle that it shares with the item puts it.
   Every shingle position of a document is looked up.
2. *Bound.*  A document and an item go on only if the document has as many places with the item's shingles as the
   threshold takes.  No window shares more than its document does, so the bound loses nothing at any similarity.
3. *Verification.*  Every window left is compared with its item by the full weighted shingles:
   100 * intersection >= 75 * union.  No fingerprint stands between a window and this comparison.

The shingle table of the benchmark and the ids of documents with windows are broadcast only when their counted
rows are within a bound (``common.BROADCAST_ROWS``); beyond it the same joins are shuffled.

Defined results: null and empty texts, and documents or items of fewer than five words, match nothing.  Repeated
rows match once.  A null doc_id or item_id is carried as it is.  An empty table on either side gives an empty
result.  Windows are cut at the document's ends.  Other columns are not read.  Up to 32767 words an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, fresh, table

PERCENT = 75
SHINGLE = 5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def shingle_at(words: Column, position: Column) -> Column:
    """Hash of the shingle that starts at the 0-based position."""
    return F.xxhash64(*(F.get(words, position + i) for i in range(SHINGLE)))


def _positions(words: Column) -> Column:
    last = F.size(words) - SHINGLE
    return F.when(last >= 0, F.sequence(F.lit(0), last))


def _least_run(shingles: int, percent: int) -> int:
    """The longest run of shared shingles that edits leave of a passage at the threshold; the search does not rest on it."""
    lost = shingles * (100 - percent) // 100
    return max(1, min(-(-(shingles - m) // (m // (SHINGLE - 1) + 1)) for m in range(lost + 1)))


def _counted(rows: DataFrame, key: list[str], words: str) -> DataFrame:
    """(key, shingle, weight) of word arrays."""
    at = rows.select(*key, words, F.explode(_positions(F.col(words))).alias("at"))
    return (at.select(*key, shingle_at(F.col(words), F.col("at")).alias("shingle"))
            .groupBy(*key, "shingle").agg(F.count(F.lit(1)).alias("weight")))


def row_key() -> Column:
    """A document's key: equal for rows of one doc_id and text, never null."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def _matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    """The columns of ``leaks`` with doc, the document's ``row_key``."""
    scratch = Scratch(spark, "decontamination")
    # items of one text are compared once
    rows = scratch.keep(benchmark.select("item_id", words_of(F.col("text").cast("string")).alias("words"))
                        .withColumn("size", F.size("words")).where(F.col("size") >= SHINGLE)
                        .withColumn("item", F.xxhash64("words")))
    names = rows.select("item", "item_id").distinct()
    items = scratch.keep(rows.select("item", "size", "words").dropDuplicates(["item"]))
    places = items.select("item", "size", "words", F.explode(_positions(F.col("words"))).alias("place")).select(
        "item", "size", "place", shingle_at(F.col("words"), F.col("place")).alias("shingle"))
    places = bounded(scratch.keep(places))

    texts = docs.select(row_key().alias("doc"), "doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    texts = texts.select("doc", "doc_id", words_of(F.col("text")).alias("words"))
    shingles = F.transform(_positions(F.col("words")),
                           lambda at: F.struct(at.alias("at"), shingle_at(F.col("words"), at).alias("shingle")))
    seen = texts.select("doc", F.size("words").alias("n_all"), F.explode(shingles).alias("s")).select(
        "doc", "n_all", F.col("s.at").alias("at"), F.col("s.shingle").alias("shingle"))
    start = F.greatest(F.least(F.col("at") - F.col("place"), F.col("n_all") - F.col("size")), F.lit(0))
    met = scratch.keep(seen.join(places, "shingle").select(
        "doc", "item", "at", start.alias("start"), F.least("size", "n_all").alias("size"), F.col("size").alias("item_size")))
    # 100 * both >= percent * (own + theirs - both) takes at least so many places
    total = F.col("size") + F.col("item_size") - 2 * (SHINGLE - 1)
    enough = (met.groupBy("doc", "item", "size", "item_size").agg(F.count_distinct("at").alias("n"))
              .where(F.col("n") * (100 + percent) >= total * percent).select("doc", "item"))
    windows = scratch.keep(met.join(enough, ["doc", "item"], "left_semi").select("doc", "item", "start", "size").distinct())
    scratch.drop(met)

    wanted = scratch.keep(windows.select("doc").distinct())
    found = scratch.keep(texts.join(bounded(wanted), "doc", "left_semi").dropDuplicates(["doc"]))
    key = ["doc", "start", "size"]
    cut = found.join(windows.select(*key).distinct(), "doc").select(
        *key, F.slice("words", F.col("start") + 1, F.col("size")).alias("words"))
    own = _counted(cut, key, "words")
    theirs = _counted(items, ["item"], "words").withColumnRenamed("weight", "item_weight")
    shared = (windows.join(own, key).join(theirs, ["item", "shingle"])
              .groupBy(*key, "item").agg(F.sum(F.least("weight", "item_weight")).alias("both")))
    sizes = items.select("item", (F.col("size") - SHINGLE + 1).alias("item_total"))
    union = F.col("size") - SHINGLE + 1 + F.col("item_total") - F.col("both")
    matched = (shared.join(sizes, "item").where(F.col("both") * 100 >= union * percent)
               .withColumn("similarity", F.col("both") / union))
    best = matched.groupBy("doc", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("m"))
    return (best.join(found.select("doc", "doc_id"), "doc").join(names, "item")
            .select("doc", "doc_id", "item_id", (-F.col("m.back")).cast("long").alias("start_word"),
                    F.col("m.size").cast("long").alias("n_words"), F.col("m.similarity").alias("similarity")))


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each document and item that match."""
    return _matches(spark, docs, benchmark, percent).drop("doc").distinct()


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark passage, with their columns as they are.

    Rows are judged by doc_id and text: a clean text stays beside a leaking one of the same or of no doc_id.
    """
    scratch = Scratch(spark, "decontaminated")
    [mark] = fresh(docs, "leaking")
    hit = scratch.keep(_matches(spark, docs, table(spark, sf_dir, "benchmark"), PERCENT).select(F.col("doc").alias(mark)).distinct())
    return docs.join(bounded(hit), row_key() == F.col(mark), "left_anti").select(docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all ``documents``: doc_id, item_id, start_word, n_words, similarity."""
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS at, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh
       FROM d WHERE len(w) >= 5),
bs AS (SELECT item_id, len(w) AS size, unnest(range(0, len(w) - 4)) AS at, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh
       FROM b WHERE len(w) >= 5),
win AS (SELECT DISTINCT doc_id, item_id, size AS item_size, least(size, n) AS size, greatest(0, least(ds.at - bs.at, n - size)) AS start FROM ds JOIN bs ON ds.sh = bs.sh),
own AS (SELECT win.doc_id, win.item_id, win.start, ds.sh, COUNT(*) AS c FROM win
        JOIN ds ON ds.doc_id = win.doc_id AND ds.at BETWEEN win.start AND win.start + win.size - 5 GROUP BY ALL),
their AS (SELECT item_id, sh, COUNT(*) AS c FROM bs GROUP BY ALL),
k AS (SELECT doc_id, own.item_id, start, SUM(least(own.c, their.c)) AS k FROM own JOIN their ON their.item_id = own.item_id AND their.sh = own.sh GROUP BY ALL),
m AS (SELECT k.doc_id, k.item_id, k.start, win.size, k, win.size - 4 + win.item_size - 4 - k AS u FROM k
      JOIN win ON win.doc_id = k.doc_id AND win.item_id = k.item_id AND win.start = k.start)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, CAST(size AS BIGINT) AS n_words, CAST(k AS DOUBLE) / CAST(u AS DOUBLE) AS similarity
FROM m WHERE 100 * k >= 75 * u
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
