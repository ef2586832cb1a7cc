"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

1. Base patterns find the seed entities (email, ip, card, phone); these spans always stay.
2. Looser shapes find mentions that might be identifiers too: addresses with letters beyond ASCII or ``(at)``,
   colon-separated hex groups, digit groups that are no base match.  A mention that overlaps a base span is none.
3. The one and the two words before a mention are its lexical patterns.  A pattern with at least ``SUPPORT`` different
   instances of a kind, one of them a seed, is induced, and all its occurrences are counted over every text, so a pattern that
   mostly precedes prose scores low.
4. Patterns and instances form a graph that Spark scores in rounds: a pattern by the confidence of its instances over its
   occurrences, an instance by its best high-scoring pattern; seeds count 1.  Copies of a document raise both sides alike, and a
   pattern needs ``SUPPORT`` different confident instances.  Confidence is in whole thousandths, so sums do not depend on order.
5. Mentions in a high-scoring pattern are added as spans of the pattern's kind (of two kinds the better one).

The regular expressions are written so that no match is tried twice from inside a run and no group is entered
recursively: a run of any length costs one pass (``(?:\\G|(?<!x))x++`` starts only where the leftmost match can).

Defined results: a null or empty text has no span, ``base_sha256`` of nothing and ``spans`` empty.  A null doc_id is
carried.  Repeated rows give equal rows.  A mention that is glued to the word before it, or follows another mention of its shape
directly, has fewer patterns or none.  Texts are searched whole.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, bounded, table

# The kinds in order and their base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
LOCAL, DOMAIN = r"[\p{L}\p{N}._%+!#$&*~-]", r"[\p{L}\p{N}-]"
LOOSE = {
    EMAIL: rf"(?:\G|(?<!{LOCAL})){LOCAL}++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?){DOMAIN}++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?){DOMAIN}++)*+",
    IP: r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+",
    CARD: r"\(?[0-9](?:[\x20().-]{0,2}+[0-9])++",
    PHONE: r"\(?[0-9](?:[\x20().-]{0,2}+[0-9])++",
}
SPACE = r"[\x20\x09-\x0D]"
SUPPORT, HIGH, ROUNDS, CONTEXT, WORD = 3, 600, 4, 200, 40
BLOCK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _before(lengths: Column) -> Column:
    """Sums of the numbers before each place: block by block, so a long array costs a block per place."""
    def within(x: Column, first: Column, n: Column) -> Column:
        return F.aggregate(F.slice(x, first, n), F.lit(0).cast("long"), lambda a, b: a + b)

    def places(all_: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / BLOCK).cast("int")), lambda b: within(all_, b * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, lambda sums: _let(
            F.transform(sums, lambda _, b: within(sums, F.lit(1), b)),
            lambda starts: F.transform(all_, lambda _, i: F.get(starts, F.floor(i / BLOCK).cast("int")) + within(
                all_, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))

    return _let(lengths, places)


def _matches(parts: Column, values: Column) -> Column:
    """Structs of start and end in code points, value, and the text before and after as far as a mention needs it, from
    the text between the matches and the matches themselves."""
    lengths = F.zip_with(parts, values, lambda p, v: (F.length(p) + F.coalesce(F.length(v), F.lit(0))).cast("long"))
    return _let(_before(lengths), lambda at: F.transform(values, lambda v, i: F.struct(
        (at[i] + F.length(parts[i])).alias("start"), (at[i] + F.length(parts[i]) + F.length(v)).alias("end"), v.alias("value"),
        F.right(parts[i], F.lit(CONTEXT)).alias("before"), F.left(parts[i + 1], F.lit(1)).alias("after"),
        ((i == 0) & (F.length(parts[i]) <= CONTEXT)).alias("whole"))))


def _patterns() -> Column:
    """The last word and the last two words before a mention, lower-cased, each complete and set off by white space."""
    # the first word may be a part of a longer one
    whole = F.when(F.col("whole"), F.col("before")).otherwise(F.regexp_replace("before", rf"^(?!{SPACE})[^\x20\x09-\x0D]++", ""))
    tail = F.lower(F.when(F.right("before", F.lit(1)).rlike(SPACE), whole))
    start, word = r"(?<![^\x20\x09-\x0D])", r"[^\x20\x09-\x0D]++"
    last = F.regexp_extract(tail, rf"{start}({word}){SPACE}*+\z", 1)
    two = F.regexp_extract(tail, rf"{start}({word}){SPACE}++({word}){SPACE}*+\z", 1)
    found = F.array(F.when(last != "", last), F.when(two != "", F.concat(two, F.lit(" "), last)))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda p: p.isNotNull() & (F.length(p) <= 2 * WORD))


def mentions(docs: DataFrame) -> DataFrame:
    """key, doc_id, kind, start, end, base, value, patterns: the base spans and looser mentions of each row's whole text, and
    for each input row one row with its key and doc_id alone."""
    text = F.col("text").cast("string")

    def group(kind: int, base: bool, pattern: str | None) -> Column:
        parts, values = (F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) if pattern else (F.lit(None), F.lit(None))
        return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), parts.cast("array<string>").alias("parts"),
                        values.cast("array<string>").alias("values"))

    none = group(-1, False, None)
    groups = [group(k, True, p) for k, p in BASE.items()] + [group(k, False, p) for k, p in LOOSE.items()]
    # a text without a digit, an at sign or a bracketed at has no mention
    may = text.rlike(r"[0-9@]|[\[(](?:at|AT)[\])]")
    rows = (docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
            .select("key", "doc_id", F.explode(F.when(may, F.array(none, *groups)).otherwise(F.array(none))).alias("g"))
            .select("key", "doc_id", "g.kind", "g.base", F.explode_outer(_matches(F.col("g.parts"), F.col("g.values"))).alias("m"))
            .select("key", "doc_id", "kind", "base", "m.*").where("kind < 0 or start is not null"))
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    glued = F.right("before", F.lit(1)).rlike(r"[\p{L}\p{N}_@]") | F.col("after").rlike(r"[\p{L}\p{N}_@]")
    kind, base = F.col("kind"), F.col("base")
    valid = (F.when(kind < 0, True).when(kind == EMAIL, True)
             .when(base & (kind == IP), F.col("value").rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}\z"))
             .when(base & (kind == CARD), F.when(n.between(12, 19), F.call_function("luhn_check", digits)).otherwise(False))
             .when(base, n.between(9, 15))
             .when(glued, False)
             .when(kind == IP, F.col("value").rlike("[0-9A-Fa-f]{2}") & (F.length("value") >= 6))
             .when(kind == CARD, n.between(12, 19)).otherwise(n.between(7, 15)))
    return rows.where(valid).select("key", "doc_id", "kind", "start", "end", "base", F.lower("value").alias("value"), _patterns().alias("patterns"))


def apart(found: DataFrame) -> DataFrame:
    """The mentions without those that are no base spans and overlap one."""
    order = [F.col(c) for c in ("start", "end", "kind", "base")]
    so_far = Window.partitionBy("key").rowsBetween(Window.unboundedPreceding, 0)  # running frames cost one step a row
    left = F.max(F.when(F.col("base"), F.col("end"))).over(so_far.orderBy(*order))
    right = F.min(F.when(F.col("base"), F.col("start"))).over(so_far.orderBy(*(c.desc() for c in order)))
    return (found.where("kind >= 0").withColumn("left", left).withColumn("right", right)
            .where(F.col("base") | ((F.coalesce("left", F.col("start")) <= F.col("start")) & (F.coalesce("right", F.col("end")) >= F.col("end"))))
            .drop("left", "right"))


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern hash -> number of places of the word or word pair in all texts."""
    words = F.filter(F.split(F.lower(F.col("text").cast("string")), SPACE + "+", -1), lambda w: w != "")
    pairs = F.zip_with(F.concat(F.array(F.lit(None).cast("string")), F.col("words")), F.col("words"), lambda p, w: F.array(
        F.when(w.isNotNull(), F.xxhash64(w)), F.when(p.isNotNull() & w.isNotNull(), F.xxhash64(F.concat(p, F.lit(" "), w)))))
    places = docs.select(words.alias("words")).select(F.explode(F.flatten(pairs)).alias("mark"))
    wanted = patterns.select(F.xxhash64("pattern").alias("mark")).distinct()
    if patterns.count() <= BROADCAST_ROWS:  # only places of patterns are counted
        places = places.join(F.broadcast(wanted), "mark", "left_semi")
        return places.groupBy("mark").agg(F.count(F.lit(1)).alias("occ"))
    return places.groupBy("mark").agg(F.count(F.lit(1)).alias("occ")).join(wanted, "mark", "left_semi")


def scored(scratch: Scratch, docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """kind, pattern, score of the high-scoring patterns; None where there are none."""
    edges = (rows.select("kind", "value", "base", F.explode("patterns").alias("pattern"))
             .groupBy("kind", "pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("base").alias("base")))
    # a value that is a base match anywhere is a seed
    seeds = rows.where("base").select("kind", "value").distinct().withColumn("seed", F.lit(True))
    edges = scratch.keep(edges.join(seeds, ["kind", "value"], "left").withColumn("seed", F.coalesce("seed", F.lit(False))).drop("base"))
    induced = scratch.keep(edges.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("instances"), F.max("seed").alias("seeded"))
                           .where(F.col("seeded") & (F.col("instances") >= SUPPORT)).select("kind", "pattern"))
    if not induced.limit(1).count():
        return None
    occ = scratch.keep(occurrences(docs, induced))
    weights = scratch.keep(induced.withColumn("mark", F.xxhash64("pattern")).join(occ, "mark").drop("mark"))
    graph = scratch.keep(edges.join(bounded(weights), ["kind", "pattern"])
                         .withColumn("conf", F.when(F.col("seed"), F.lit(1000)).otherwise(0).cast("long")))
    scratch.drop(edges, induced, occ, weights)
    high = None
    for _ in range(ROUNDS):
        score = F.expr("least(1000, (2 * sum(n * conf)) div (2 * max(occ) + 1))")
        high = scratch.keep(graph.groupBy("kind", "pattern").agg(score.alias("score"), F.sum((F.col("conf") >= HIGH).cast("int")).alias("support"))
                            .where((F.col("score") >= HIGH) & (F.col("support") >= SUPPORT)).select("kind", "pattern", "score"))
        best = scratch.keep(graph.where("not seed").join(bounded(high), ["kind", "pattern"])
                            .groupBy("kind", "value").agg(F.max("score").alias("best")))
        if not best.limit(1).count():
            break
        after = scratch.keep(graph.join(bounded(best), ["kind", "value"], "left")
                             .withColumn("conf", F.greatest("conf", F.coalesce("best", F.lit(0)))).drop("best"))
        same = after.agg(F.sum("conf")).first() == graph.agg(F.sum("conf")).first()
        scratch.drop(graph, best)
        graph = after
        if same:
            break
    scratch.drop(graph)
    return high


def personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, spans: one row per input row; a span is a struct of start, kind (number), end and base."""
    scratch = Scratch(spark, "personal-data")
    found = scratch.keep(mentions(docs))
    rows = scratch.keep(apart(found))
    high = scored(scratch, docs, rows)
    span = F.struct("start", "kind", "end", "base")
    if high is None:
        added = rows.where("false").select("key", span.alias("span"))
    else:
        added = (rows.where("not base").select("key", "kind", "start", "end", "base", F.explode("patterns").alias("pattern"))
                 .join(bounded(high), ["kind", "pattern"])
                 .groupBy("key", "start", "end", "base").agg(F.min(F.struct((-F.col("score")).alias("score"), F.col("kind"))).alias("best"))
                 .select("key", F.struct("start", "best.kind", "end", "base").alias("span")))
    # the row without a span carries the doc_id
    spans = (found.where("kind < 0 or base").select("key", F.when(F.col("kind") >= 0, span).alias("span"), "doc_id", (F.col("kind") < 0).alias("whole"))
             .unionByName(added.withColumns({"doc_id": F.lit(None), "whole": F.lit(False)})))
    return (spans.groupBy("key").agg(F.max(F.when(F.col("whole"), F.col("doc_id"))).alias("doc_id"), F.array_sort(F.collect_list("span")).alias("spans"))
            .drop("key"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all ``documents``: doc_id, counts by kind of the base spans, base_sha256, spans, n_added."""
    def joined(spans: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    base = F.filter("spans", lambda s: s["base"])
    return personal_data(spark, table(spark, sf_dir, "documents")).select(
        "doc_id", *(counted(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"))
