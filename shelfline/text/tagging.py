"""Conversation text jobs over the ``conversations`` table.

All rules are native column expressions (``rlike``, ``split``, ``regexp_extract``,
array functions) evaluated per row inside whole-stage codegen: no Python per
row, no join against a rules table.  Regular expressions are written so that
Java's engine (Spark) and RE2 (the DuckDB oracle) agree with the original
semantics: JavaScript ``\\b`` is an ASCII word boundary, Python's is Unicode,
both spelled out as explicit character classes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import positions
from . import rules as R

ASCII_WORD = "A-Za-z0-9_"
UNICODE_WORD = r"\p{L}\p{N}_"
# Python str.split() whitespace, spelled out (Java's \s and RE2's \s differ from it)
PY_SPACE = r"[\t\n\x{0b}\x{0c}\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def boundaries(pattern: str, word: str = ASCII_WORD) -> str:
    r"""Rewrite ``\b`` as explicit boundaries over the ``word`` class: before a word
    (or group) it is 'start or non-word char', before ``)``, ``|`` or the end it
    is 'non-word char or end'."""
    out, i = [], 0
    left, right = f"(?:^|[^{word}])", f"(?:$|[^{word}])"
    while i < len(pattern):
        if pattern.startswith(r"\b", i):
            nxt = pattern[i + 2:i + 3]
            out.append(right if nxt in ("", ")", "|") else left)
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def factored(pattern: str, word: str = ASCII_WORD) -> str:
    r"""The same test for Java's engine: one look-behind before one alternation, so a position that starts no word is
    left at once.  ``\b`` may open or close the pattern or open each of its alternatives."""
    left, right = f"(?<![{word}])", f"(?![{word}])"
    close = pattern.endswith(r"\b")
    body = pattern[:-2] if close else pattern
    depth, cut = 0, [0]
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            cut.append(i + 1)
    parts = [body[a:b].rstrip("|") for a, b in zip(cut, [*cut[1:], len(body)])]
    if not all(x.startswith(r"\b") for x in parts) or any(r"\b" in x[2:] for x in parts):
        raise ValueError(f"cannot factor {pattern}")
    return left + "(?:" + "|".join(x[2:] for x in parts) + ")" + (right if close else "")


def words_rx(words, word: str = ASCII_WORD) -> str:
    return factored(r"\b(?:" + "|".join(words) + r")\b", word)


def words_re(words, word: str = ASCII_WORD) -> str:
    return boundaries(r"\b(?:" + "|".join(words) + r")\b", word)


def lowered(text: Column) -> Column:
    return F.lower(text)


# ---------------------------------------------------------------- T1 / T2
def on_topic(text: Column) -> Column:
    """Any whitespace-separated word (punctuation attached) is in the vocabulary."""
    vocab = F.array(*[F.lit(w) for w in dict.fromkeys(R.TOPIC_VOCAB)])
    return F.arrays_overlap(F.split(lowered(text), PY_SPACE), vocab)


def edit_intent(text: Column) -> Column:
    """Whole-word edit verbs (Python word boundaries, any case)."""
    return lowered(text).rlike(words_rx(R.EDIT_WORDS, UNICODE_WORD))


# ---------------------------------------------------------------- T3 / T4
def topic_tags(text: Column) -> Column:
    """Every matching topic label in display order; the default when none."""
    p = lowered(text)
    tags = F.filter(F.array(*[F.when(p.rlike(pat), F.lit(label)) for pat, label in R.TOPIC_TAGS]),
                    lambda x: x.isNotNull())
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit(R.DEFAULT_TAG)))


def dashboard_keyword(text: Column) -> Column:
    """T4: the off-topic guard's keyword test."""
    return lowered(text).rlike(words_rx(R.DASHBOARD_WORDS))


# ---------------------------------------------------------------- T5
def answer_key(text: Column, available=tuple(R.CACHED_ANSWERS)) -> Column:
    """T5: key of the first rule with a phrase contained in the trimmed lowercase text, among the rules whose key has
    an ``available`` answer."""
    p = F.trim(lowered(text))
    out = None
    for key, phrases in R.ANSWER_RULES:
        if key not in available:
            continue
        hit = None
        for ph in phrases:
            c = F.instr(p, ph) > 0
            hit = c if hit is None else (hit | c)
        out = F.when(hit, F.lit(key)) if out is None else out.when(hit, F.lit(key))
    return out


# ---------------------------------------------------------------- T6 / T7
def parse_number(s: Column) -> Column:
    """JavaScript parseFloat of the text without commas: the leading number, else null."""
    clean = F.regexp_replace(s, ",", "")
    lead = F.regexp_extract(clean, r"^([0-9]+(?:\.[0-9]*)?|\.[0-9]+)", 1)
    return F.when(lead != "", lead.cast("double"))


def scaled(number: Column, suffix: Column) -> Column:
    """The captured number times its suffix (k, m, juta, ribu); null when absent or zero (a falsy amount is
    ignored)."""
    num = parse_number(number)
    mult = F.lit(1.0)
    for s, m in reversed(R.AMOUNT_SUFFIXES):
        mult = F.when(suffix == s, F.lit(m)).otherwise(mult)
    v = num * mult
    return F.when(v != 0, v)


def amount(text: Column, pattern: str) -> Column:
    """T6 on a text: number in group 1 of the pattern, suffix in group 2."""
    p = lowered(text)
    return scaled(F.regexp_extract(p, pattern, 1), F.regexp_extract(p, pattern, 2))


def branch(text: Column) -> Column:
    """Which parameterised query a 'show/list/...' request targets (first match)."""
    p = lowered(text)
    verb = p.rlike(factored(R.QUERY_VERB_RE))
    out = None
    for name, pat in R.QUERY_BRANCHES:
        c = p.rlike(factored(pat))
        out = F.when(c, F.lit(name)) if out is None else out.when(c, F.lit(name))
    return F.when(verb, out)


def captures(p: Column, b: Column) -> tuple[dict[str, Column], dict[str, list[tuple[str, str]]]]:
    """Per threshold the captured number and suffix of the detected branch's pattern, each regex run once, and which
    capture columns make up each threshold, in order."""
    cols, fields = {}, {}
    for table, mark in (({(n, br): pat for n, br, pat in R.THRESHOLDS}, "a"), (R.THRESHOLDS_ELSE, "b")):
        for name in dict.fromkeys(n for n, _ in table):
            num = suf = None
            for (n, br), pat in table.items():
                if n == name:
                    num = (F if num is None else num).when(b == br, F.regexp_extract(p, pat, 1))
                    suf = (F if suf is None else suf).when(b == br, F.regexp_extract(p, pat, 2))
            cols[f"_{mark}_{name}"], cols[f"_{mark}s_{name}"] = num, suf
            fields.setdefault(name, []).append((f"_{mark}_{name}", f"_{mark}s_{name}"))
    return cols, fields


# ---------------------------------------------------------------- T8
def first_contained(text: Column, entries, word_boundary: bool = False) -> Column:
    p = lowered(text)
    out = None
    for e in entries:
        c = p.rlike(words_rx([re.escape(e)])) if word_boundary else (F.instr(p, e) > 0)
        out = F.when(c, F.lit(e)) if out is None else out.when(c, F.lit(e))
    return out


def entities(text: Column, rating_word_boundary: bool = True) -> Column:
    """First country, category and rating mentioned.  Ratings use whole-word
    matching by default (plain substrings make 'g' and 'r' match almost anything)."""
    return F.struct(first_contained(text, R.COUNTRIES).alias("country"),
                    first_contained(text, R.CATEGORIES).alias("category"),
                    F.upper(first_contained(text, R.RATINGS, rating_word_boundary)).alias("rating"))


# ---------------------------------------------------------------- T10
def chart_dimension(text: Column) -> Column:
    p = lowered(text)
    out = None
    for name, pat in R.CHART_DIMENSIONS:
        c = p.rlike(factored(pat))
        out = F.when(c, F.lit(name)) if out is None else out.when(c, F.lit(name))
    return out


def route(text: Column) -> Column:
    """Revert -> instant answer -> chart -> direct query -> off-topic -> agent.
    The instant route covers the answer library and the forecast shortcut."""
    p = lowered(text)
    revert = p.rlike(factored(R.REVERT_RE))
    instant = answer_key(text).isNotNull() | F.trim(p).rlike(factored(R.FORECAST_NAV_RE))
    chart = (p.rlike(factored(R.CHART_VERB_RE)) & p.rlike(factored(R.CHART_NOUN_RE))
             & chart_dimension(text).isNotNull())
    direct = branch(text).isNotNull()
    return (F.when(revert, F.lit("revert")).when(instant, F.lit("instant")).when(chart, F.lit("chart"))
            .when(direct, F.lit("direct_query")).when(~dashboard_keyword(text), F.lit("off_topic"))
            .otherwise(F.lit("agent")))


# ---------------------------------------------------------------- T11
def truncate(text: Column, limit: int, with_length: bool = True) -> Column:
    """First ``limit`` characters plus a marker (with the original length, or '...')."""
    marker = (F.concat(F.lit("\n...[truncated "), F.length(text).cast("string"), F.lit(" chars]"))
              if with_length else F.lit("..."))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), marker)).otherwise(text)


# ---------------------------------------------------------------- table-level jobs
def user_turns(conv: DataFrame) -> DataFrame:
    return conv.where(F.col("role") == "user")


def _routed(conv: DataFrame) -> DataFrame:
    """User turns with the rule results as columns, each computed once; the
    route is then a short CASE over those columns."""
    t = F.col("text")
    base = user_turns(conv).select("conv_id", "turn", "text", lowered(t).alias("_p"))
    p = F.col("_p")
    chart_cmd = p.rlike(factored(R.CHART_VERB_RE)) & p.rlike(factored(R.CHART_NOUN_RE))
    step = base.select(
        "*", answer_key(p).alias("answer_key"), branch(p).alias("_branch"),
        F.when(chart_cmd, chart_dimension(p)).alias("_chart_dim"), dashboard_keyword(p).alias("dashboard_keyword"),
        p.rlike(factored(R.REVERT_RE)).alias("_revert"),
        F.trim(p).rlike(factored(R.FORECAST_NAV_RE)).alias("_fnav"),
        )
    route_col = (F.when(F.col("_revert"), F.lit("revert"))
                 .when(F.col("answer_key").isNotNull() | F.col("_fnav"), F.lit("instant"))
                 .when(F.col("_chart_dim").isNotNull(), F.lit("chart"))
                 .when(F.col("_branch").isNotNull(), F.lit("direct_query"))
                 .when(~F.col("dashboard_keyword"), F.lit("off_topic"))
                 .otherwise(F.lit("agent")))
    return step.withColumn("route", route_col)


def intents(conv: DataFrame) -> DataFrame:
    """Per user turn: T1, T2, T3, T4, T5 and the T10 route."""
    r = _routed(conv)
    p = F.col("_p")
    return r.select("conv_id", "turn", on_topic(p).alias("on_topic"), edit_intent(p).alias("edit_intent"),
                    F.array_join(topic_tags(p), "|").alias("topics"), "dashboard_keyword", "answer_key", "route")


def topic_counts(conv: DataFrame) -> DataFrame:
    """Number of user turns per topic tag."""
    return (user_turns(conv).select(F.explode(topic_tags(F.col("text"))).alias("topic"))
            .groupBy("topic").agg(F.count(F.lit(1)).alias("turns")))


def route_counts(conv: DataFrame) -> DataFrame:
    """Number of user turns per route."""
    return _routed(conv).groupBy("route").agg(F.count(F.lit(1)).alias("turns"))


def parameters(conv: DataFrame) -> DataFrame:
    """Detected query branch, thresholds and entities per user turn."""
    p, b = F.col("_p"), F.col("branch")
    base = user_turns(conv).select("conv_id", "turn", lowered(F.col("text")).alias("_p"))
    base = base.withColumn("branch", branch(p))
    cols, fields = captures(p, b)
    ent = entities(p)
    found = base.select("conv_id", "turn", "branch", ent.alias("_ent"), *(c.alias(k) for k, c in cols.items()))
    out = [F.coalesce(*(scaled(F.col(n), F.col(s)) for n, s in pairs)).alias(name) for name, pairs in fields.items()]
    return found.select("conv_id", "turn", "branch", *out, "_ent.*")


def commands(conv: DataFrame) -> DataFrame:
    """Per user turn the row limit, sort direction, measure and film flags that a chart or query command names,
    and the KPI override with its second suffix set."""
    p = F.col("_p")
    base = user_turns(conv).select("conv_id", "turn", lowered(F.col("text")).alias("_p"))
    found = base.select("conv_id", "turn", F.regexp_extract(p, R.LIMIT_RE, 1).alias("_top"),
                        p.rlike(R.ASCENDING_RE).alias("ascending"), p.rlike(R.BY_REVENUE_RE).alias("by_revenue"),
                        p.rlike(R.OVERSTOCK_RE).alias("overstock"), p.rlike(factored(R.SLOW_RE)).alias("slow"),
                        F.regexp_extract(p, R.KPI_RE, 1).alias("_kpi"), F.regexp_extract(p, R.KPI_RE, 2).alias("_raw"))
    mult = F.lit(1.0)
    for pattern, m in reversed(R.KPI_SUFFIXES):
        mult = F.when(F.col("_raw").rlike(pattern), F.lit(m)).otherwise(mult)
    return found.select("conv_id", "turn", F.coalesce(F.col("_top").try_cast("bigint"), F.lit(R.DEFAULT_LIMIT)).alias("row_limit"),
                        "ascending", "by_revenue", "overstock", "slow", F.when(F.col("_kpi") != "", F.col("_kpi")).alias("kpi"),
                        (parse_number(F.col("_raw")) * mult).alias("kpi_value"))


def history(conv: DataFrame, bucket: int = 4096) -> DataFrame:
    """For every user turn, the turns the chat would send (last 12 before it)
    and the agent's (last 4 before it, then only user/assistant ones).

    Every turn gets its place in its conversation; places are cut into buckets of ``bucket`` rows, and the last 12 rows
    of a bucket are copied into the next one as a halo.  The windows then run per bucket: a conversation
    of any length and numbering is spread over tasks of counted size.  Turns with equal numbers go by role and text, turns
    without a number come first, turns without a conversation form one."""
    halo = max(R.CHAT_HISTORY, R.AGENT_HISTORY)
    if bucket <= halo:
        raise ValueError(f"a bucket must hold more than {halo} rows")
    rows = conv.select("conv_id", "turn", "role", F.xxhash64("text").alias("_text"))
    placed = positions(rows, "conv_id", ["turn", "role", "_text"], "_pos")
    home = F.expr(f"_pos div {bucket}")
    copies = F.when(F.col("_pos") % bucket >= bucket - halo, F.array(home, home + 1)).otherwise(F.array(home))
    cut_up = placed.withColumn("_bucket", F.explode(copies))
    o = Window.partitionBy("conv_id", "_bucket").orderBy("_pos")
    seen = cut_up.select(
        "conv_id", "turn", "role", "_pos", "_bucket",
        F.collect_list(F.col("turn").cast("string")).over(o.rowsBetween(-R.CHAT_HISTORY, -1)).alias("_chat"),
        F.collect_list(F.when(F.col("role").isin(*R.AGENT_ROLES), F.col("turn").cast("string")))
        .over(o.rowsBetween(-R.AGENT_HISTORY, -1)).alias("_agent"))
    return (seen.where((F.col("role") == "user") & (F.col("_bucket") == home))
            .select("conv_id", "turn", F.array_join("_chat", ",").alias("chat_turns"), F.array_join("_agent", ",").alias("agent_turns")))


def truncated(conv: DataFrame, limit: int = 500) -> DataFrame:
    """T11 over every turn."""
    return conv.select("conv_id", "turn", truncate(F.col("text"), limit).alias("text"),
                       (F.length("text") > limit).alias("was_truncated"))
