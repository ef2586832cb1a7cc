"""Registered conversation text jobs (T1-T11) with DuckDB oracles.

The oracle evaluates the same rule values with DuckDB's RE2 engine; agreement
shows the Spark (Java regex) expressions implement the intended semantics.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..oracle import with_roles
from ..registry import register
from ..text import entities as en
from ..text import rules as R
from ..text import tagging as tg

P = "lower(text)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rx(pattern: str) -> str:
    return f"regexp_matches({P}, {_q(pattern)})"


def _on_topic() -> str:
    vocab = ", ".join(_q(w) for w in dict.fromkeys(R.TOPIC_VOCAB))
    return f"list_has_any(regexp_split_to_array({P}, {_q(tg.PY_SPACE)}), [{vocab}])"


def _edit() -> str:
    return _rx(tg.words_re(R.EDIT_WORDS, tg.UNICODE_WORD))


def _topics() -> str:
    items = ", ".join(f"CASE WHEN {_rx(pat)} THEN {_q(label)} END" for pat, label in R.TOPIC_TAGS)
    lst = f"list_filter([{items}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({lst}) > 0 THEN array_to_string({lst}, '|') ELSE {_q(R.DEFAULT_TAG)} END"


def _dash() -> str:
    return _rx(tg.words_re(R.DASHBOARD_WORDS))


def _answer() -> str:
    parts = []
    for key, phrases in R.ANSWER_RULES:
        if key not in R.CACHED_ANSWERS:
            continue
        cond = " OR ".join(f"contains(trim({P}), {_q(ph)})" for ph in phrases)
        parts.append(f"WHEN {cond} THEN {_q(key)}")
    return "CASE " + " ".join(parts) + " END"


def _first(items) -> str:
    return "CASE " + " ".join(f"WHEN {_rx(tg.boundaries(pat))} THEN {_q(name)}" for name, pat in items) + " END"


def _branch() -> str:
    return f"CASE WHEN {_rx(tg.boundaries(R.QUERY_VERB_RE))} THEN {_first(R.QUERY_BRANCHES)} END"


def _route() -> str:
    instant = f"(({_answer()}) IS NOT NULL OR regexp_matches(trim({P}), {_q(tg.boundaries(R.FORECAST_NAV_RE))}))"
    chart = (f"({_rx(tg.boundaries(R.CHART_VERB_RE))} AND {_rx(tg.boundaries(R.CHART_NOUN_RE))} "
             f"AND ({_first(R.CHART_DIMENSIONS)}) IS NOT NULL)")
    return (f"CASE WHEN {_rx(tg.boundaries(R.REVERT_RE))} THEN 'revert' WHEN {instant} THEN 'instant' "
            f"WHEN {chart} THEN 'chart' WHEN ({_branch()}) IS NOT NULL THEN 'direct_query' "
            f"WHEN NOT {_dash()} THEN 'off_topic' ELSE 'agent' END")


USER = "FROM conversations WHERE role = 'user'"


@register("text_intents", f"""
SELECT conv_id, turn, {_on_topic()} AS on_topic, {_edit()} AS edit_intent, {_topics()} AS topics,
       {_dash()} AS dashboard_keyword, {_answer()} AS answer_key, {_route()} AS route
{USER}""")
def q_text_intents(roles):
    return tg.intents(roles.conversations)


@register("text_topic_counts", f"""
SELECT topic, COUNT(*) AS turns
FROM (SELECT unnest(string_split({_topics()}, '|')) AS topic {USER}) t GROUP BY topic""")
def q_text_topics(roles):
    return tg.topic_counts(roles.conversations)


@register("text_route_counts", f"SELECT {_route()} AS route, COUNT(*) AS turns {USER} GROUP BY 1")
def q_text_routes(roles):
    return tg.route_counts(roles.conversations)


def _num(pattern: str) -> str:
    g1 = f"regexp_extract({P}, {_q(pattern)}, 1)"
    g2 = f"regexp_extract({P}, {_q(pattern)}, 2)"
    lead = f"regexp_extract(replace({g1}, ',', ''), '^([0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)', 1)"
    num = f"CASE WHEN {lead} <> '' THEN CAST({lead} AS DOUBLE) END"
    mult = "CASE " + " ".join(f"WHEN {g2} = {_q(s)} THEN {m}" for s, m in R.AMOUNT_SUFFIXES) + " ELSE 1.0 END"
    v = f"({num}) * ({mult})"
    return f"CASE WHEN regexp_matches({P}, {_q(pattern)}) AND {v} <> 0 THEN {v} END"


def _thresholds() -> list[str]:
    fields: dict[str, list[str]] = {}
    for name, br, pat in R.THRESHOLDS:
        v = _num(pat)
        alt = R.THRESHOLDS_ELSE.get((name, br))
        if alt:
            v = f"COALESCE({v}, {_num(alt)})"
        fields.setdefault(name, []).append(f"CASE WHEN b = {_q(br)} THEN {v} END")
    return [f"COALESCE({', '.join(v)}) AS {k}" if len(v) > 1 else f"{v[0]} AS {k}" for k, v in fields.items()]


def _contained(entries, boundary=False) -> str:
    if boundary:
        import re
        return "CASE " + " ".join(f"WHEN {_rx(tg.words_re([re.escape(e)]))} THEN {_q(e)}" for e in entries) + " END"
    return "CASE " + " ".join(f"WHEN contains({P}, {_q(e)}) THEN {_q(e)}" for e in entries) + " END"


@register("text_parameters", f"""
SELECT conv_id, turn, b AS branch, {', '.join(_thresholds())},
       {_contained(R.COUNTRIES)} AS country, {_contained(R.CATEGORIES)} AS category,
       upper({_contained(R.RATINGS, True)}) AS rating
FROM (SELECT *, {_branch()} AS b {USER}) t""")
def q_text_parameters(roles):
    return tg.parameters(roles.conversations)


@register("text_history", f"""
SELECT conv_id, turn, chat_turns, agent_turns FROM (
  SELECT conv_id, turn, role,
         COALESCE(array_to_string(list(CAST(turn AS VARCHAR)) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN {R.CHAT_HISTORY} PRECEDING AND 1 PRECEDING), ','), '') AS chat_turns,
         COALESCE(array_to_string(list_transform(list_filter(
                  list({{'turn': turn, 'role': role}}) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN {R.AGENT_HISTORY} PRECEDING AND 1 PRECEDING),
                  lambda x: x.role IN ('user', 'assistant')), lambda x: CAST(x.turn AS VARCHAR)), ','), '') AS agent_turns
  FROM conversations) t
WHERE role = 'user'""")
def q_text_history(roles):
    return tg.history(roles.conversations)


@register("text_truncated", """
SELECT conv_id, turn,
       CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || chr(10) || '...[truncated '
            || CAST(length(text) AS VARCHAR) || ' chars]' ELSE text END AS text,
       length(text) > 500 AS was_truncated
FROM conversations""")
def q_text_truncated(roles):
    return tg.truncated(roles.conversations, 500)


_KPI_NUM = "regexp_extract(replace(raw, ',', ''), '^([0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)', 1)"


@register("text_commands", f"""
SELECT conv_id, turn, COALESCE(TRY_CAST(top AS BIGINT), {R.DEFAULT_LIMIT}) AS row_limit, ascending, by_revenue, overstock, slow,
       NULLIF(kpi, '') AS kpi,
       CASE WHEN {_KPI_NUM} <> '' THEN CAST({_KPI_NUM} AS DOUBLE) * CASE {' '.join(
           f"WHEN regexp_matches(raw, {_q(rx)}) THEN {m}" for rx, m in R.KPI_SUFFIXES)} ELSE 1.0 END END AS kpi_value
FROM (SELECT conv_id, turn, regexp_extract({P}, {_q(R.LIMIT_RE)}, 1) AS top, {_rx(R.ASCENDING_RE)} AS ascending,
             {_rx(R.BY_REVENUE_RE)} AS by_revenue, {_rx(R.OVERSTOCK_RE)} AS overstock, {_rx(tg.boundaries(R.SLOW_RE))} AS slow,
             regexp_extract({P}, {_q(R.KPI_RE)}, 1) AS kpi, regexp_extract({P}, {_q(R.KPI_RE)}, 2) AS raw {USER}) t""")
def q_text_commands(roles):
    return tg.commands(roles.conversations)


def _entities_sql(texts: str, ids: str) -> str:
    """The first name of each kind by a containment test of every name in every text."""
    plain = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    picks = ", ".join(f"MAX(CASE WHEN kind = '{k}' AND k = 1 THEN name END) AS {k}" for k in en.KINDS)
    return with_roles(f"""
, raw AS (SELECT DISTINCT 'country' AS kind, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
          UNION SELECT 'category', name FROM category UNION SELECT 'title', title FROM film),
keyed AS (SELECT kind, MIN(name) AS name, key FROM (SELECT kind, name, {plain.format('name')} AS key FROM raw) k WHERE key <> '' GROUP BY kind, key),
texts AS (SELECT {ids}, ' ' || {plain.format('text')} || ' ' AS w FROM ({texts}) q),
hits AS (SELECT {ids}, kind, name, row_number() OVER (PARTITION BY {ids}, kind
                ORDER BY instr(w, ' ' || key || ' '), length(key) DESC, name) AS k
         FROM texts JOIN keyed ON contains(w, ' ' || key || ' '))
SELECT {ids}, {picks} FROM hits GROUP BY {ids}""")


@register("text_catalogue_entities", _entities_sql("SELECT * FROM conversations WHERE role = 'user'", "conv_id, turn"))
def q_catalogue_entities(roles):
    """First country, category and title of the catalogue that each user turn names."""
    return en.catalogue_entities(roles)


@register("title_entities", _entities_sql("SELECT film_id, title AS text FROM film", "film_id"))
def q_title_entities(roles):
    """T8 over the catalogue's own texts: the country, category and title that each title names."""
    hits = en.spotted(roles.film.select("film_id", F.col("title").alias("text")), en.names(roles), ["film_id"])
    return hits.groupBy("film_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("name"))).alias(k) for k in en.KINDS))
