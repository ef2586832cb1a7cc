"""Ad-hoc read-only SQL over registered role views.

Two guards.  ``check_select`` is the dashboard's word test (the statement must start with
SELECT; no blocked keyword as a whitespace-separated token; optionally no
``pg_``-prefixed token).  ``check_plan`` judges what Spark's own parser makes of the text: only query
operators, only the role views (and the statement's own WITH names) as relations, no files, tables, table functions,
streams or calls into the JVM, in subqueries too.  ``run_select`` applies both, or with ``words=False`` the plan alone, which
also admits leading comments, WITH and blocked words inside strings and names.

It returns the columns, the first ``max_rows`` rows as a DataFrame and the total row count.  The row cap is part of the
feature (a preview), the count runs over the whole result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from .roles import Roles

# Keywords that make a statement rejected.
BLOCKED = ["insert", "update", "delete", "drop", "alter", "create", "truncate", "grant", "revoke",
           "copy", "execute"]


class RejectedQuery(ValueError):
    pass


def check_select(sql: str, block_pg: bool = True) -> str:
    s = (sql or "").strip()
    if not s:
        raise RejectedQuery("Empty query")
    # the ad-hoc endpoint wants the first word to be SELECT, the direct-query one a prefix
    ok = s.lower().split()[0] == "select" if block_pg else s.lower().startswith("select")
    if not ok:
        raise RejectedQuery("Only SELECT queries are allowed.")
    for tok in s.lower().split():
        if tok in BLOCKED or (block_pg and tok.startswith("pg_")):
            raise RejectedQuery(f"Forbidden keyword: '{tok}'")
    return s


# Operators that a parsed query may consist of; a command, a write or anything unknown is none of them.
QUERY_NODES = frozenset("""Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Join LateralJoin Union Except Intersect Distinct
    SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedHaving UnresolvedInlineTable OneRowRelation UnresolvedRelation
    LocalRelation WithWindowDefinition Pivot Unpivot Generate UnresolvedHint Sample""".split())
# Functions that run code of the caller's choice.
BLOCKED_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect"})


def _seq(scala) -> Iterator:
    return (scala.apply(i) for i in range(scala.size()))


def _functions(expression) -> Iterator[str]:
    if expression.getClass().getSimpleName() == "UnresolvedFunction":
        yield ".".join(_seq(expression.nameParts())).lower()
    for child in _seq(expression.children()):
        yield from _functions(child)


def _check_node(node, known: frozenset[str]) -> None:
    kind = node.getClass().getSimpleName().rstrip("$")
    if kind not in QUERY_NODES:
        raise RejectedQuery(f"{kind} is not part of a query")
    if kind == "UnresolvedRelation":
        name = list(_seq(node.multipartIdentifier()))
        if len(name) != 1 or name[0].lower() not in known or node.isStreaming():
            raise RejectedQuery(f"Not a view of this schema: {'.'.join(name)}")
    if kind == "UnresolvedWith":  # a WITH name is known to later ones and to the query, or to all if recursive
        named = [(r._1(), r._2()) for r in _seq(node.cteRelations())]
        if node.allowRecursion():
            known |= {n.lower() for n, _ in named}
        for name, plan in named:
            _check_node(plan, known)
            known |= {name.lower()}
    for expression in _seq(node.expressions()):
        if found := BLOCKED_FUNCTIONS.intersection(f.rpartition(".")[2] for f in _functions(expression)):
            raise RejectedQuery(f"Forbidden function: {', '.join(sorted(found))}")
    for child in [*_seq(node.children()), *_seq(node.subqueries())]:
        _check_node(child, known)


def check_plan(spark: SparkSession, sql: str, views: Iterable[str] | None = None) -> str:
    """The statement if its parsed plan is a query over the given views (by default the role views) alone."""
    if not (sql or "").strip():
        raise RejectedQuery("Empty query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise RejectedQuery(f"Not a statement: {str(e).strip().splitlines()[0]}") from e
    _check_node(plan, frozenset(v.lower() for v in (Roles.__dataclass_fields__ if views is None else views)))
    return sql


@dataclass
class Result:
    columns: list
    rows: DataFrame
    total_rows: int


def register_views(roles: Roles) -> None:
    """Expose every role as a temporary view named after it."""
    for name in Roles.__dataclass_fields__:
        df = getattr(roles, name)
        if isinstance(df, DataFrame):
            df.createOrReplaceTempView(name)


def run_select(spark: SparkSession, sql: str, max_rows: int = 500, block_pg: bool = True,
               args: dict | None = None, count: bool = True, words: bool = True) -> Result:
    df = spark.sql(check_plan(spark, check_select(sql, block_pg) if words else sql), args=args)
    total = df.count() if count else -1
    return Result(columns=df.columns, rows=df.limit(max_rows), total_rows=total)


def run_batch(spark: SparkSession, queries: dict[str, str], max_rows: int = 30) -> dict:
    """Run labelled queries; one failure is reported and does not stop the rest."""
    out = {}
    for label, sql in queries.items():
        try:
            out[label] = run_select(spark, sql, max_rows=max_rows, block_pg=False, count=False)
        except Exception as e:  # noqa: BLE001 - the error is the result for this label
            out[label] = e
    return out
