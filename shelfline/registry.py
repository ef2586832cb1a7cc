"""Registry of named queries: Spark plan + DuckDB oracle SQL.

Each entry is ``name -> (fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
A ``None`` oracle marks a query that SQL cannot express (model fits, iterative
solvers); those get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.testdata import load_roles

QueryFn = Callable[[SparkSession, str], DataFrame]

_ENTRIES: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, oracle: str | None):
    """Decorator for ``fn(roles) -> DataFrame``; roles are loaded from sf_dir."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(load_roles(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in _ENTRIES:
            raise ValueError(f"duplicate query name {name}")
        _ENTRIES[name] = (run, oracle)
        return fn
    return deco


def _load_all() -> None:
    # Importing the catalogue modules fills _ENTRIES.
    from . import catalogue  # noqa: F401


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in _ENTRIES.items() if v[1] is not None}
