"""Small helpers to write oracle SQL fragments the way the marts are specified."""

from __future__ import annotations

# Parameters used by the registered filtered variants (valid at every test scale).
TEST_STORE = 1
TEST_MONTH = "1998-10"


def sc(store, alias: str = "i") -> str:
    return f"AND {alias}.store_id = {int(store)}" if store is not None else ""


def mc(month, alias: str = "r") -> str:
    return f"AND strftime({alias}.rental_date, '%Y-%m') = '{month}'" if month is not None else ""


def money(expr: str) -> str:
    return f"CAST(ROUND({expr}, 2) AS DOUBLE)"


def store_lbl(expr: str = "i.store_id") -> str:
    return f"'Store ' || CAST({expr} AS VARCHAR)"
