"""Exact money arithmetic.

Amounts stay DECIMAL from input to aggregate; rounding happens once, at output.
Rounding a double per row and summing gives engine-dependent cents, summing
exact decimals does not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_out(c: Column | str, scale: int = 2) -> Column:
    """ROUND(exact, 2) then DOUBLE: the published form of every money column."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, scale).cast("double")


def zero_if_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(0))


def safe_ratio(num: Column, den: Column, scale: int = 2) -> Column:
    """ROUND(num / NULLIF(den, 0), scale): null, never an error, on a zero denominator."""
    return F.round(F.try_divide(num, den), scale)


def guarded_ratio(num: Column, den: Column, scale: int = 2) -> Column:
    """Client-side ratio with a zero guard: 0 when the denominator is not positive."""
    return F.when(den > 0, F.round(num / den, scale)).otherwise(F.lit(0))


def py_round(c, digits: int):
    """Half-even rounding of a double through its 9-decimal value, as a double.

    Matches Python's ``round`` except where a value sits within 1e-9 of a tie,
    where float noise would otherwise decide; both engines then agree.
    Non-finite values become null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.bround(c.try_cast("decimal(38,9)"), digits).cast("double")
