"""Filter context: optional store and month, the sentinel "All" meaning no predicate.

The month filter is always emitted as a half-open timestamp range
``ts >= first_day AND ts < first_day_of_next_month`` with literals typed like the
column, so it reaches the Parquet/JDBC scan as a pushed filter (the text form
``date_format(ts,'yyyy-MM') = m`` is not pushed by Catalyst).
"""

from __future__ import annotations

import datetime as _dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ALL = ("", "All", None)
_MONTH_RE = re.compile(r"^(\d{4})-(\d{2})$")


def month_bounds(month: str) -> tuple[str, str]:
    m = _MONTH_RE.match(month)
    if not m:
        raise ValueError(f"month must look like YYYY-MM, got {month!r}")
    y, mo = int(m.group(1)), int(m.group(2))
    start = _dt.date(y, mo, 1)
    end = _dt.date(y + (mo == 12), mo % 12 + 1, 1)
    return start.isoformat(), end.isoformat()


def typed_literal(df: DataFrame, column: str, value: str) -> Column:
    """A literal of the column's own type, so the comparison needs no cast on the column."""
    return F.lit(value).cast(df.schema[column].dataType)


def month_range(df: DataFrame, column: str, month: str) -> Column:
    start, end = month_bounds(month)
    c = df[column]
    return (c >= typed_literal(df, column, f"{start} 00:00:00")) & \
           (c < typed_literal(df, column, f"{end} 00:00:00"))


@dataclass(frozen=True)
class Filters:
    store: int | None = None
    month: str | None = None

    @classmethod
    def of(cls, store=None, month=None) -> "Filters":
        s = None if store in _ALL else int(store)
        m = None if month in _ALL else str(month)
        if m is not None:
            month_bounds(m)  # validate early
        return cls(s, m)

    def apply_store(self, df: DataFrame, column: str = "store_id") -> DataFrame:
        return df if self.store is None else df.where(df[column] == F.lit(self.store))

    def apply_month(self, df: DataFrame, column: str = "rental_date") -> DataFrame:
        if self.month is None:
            return df
        kept = df.where(month_range(df, column, self.month))
        if column == "rental_date" and "rental_month" in df.columns:  # a partition column: only this month's files are listed
            kept = kept.where(F.col("rental_month") == int(self.month.replace("-", "")))
        return kept

    def without_store(self) -> "Filters":
        return Filters(None, self.month)

    def without_month(self) -> "Filters":
        return Filters(self.store, None)


NO_FILTERS = Filters()
