"""Sinks and output shaping."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.roles import Roles


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN and ±Infinity in floating columns become null."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def write_records(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> str:
    """Write cleaned records (json lines or parquet)."""
    clean_doubles(df).write.mode(mode).format(fmt).save(path)
    return path


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return clean_doubles(df).select(F.to_json(F.struct(*df.columns)).alias("record"))


def chart_points(df: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """(x, y) points: x as text, y as double with unparsable/null -> 0.  An unknown
    x column falls back to the first column, an unknown y column to the first other."""
    cols = df.columns
    if not cols:
        raise ValueError("Query returned no columns")
    x = x_col if x_col in cols else cols[0]
    if y_col not in cols:
        others = [c for c in cols if c != x]
        y_col = others[0] if others else x
    return df.select(F.col(x).cast("string").alias("x"),
                     F.coalesce(F.col(y_col).try_cast("double"), F.lit(0.0)).alias("y"))


def chart_points_checked(df: DataFrame, x_col: str, y_col: str) -> DataFrame:
    """S8 with the empty-result error (one-row probe, not a full count)."""
    if df.isEmpty():
        raise ValueError("Query returned no rows")
    return chart_points(df, x_col, y_col)


def bundle_dir(roles: Roles, signature: str) -> str:
    """Folder of the answer bundle for one input version, under the shared checkpoint folder."""
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(roles.rental.sparkSession).rstrip('/')}/shelfline-bundle/{signature}"


def write_bundle(marts: dict[str, DataFrame], base: str) -> dict[str, str]:
    """Write cleaned marts under ``base``, a shared folder on a cluster; name -> path."""
    out = {}
    for name, df in marts.items():
        path = os.path.join(base, name)
        clean_doubles(df).write.mode("overwrite").parquet(path)
        out[name] = path
    return out
