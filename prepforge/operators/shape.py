"""Projection, filter and grouping steps."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frame import col, dtype_of, finite, is_integral, is_numeric, need_columns, quote

AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "count": F.count}


def drop_column(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        warnings.warn(f"column {column!r} not found; nothing dropped", stacklevel=2)
        return df
    return df.drop(col(column))


def compute(df: DataFrame, expr: str, new_column: str) -> DataFrame:
    """Add or overwrite a column with a Spark SQL expression; ``[name]`` stands for a column."""
    names = re.findall(r"\[([^\[\]]+)\]", expr)
    need_columns(df, names)
    text = re.sub(r"\[([^\[\]]+)\]", lambda m: quote(m.group(1)), expr)
    return df.withColumn(new_column, F.expr(text))


def log_transform(df: DataFrame, columns: list[str], eps: float = 1e-9) -> DataFrame:
    """ln(x + eps) in place; values at or below -eps give NULL."""
    need_columns(df, columns)
    return df.withColumns({c: F.expr(f"CASE WHEN {quote(c)} + {eps!r}D > 0 THEN ln({quote(c)} + {eps!r}D) END") for c in columns})


def filter_equals(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose column equals the value.  Whole numbers stay integers so the filter reaches the scan."""
    need_columns(df, [column])
    kind = dtype_of(df, column)
    if is_numeric(kind):
        number = float(value)
        value = int(number) if is_integral(kind) and number.is_integer() else number
    return df.where(col(column) == F.lit(value))


def group_aggregate(df: DataFrame, group_col: str, target_col: str, agg: str) -> DataFrame:
    """One value per group; rows without a group are left out; an all-NULL sum is 0."""
    need_columns(df, [group_col, target_col])
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; use one of {sorted(AGGREGATES)}")
    kind = df.schema[target_col].dataType
    # NaN and infinities count as missing
    source = finite(df, target_col).cast(kind) if isinstance(kind, (T.FloatType, T.DoubleType)) else col(target_col)
    value = AGGREGATES[agg](source)
    if agg == "sum":
        value = F.coalesce(value, F.lit(0))
    return df.where(col(group_col).isNotNull()).groupBy(col(group_col)).agg(value.alias(f"{agg}_{target_col}"))


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
