"""Queries and the SQL that checks them, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import FIXTURES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t) -> DataFrame`` where ``t(table_name)`` reads a driver or derived table."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda n: table(spark, sf_dir, n))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def fx(name: str) -> str:
    """A derived table as a subquery."""
    return f"({FIXTURES[name]})"


def r(expr: str, digits: int = 6) -> str:
    """Rounded, without negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def q(column: str, p: float) -> str:
    return f"quantile_cont({column}, {p})"


def each(columns: list[str], select: str, source: str, key: str = "column") -> str:
    """UNION ALL of one SELECT per column; ``{c}`` is the column name."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"{key}\", {select.format(c=c)} FROM {source}" for c in columns)
