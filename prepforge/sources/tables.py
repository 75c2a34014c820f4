"""Table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.frame import col, nan_to_null


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """Read a CSV (header, inferred or given types) or Parquet table; NaN and infinities become NULL."""
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt == "parquet":
        return nan_to_null(spark.read.parquet(path))
    if fmt == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return nan_to_null(reader.csv(path))
    raise ValueError(f"unsupported table format: {fmt}")


def preview(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """The first n rows in the order of ``order_by``."""
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> DataFrame:
    """Write a Parquet table and return it read back, which also cuts the lineage."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)
