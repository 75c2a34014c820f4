"""Column helpers, lineage cuts and size-checked lookups shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# A table is broadcast only when a count proved it has at most this many rows.
BROADCAST_ROWS = 200_000


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


def number_sql(value) -> str:
    """A double literal in Spark SQL text."""
    value = float(value)
    if value != value:
        return "CAST(NULL AS DOUBLE)"
    if value in (float("inf"), float("-inf")):
        return f"double('{'-' if value < 0 else ''}Infinity')"
    return f"({value!r}D)"


def string_sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value) if abs(value) < 2**31 else f"{value}L"
    if isinstance(value, float):
        return number_sql(value)
    return string_sql(str(value))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def columns_by_kind(df: DataFrame) -> dict[str, list[str]]:
    """Column names grouped as numeric, text, boolean, datetime and other."""
    kinds: dict[str, list[str]] = {k: [] for k in ("numeric", "text", "boolean", "datetime", "other")}
    for field in df.schema.fields:
        t = field.dataType
        if isinstance(t, T.NumericType):
            kinds["numeric"].append(field.name)
        elif isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
            kinds["text"].append(field.name)
        elif isinstance(t, T.BooleanType):
            kinds["boolean"].append(field.name)
        elif isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            kinds["datetime"].append(field.name)
        else:
            kinds["other"].append(field.name)
    return kinds


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_by_kind(df)["numeric"]


def need_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}; the table has {df.columns}")


def need_numeric(df: DataFrame, names) -> None:
    need_columns(df, names)
    bad = [n for n in names if not is_numeric(dtype_of(df, n))]
    if bad:
        raise ValueError(f"columns must be numeric: {bad}")


def finite(df: DataFrame, name: str) -> Column:
    """The column as double with NaN and infinities turned into NULL."""
    value = col(name).cast("double")
    if isinstance(dtype_of(df, name), (T.FloatType, T.DoubleType)):
        bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
        return F.when(~bad, value)
    return value


def finite_frame(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns c0, c1, ... as finite doubles, projected once so that many aggregates share them."""
    return df.select(*[finite(df, n).alias(f"c{i}") for i, n in enumerate(names)])


def finite_sql(df: DataFrame, name: str) -> str:
    c = f"CAST({quote(name)} AS DOUBLE)"
    if isinstance(dtype_of(df, name), (T.FloatType, T.DoubleType)):
        return f"IF(isnan({c}) OR abs({c}) = double('Infinity'), CAST(NULL AS DOUBLE), {c})"
    return c


def present_sql(df: DataFrame, name: str) -> str:
    """The column with NaN as NULL, in its own type."""
    return f"nanvl({quote(name)}, NULL)" if isinstance(dtype_of(df, name), (T.FloatType, T.DoubleType)) else quote(name)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every fractional column; one projection."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.when(F.abs(F.nanvl(col(n), F.lit(None).cast("double"))) < float("inf"), col(n)) for n in floats}) if floats else df


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the table once to the shared checkpoint folder and read it back.

    A reliable ``checkpoint()`` would compute the table twice, and the written table also tells the
    planner its size.  The folder is the one the session names in ``spark.checkpoint.dir``; only a
    local session without that setting gets a folder of its own.
    """
    path = settled_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        _local_folder = _local_folder or tempfile.mkdtemp(prefix="prepforge-checkpoint-")
        folder = _local_folder
    return f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"


_local_folder: str | None = None


def small_or_none(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when the table provably has at most ``limit`` rows (reads only limit + 1 rows)."""
    return df.limit(limit + 1).count() <= limit


def lookup(df: DataFrame, dictionary: DataFrame, key: str, heavy_share: float = 0.01) -> DataFrame:
    """Left join ``df`` with a dictionary that has one row per value of ``key``, which may be of any type.

    A dictionary proved small is broadcast.  A larger one is shuffled; values whose hash holds more
    than ``heavy_share`` of the rows (at most ``1 / heavy_share`` of them) go through a small
    broadcast instead, so that no task receives a hot value.
    """
    if small_or_none(dictionary):
        return df.join(F.broadcast(dictionary), key, "left")
    heavy = heavy_hashes(df, key, heavy_share)
    hashed = F.xxhash64(col(key))
    is_heavy = hashed.isin(heavy) if heavy else F.lit(False)
    loose = is_heavy | col(key).isNull()  # a missing key finds nothing and may be as frequent as any
    hot_words = dictionary.where(is_heavy)
    joined = df.where(loose).join(F.broadcast(hot_words), key, "left")
    return df.where(~loose).join(dictionary, key, "left").unionByName(joined)


def heavy_hashes(df: DataFrame, key: str, share: float = 0.01) -> list[int]:
    """Hashes of the values that hold more than ``share`` of the rows; at most ``1/share`` of them exist."""
    counts = df.where(col(key).isNotNull()).groupBy(F.xxhash64(col(key)).alias("h")).count()
    total = counts.agg(F.sum("count")).head()[0] or 0
    return [r[0] for r in counts.where(F.col("count") > max(1.0, share * total)).select("h").collect()]


def numbered(df: DataFrame, order: list[str], name: str, single_task_rows: int = 1_000_000) -> DataFrame:
    """Add ``name`` = 0-based position in the order of the unique columns ``order``.

    Small inputs use one window.  Larger ones are range partitioned, numbered inside each range
    and shifted by the row counts of the earlier ranges, so no task sorts the whole table.
    """
    keys = [col(o) for o in order]
    if small_or_none(df, single_task_rows):
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("bigint"))
    ranged = settle(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").count()
    before = sizes.select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return (ranged.join(F.broadcast(before), "__range")
            .withColumn(name, (local + F.col("__before")).cast("bigint")).drop("__range", "__before"))


def cumulative(df: DataFrame, order: str, sums: list[str], descending: bool = False, single_task_rows: int = 1_000_000) -> DataFrame:
    """Running sums ``run_<name>`` in the order of a unique column, by ranges when the input is large."""
    key = col(order).desc() if descending else col(order).asc()
    if small_or_none(df, single_task_rows):
        w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({f"run_{s}": F.sum(col(s)).over(w) for s in sums})
    ranged = settle(df.repartitionByRange(key).withColumn("__range", F.spark_partition_id()))
    w0 = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*[F.sum(col(s)).alias(s) for s in sums])
    before = totals.select("__range", *[F.coalesce(F.sum(col(s)).over(w0), F.lit(0)).alias(f"__b_{s}") for s in sums])
    w1 = Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "__range")
    out = out.withColumns({f"run_{s}": F.sum(col(s)).over(w1) + F.col(f"__b_{s}") for s in sums})
    return out.drop("__range", *[f"__b_{s}" for s in sums])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; ``+ 0`` turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(col(f.name), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else col(f.name)
        for f in df.schema.fields
    ])


def long_rows(df: DataFrame, pairs: list[tuple[str, Column]], key: str = "column", value: str = "value") -> DataFrame:
    """Turn named expressions of each row into (key, value) rows."""
    items = F.array(*[F.struct(F.lit(n).alias(key), e.alias(value)) for n, e in pairs])
    return df.select(F.explode(items).alias("__item")).select(f"__item.{key}", f"__item.{value}")


def facts_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A result table from fitted scalars (one row per column or class, never per data row)."""
    return spark.createDataFrame(rows, schema)
