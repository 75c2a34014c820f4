"""Tables behind the charts; drawing is left to the caller."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.frame import col, columns_by_kind, facts_frame, finite, lookup, need_columns, need_numeric, numeric_columns, quote, settle
from ..functions.quantiles import exact_quantiles_by
from .clean import null_summary
from .stats import pair_correlations


def keyed_sample(df: DataFrame, key: list[str], points: int | None) -> DataFrame:
    """All rows, or the ``points`` rows with the smallest hash of their key (a top-k, no sort)."""
    if points is None:
        return df
    return df.orderBy(F.md5(F.concat_ws("|", *[col(k).cast("string") for k in key]))).limit(points)


def point_data(df: DataFrame, columns: list[str], key: list[str] | None = None, points: int | None = None) -> DataFrame:
    """Scatter (2-D, 3-D, colour, size) and parallel-coordinate data."""
    need_columns(df, columns)
    sampled = keyed_sample(df, key, points) if points is not None else df
    return sampled.select(*[col(c) for c in dict.fromkeys(columns)])


def scatter_data(df, x, y, color=None, size=None, z=None, key=None, points=None):
    return point_data(df, [c for c in (x, y, z, color, size) if c], key, points)


def parallel_coordinates_data(df, dimensions, color=None, key=None, points=None):
    return point_data(df, [*dimensions, *([color] if color else [])], key, points)


def line_data(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    cols = [c for c in (color, x, y) if c]
    need_columns(df, cols)
    return df.select(*[col(c) for c in cols]).orderBy(*[col(c) for c in cols])


def bar_data(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Height of each stacked bar part."""
    need_numeric(df, [y])
    keys = [c for c in (x, color) if c]
    return df.groupBy(*[col(c) for c in keys]).agg(F.sum(finite(df, y)).alias("height"))


def bin_of(x, lo: float, width: float, bins: int):
    return F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """([by,] bin, lower, upper, count) for equal-width bins between minimum and maximum."""
    need_numeric(df, [column])
    if not 1 <= bins <= 1000:
        raise ValueError("bins must lie between 1 and 1000")
    x = finite(df, column)
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).head()
    shape = "bin int, lower double, upper double, count bigint"
    if row["lo"] is None:
        return df.sparkSession.createDataFrame([], (f"{quote(by)} {df.schema[by].dataType.simpleString()}, " if by else "") + shape)
    width = (row["hi"] - row["lo"]) / bins or 1.0
    keys = ([col(by)] if by else []) + [bin_of(x, row["lo"], width, bins).alias("bin")]
    counts = df.where(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    edges = [(F.lit(row["lo"]) + F.col("bin") * F.lit(width)).alias("lower"), (F.lit(row["lo"]) + (F.col("bin") + 1) * F.lit(width)).alias("upper")]
    return counts.select(*([col(by)] if by else []), "bin", *edges, "count")


def box_data(df: DataFrame, column: str, by: str) -> DataFrame:
    """(by, q1, median, q3, low, high, n): whiskers end at the last value inside the fences."""
    need_numeric(df, [column])
    q = exact_quantiles_by(df, by, column, [0.25, 0.5, 0.75])
    box = q.select(col(by), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    x = finite(df, column)
    rows = lookup(df.where(x.isNotNull() & col(by).isNotNull()).select(col(by), x.alias("__x")), settle(box), by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("__x") >= F.col("q1") - reach) & (F.col("__x") <= F.col("q3") + reach)
    return rows.groupBy(col(by), "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("__x"))).alias("low"), F.max(F.when(inside, F.col("__x"))).alias("high"), F.count(F.lit(1)).alias("n"))


def pie_data(df: DataFrame, names: str, values: str | None = None) -> DataFrame:
    """(names, value, share): row count, or the sum of ``values``; shares of a zero total are NULL."""
    value = F.count(F.lit(1)).cast("double") if values is None else F.sum(finite(df, values))
    parts = df.groupBy(col(names)).agg(value.alias("value"))
    total = parts.agg(F.sum("value").alias("__total"))
    return parts.crossJoin(F.broadcast(total)).select(col(names), "value", F.try_divide("value", "__total").alias("share"))


def heatmap_pivot(df: DataFrame, x: str, y: str, z: str, wide: bool = False, max_columns: int = 1000) -> DataFrame:
    """Mean of z per (y, x) in long form, or with one column per x."""
    need_numeric(df, [z])
    cells = df.groupBy(col(y), col(x)).agg(F.avg(finite(df, z)).alias("mean"))
    if not wide:
        return cells
    heads = [r[0] for r in cells.select(col(x)).distinct().limit(max_columns + 1).collect()]
    if len(heads) > max_columns:
        raise ValueError(f"{x} has more than {max_columns} values; use the long form")
    return cells.groupBy(col(y)).pivot(x, sorted(h for h in heads if h is not None)).agg(F.first("mean"))


def missing_chart(df: DataFrame) -> DataFrame:
    return null_summary(df).where("null_count > 0").select("column", "null_pct").orderBy("null_pct", "column")


def target_distribution_chart(df: DataFrame, target: str, task: str, bins: int = 30) -> DataFrame:
    if task == "regression":
        return histogram(df, target, bins)
    return df.groupBy(col(target)).agg(F.count(F.lit(1)).alias("count"))


def top_correlations(df: DataFrame, columns: list[str] | None = None, target: str | None = None, n: int = 10) -> DataFrame:
    """The n strongest |r|: with the target, or over all pairs."""
    columns = columns or numeric_columns(df)
    if target:
        names = [c for c in columns if c != target]
        t = finite(df, target)
        row = df.agg(*[F.corr(finite(df, c), t).alias(f"p{i}") for i, c in enumerate(names)]).head()
        pairs = {(c, target): row[f"p{i}"] for i, c in enumerate(names)}
    else:
        pairs = pair_correlations(df, columns)
    known = [(a, b, r) for (a, b), r in pairs.items() if r is not None and not math.isnan(r)]
    best = sorted(known, key=lambda p: (-abs(p[2]), p[0], p[1]))[:n]
    return facts_frame(df.sparkSession, best, "x string, y string, r double")


def spread_table(df: DataFrame, columns: list[str], relative: bool) -> list[tuple[str, float]]:
    row = df.agg(*[e for i, c in enumerate(columns) for e in (F.stddev_samp(finite(df, c)).alias(f"s{i}"), F.avg(finite(df, c)).alias(f"m{i}"))]).head()
    out = []
    for i, c in enumerate(columns):
        s, m = row[f"s{i}"], row[f"m{i}"]
        if s is not None:
            out.append((c, s / abs(m) if relative and abs(m) > 1e-9 else s))
    return sorted(out, key=lambda p: (-p[1], p[0]))


def feature_spread(df: DataFrame, columns: list[str] | None = None, n: int = 20) -> DataFrame:
    """Coefficient of variation, or the deviation itself when the mean is about 0; the n largest."""
    return facts_frame(df.sparkSession, spread_table(df, columns or numeric_columns(df), True)[:n], "column string, spread double")


def pair_plot_data(df: DataFrame, columns: list[str] | None = None, max_features: int = 5, key: list[str] | None = None, points: int | None = None) -> DataFrame:
    """The columns with the largest deviation, complete rows only."""
    best = [c for c, _ in spread_table(df, columns or numeric_columns(df), False)[:max_features]]
    return point_data(df.dropna(subset=best), best + list(key or []), key, points).select(*[col(c) for c in best])


def categorical_frequencies(df: DataFrame, columns: list[str] | None = None, max_cols: int | None = None, top: int | None = 15) -> DataFrame:
    """(column, value, count): the ``top`` values of the text columns with 2 to 30 distinct values; ``max_cols`` and ``top`` are limits the caller sets (None: all)."""
    columns = columns or columns_by_kind(df)["text"]
    distinct = df.agg(*[F.count_distinct(col(c)).alias(c) for c in columns]).head()
    chosen = [c for c in columns if 2 <= distinct[c] <= 30][:max_cols]
    if not chosen:
        return df.sparkSession.createDataFrame([], "column string, value string, count bigint")
    items = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in chosen])
    counts = df.select(F.inline(items)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.col("count").desc(), "value"))  # at most 30 rows each
    return counts if top is None else counts.withColumn("__r", rank).where(F.col("__r") <= top).drop("__r")


def density_by_group(df: DataFrame, value: str, group: str | None = None, points: int = 200, fine_bins: int = 2000) -> DataFrame:
    """([group,] x, density): Gaussian kernel density on a grid of ``points``.

    The kernel runs over counts in ``fine_bins`` bins, not over rows, so the work after one count is
    bins x points per group: an approximation with an error of the bin width.  The bandwidth is
    n^(-1/5) times the sample deviation of the group.
    """
    need_numeric(df, [value])
    x = finite(df, value)
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).head()
    key = col(group) if group else F.lit(1)
    lo, hi = row["lo"], row["hi"]
    width = (hi - lo) / fine_bins or 1.0
    rows = df.where(x.isNotNull() & key.isNotNull()).select(key.alias("g"), x.alias("v"), bin_of(x, lo, width, fine_bins).alias("b"))
    bins = rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("c"), F.avg("v").alias("centre"))
    scale = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("s"))
    h = F.col("s") * F.pow(F.col("n"), F.lit(-0.2))
    step = (hi - lo) / (points - 1)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(lo) + i * F.lit(step))).alias("x")
    terms = bins.join(scale, "g").where("s > 0").select("g", "c", "n", h.alias("h"), "centre", grid)
    kernel = F.col("c") * F.exp(-0.5 * F.pow((F.col("x") - F.col("centre")) / F.col("h"), F.lit(2))) / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    out = terms.select("g", "x", kernel.alias("d")).groupBy("g", "x").agg(F.sum("d").alias("density"))
    return out.withColumnRenamed("g", group) if group else out.drop("g")
