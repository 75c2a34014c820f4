"""Scaling: each fit is one aggregate over all columns, each transform one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frame import finite, need_numeric, number_sql, quote
from ..functions.projection import Projection
from ..functions.quantiles import exact_quantiles


def _linear(columns: list[str], centre: dict, spread: dict, lower: float = 0.0) -> Projection:
    """x -> (x - centre) / spread + lower, with the inverse kept in the facts."""
    replace = {}
    for c in columns:
        if centre[c] is None or spread[c] is None:
            continue
        replace[c] = f"(CAST({quote(c)} AS DOUBLE) - {number_sql(centre[c])}) / {number_sql(spread[c])} + {number_sql(lower)}"
    return Projection(replace=replace, facts={"centre": centre, "spread": spread, "lower": lower})


def inverse(fitted: Projection) -> Projection:
    """The reverse of a fitted linear scaling."""
    f = fitted.facts
    return Projection(replace={
        c: f"(CAST({quote(c)} AS DOUBLE) - {number_sql(f['lower'])}) * {number_sql(f['spread'][c])} + {number_sql(f['centre'][c])}"
        for c in fitted.replace})


def fit_minmax(df: DataFrame, columns: list[str], feature_range: tuple[float, float] = (0.0, 1.0)) -> Projection:
    need_numeric(df, columns)
    lo, hi = feature_range
    if not lo < hi:
        raise ValueError("feature_range must be increasing")
    row = df.agg(*[e for c in columns for e in (F.min(finite(df, c)).alias(f"{c}__lo"), F.max(finite(df, c)).alias(f"{c}__hi"))]).head()
    centre = {c: row[f"{c}__lo"] for c in columns}
    width = {c: None if row[f"{c}__lo"] is None else (row[f"{c}__hi"] - row[f"{c}__lo"]) or 1.0 for c in columns}
    return _linear(columns, centre, {c: None if w is None else w / (hi - lo) for c, w in width.items()}, lo)


def fit_zscore(df: DataFrame, columns: list[str], with_mean: bool = True, with_std: bool = True) -> Projection:
    """Population standard deviation; a zero deviation counts as 1."""
    need_numeric(df, columns)
    row = df.agg(*[e for c in columns for e in (F.avg(finite(df, c)).alias(f"{c}__m"), F.stddev_pop(finite(df, c)).alias(f"{c}__s"))]).head()
    centre = {c: row[f"{c}__m"] if with_mean else 0.0 for c in columns}
    spread = {c: (row[f"{c}__s"] or 1.0) if with_std else 1.0 for c in columns}
    return _linear(columns, centre, spread)


def fit_robust(df: DataFrame, columns: list[str], quantile_range: tuple[float, float] = (25.0, 75.0), with_centering: bool = True, with_scaling: bool = True) -> Projection:
    """Median and interquantile range, both exact; a zero range counts as 1."""
    need_numeric(df, columns)
    lo, hi = quantile_range
    q = exact_quantiles(df, columns, [lo / 100, 0.5, hi / 100])
    centre = {c: v[1] if with_centering else 0.0 for c, v in q.items()}
    spread = {c: None if v[0] is None else ((v[2] - v[0]) or 1.0) if with_scaling else 1.0 for c, v in q.items()}
    return _linear(columns, centre, spread)


def fit_mean_normalize(df: DataFrame, columns: list[str]) -> Projection:
    """(x - mean) / (max - min); a column without range stays as it is."""
    need_numeric(df, columns)
    row = df.agg(*[e for c in columns for e in (F.avg(finite(df, c)).alias(f"{c}__m"), (F.max(finite(df, c)) - F.min(finite(df, c))).alias(f"{c}__r"))]).head()
    moving = [c for c in columns if row[f"{c}__r"]]
    return _linear(moving, {c: row[f"{c}__m"] for c in moving}, {c: row[f"{c}__r"] for c in moving})


def minmax(df, columns, feature_range=(0.0, 1.0)):
    return fit_minmax(df, columns, feature_range).transform(df)


def zscore(df, columns, with_mean=True, with_std=True):
    return fit_zscore(df, columns, with_mean, with_std).transform(df)


def robust(df, columns, quantile_range=(25.0, 75.0), with_centering=True, with_scaling=True):
    return fit_robust(df, columns, quantile_range, with_centering, with_scaling).transform(df)


def mean_normalize(df, columns):
    return fit_mean_normalize(df, [columns] if isinstance(columns, str) else columns).transform(df)


def fit_scale_for_model(df: DataFrame, columns: list[str], mode: str = "standard") -> Projection:
    """Scaling of model inputs: ``standard``, ``robust`` or ``none``."""
    if mode == "none":
        return Projection()
    return {"standard": fit_zscore, "robust": fit_robust}[mode](df, columns)


def column_stats(df: DataFrame, columns: list[str], digits: int = 2) -> DataFrame:
    """(column, min, max, mean, std): sample deviation, rounded."""
    need_numeric(df, columns)
    parts = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
    wide = df.agg(*[f(finite(df, c)).alias(f"{i}_{p}") for i, c in enumerate(columns) for p, f in parts.items()])
    items = [F.struct(F.lit(c).alias("column"), *[F.round(F.col(f"{i}_{p}"), digits).alias(p) for p in parts]) for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*items)))


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max), as shown before and after scaling."""
    need_numeric(df, columns)
    quart = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[f(finite(df, c)).alias(f"{i}_{p}") for i, c in enumerate(columns) for p, f in parts.items()]).head()
    rows = [(c, row[f"{i}_count"], row[f"{i}_mean"], row[f"{i}_std"], row[f"{i}_min"], *quart[c], row[f"{i}_max"]) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double")
