"""Descriptive statistics, correlation and tests: aggregates over the table, scalars at the end."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_quantile, t_two_sided
from ..functions.frame import col, facts_frame, finite, finite_frame, need_columns, need_numeric, numeric_columns
from ..functions.quantiles import exact_quantiles
from .clean import value_modes

PAIRS_PER_JOB = 100
WIDE_COLUMNS = 12


def sample_skew(g1, n):
    """Sample skewness from the population moment."""
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurt(g2, n):
    """Sample excess kurtosis from the population moment."""
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def moment_table(df: DataFrame, columns: list[str]) -> list[dict]:
    """Count, mean, deviation, variance, sample skewness and kurtosis per column, in one job."""
    parts = []
    for i in range(len(columns)):
        x = F.col(f"c{i}")
        n = F.count(x).cast("double")
        parts += [F.count(x).alias(f"{i}_n"), F.avg(x).alias(f"{i}_mean"), F.stddev_samp(x).alias(f"{i}_std"), F.var_samp(x).alias(f"{i}_var"),
                  sample_skew(F.skewness(x), n).alias(f"{i}_skew"), sample_kurt(F.kurtosis(x), n).alias(f"{i}_kurt")]
    row = finite_frame(df, columns).agg(*parts).head()
    return [{k: row[f"{i}_{k}"] for k in ("n", "mean", "std", "var", "skew", "kurt")} for i in range(len(columns))]


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, mean, median, std, var, skew, kurt, mode)."""
    columns = columns or numeric_columns(df)
    need_numeric(df, columns)
    medians = exact_quantiles(df, columns, [0.5])
    modes = value_modes(df, columns)
    rows = []
    for c, m in zip(columns, moment_table(df, columns)):
        mode = modes[c]
        rows.append((c, m["mean"], medians[c][0], m["std"], m["var"], m["skew"], m["kurt"], None if mode is None else float(mode)))
    return facts_frame(df.sparkSession, rows, "column string, mean double, median double, std double, var double, skew double, kurt double, mode double")


def pair_correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float | None]:
    """Pearson r of every column pair on the rows complete for that pair.

    Columns without gaps: one pass for the means, one for sums of products around them, or with many columns one Gram
    pass over vectors, which needs no aggregate function per pair.  Others: an aggregate function per pair.
    """
    need_numeric(df, columns)
    pairs = list(combinations(range(len(columns)), 2))
    data = finite_frame(df, columns)
    out = {}
    moments = data.agg(F.count(F.lit(1)).alias("n"), *[e for c in data.columns for e in (F.count(c).alias(c), F.avg(c).alias(f"m{c}"), F.min(c).alias(f"l{c}"), F.max(c).alias(f"h{c}"))]).head()
    if moments["n"] > 1 and all(moments[c] == moments["n"] and moments[f"l{c}"] < moments[f"h{c}"] for c in data.columns):
        if len(columns) > WIDE_COLUMNS:
            vectors = VectorAssembler(inputCols=data.columns, outputCol="v").transform(data).select("v")
            m = Correlation.corr(vectors, "v").head()[0].toArray()
            return {(columns[i], columns[j]): float(m[i, j]) for i, j in pairs}
        near = data.select(*[(F.col(c) - F.lit(moments[f"m{c}"])).alias(c) for c in data.columns])
        places = range(len(columns))
        row = near.agg(*[F.sum(f"c{i}").alias(f"s{i}") for i in places], *[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i, j in [*pairs, *zip(places, places)]]).head()
        around = lambda i, j: row[f"p{i}_{j}"] - row[f"s{i}"] * row[f"s{j}"] / moments["n"]  # noqa: E731  the means are rounded
        if all(0 < 1e-3 * row[f"p{i}_{i}"] < around(i, i) < float("inf") for i in places):
            size = [around(i, i) ** 0.5 for i in places]
            return {(columns[i], columns[j]): max(-1.0, min(1.0, around(i, j) / size[i] / size[j])) for i, j in pairs}
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        part = pairs[start:start + PAIRS_PER_JOB]
        row = data.agg(*[F.corr(f"c{i}", f"c{j}").alias(f"p{n}") for n, (i, j) in enumerate(part)]).head()
        for n, (i, j) in enumerate(part):
            r = row[f"p{n}"]
            out[columns[i], columns[j]] = None if r is None or r != r else r
    return out


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long form (x, y, r) with both orders and the diagonal."""
    columns = columns or numeric_columns(df)
    pairs = pair_correlations(df, columns)
    spread = df.agg(*[F.var_samp(finite(df, c)).alias(f"v{i}") for i, c in enumerate(columns)]).head()
    rows = [(c, c, 1.0 if spread[f"v{i}"] else None) for i, c in enumerate(columns)]
    for (a, b), r in pairs.items():
        rows += [(a, b, r), (b, a, r)]
    return facts_frame(df.sparkSession, rows, "x string, y string, r double")


def t_test_two_sample(df: DataFrame, group_col: str, value_col: str, alpha: float = 0.05) -> DataFrame:
    """Welch's test for exactly two groups; group 1 is the smaller value."""
    need_numeric(df, [value_col])
    need_columns(df, [group_col])
    x = finite(df, value_col)
    groups = (df.where(col(group_col).isNotNull()).groupBy(col(group_col).alias("g"))
              .agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")).orderBy("g").limit(3).collect())
    if len(groups) != 2:
        raise ValueError(f"{group_col} must have exactly two groups")
    a, b = groups
    if a["n"] < 2 or b["n"] < 2:
        raise ValueError("each group needs two values")
    ea, eb = a["v"] / a["n"], b["v"] / b["n"]
    t = (a["m"] - b["m"]) / (ea + eb) ** 0.5
    dof = (ea + eb) ** 2 / (ea**2 / (a["n"] - 1) + eb**2 / (b["n"] - 1))
    p = t_two_sided(t, dof)
    row = (str(a["g"]), str(b["g"]), a["n"], b["n"], a["m"], b["m"], t, dof, p, p < alpha)
    return facts_frame(df.sparkSession, [row], "group_1 string, group_2 string, n_1 bigint, n_2 bigint, mean_1 double, mean_2 double, t double, dof double, p_value double, significant boolean")


def confidence_interval(df: DataFrame, column: str, level: float = 95) -> DataFrame:
    """t interval for the mean."""
    need_numeric(df, [column])
    x = finite(df, column)
    r = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).head()
    if r["n"] < 2:
        raise ValueError("two values are needed")
    error = r["s"] / r["n"] ** 0.5
    margin = t_quantile(0.5 + level / 200, r["n"] - 1) * error
    return facts_frame(df.sparkSession, [(column, r["n"], r["m"], error, margin, r["m"] - margin, r["m"] + margin)],
                       "column string, n bigint, mean double, std_error double, margin double, lower double, upper double")


def correlation_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n, r, strength, direction) on the complete rows."""
    need_numeric(df, [x, y])
    a, b = finite(df, x), finite(df, y)
    r = F.corr(a, b)
    size = F.abs(F.col("r"))
    strength = F.when(size >= 0.8, "very strong").when(size >= 0.6, "strong").when(size >= 0.3, "moderate").otherwise("weak")
    direction = F.when(size < 0.05, "none").when(F.col("r") > 0, "positive").otherwise("negative")
    base = df.agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("n"), r.alias("r"))
    return base.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "n", "r", strength.alias("strength"), direction.alias("direction"))


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    need_numeric(df, [x, y])
    a, b = finite(df, x), finite(df, y)
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def feature_target_correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, r), the strongest first."""
    need_numeric(df, [*features, target])
    t = finite(df, target)
    wide = df.agg(*[F.corr(finite(df, f), t).alias(f"r{i}") for i, f in enumerate(features)])
    items = [F.struct(F.lit(f).alias("feature"), F.col(f"r{i}").alias("r")) for i, f in enumerate(features)]
    return wide.select(F.inline(F.array(*items))).orderBy(F.abs("r").desc_nulls_last(), "feature")
