"""Feature selection."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frame import col, dtype_of, facts_frame, finite, is_numeric, need_columns, need_numeric, numeric_columns, settle
from ..functions.quantiles import exact_quantiles
from .encode import fit_label_encode
from .stats import pair_correlations


def infer_task(df: DataFrame, target: str | None) -> str:
    """No target: unsupervised; text or at most 20 distinct values: classification; else regression."""
    if not target or target not in df.columns:
        return "unsupervised"
    if not is_numeric(dtype_of(df, target)):
        return "classification"
    few = df.select(col(target)).where(col(target).isNotNull()).distinct().limit(21).count() <= 20
    return "classification" if few else "regression"


def chi2_scores(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, chi2), best first: observed class sums against the share of the class.

    NULL counts as 0 and columns with negative values are shifted up by their minimum.
    """
    need_numeric(df, features)
    need_columns(df, [target])
    filled = {f: F.coalesce(finite(df, f), F.lit(0.0)) for f in features}
    low = df.agg(*[F.min(x).alias(f"m{i}") for i, x in enumerate(filled.values())]).head()
    shifted = {f: x - F.lit(min(low[f"m{i}"] or 0.0, 0.0)) for i, (f, x) in enumerate(filled.items())}
    per_class = df.groupBy(col(target).alias("c")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(shifted.values())])
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s{i}").alias("o")) for i, f in enumerate(features)])
    long = per_class.select("n", F.inline(items))
    totals = long.groupBy("feature").agg(F.sum("o").alias("s"), F.sum("n").alias("t"))
    expected = F.col("n") / F.col("t") * F.col("s")
    score = F.sum(F.when(expected > 0, (F.col("o") - expected) * (F.col("o") - expected) / expected))
    return long.join(F.broadcast(totals), "feature").groupBy("feature").agg(score.alias("chi2")).orderBy(F.col("chi2").desc_nulls_last(), "feature")


def select_chi2(df: DataFrame, features: list[str], target: str, k: int) -> DataFrame:
    best = {r[0] for r in chi2_scores(df, features, target).limit(min(k, len(features))).collect()}
    return df.select(*[col(f) for f in features if f in best], col(target))


def anova_scores(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """(feature, f_value): one-way F from counts, means and variances per class."""
    features = features or [c for c in numeric_columns(df) if c != target]
    need_numeric(df, features)
    medians = exact_quantiles(df, features, [0.5])
    xs = [F.coalesce(finite(df, f), F.lit(medians[f][0] or 0.0)) for f in features]
    rows = df.where(col(target).isNotNull()).groupBy(col(target).alias("c")).agg(
        F.count(F.lit(1)).alias("n"), *[e for i, x in enumerate(xs) for e in (F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}"))])
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i, f in enumerate(features)])
    long = rows.select("n", F.inline(items))
    means = long.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    joined = long.join(F.broadcast(means), "feature")
    gap = F.col("m") - F.col("mean")
    sums = joined.groupBy("feature").agg(F.sum(F.col("n") * gap * gap).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    f_value = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return sums.select("feature", F.when((F.col("k") > 1) & (F.col("within") > 0), f_value).alias("f_value")).orderBy(F.col("f_value").desc_nulls_last(), "feature")


def select_anova(df: DataFrame, target: str, k: int = 5) -> DataFrame:
    """Numeric columns with the k largest F values and the target; fewer than 5 rows: unchanged."""
    if df.where(col(target).isNotNull()).limit(5).count() < 5:
        return df
    features = [c for c in numeric_columns(df) if c != target]
    best = {r[0] for r in anova_scores(df, target, features).limit(max(1, min(k, len(features)))).collect()}
    return df.select(*[col(f) for f in features if f in best], col(target))


def correlated_columns(df: DataFrame, threshold: float = 0.9, columns: list[str] | None = None) -> list[str]:
    """Columns with |r| above the threshold to an earlier column."""
    columns = columns or numeric_columns(df)
    pairs = pair_correlations(df, columns)
    return [c for c in columns if any(b == c and r is not None and abs(r) > threshold for (_, b), r in pairs.items())]


def select_correlation(df: DataFrame, threshold: float = 0.9) -> DataFrame:
    gone = correlated_columns(df, threshold)
    return df.select(*[col(c) for c in df.columns if c not in gone])


def variances(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    row = df.agg(*[F.var_samp(finite(df, c)).alias(f"v{i}") for i, c in enumerate(columns)]).head()
    return {c: row[f"v{i}"] for i, c in enumerate(columns)}


def select_variance(df: DataFrame, threshold: float = 0.01) -> DataFrame:
    gone = [c for c, v in variances(df, numeric_columns(df)).items() if v is not None and v < threshold]
    return df.select(*[col(c) for c in df.columns if c not in gone])


def select_top_variance(df: DataFrame, features: list[str], n: int) -> DataFrame:
    """Recursive elimination without a target: no constant columns, then the n largest variances."""
    ranked = sorted(((v, f) for f, v in variances(df, features).items() if v), key=lambda p: (-p[0], p[1]))
    best = {f for _, f in ranked[:n]}
    return df.select(*[col(f) for f in features if f in best])


def rfe_ranking(df: DataFrame, features: list[str], target: str, n_features: int, estimator: str = "linear", trees: int = 300, seed: int = 42) -> DataFrame:
    """(feature, rank, weight): rank 1 for the features kept, larger for those removed earlier.

    Every round fits one model on the remaining columns of a checkpointed frame and removes the
    weakest feature: squared coefficients (summed over classes) or forest importance.
    """
    need_numeric(df, features)
    task = infer_task(df, target)
    rows = df.where(col(target).isNotNull())
    means = rows.agg(*[F.avg(finite(rows, f)).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(finite(rows, f)).alias(f"s{i}") for i, f in enumerate(features)]).head()
    xs = [((F.coalesce(finite(rows, f), F.lit(means[f"m{i}"] or 0.0)) - F.lit(means[f"m{i}"] or 0.0)) / F.lit(means[f"s{i}"] or 1.0)).alias(f"x{i}") for i, f in enumerate(features)]
    if task == "classification":
        coded = fit_label_encode(rows, [target], null_label=None).transform(rows)
        data = coded.select(*xs, col(target).cast("double").alias("y"))
    else:
        data = rows.select(*xs, col(target).cast("double").alias("y"))
    data = settle(data)
    left, gone = list(range(len(features))), []
    weights: dict[int, float] = {}
    while True:
        frame = VectorAssembler(inputCols=[f"x{i}" for i in left], outputCol="v").transform(data).select("v", "y")
        common = {"featuresCol": "v", "labelCol": "y"}
        if estimator == "tree":
            kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
            w = kind(numTrees=trees, seed=seed, **common).fit(frame).featureImportances.toArray()
        elif task == "classification":
            m = LogisticRegression(regParam=1.0 / max(data.count(), 1), standardization=False, **common).fit(frame)
            w = (m.coefficientMatrix.toArray() ** 2).sum(0)
        else:
            w = LinearRegression(regParam=1e-6, standardization=False, **common).fit(frame).coefficients.toArray() ** 2
        weights.update({i: float(x) for i, x in zip(left, w)})
        if len(left) <= max(1, n_features):
            break
        weakest = left[int(w.argmin())]
        left.remove(weakest)
        gone.append(weakest)
    ranks = {**{i: 1 for i in left}, **{i: len(gone) - p + 1 for p, i in enumerate(gone)}}
    return facts_frame(df.sparkSession, [(features[i], r, weights[i]) for i, r in sorted(ranks.items())], "feature string, rank int, weight double")


def select_rfe(df, features, target, n_features, estimator="linear", **options):
    if target is None:
        return select_top_variance(df, features, n_features)
    kept = {r["feature"] for r in rfe_ranking(df, features, target, n_features, estimator, **options).where("rank = 1").collect()}
    return df.select(*[col(f) for f in features if f in kept], col(target))
