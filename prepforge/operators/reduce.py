"""Dimensionality reduction: d x d statistics in Spark, a small eigenproblem, a column projection."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frame import col, facts_frame, finite, need_columns, need_numeric, number_sql, quote
from ..functions.projection import Projection
from .neighbors import knn_graph  # noqa: F401  the neighbour graph is the scalable part of the 2-D layouts

PAIRS_PER_JOB = 300
MAX_CLASSES = 1000


def upright(vectors: np.ndarray) -> np.ndarray:
    """Fix the sign of each column: the entry of largest size is positive."""
    lead = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return vectors * np.where(lead < 0, -1.0, 1.0)


def _linear_columns(columns: list[str], centre: list[float], weights: np.ndarray, prefix: str) -> dict[str, str]:
    xs = [f"(coalesce(nanvl(CAST({quote(c)} AS DOUBLE), NULL), {number_sql(m)}) - {number_sql(m)})" for c, m in zip(columns, centre)]
    return {f"{prefix}{j + 1}": " + ".join(f"{x} * {number_sql(w)}" for x, w in zip(xs, weights[:, j])) for j in range(weights.shape[1])}


def fit_pca(df: DataFrame, columns: list[str], n_components: int = 2, whiten: bool = False) -> Projection:
    """Adds PC1..; NULL counts as the mean.  Facts: mean, loadings, ratio, eigenvalues."""
    need_numeric(df, columns)
    if not 1 <= n_components <= len(columns):
        raise ValueError("n_components must lie between 1 and the number of columns")
    row = df.agg(*[F.avg(finite(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).head()
    means = [row[f"m{i}"] or 0.0 for i in range(len(columns))]
    centred = df.select(*[(F.coalesce(finite(df, c), F.lit(m)) - F.lit(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(columns, means))])
    names = [f"x{i}" for i in range(len(columns))]
    total = centred.agg(*[F.var_samp(n).alias(n) for n in names]).head()
    model = PCA(k=n_components, inputCol="v", outputCol="p").fit(VectorAssembler(inputCols=names, outputCol="v").transform(centred).select("v"))
    loadings = upright(model.pc.toArray())
    ratio = model.explainedVariance.toArray()
    eigen = ratio * sum(v or 0.0 for v in total)
    weights = loadings / np.sqrt(np.where(eigen > 0, eigen, 1.0)) if whiten else loadings
    return Projection(add=_linear_columns(columns, means, weights, "PC"),
                      facts={"columns": columns, "mean": means, "loadings": loadings, "ratio": ratio, "eigenvalues": eigen})


def pca(df, columns, n_components=2, whiten=False):
    return fit_pca(df, columns, n_components, whiten).transform(df)


def pca_explained_variance(df: DataFrame, fitted: Projection) -> DataFrame:
    ratio = fitted.facts["ratio"]
    rows = [(f"PC{i + 1}", float(r), float(c)) for i, (r, c) in enumerate(zip(ratio, np.cumsum(ratio)))]
    return facts_frame(df.sparkSession, rows, "component string, ratio double, cumulative double")


def pca_loadings(df: DataFrame, fitted: Projection) -> DataFrame:
    f = fitted.facts
    rows = [(c, f"PC{j + 1}", float(f["loadings"][i, j])) for i, c in enumerate(f["columns"]) for j in range(f["loadings"].shape[1])]
    return facts_frame(df.sparkSession, rows, "column string, component string, loading double")


def scatter_matrices(df: DataFrame, xs: list[str], by: str) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Within-class and total scatter from partial aggregates; only d x d sums reach the driver."""
    d = len(xs)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    within, total = np.zeros((d, d)), np.zeros((d, d))
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        part = pairs[start:start + PAIRS_PER_JOB]
        aggs = [F.covar_pop(xs[i], xs[j]).alias(f"p{i}_{j}") for i, j in part]
        n = F.count(F.lit(1))
        per = df.groupBy(by).agg(n.alias("n"), *aggs)
        w = per.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), *[F.sum(F.col("n") * F.col(f"p{i}_{j}")).alias(f"p{i}_{j}") for i, j in part]).head()
        t = df.agg(*aggs).head()
        for i, j in part:
            within[i, j] = within[j, i] = w[f"p{i}_{j}"]
            total[i, j] = total[j, i] = t[f"p{i}_{j}"] * w["n"]
    return within, total, w["n"], w["k"]


def fit_discriminant(df: DataFrame, features: list[str], target: str, n_components: int | None = None, keep_features: bool = True) -> Projection:
    """Adds LDA_1..: axes that separate the classes, at most classes - 1.

    Rows without a target are removed; NULL features count as the mean.
    """
    need_numeric(df, features)
    need_columns(df, [target])
    rows = df.where(col(target).isNotNull())
    m = rows.agg(*[F.avg(finite(df, f)).alias(f"m{i}") for i, f in enumerate(features)]).head()
    means = [m[f"m{i}"] or 0.0 for i in range(len(features))]
    xs = [f"x{i}" for i in range(len(features))]
    data = rows.select(col(target).alias("y"), *[F.coalesce(finite(df, f), F.lit(c)).alias(x) for f, c, x in zip(features, means, xs)])
    within, total, n, k = scatter_matrices(data, xs, "y")
    if k < 2:
        raise ValueError("two classes are needed")
    if k > MAX_CLASSES:
        raise ValueError(f"{target}: more than {MAX_CLASSES} classes")
    axes = min(k - 1, len(features), n_components or len(features))
    shared = within / max(n - k, 1)
    # whiten the shared covariance (null directions left out), then rotate to the class spread
    value, vector = np.linalg.eigh(shared)
    good = value > value.max() * 1e-10
    white = vector[:, good] / np.sqrt(value[good])
    spread, rotation = np.linalg.eigh(white.T @ (total - within) @ white)
    order = spread.argsort()[::-1][:axes]
    scalings = upright(white @ rotation[:, order])
    classes = data.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in xs]).orderBy("y").collect()
    coef = (np.array([[r[x] for x in xs] for r in classes]) - np.array(means)) @ (white @ white.T)
    if k == 2:
        coef = coef[1:] - coef[:1]
    add = {f"LDA_{j[3:]}" if j.startswith("LDA") else j: e for j, e in _linear_columns(features, means, scalings, "LDA").items()}
    return Projection(add=add, drop=[] if keep_features else list(features), keep_when=f"{quote(target)} IS NOT NULL",
                      facts={"columns": features, "scalings": scalings, "importance": np.abs(coef).mean(0), "spread": spread[order],
                             "classes": [(str(r["y"]), r["n"], r["n"] / n) for r in classes]})


def discriminant_projection(df, features, target, n_components=None, keep_features=True):
    return fit_discriminant(df, features, target, n_components, keep_features).transform(df)


def discriminant_importance(df: DataFrame, fitted: Projection) -> DataFrame:
    rows = sorted(zip(fitted.facts["columns"], map(float, fitted.facts["importance"])), key=lambda p: (-p[1], p[0]))
    return facts_frame(df.sparkSession, rows, "feature string, importance double")


def discriminant_classes(df: DataFrame, target: str) -> DataFrame:
    """(class, rows, share) of the rows that have a target."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("class", "rows", (F.col("rows") / F.col("total")).alias("share"))
