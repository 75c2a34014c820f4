"""Clustering."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frame import col, facts_frame, need_columns, settle
from ..functions.quantiles import exact_quantiles
from . import evaluate
from .charts import histogram
from .density import density_labels, label_arrays
from .encode import fit_model_inputs
from .neighbors import NeighborIndex, graph_edges, knn_graph, nearest_neighbors, take, vectors
from .reduce import fit_pca
from .scale import fit_zscore


# -- k-means -----------------------------------------------------------------------------------

def scaled_vectors(df: DataFrame, columns: list[str] | str, keep: list[str]) -> DataFrame:
    """z-scored columns as an ML vector ``v``; NULL counts as the mean."""
    flat, xs = evaluate.spread_columns(df, columns, keep)
    scaled = fit_zscore(flat, xs).transform(flat).fillna(0.0, subset=xs)
    return VectorAssembler(inputCols=xs, outputCol="v").transform(scaled).select(*[col(k) for k in keep], "v")


def best_kmeans(data: DataFrame, k: int, seed: int = 42, restarts: int = 10):
    """The run with the smallest cost of ``restarts`` seeds."""
    models = [KMeans(k=k, seed=seed + i, featuresCol="v", predictionCol="cluster", maxIter=300, tol=1e-4).fit(data) for i in range(restarts)]
    return min(models, key=lambda m: m.summary.trainingCost)


def kmeans(df: DataFrame, key: str, columns: list[str] | str, k: int, seed: int = 42, restarts: int = 10) -> DataFrame:
    """(key, cluster)."""
    data = settle(scaled_vectors(df, columns, [key]))
    return best_kmeans(data, k, seed, restarts).transform(data).select(col(key), "cluster")


def elbow(costs: list[tuple[int, float]]) -> int:
    """The k whose point lies farthest from the line between the first and the last point."""
    (x0, y0), (x1, y1) = costs[0], costs[-1]
    span = math.hypot(x1 - x0, y1 - y0) or 1.0
    return max(costs, key=lambda p: (abs((y1 - y0) * p[0] - (x1 - x0) * p[1] + x1 * y0 - y1 * x0) / span, -p[0]))[0]


def kmeans_auto(df: DataFrame, key: str, columns: list[str] | str, max_k: int = 10, seed: int = 42, restarts: int = 10) -> tuple[DataFrame, DataFrame]:
    """((key, cluster) at the elbow, (k, inertia, chosen))."""
    data = settle(scaled_vectors(df, columns, [key]))
    top = min(max_k, data.limit(2 * max_k).count() // 2)
    models = {k: best_kmeans(data, k, seed, restarts) for k in range(2, top + 1)}
    costs = [(k, float(m.summary.trainingCost)) for k, m in models.items()]
    chosen = elbow(costs)
    table = facts_frame(df.sparkSession, [(k, c, k == chosen) for k, c in costs], "k int, inertia double, chosen boolean")
    return models[chosen].transform(data).select(col(key), "cluster"), table


# -- density clustering ------------------------------------------------------------------------

def dbscan(df: DataFrame, key: str, columns: list[str] | str, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean", prepare: bool = False) -> DataFrame:
    """(key, cluster bigint) of every row, -1 is noise; see ``density_labels``.

    ``prepare`` first fills and scales numbers and spreads text columns, see ``cluster_inputs``.
    """
    need_columns(df, [key])
    if prepare:
        df, columns = cluster_inputs(df, key, columns)
    rows = settle(df.select(col(key).alias("row_id"), vectors(df, columns, metric).alias("v")))
    return density_labels(rows, [eps], [min_samples], metric).select(F.col("row_id").alias(key), "cluster")


def dbscan_grid(df: DataFrame, key: str, columns: list[str] | str, eps: list[float], min_samples: list[int], metrics: tuple = ("euclidean",), sample: int | None = None,
                prepare: bool = False) -> DataFrame:
    """(eps, min_samples, metric, clusters, silhouette, chosen); without two clusters anywhere 0.5 / 5 is chosen.

    All radii and neighbour numbers of a metric share their neighbour passes.  Each combination is scored by
    the silhouette of its clustered rows in its own metric, over all of them or over a ``sample`` the caller asks for;
    clusters that several combinations share are measured once.
    """
    need_columns(df, [key])
    if prepare:
        df, columns = cluster_inputs(df, key, columns)
        df = settle(df)
    rows = []
    combos = list(itertools.product(eps, min_samples))
    for metric in metrics:
        data = settle(df.select(col(key).alias("row_id"), vectors(df, columns, metric).alias("v")))
        labels = settle(label_arrays(data, eps, min_samples, metric))
        most = labels.agg(*[F.max(F.get("clusters", F.lit(k))).alias(f"c{k}") for k in range(len(combos))]).head()
        found = [0 if c is None else c + 1 for c in most]
        scores = evaluate.silhouettes(data.join(labels, "row_id"), [k for k, n in enumerate(found) if n >= 2], metric, sample)
        for k, (e, m) in enumerate(combos):
            n, score = found[k], scores.get(k)
            rows.append((float(e), int(m), metric, int(n), score))
    known = [r for r in rows if r[4] is not None]
    best = max(known, key=lambda r: r[4])[:3] if known else (0.5, 5, "euclidean")
    out = [(*r, r[:3] == best) for r in rows]
    if not known and best not in [r[:3] for r in rows]:
        out.append((*best, None, None, True))
    return facts_frame(df.sparkSession, out, "eps double, min_samples int, metric string, clusters int, silhouette double, chosen boolean")


# -- hierarchical ------------------------------------------------------------------------------

def hierarchical(df: DataFrame, key: str, columns: list[str] | str, n_clusters: int, metric: str = "euclidean", seed: int = 42, restarts: int = 3,
                 prepare: bool = False) -> tuple[DataFrame, DataFrame]:
    """((key, cluster), (step, a, b, size_a, size_b, height)): a tree from the top down, for any number of rows.

    The cluster with the largest sum of squares is split by 2-means until there are ``n_clusters`` or no cluster
    has two distinct rows.  Read from step 0 the table merges clusters into a; ``height`` is Ward's, the square root of
    twice the growth of the sum of squares.  Cosine works on unit vectors; numbers are scaled as for ``kmeans``.
    Clusters are numbered by size, the largest first, ties by their first key.  The driver holds the centres only.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError("Ward heights need the Euclidean or the cosine metric")
    if prepare:
        df, columns = cluster_inputs(df, key, columns)
    if metric == "cosine":
        flat, xs = evaluate.spread_columns(df.select(col(key), vectors(df, columns, metric).alias("a")), "a", [key])
        data = VectorAssembler(inputCols=xs, outputCol="v").transform(flat.fillna(0.0, subset=xs)).select(col(key), "v")
    else:
        data = scaled_vectors(df, columns, [key])
    data = settle(data.withColumn("cluster", F.lit(0)))
    splits: list[tuple] = []
    live = {0: _spread_of(data)} if n_clusters > 1 else {}
    while live and len(splits) + 1 < n_clusters:
        widest = max(live, key=lambda c: (live[c], -c))
        if live[widest] <= 1e-12:
            break
        part = data.where(F.col("cluster") == widest).drop("cluster")
        model = best_kmeans(part, 2, seed, restarts)
        centres = [np.array(c) for c in model.clusterCenters()]
        if len(centres) < 2:  # rows that differ by rounding only
            live[widest] = 0.0
            continue
        new = len(splits) + 1
        moved = model.transform(part).select(col(key), "v", F.when(F.col("cluster") == 1, new).otherwise(widest).alias("cluster"))
        data = settle(data.where(F.col("cluster") != widest).unionByName(moved))
        n = {r["cluster"]: r["count"] for r in data.where(F.col("cluster").isin(widest, new)).groupBy("cluster").count().collect()}
        growth = n[widest] * n[new] / (n[widest] + n[new]) * float(((centres[0] - centres[1]) ** 2).sum())
        splits.append((widest, new, n[widest], n[new], math.sqrt(2 * growth)))
        for c in (widest, new):
            live[c] = _spread_of(data.where(F.col("cluster") == c))
    order = data.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min(col(key)).alias("first")).orderBy(F.desc("n"), "first").collect()
    place = {r["cluster"]: i for i, r in enumerate(order)}
    names = F.broadcast(facts_frame(df.sparkSession, list(place.items()), "cluster int, place int"))  # one row for each cluster asked for
    tree = [(i, place[a], place[b], na, nb, h) for i, (a, b, na, nb, h) in enumerate(reversed(splits))]
    return (data.join(names, "cluster").select(col(key), F.col("place").alias("cluster")),
            facts_frame(df.sparkSession, tree, "step int, a int, b int, size_a bigint, size_b bigint, height double"))


def _spread_of(data: DataFrame) -> float:
    """Sum of squared distances to the mean."""
    m = data.select(Summarizer.metrics("variance", "count").summary(F.col("v")).alias("m")).select("m.variance", "m.count").head()
    return float(m["variance"].toArray().sum() * max(0, m["count"] - 1)) if m and m["count"] else 0.0


def bisecting(df: DataFrame, key: str, columns: list[str] | str, n_clusters: int, seed: int = 42) -> DataFrame:
    """Spark's own top-down clustering, without a tree."""
    data = settle(scaled_vectors(df, columns, [key]))
    return BisectingKMeans(k=n_clusters, seed=seed, featuresCol="v", predictionCol="cluster").fit(data).transform(data).select(col(key), "cluster")


# -- clusters from the neighbour graph -----------------------------------------------------------

def knn_graph_clusters(df: DataFrame, key: str, columns: list[str] | str, n_clusters: int, k: int = 10, metric: str = "euclidean", lists: DataFrame | None = None) -> DataFrame:
    """Power iteration (the scalable spectral method) on the symmetric neighbour graph; integer keys.  ``lists`` are neighbours known already."""
    edges = knn_graph(df, key, columns, k, metric) if lists is None else graph_edges(take(lists, k, False))
    pairs = edges.select(F.least("src", "dst").cast("bigint").alias("src"), F.greatest("src", "dst").cast("bigint").alias("dst"))
    weighted = settle(pairs.groupBy("src", "dst").agg((F.count(F.lit(1)) / 2.0).alias("weight")))
    found = PowerIterationClustering(k=n_clusters, maxIter=30, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight").assignClusters(weighted)
    return found.select(F.col("id").alias(key), "cluster")


def neighbor_eps(df: DataFrame, key: str, columns: list[str] | str, k: int, metric: str = "euclidean", lists: DataFrame | None = None) -> float:
    """Median over the rows of the mean distance to the k nearest rows, the row itself included."""
    near = nearest_neighbors(df, df, k, key, columns, metric) if lists is None else take(lists, k)
    means = near.groupBy("query_id").agg(F.avg("distance").alias("d"))
    return exact_quantiles(settle(means), ["d"], [0.5])["d"][0]


def knn_density_clusters(df: DataFrame, key: str, columns: list[str] | str, k: int = 5, metric: str = "euclidean", lists: DataFrame | None = None) -> DataFrame:
    return dbscan(df, key, columns, neighbor_eps(df, key, columns, k, metric, lists), k, metric)


def knn_cluster_grid(df: DataFrame, key: str, columns: list[str] | str, n_clusters: list[int], ks: list[int], sample: int | None = None) -> DataFrame:
    """(method, n_clusters, k, clusters, silhouette, chosen) over both graph methods; one neighbour search serves all."""
    rows = []
    need_columns(df, [key])
    index = NeighborIndex.build(df, key, columns)
    lists = settle(index.lists(index.rows, max(ks, default=0) + 1))
    trials = [("graph", n, k) for n in n_clusters for k in ks] + [("density", None, k) for k in ks]
    for method, n, k in trials:
        labels = settle(knn_graph_clusters(df, key, columns, n, k, lists=lists) if method == "graph" else knn_density_clusters(df, key, columns, k, lists=lists))
        found = labels.where("cluster >= 0").select("cluster").distinct().count()
        score = evaluate.silhouette(df.join(labels.where("cluster >= 0"), key), key, columns, "cluster", sample).head()["silhouette"] if found >= 2 else None
        rows.append((method, n, k, found, score))
    best = max((r for r in rows if r[4] is not None), key=lambda r: r[4], default=None)
    return facts_frame(df.sparkSession, [(*r, r is best) for r in rows], "method string, n_clusters int, k int, clusters int, silhouette double, chosen boolean")


# -- reports -----------------------------------------------------------------------------------

def cluster_inputs(df: DataFrame, key: str, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Median and z-score for numbers, one-hot for text: (key, inputs...) and the input names, ready for any clustering."""
    fitted = fit_model_inputs(df, features, "standard", drop_first=False)
    return fitted.transform(df.select(*dict.fromkeys([key, *features]))).select(col(key), *[col(n) for n in fitted.add]), list(fitted.add)


def cluster_sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    counts = df.groupBy(col(cluster)).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select(col(cluster), "count", (100.0 * F.col("count") / F.col("n")).alias("pct"))


def cluster_profile(df: DataFrame, columns: list[str], cluster: str = "cluster") -> DataFrame:
    """Mean of every column per cluster."""
    return df.groupBy(col(cluster)).agg(*[F.avg(col(c)).alias(c) for c in columns])


def cluster_histogram(df: DataFrame, column: str, cluster: str = "cluster", bins: int = 20) -> DataFrame:
    return histogram(df, column, bins, cluster)


def cluster_pca_view(df: DataFrame, columns: list[str], cluster: str = "cluster") -> tuple[DataFrame, list[float]]:
    """((PC1, PC2, cluster), variance ratio)."""
    fitted = fit_pca(df, columns, 2)
    return fitted.transform(df).select("PC1", "PC2", col(cluster)), [float(r) for r in fitted.facts["ratio"]]
