"""Parameter search over stratified folds, from shared statistics where a model allows it.

Ridge and lasso: one pass collects the Gram matrix of every fold; a fold is left out by subtraction and judged by
its own matrix.  Gaussian naive Bayes: class sums by fold, left out likewise, and one pass judges all values.
Nearest neighbours: one index of all rows and one list at the largest k, outside the own fold, serve all folds, k and weights.  Everything else is refitted.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import matrix
from ..functions.frame import col, lookup, settle
from .knn_model import vote
from .neighbors import nearest_outside


def combinations(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def with_folds(df: DataFrame, key: str, folds: int, label: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``fold``: equal parts by a hash of the key, within each class when ``label`` is given (few classes).

    The cuts are quantiles of the hashes, so sizes differ from equal ones by about a ten-thousandth.
    """
    if folds < 2:
        raise ValueError("two folds are needed")
    h, group = F.shiftrightunsigned(F.xxhash64(col(key), F.lit(seed)), 12), col(label) if label else F.lit(0.0)  # 52 bits stay exact in quantiles
    cuts = [i / folds for i in range(1, folds)]
    rows = df.withColumns({"__h": h, "__c": group})
    table = rows.groupBy("__c").agg(F.percentile_approx("__h", cuts, 100_000).alias("__cuts"))
    return lookup(rows, table, "__c").withColumn("fold", F.size(F.filter("__cuts", lambda c: c < F.col("__h")))).drop("__h", "__c", "__cuts")


# -- ridge and lasso -----------------------------------------------------------------------------

def fold_grams(rows: DataFrame, folds: int) -> np.ndarray:
    """Sums of z zᵀ by fold for z = (1, x, y) of (v, label, fold)."""
    def sums(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x = matrix(pdf["v"])
                z = np.hstack([np.ones((len(x), 1)), x, pdf["label"].to_numpy()[:, None]])
                total = np.zeros((folds, z.shape[1], z.shape[1])) if total is None else total
                for f in range(folds):
                    part = z[pdf["fold"].to_numpy() == f]
                    total[f] += part.T @ part
        if total is not None:
            for f in range(folds):
                yield pd.DataFrame({"fold": [f] * total.shape[1], "i": range(total.shape[1]), "g": total[f].tolist()})

    parts = rows.select("v", "label", "fold").mapInPandas(sums, "fold int, i int, g array<double>")
    found = parts.select("fold", "i", F.posexplode("g").alias("j", "g")).groupBy("fold", "i", "j").agg(F.sum("g").alias("g")).collect()
    size = 1 + max(r["i"] for r in found)
    out = np.zeros((folds, size, size))
    for r in found:
        out[r["fold"], r["i"], r["j"]] = r["g"]
    return out


def solve_gram(g: np.ndarray, alpha: float, lasso: bool, rounds: int = 10_000, tol: float = 1e-12) -> np.ndarray:
    """(intercept, weights) of sum (y - xw)² + alpha |w|², or of the mean of (y - xw)² / 2 + alpha |w|₁."""
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    centred = g[1:, 1:] - n * np.outer(mean, mean)
    a, b = centred[:-1, :-1], centred[:-1, -1]
    if not lasso:
        w = np.linalg.lstsq(a + alpha * np.eye(len(a)), b, rcond=None)[0]
    else:
        w = np.zeros(len(a))
        for _ in range(rounds):
            change = 0.0
            for j in range(len(w)):  # coordinate descent on the few coefficients
                if a[j, j] <= 0:
                    continue
                rest = b[j] - a[j] @ w + a[j, j] * w[j]
                new = np.sign(rest) * max(abs(rest) - n * alpha, 0.0) / a[j, j]
                change, w[j] = max(change, abs(new - w[j])), new
            if change <= tol * (1 + np.abs(w).max()):
                break
    return np.concatenate([[mean[-1] - mean[:-1] @ w], w])


def linear_scores(rows: DataFrame, folds: int, alphas: list[float], lasso: bool) -> list[float]:
    """Mean squared error over all folds for each alpha."""
    grams = fold_grams(rows, folds)
    whole, scores = grams.sum(0), []
    for alpha in alphas:
        error = 0.0
        for g in grams:
            w = np.concatenate([solve_gram(whole - g, alpha, lasso), [-1.0]])
            error += float(w @ g @ w)
        scores.append(error / whole[0, 0])
    return scores


# -- Gaussian naive Bayes ------------------------------------------------------------------------

def gaussian_scores(rows: DataFrame, folds: int, classes: int, smoothings: list[float], priors: list[bool]) -> list[float]:
    """Accuracy for each (var_smoothing, fit_prior), from class sums by fold and one judging pass."""
    def sums(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                x, at = matrix(pdf["v"]), pdf["fold"].to_numpy() * classes + pdf["label"].to_numpy().astype(int)
                total = np.zeros((folds * classes, 2 * x.shape[1] + 1)) if total is None else total
                np.add.at(total, at, np.hstack([np.ones((len(x), 1)), x, x * x]))
        if total is not None:
            yield pd.DataFrame({"cell": range(len(total)), "s": total.tolist()})

    parts = rows.select("v", "label", "fold").mapInPandas(sums, "cell int, s array<double>")
    found = parts.select("cell", F.posexplode("s").alias("j", "s")).groupBy("cell", "j").agg(F.sum("s").alias("s")).collect()
    table = np.zeros((folds * classes, 1 + max(r["j"] for r in found)))
    for r in found:
        table[r["cell"], r["j"]] = r["s"]
    table = table.reshape(folds, classes, -1)
    left = table.sum(0)[None] - table  # statistics of the training rows of each fold
    d = (table.shape[2] - 1) // 2
    n = left[:, :, :1]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = left[:, :, 1:d + 1] / n
        var = np.maximum(left[:, :, d + 1:] / n - mean * mean, 0.0)
        every = left.sum(1)
        spread = np.maximum(every[:, d + 1:] / every[:, :1] - (every[:, 1:d + 1] / every[:, :1]) ** 2, 0.0)  # inputs are z-scored by it
        prior = np.log(n[:, :, 0] / every[:, :1])
    choices = list(itertools.product(smoothings, priors))

    def judge(batches):
        hits, count = np.zeros(len(choices)), 0
        for pdf in batches:
            x, y, fold = matrix(pdf["v"]), pdf["label"].to_numpy().astype(int), pdf["fold"].to_numpy()
            count += len(pdf)
            for f in np.unique(fold):
                at = fold == f
                for c, (smoothing, fitted) in enumerate(choices):
                    v = var[f] + smoothing * spread[f][None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        joint = -0.5 * (np.log(2 * np.pi * v)[None] + (x[at][:, None] - mean[f][None]) ** 2 / v[None]).sum(2)
                    joint = np.where(np.isnan(joint), -np.inf, joint) + (np.where(np.isfinite(prior[f]), prior[f], -np.inf) if fitted else 0.0)
                    hits[c] += (joint.argmax(1) == y[at]).sum()
        yield pd.DataFrame({"hits": [hits.tolist()], "n": [count]})

    judged = rows.select("v", "label", "fold").mapInPandas(judge, "hits array<double>, n bigint")
    row = judged.agg(F.sum("n").alias("n"), *[F.sum(F.get("hits", F.lit(i))).alias(f"h{i}") for i in range(len(choices))]).head()
    return [row[f"h{i}"] / row["n"] for i in range(len(choices))]


# -- nearest neighbours --------------------------------------------------------------------------

def neighbor_scores(rows: DataFrame, folds: int, task: str, choices: list[tuple[int, str]], metric: str) -> list[float]:
    """Accuracy, or mean squared error, for each (k, weights): each row asks the other folds once, at the largest k."""
    most = max(k for k, _ in choices)
    near = nearest_outside(rows, most, "id", "v", "fold", folds, metric)
    near = settle(lookup(near, rows.select(F.col("id").alias("neighbor_id"), F.col("label").alias("value")), "neighbor_id"))
    truth, out = rows.select(F.col("id").alias("query_id"), "label"), []
    for k, weights in choices:
        judged = vote(near.where(F.col("rank") <= k), weights, task).join(truth, "query_id")
        score = F.avg((F.col("prediction") == F.col("label")).cast("double")) if task == "classification" else F.avg((F.col("prediction") - F.col("label")) ** 2)
        out.append(judged.agg(score.alias("s")).head()["s"])
    return out


def mean_score(scored: DataFrame, task: str) -> tuple[float, int]:
    """(sum of hits or squared errors, rows) of a held-out fold."""
    good: Column = F.sum((F.col("prediction") == F.col("label")).cast("double")) if task == "classification" else F.sum((F.col("prediction") - F.col("label")) ** 2)
    row = scored.agg(good.alias("s"), F.count(F.lit(1)).alias("n")).head()
    return row["s"] or 0.0, row["n"]
