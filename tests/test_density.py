"""Density clustering and silhouettes against numpy, on dense cells, many radii and all metrics."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepforge.functions import blocks, fields
from prepforge.operators import cluster, density, evaluate


def apart(x, metric):
    if metric == "cosine":
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.clip(1 - u @ u.T, 0, None)
    diff = x[:, None] - x[None]
    return np.abs(diff).sum(2) if metric == "manhattan" else np.sqrt((diff * diff).sum(2))


def scan(x, eps, least, metric="euclidean"):
    near = apart(x, metric) <= eps * (1 + 1e-12)
    core, label, found = near.sum(1) >= least, -np.ones(len(x), int), 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        stack, label[i] = [i], found
        while stack:
            u = stack.pop()
            if core[u]:
                for v in np.nonzero(near[u])[0]:
                    if label[v] == -1:
                        label[v] = found
                        stack.append(v)
        found += 1
    return label


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), **{f"x{i}": x[:, i] for i in range(x.shape[1])}})), [f"x{i}" for i in range(x.shape[1])]


@pytest.mark.parametrize("metric,width,eps,least", [("euclidean", 2, [0.12, 0.3, 0.7], [3, 8]), ("manhattan", 3, [0.4, 0.9], [2, 6]), ("cosine", 3, [0.001, 0.02], [3, 5]), ("euclidean", 6, [0.6, 1.4], [4])])
def test_many_radii_equal_a_scan_each(spark, monkeypatch, metric, width, eps, least):
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.normal(0, 0.15, (90, width)), rng.normal(1, 0.3, (60, width)), rng.uniform(-1, 2, (50, width)), np.repeat(rng.uniform(-1, 2, (3, width)), 15, axis=0)])
    x = x[rng.permutation(len(x))]
    df, xs = frame(spark, x)
    monkeypatch.setattr(density, "MICRO", 1)  # one stand-in for a full sub-cell, so that the others have to be compared
    monkeypatch.setattr(blocks.block_join, "__defaults__", (32,))
    data = df.select(df.id.alias("row_id"), density.F.array(*xs).alias("v"))
    if metric == "cosine":
        data = cluster.vectors(df, xs, metric)
        data = df.select(df.id.alias("row_id"), data.alias("v"))
    got = density.density_labels(data, eps, least, metric).toPandas()
    for k, (e, m) in enumerate((e, m) for e in eps for m in least):
        mine = got[got.combo == k].sort_values("row_id").cluster.to_numpy()
        assert (mine == scan(x, e, m, metric)).all(), (e, m)


def test_components_that_meet_away_from_the_stand_ins(spark, monkeypatch):
    # two full sub-cells whose first points are too far apart, tied by a pair of later points only
    x = np.array([[0.0, 0.0], [0.1, 0.0], [0.65, 0.0], [1.5, 0.0], [1.45, 0.0], [0.75, 0.0], [9.0, 9.0]])
    df, xs = frame(spark, x)
    monkeypatch.setattr(density, "MICRO", 1)
    for least in (2, 3):
        got = cluster.dbscan(df, "id", xs, 1.0, least).toPandas().sort_values("id").cluster.to_numpy()
        assert (got == scan(x, 1.0, least)).all()


def test_dense_cells_and_zero_vectors(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.uniform(0, 0.9, (50_000, 2)), rng.uniform(0, 0.9, (20_000, 2)) + [2.2, 0], [[5.0, 5.0], [1.55, 0.45]]])
    df, xs = frame(spark, x)
    start = time.time()
    got = cluster.dbscan(df, "id", xs, 1.0, 5).toPandas().sort_values("id").cluster.to_numpy()
    assert (got[:50_000] == 0).all() and (got[-2:] == [-1, 0]).all()
    assert len(set(got[50_000:70_000])) == 1 and time.time() - start < 60
    zero, _ = frame(spark, np.array([[0.0, 0.0]] * 5 + [[1.0, 1.0]] * 4 + [[np.inf, 0.0], [np.nan, 1.0]]))
    assert [r["cluster"] for r in cluster.dbscan(zero, "id", xs, 0.1, 3, "cosine").orderBy("id").collect()] == [-1] * 5 + [0] * 4 + [-1, -1]


def test_dbscan_prepares_its_inputs(spark):
    df = spark.createDataFrame([(i, 5.0 if i < 4 else float("inf") if i == 4 else 9.0, "a" if i % 2 else None) for i in range(10)], "id bigint, n double, s string")
    labels = {r["id"]: r["cluster"] for r in cluster.dbscan(df, "id", ["n", "s"], 0.5, 2, prepare=True).collect()}
    assert labels == {0: 0, 2: 0, 1: 1, 3: 1, 4: 2, 6: 2, 8: 2, 5: 3, 7: 3, 9: 3}  # the infinite value takes the median


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_silhouettes_equal_all_pairs(spark, monkeypatch, metric):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, s, (n, 9)) for c, s, n in ((0, 1, 900), (3, 0.5, 600), (1.5, 2, 450), (9, 0.1, 48))] + [np.full((1, 9), 40.0), np.zeros((1, 9))])
    y = np.repeat([4, 1, 2, 3, 7, 2], [900, 600, 450, 48, 1, 1])
    d = apart(x, metric)
    np.fill_diagonal(d, 0)
    want = np.zeros(len(x))
    for i in range(len(x)):
        same = (y == y[i]) & (np.arange(len(x)) != i)
        if same.any():
            a, b = d[i, same].mean(), min(d[i, y == k].mean() for k in set(y) - {y[i]})
            want[i] = (b - a) / max(a, b)
    df, xs = frame(spark, x)
    df = df.join(spark.createDataFrame(pd.DataFrame({"id": np.arange(len(y)), "k": y})), "id")
    monkeypatch.setattr(blocks.block_join, "__defaults__", (300,))
    got = evaluate.silhouette_rows(df, "id", xs, "k", metric=metric).toPandas().sort_values("id")
    assert np.allclose(got.silhouette.to_numpy(), want, atol=1e-9) and (got.cluster.to_numpy() == y).all()
    one = evaluate.silhouette(df.where("k = 4"), "id", xs, "k", metric=metric).head()
    assert one["silhouette"] == 0.0 and one["rows"] == 900


def test_dense_clusters_apart_are_not_compared_point_by_point(spark, monkeypatch):
    x = np.concatenate([np.stack([np.full(400, float(k)), np.linspace(0, 4, 400)], 1) for k in range(3)])  # full sub-cells, lines out of reach
    df, xs = frame(spark, x)
    data = df.select(F.col("id").alias("row_id"), F.array(*xs).alias("v"))
    keys = []
    monkeypatch.setattr(density, "block_join", lambda left, right, key, *rest, **named: keys.append((key, left)) or blocks.block_join(left, right, key, *rest, **named))
    got = density.density_labels(data, [0.6, 1.2], [3, 5]).toPandas()
    assert (got[got.combo < 2].cluster == got[got.combo < 2].row_id // 400).all() and (got[got.combo >= 2].cluster == 0).all()
    sent = [left.count() for key, left in keys if "v" in left.columns]
    assert sum(sent) < 4 * len(x)  # before, all points but the stand-ins met the cells around them


def test_grid_sums_shared_clusters_once_and_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.25, (n, 2)) for c, n in (((0, 0), 220), ((4, 0), 180), ((4, 1.9), 150))] + [rng.uniform(-2, 6, (25, 2))])
    x[10] = x[11]  # copies
    df, xs = frame(spark, x)
    calls = []
    monkeypatch.setattr(evaluate, "FIELD_ROWS", 100)
    monkeypatch.setattr(evaluate, "distance_sums", lambda *args: calls.append(args) or fields.distance_sums(*args))
    eps, least = [0.5, 0.9], [3, 6]
    data = df.select(F.col("id").alias("row_id"), F.array(*xs).alias("v"))
    labels = density.density_labels(data, eps, least).toPandas()
    got = cluster.dbscan_grid(df, "id", xs, eps, least).collect()
    d = apart(x, "euclidean")
    np.fill_diagonal(d, 0)
    for k, row in enumerate(got):
        one = labels[labels.combo == k].sort_values("row_id").cluster.to_numpy()
        want = []
        for i in np.flatnonzero(one >= 0):
            same = (one == one[i]) & (np.arange(len(x)) != i)
            if same.any():
                a, b = d[i, same].mean(), min(d[i, one == c].mean() for c in set(one) - {-1, one[i]})
                want.append((b - a) / max(a, b))
            else:
                want.append(0.0)
        assert row["clusters"] == one.max() + 1 and row["silhouette"] == pytest.approx(np.mean(want), abs=1e-9)
    assert len(calls) == 1 and len({r["silhouette"] for r in got}) > 1  # different labellings in one pass
    names = {(k, c): frozenset(g.row_id) for (k, c), g in labels[labels.cluster >= 0].groupby(["combo", "cluster"])}
    assert calls[0][1].select("slot").distinct().count() == len(set(names.values()))
