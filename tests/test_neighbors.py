"""The pivot tree: hot vectors, hubs, levels, saving, probing."""

import tempfile

import numpy as np
import pandas as pd
import pytest

from prepforge.functions import frame
from prepforge.functions.blocks import block_join
from prepforge.operators import cluster, neighbors, search


def table(spark, x, first=0):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(first, first + len(x)), "v": list(map(list, x))}), "id bigint, v array<double>")


def brute(q, x, k, metric):
    if metric == "cosine":
        q, x = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, x))
        d = np.clip(1 - q @ x.T, 0, None)
    else:
        diff = q[:, None] - x[None]
        d = np.abs(diff).sum(2) if metric == "manhattan" else np.sqrt((diff * diff).sum(2))
    return np.sort(d, axis=1)[:, :k]


@pytest.mark.parametrize("metric", neighbors.METRICS)
def test_tree_of_many_levels_equals_all_pairs(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbors, "FANOUT", 5)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, s, (n, 4)) for c, s, n in ((0, 1, 500), (8, 0.1, 300), (-5, 3, 100))]) + 0.01
    q = rng.normal(1, 4, (60, 4))
    base = table(spark, x)
    index = neighbors.NeighborIndex.build(base, "id", "v", metric, leaf_rows=20)
    assert len(index.levels) >= 3 and index.points.count() == 900
    sizes = [r["count"] for r in index.points.groupBy("node").count().collect()]
    assert max(sizes) <= 20
    asked = table(spark, q, 10_000)
    got = neighbors.nearest_neighbors(asked, base, 7, "id", "v", metric, leaf_rows=20).toPandas().sort_values(["query_id", "rank"])
    assert np.allclose(got.distance.to_numpy().reshape(-1, 7), brute(q, x, 7, metric))
    few = neighbors.nearest_neighbors(asked, base.limit(3), 7, "id", "v", metric).groupBy("query_id").count()
    assert {r["count"] for r in few.collect()} == {3}


def test_nearest_rows_of_other_parts(spark, monkeypatch):
    """One index for all parts; a place held by one part alone, copies in several parts, and a key that stands twice."""
    monkeypatch.setattr(neighbors, "FANOUT", 6)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, s, (n, 3)) for c, s, n in ((2, 1, 250), (9, 0.05, 120))] + [np.full((30, 3), 3.0)]) + 0.01
    part = np.concatenate([rng.integers(0, 3, 250), np.full(120, 1), np.arange(30) % 3])
    rows = spark.createDataFrame([(i, v.tolist(), int(p)) for i, (v, p) in enumerate(zip(x, part))], "id bigint, v array<double>, fold int")
    got = neighbors.nearest_outside(rows, 4, "id", "v", "fold", 3, leaf_rows=100).toPandas().sort_values(["query_id", "rank"])
    assert (part[got.query_id] != part[got.neighbor_id]).all() and len(got) == 4 * len(x)
    for p in range(3):
        mine = got[part[got.query_id] == p]
        assert np.allclose(mine.distance.to_numpy().reshape(-1, 4), brute(x[part == p], x[part != p], 4, "euclidean"))
    copies = got[got.query_id == 370]  # part 0: the copies of parts 1 and 2, smallest keys first
    assert copies.neighbor_id.tolist() == [371, 372, 374, 375]
    twice = spark.createDataFrame([(1, [0.0], 0), (1, [0.0], 1), (2, [1.0], 2)], "id bigint, v array<double>, fold int")
    asked = sorted(tuple(r) for r in neighbors.nearest_outside(twice, 5, "id", "v", "fold", 3).collect())
    assert asked == [(1, 1, 0.0, 1), (1, 1, 0.0, 1), (1, 2, 1.0, 2), (1, 2, 1.0, 2), (2, 1, 1.0, 1), (2, 1, 1.0, 2)]


def test_folds_share_one_index(spark, monkeypatch):
    built, build = [], neighbors.NeighborIndex.build
    monkeypatch.setattr(neighbors.NeighborIndex, "build", staticmethod(lambda *args, **named: built.append(1) or build(*args, **named)))
    rows = spark.createDataFrame([(i, [float(i)], float(i), i % 3) for i in range(30)], "id bigint, v array<double>, label double, fold int")
    assert search.neighbor_scores(rows, 3, "regression", [(2, "uniform")], "euclidean") == [pytest.approx((28 * 0.0 + 2 * 2.25) / 30)]
    assert len(built) == 1


def test_hot_vector_and_hub(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "FANOUT", 4)
    monkeypatch.setattr(frame, "BROADCAST_ROWS", 0)  # every lookup takes the path for large dictionaries
    monkeypatch.setattr(frame.small_or_none, "__defaults__", (0,))
    ring = np.array([[np.cos(t), np.sin(t)] for t in np.linspace(0, 6.2, 60)])
    x = np.concatenate([np.zeros((90, 2)), ring, ring * 3])  # a third and more on the vector that is everybody's neighbour
    got = neighbors.nearest_neighbors(table(spark, x), table(spark, x), 3, "id", "v", leaf_rows=10).toPandas().sort_values(["query_id", "rank"])
    assert np.allclose(got.distance.to_numpy().reshape(-1, 3), brute(x, x, 3, "euclidean"))
    centre = got[got.query_id < 90]
    assert set(centre.neighbor_id) == {0, 1, 2} and len(centre) == 270


def test_index_is_saved_and_loaded(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(0, 1, (300, 3)), rng.normal(0, 1, (20, 3))
    path = tempfile.mkdtemp(prefix="prepforge-index-") + "/index"
    neighbors.NeighborIndex.build(table(spark, x), "id", "v", leaf_rows=50).save(path)
    index = neighbors.NeighborIndex.load(spark, path)
    asked = table(spark, q).select(frame.F.col("id").alias("row_id"), "v")
    got = index.search(asked, 4).toPandas().sort_values(["query_id", "rank"])
    assert np.allclose(got.distance.to_numpy().reshape(-1, 4), brute(q, x, 4, "euclidean")) and len(index.levels) == 1


def test_probing_behaves_alike_at_every_size(spark):
    rng = np.random.default_rng(3)
    for n in (100, 2000):
        x = rng.normal(0, 1, (n, 2))
        base = table(spark, x)
        got = neighbors.nearest_neighbors(base, base, 5, "id", "v", probe_cells=1).toPandas().sort_values(["query_id", "rank"])
        assert (got[got["rank"] == 1].distance == 0).all() and (got.groupby("query_id").size() <= 5).all()
        close = neighbors.nearest_neighbors(base, base, 5, "id", "v", probe_cells=4).toPandas()
        exact = brute(x, x, 5, "euclidean")
        hits = sum((g.distance.to_numpy() <= exact[i, 4] * (1 + 1e-9)).sum() for i, g in close.groupby("query_id"))
        one = sum((g.distance.to_numpy() <= exact[i, 4] * (1 + 1e-9)).sum() for i, g in got.groupby("query_id"))
        assert 0.9 * exact.size <= hits <= exact.size and one < exact.size  # a single cell does lose neighbours


def test_missing_vectors_and_empty_tables(spark):
    base = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [2.0, 2.0])], "id bigint, v array<double>")
    rows = neighbors.nearest_neighbors(base, base, 5, "id", "v").collect()
    assert sorted((r["query_id"], r["neighbor_id"], r["rank"]) for r in rows) == [(1, 1, 1), (1, 4, 2), (4, 1, 2), (4, 4, 1)]
    assert neighbors.nearest_neighbors(base, base.where("id > 9"), 5, "id", "v").collect() == []
    assert neighbors.nearest_neighbors(base.where("id > 9"), base, 5, "id", "v").collect() == []


def test_vectors_that_no_bound_tells_apart_are_compared_block_by_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24)).round(3)
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[500:550] = x[:50]  # copies
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, v array<double>")
    sent = []
    monkeypatch.setattr(neighbors, "FANOUT", 16)
    monkeypatch.setattr(neighbors, "block_join", lambda left, right, key, kernel, schema, rows=4096: sent.append((schema, left, rows)) or block_join(left, right, key, kernel, schema, rows))
    rows = neighbors.nearest_neighbors(df, df, 4, "id", "v", include_self=False, leaf_rows=40).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    expected = {(i, int(j), r + 1) for i in range(600) for r, j in enumerate(np.lexsort((np.arange(600), d[i]))[:4])}
    assert {(r.query_id, r.neighbor_id, r["rank"]) for r in rows} == expected
    last = [left for schema, left, _ in sent if schema.startswith("id bigint, nid")][-1]
    assert last.count() == last.select("id").distinct().count()  # a query is sent once, not once for each open leaf


def test_cluster_grid_searches_neighbours_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.3, (30, 5)) for c in (0, 4)])
    df = table(spark, np.concatenate([x, x[:4]]))  # copies
    built, build = [], neighbors.NeighborIndex.build
    eps = cluster.neighbor_eps(df, "id", "v", 4)
    monkeypatch.setattr(neighbors.NeighborIndex, "build", staticmethod(lambda *args, **named: built.append(1) or build(*args, **named)))
    asked, run = [], cluster.dbscan
    monkeypatch.setattr(cluster, "dbscan", lambda *args: asked.append(args[3]) or run(*args))
    rows = cluster.knn_cluster_grid(df, "id", "v", [2], [4]).collect()
    assert len(built) == 1 and asked == [pytest.approx(eps)] and [(r["method"], r["clusters"]) for r in rows] == [("graph", 2), ("density", 2)]
    index = build(df, "id", "v")
    for itself in (True, False):
        alone = neighbors.nearest_neighbors(df, df, 3, "id", "v", include_self=itself)
        assert sorted(neighbors.take(index.lists(index.rows, 6), 3, itself).collect()) == sorted(alone.collect())
