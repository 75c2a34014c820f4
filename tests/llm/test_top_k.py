import numpy as np
import pytest

from prepforge.llm import top_k


def brute(rows, every, k, scale=1024):
    ok = [(i, np.floor(scale * np.array(v, dtype=float)).astype("int64")) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i in {i for i, _ in ok if i % every == 0}:
        q = next(v for j, v in ok if j == i)
        best = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 3)
    monkeypatch.setattr(top_k, "LEAF", 4)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(120)] + [(i, [1.0] * 5) for i in range(200, 260)]  # many ties
    rows += [(300, None), (310, []), (320, [1.0, None, 0.0, 0.0, 0.0]), (330, [float("nan")] * 5), (340, [float("inf")] * 5), (None, [1.0] * 5), (350, [1.0, 2.0]), (360, [0.5, 0.5])]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<double>, rank int, score int")
    found = top_k.search_all(table, every=10, k=4).collect()
    assert {tuple(r) for r in found} == brute(rows, 10, 4) and len(found) == len(brute(rows, 10, 4))


def test_empty_and_tiny_tables(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert top_k.search_all(empty).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")
    assert top_k.search_all(one).count() == 0


def test_cover_tree_covers():
    x = np.random.default_rng(2).normal(size=(500, 6))
    tree = top_k.CoverTree(x, leaf=10)
    for node, rows in enumerate(tree.rows):
        assert np.sqrt(((x[rows] - tree.center[node]) ** 2).sum(axis=1)).max() <= tree.radius[node] + 1e-9
        if tree.children[node]:
            assert sorted(np.concatenate([tree.rows[c] for c in tree.children[node]]).tolist()) == sorted(rows.tolist())


def test_scores_up_to_the_range_of_a_long(spark):
    big = 0.9e9
    rows = [(i, [big * (1 + i % 3), float(i)]) for i in range(0, 40)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {tuple(r) for r in top_k.search_all(table, every=20, k=3, scale=1.0).collect()}
    assert found == brute(rows, 20, 3, scale=1) and max(r[3] for r in found) > 1 << 62
