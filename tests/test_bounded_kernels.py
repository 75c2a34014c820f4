"""Kernels of large blocks hold slabs, whatever the block."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from prepforge.functions import blocks
from prepforge.operators import evaluate, neighbors


def block(rng, n, d):
    return pd.DataFrame({"id": np.arange(n), "v": list(rng.normal(0, 1, (n, d)))})


@pytest.mark.parametrize("metric", neighbors.METRICS)
def test_best_rows_of_a_block_pair_hold_no_full_distance_table(metric):
    rng = np.random.default_rng(3)
    a, b = block(rng, 3000, 4), block(rng, 4000, 4)
    b.loc[1, "v"][:] = b.loc[0, "v"]  # a tie goes to the smaller id
    tracemalloc.start()
    got = neighbors.top_of_block(5, metric)(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6  # one table of 3,000 x 4,000 distances is 96 MB
    x, y = np.stack(a["v"]), np.stack(b["v"])
    d = np.clip(1 - x @ y.T, 0, None) if metric == "cosine" else sum(np.abs(x[:, None, i] - y[None, :, i]) ** (1 if metric == "manhattan" else 2) for i in range(4)) ** (1 if metric == "manhattan" else 0.5)
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert np.allclose(got.distance.to_numpy().reshape(-1, 5), np.take_along_axis(d, order, 1)) and (got.id.to_numpy().reshape(-1, 5) == np.arange(3000)[:, None]).all()
    near_zero = got.loc[got.nid == 1].merge(got.loc[got.nid == 0], on="id")
    assert (near_zero.distance_x == near_zero.distance_y).all()


def test_blocks_of_silhouettes_grow_with_the_table_up_to_a_bound():
    assert evaluate._sum_rows(10_000, 64) == 2048
    assert evaluate._sum_rows(300_000, 64) == 9375  # each row is sent about 32 times, at any size
    assert evaluate._sum_rows(1e9, 64) == evaluate.BLOCK_BYTES // (8 * 64)


def test_manhattan_distances_hold_no_table_of_differences():
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, (301, 64)), rng.normal(0, 1, (1000, 64))
    tracemalloc.start()
    got = blocks.distances(a, b, "manhattan")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6  # the result is 2.4 MB; slabs of all differences came to 30 MB and more
    assert np.allclose(got, np.abs(a[:, None] - b[None]).sum(2), rtol=1e-13)
    assert blocks.distances(a[:0], b, "manhattan").shape == (0, 1000) and blocks.distances(a, b[:0], "manhattan").shape == (301, 0)


def test_manhattan_neighbours_measure_only_pairs_that_short_codes_leave_open(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = block(rng, 300, 64), block(rng, 1000, 64)
    b.loc[1, "v"][:] = b.loc[0, "v"]  # a tie goes to the smaller id
    x, y = np.stack(a["v"]), np.stack(b["v"])
    d = np.abs(x[:, None] - y[None]).sum(2)
    order = np.argsort(d, axis=1, kind="stable")[:, :5]
    with monkeypatch.context() as patch:
        patch.setattr(neighbors, "distances", None)  # no table of all distances
        got = neighbors.top_of_block(5, "manhattan")(a, b)
    assert (got.nid.to_numpy().reshape(-1, 5) == order).all() and np.allclose(got.distance.to_numpy().reshape(-1, 5), np.take_along_axis(d, order, 1), rtol=1e-13)
    for odd in (rng.integers(0, 3, (1000, 4)).astype(float), rng.normal(size=(1000, 3)) * [1e9, 1, 1e-6] + [1e12, 0, 0], np.where(rng.random((1000, 2)) < 0.01, np.inf, 0.0), rng.normal(size=(1000, 1))):
        got = neighbors.top_of_block(5, "manhattan")(pd.DataFrame({"id": range(40), "v": list(odd[:40])}), pd.DataFrame({"id": range(1000), "v": list(odd)}))
        with np.errstate(invalid="ignore"):
            d = np.abs(odd[:40, None] - odd[None]).sum(2)
        kept = np.isfinite(odd[:40]).all(1)
        order = np.lexsort((np.broadcast_to(np.arange(1000), d.shape), d), axis=1)[:, :5]
        assert all(list(g.nid) == list(order[i]) for i, g in got.groupby("id") if kept[i]) and set(got.id) >= set(np.flatnonzero(kept))


def test_distances_near_a_limit_are_direct_ones():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 4, (70, 8)) * 0.1 + 7, rng.integers(0, 4, (90, 8)) * 0.1 + 7
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    limits = [*np.unique(d)[1:6], 0.5 * (1 + 1e-12)]  # many pairs lie on a limit
    got = blocks.distances_to_limits(a, b, "euclidean", limits)
    assert np.allclose(got, d, rtol=1e-9) and all(((got <= limit) == (d <= limit)).all() for limit in limits)


def test_bound_of_the_least_values_holds_k_of_them():
    g = np.random.default_rng(7).normal(size=(20, 1003))
    bound = neighbors._kth(g, 6)
    assert ((g <= bound[:, None]).sum(1) >= 6).all() and ((g <= bound[:, None]).sum(1) < 30).all()
    g[:, :990] = np.nan  # too few columns are left to give k bounds
    assert ((g <= neighbors._kth(g, 6)[:, None]).sum(1) == 6).all()
