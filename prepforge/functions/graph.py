"""Connected components: forests of partitions, then alternating star operations on the edge table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import lookup, settle, small_or_none

# A graph proved to have at most this many edges is solved in one task; larger ones by rounds, with equal results.
ONE_TASK_EDGES = 200_000


def smallest_roots(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of the component of each) for the edges of one block."""
    nodes, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = codes[:len(src)], codes[len(src):]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        hooked = root.copy()
        np.minimum.at(hooked, root[a], least)
        np.minimum.at(hooked, root[b], least)
        while True:  # every node points at the end of its chain
            further = hooked[hooked]
            if (further == hooked).all():
                break
            hooked = further
        if (hooked == root).all():
            return nodes, nodes[root]
        root = hooked


def _stars(edges: DataFrame) -> DataFrame:
    """Each Arrow batch replaced by one star for each of its components."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                nodes, roots = smallest_roots(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
                keep = nodes != roots
                yield pd.DataFrame({"src": nodes[keep], "dst": roots[keep]})

    return edges.select("src", "dst").mapInPandas(run, f"src {kind}, dst {kind}")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.union(edges.select("dst", "src")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return lookup(both.where("v > u"), least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = lookup(down, least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    return tied.union(least.select("u", "m")).where("src <> dst").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, root) for every node of (src, dst) with two different ends; root is the smallest id of the component.

    Batches are first reduced to stars.  A small rest is solved in one task; otherwise rounds, whose number
    grows with the logarithm of the longest path, are checkpointed each, and the loop ends when count and
    checksum of the edges no longer change.  Hubs, to which in the end most nodes are tied, are split by ``lookup``.
    """
    kind = edges.schema["src"].dataType.simpleString()
    state, previous = settle(_stars(edges.select("src", "dst").where("src <> dst")).distinct()), None
    if small_or_none(state, ONE_TASK_EDGES):
        def whole(batches):
            parts = [pdf for pdf in batches if len(pdf)]
            if parts:
                nodes, roots = smallest_roots(*(np.concatenate([p[c].to_numpy() for p in parts]) for c in ("src", "dst")))
                yield pd.DataFrame({"id": nodes, "root": roots})
        return state.coalesce(1).mapInPandas(whole, f"id {kind}, root {kind}")
    for _ in range(max_rounds):
        state = settle(_small_star(_large_star(state)))
        check = state.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")).head()
        if previous == tuple(check):
            roots = state.select(F.col("dst").alias("id")).distinct()
            return state.select(F.col("src").alias("id"), F.col("dst").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))
        previous = tuple(check)
    raise RuntimeError("components did not settle")
