"""Exact k nearest neighbours as Spark jobs.

1. Equal vectors are merged on both sides: only the k+1 smallest ids of a group of copies can be
   neighbours, and one search serves all copies.
2. The base is an index: a tree of pivots that grows with the table.  A node with too many points draws
   pivots from them, each point goes to its nearest pivot, and every node keeps the radius that covers its points.
   Levels are tables; no level is collected or broadcast whole.
3. Queries go down the tree twice: first to the nearest leaves that hold enough vectors, whose k-th distance is
   a bound, then to all nodes that the triangle inequality leaves open.
4. Large leaves are cut into blocks; each block pair returns its k best rows.  Where the tree leaves much of the base open
   (many dimensions), all queries meet all points in a few large blocks instead, which sends each vector far less often.

``probe_cells`` keeps the given number of nearest nodes on every level instead: faster, approximate.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.blocks import BLOCK_ROWS, PIECE, block_join, city_codes, city_sums, distances, matrix
from ..functions.frame import col, lookup, need_columns, settle

METRICS = ("euclidean", "manhattan", "cosine")
FANOUT = 64       # pivots of a node
MAX_LEVELS = 12   # a leaf that is still larger is searched block by block
LEAF_ROWS = 8192  # below that a block comparison costs less than another level
STEP_ROWS = 512   # vectors that meet the pivots of a node at once: each may leave with a copy of itself for every pivot
SLAB = 2_000_000  # distances that a kernel holds at once
OPEN_SHARE = 0.25  # of the pairs of queries and points: from there the tree is passed by
WHOLE_BLOCKS, WHOLE_BYTES = 12, 1 << 23  # blocks of a base compared as a whole, until a block has so many bytes of vectors


def vectors(df: DataFrame, columns: list[str] | str, metric: str = "euclidean"):
    """array<double> from numeric columns or from one array column; unit length for cosine."""
    v = F.array(*[col(c).cast("double") for c in columns]) if not isinstance(columns, str) else F.transform(col(columns), lambda x: x.cast("double"))
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        v = F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))
    return v


def merge_top(df: DataFrame, k: int) -> DataFrame:
    """The k best (distance, nid) per id."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "nid"))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


class NeighborIndex:
    """The rows of a base table (row_id, v), its distinct points (id, v, node) and the levels of its pivot tree.

    A level holds (node, id, v, n, radius): the children of the nodes that are split there.  With ``parts`` rows and
    points also have a ``part`` (0 to parts - 1), a point is a vector of one part, levels count the points of each part
    (``sizes``), and a search finds the neighbours outside the part of the query.
    """

    def __init__(self, metric: str, rows: DataFrame, points: DataFrame, levels: list[DataFrame], n: int, parts: int = 0):
        self.metric, self.rows, self.points, self.levels, self.n, self.parts = metric, rows, points, levels, n, parts
        self.extra = ["part"] if parts else []

    # -- building ------------------------------------------------------------------------------

    @staticmethod
    def build(base: DataFrame, key: str, columns: list[str] | str, metric: str = "euclidean", leaf_rows: int | None = None, part: str | None = None, parts: int = 0) -> NeighborIndex:
        """Rows with a NULL in the vector are left out.  ``leaf_rows`` is the size from which a node is split.

        ``part`` names a column of integers below ``parts``, a small number; rows without one are left out.
        """
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        need_columns(base, [key])
        # written once: the vectors are grouped, joined back and compared several times below
        extra = [col(part).cast("int").alias("part")] if part else []
        rows = settle(base.select(col(key).alias("row_id"), vectors(base, columns, metric).alias("v"), *extra)).where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
        rows = rows.where(F.col("part").between(0, parts - 1)) if part else rows
        points = settle(rows.groupBy("v", *(["part"] if part else [])).agg(F.min("row_id").alias("id")))
        n = points.count()
        placed, levels = _tree(points.withColumn("node", F.lit(0).cast("bigint")), n, metric, LEAF_ROWS if leaf_rows is None else leaf_rows, parts if part else 0)
        return NeighborIndex(metric, rows, placed, levels, n, parts if part else 0)

    def save(self, path: str) -> None:
        """The index as Parquet below a path that all machines share."""
        self.rows.write.parquet(f"{path}/rows")
        self.points.write.parquet(f"{path}/points")
        for i, level in enumerate(self.levels):
            level.write.parquet(f"{path}/level-{i}")
        facts = json.dumps({"metric": self.metric, "levels": len(self.levels), "n": self.n, "parts": self.parts})
        self.rows.sparkSession.createDataFrame([(facts,)], "value string").coalesce(1).write.text(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> NeighborIndex:
        facts = json.loads(spark.read.text(f"{path}/facts").head()[0])
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return NeighborIndex(facts["metric"], read("rows"), read("points"), [read(f"level-{i}") for i in range(facts["levels"])], facts["n"], facts.get("parts", 0))

    # -- searching -----------------------------------------------------------------------------

    def search(self, query: DataFrame, k: int, include_self: bool = True, probe_cells: int | None = None) -> DataFrame:
        """(query_id, neighbor_id, distance, rank) for a query table (row_id, v); ties go to the smaller neighbour id.

        With parts the query table has a ``part`` too.
        """
        return take(self.lists(query, k if include_self else k + 1, probe_cells), k, include_self)

    def lists(self, query: DataFrame, depth: int, probe_cells: int | None = None) -> DataFrame:
        """(row_id, best) with the ``depth`` nearest rows (distance, nid) of each query, itself included; see ``take``."""
        place = ["v", *self.extra]
        queries = query.groupBy(*place).agg(F.min("row_id").alias("id"))
        # one key may stand in several parts
        queries = settle(queries.withColumn("id", F.monotonically_increasing_id()) if self.parts else queries)
        found = settle(self._distinct(queries, depth, probe_cells))
        # the copies of a neighbour, at most `depth`, as one row for each vector
        copy = F.row_number().over(Window.partitionBy(*place).orderBy("row_id"))
        copies = self.rows.withColumn("copy", copy).where(F.col("copy") <= depth).groupBy(*place).agg(F.collect_list("row_id").alias("members"))
        copies = settle(copies.join(self.points.select("id", *place), place).select(F.col("id").alias("nid"), *self.extra, "members"))
        if self.parts:
            found, copies = (t.withColumn("nid", F.struct("nid", "part")).drop("part") for t in (found, copies))
        named = lookup(found, copies, "nid").select("id", "distance", F.explode("members").alias("nid"))  # a hub is split
        best = named.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "nid"))), 1, depth).alias("best"))
        spot = (F.struct("v", "part") if self.parts else F.col("v")).alias("spot")
        best = settle(queries.join(best, "id").select(spot, "best"))
        return lookup(query.select("row_id", spot), best, "spot").where("best IS NOT NULL").select("row_id", "best")  # so is a vector with many copies

    def _distinct(self, queries: DataFrame, k: int, probe_cells: int | None) -> DataFrame:
        """(id, nid, [part of the neighbour,] distance) with the k nearest distinct vectors."""
        id_type, q_type = self.points.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
        shape = f"id {q_type}, nid {id_type}, distance double" + (", part int" if self.parts else "")
        search, rows = (top_outside_part if self.parts else top_of_block)(k, self.metric), min(BLOCK_ROWS, max(256, self.n // 4))
        start = queries.select("id", "v", *self.extra, F.lit(float("inf")).alias("bound"), F.lit(0).cast("bigint").alias("node"))

        def leaves(frontier, points=self.points, rows=rows):
            return merge_top(block_join(frontier.select("id", "v", *self.extra, "node"), points, "node", search, shape, rows), k).drop("rank")

        if not self.levels:
            return leaves(start)
        if probe_cells:
            return leaves(self._down(start, lambda d, n, radius, bound: np.ones(d.shape, dtype=bool), probe_cells))

        def enough(d, n, radius, bound):
            order = np.argsort(d, axis=1, kind="stable")
            held = np.take_along_axis(n, order, axis=1)
            before = np.cumsum(held, axis=1) - held
            taken = np.zeros(d.shape, dtype=bool)
            np.put_along_axis(taken, order, before < k, axis=1)
            return taken

        def within(d, n, radius, bound):
            return d - radius <= bound[:, None] * (1 + 1e-9) + 1e-9

        near = leaves(self._down(start, enough))
        bound = near.groupBy("id").agg(F.max("distance").alias("bound"), F.count(F.lit(1)).alias("c"))
        reach = F.sqrt(2 * F.greatest("bound", F.lit(0.0))) if self.metric == "cosine" else F.col("bound")
        bound = bound.select("id", F.when(F.col("c") >= k, reach).otherwise(float("inf")).alias("bound"))
        bounded = settle(start.drop("bound").join(bound, "id").select("id", "v", *self.extra, "bound", "node"))
        if self._open(bounded, within) < OPEN_SHARE:
            return leaves(self._down(bounded, within))
        width = self.points.select(F.max(F.size("v"))).head()[0]
        whole = max(2048, min(self.n // WHOLE_BLOCKS, WHOLE_BYTES // (8 * max(1, width))))
        return leaves(start, self.points.withColumn("node", F.lit(0).cast("bigint")), whole)

    def _open(self, frontier: DataFrame, choose) -> float:
        """Share of the pairs of queries and points that ``choose`` leaves open on the first level; no pairs are made."""
        space = "manhattan" if self.metric == "manhattan" else "euclidean"

        def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            n = b["n"].to_numpy()
            d = distances(matrix(a["v"]), matrix(b["v"]), space, product=True)
            left = choose(d, np.broadcast_to(n, d.shape), b["radius"].to_numpy(), a["bound"].to_numpy())
            return pd.DataFrame({"open": [float((left * n).sum())], "all": [float(n.sum()) * len(a)]})

        met = block_join(frontier.select("id", "v", "bound", "node"), self.levels[0].select("id", "v", "node", "n", "radius"), "node", count, "open double, all double")
        met = met.agg(F.sum("open").alias("open"), F.sum("all").alias("all")).head()
        return met["open"] / met["all"] if met["all"] else 0.0

    def _down(self, frontier: DataFrame, choose, beam: int | None = None) -> DataFrame:
        """(id, v, bound, node) rows at the leaves that ``choose`` leaves open, level by level."""
        space = "manhattan" if self.metric == "manhattan" else "euclidean"  # unit vectors for cosine
        q_type, extra = frontier.schema["id"].dataType.simpleString(), self.extra

        def step(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            d = distances(matrix(a["v"]), matrix(b["v"]), space, product=True)
            n = np.broadcast_to(b["n"].to_numpy(), d.shape)
            if extra:
                n = n - matrix(b["sizes"]).astype("int64").T[a["part"].to_numpy()]
            row, at = np.nonzero(choose(d, n, b["radius"].to_numpy(), a["bound"].to_numpy()))
            picked = a.iloc[row]
            return pd.DataFrame({"id": picked["id"].to_numpy(), "v": picked["v"].to_numpy(), **{c: picked[c].to_numpy() for c in extra}, "bound": picked["bound"].to_numpy(), "node": b["id"].to_numpy()[at], "d": d[row, at]})

        shape = f"id {q_type}, v array<double>, {'part int, ' if extra else ''}bound double, node bigint, d double"
        frontier, done = frontier.withColumn("d", F.lit(0.0)), None
        for i, level in enumerate(self.levels):
            if i:
                split = lookup(frontier, level.select("node").distinct().withColumn("split", F.lit(True)), "node")
                rest, frontier = split.where("split IS NULL").drop("split"), split.where("split").drop("split")
                done = rest if done is None else done.unionByName(rest)
            frontier = block_join(frontier, level.select("id", "v", "node", "n", "radius", *(["sizes"] if extra else [])), "node", step, shape, STEP_ROWS)
            if beam:
                best = frontier if done is None else done.unionByName(frontier)
                place = F.row_number().over(Window.partitionBy("id").orderBy("d", "node"))
                frontier, done = best.withColumn("place", place).where(F.col("place") <= beam).drop("place"), None
            if i + 1 < len(self.levels):
                frontier = settle(frontier)
                done = None if done is None else settle(done)
        return (frontier if done is None else done.unionByName(frontier)).drop("d")


def take(lists: DataFrame, k: int, include_self: bool = True) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) of the k nearest rows in lists of at least k rows, k + 1 without the row itself."""
    mine = F.col("best") if include_self else F.filter(F.slice("best", 1, k + 1), lambda b: b["nid"] != F.col("row_id"))
    out = lists.select(F.col("row_id").alias("query_id"), F.posexplode(F.slice(mine, 1, k)).alias("pos", "b"))
    return out.select("query_id", F.col("b.nid").alias("neighbor_id"), F.col("b.distance").alias("distance"), (F.col("pos") + 1).alias("rank"))


def _tree(points: DataFrame, n: int, metric: str, leaf_rows: int, parts: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """((id, v, [part,] node) with the leaf of each point, levels)."""
    extra = ["part"] if parts else []
    space, levels, leaves, open_ = "manhattan" if metric == "manhattan" else "euclidean", [], None, points
    id_type = points.schema["id"].dataType.simpleString()

    def assign(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = distances(matrix(a["v"]), matrix(b["v"]), space, product=True)
        at = d.argmin(1)
        return pd.DataFrame({"id": a["id"].to_numpy(), "v": a["v"].to_numpy(), **{c: a[c].to_numpy() for c in extra}, "node": b["id"].to_numpy()[at], "reach": d[np.arange(len(d)), at]})

    for level in range(MAX_LEVELS):
        if level:
            large = open_.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > leaf_rows).select("node", F.lit(True).alias("large"))
            large = settle(large)
            if not large.limit(1).count():
                break
            marked = lookup(open_, large, "node")
            small = marked.where("large IS NULL").drop("large")
            leaves = small if leaves is None else leaves.unionByName(small)
            open_ = marked.where("large").drop("large")
        elif n <= leaf_rows:
            break
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("id", F.lit(level)), "id"))
        pivots = open_.withColumn("place", place).where(F.col("place") <= FANOUT)
        number = F.lit((level + 1) << 52) + F.monotonically_increasing_id()
        pivots = settle(pivots.select("node", number.alias("id"), "v"))
        moved = settle(block_join(open_, pivots, "node", assign, f"id {id_type}, v array<double>, {'part int, ' if parts else ''}node bigint, reach double"))
        sizes = [F.array(*[F.count_if(F.col("part") == i) for i in range(parts)]).alias("sizes")] if parts else []
        cover = moved.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius"), *sizes)
        levels.append(settle(pivots.join(cover, "id").select("node", "id", "v", "n", "radius", *(["sizes"] if parts else []))))
        open_ = moved.drop("reach")
    return (open_ if leaves is None else leaves.unionByName(open_)), levels


def nearest_neighbors(query: DataFrame, base: DataFrame, k: int, key: str, columns: list[str] | str,
                      metric: str = "euclidean", include_self: bool = True, probe_cells: int | None = None, leaf_rows: int | None = None) -> DataFrame:
    """(query_id, neighbor_id, distance, rank); ties go to the smaller neighbour id.

    ``include_self=False`` leaves out the row whose key equals the query's key.  Rows with a NULL in
    the vector are not compared.  With ``probe_cells`` leaves hold about four times the root of the rows, at every size.
    """
    need_columns(query, [key])
    if probe_cells and leaf_rows is None:
        leaf_rows = max(16, min(LEAF_ROWS, 4 * math.isqrt(base.count())))
    index = NeighborIndex.build(base, key, columns, metric, leaf_rows)
    if query is base:
        asked = index.rows
    else:
        asked = settle(query.select(col(key).alias("row_id"), vectors(query, columns, metric).alias("v"))).where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    return index.search(asked, k, include_self, probe_cells)


def nearest_outside(df: DataFrame, k: int, key: str, columns: list[str] | str, part: str, parts: int, metric: str = "euclidean", leaf_rows: int | None = None) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) of the nearest rows in other parts (folds): one index and one search serve all parts."""
    need_columns(df, [part])
    index = NeighborIndex.build(df, key, columns, metric, leaf_rows, part, parts)
    return index.search(index.rows, k)


def top_outside_part(k: int, metric: str):
    """``top_of_block`` among the rows of other parts, with the neighbours' parts."""
    top = top_of_block(k, metric, ["part"])

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = a["part"].to_numpy(), b["part"].to_numpy()
        return pd.concat([top(a[mine == p], b[theirs != p]) for p in np.unique(mine)] or [top(a, b)], ignore_index=True)
    return search


def top_of_block(k: int, metric: str, extra: list[str] | None = None):
    """Kernel with the k best rows per query of one block pair, a slab of queries at a time, and the columns ``extra`` of those rows.

    Euclidean: a matrix product gives distances up to rounding, Manhattan: sums of 16-bit codes give them up to the error
    of the codes; every pair that could belong to the best k within that error is then measured exactly.
    """
    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in ["id", "nid", "distance", *(extra or [])]})
        b = b.sort_values("id", kind="stable")
        ids, nids = a["id"].to_numpy(), b["id"].to_numpy()
        x, y = matrix(a["v"]), matrix(b["v"])
        step = max(16, PIECE // len(y)) if metric == "euclidean" else max(1, SLAB // len(y))
        codes = city_codes(x, y) if metric == "manhattan" and len(y) > k else None
        parts = [codes and _city_top(x, y, k, codes, slice(s, s + step)) or _slab_top(x[s:s + step], y, k, metric) for s in range(0, len(x), step)]
        row = np.concatenate([p[0] + i * step for i, p in enumerate(parts)])
        at, d = (np.concatenate([p[j] for p in parts]) for j in (1, 2))
        return pd.DataFrame({"id": ids[row], "nid": nids[at], "distance": d, **{c: b[c].to_numpy()[at] for c in extra or []}})
    return search


def _slab_top(x: np.ndarray, y: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k best rows for each row of x, ties to the earlier row of y."""
    if metric == "euclidean" and len(y) > k:
        nx, ny = (x * x).sum(1), (y * y).sum(1)
        g = nx[:, None] + ny[None, :]
        g -= 2 * x @ y.T
        row, at = np.divmod(np.flatnonzero(g <= (_kth(g, k) + 1e-11 * (nx + ny.max()))[:, None]), len(y))
        d = np.empty(len(row))
        for s in range(0, len(row), 100_000):
            diff = x[row[s:s + 100_000]] - y[at[s:s + 100_000]]
            d[s:s + 100_000] = np.sqrt((diff * diff).sum(1))
    else:
        full = distances(x, y, metric)
        if len(y) > k:  # all pairs up to the k-th distance, ties and NaN included
            row, at = np.nonzero(~(full > np.partition(full, k - 1, axis=1)[:, k - 1:k]))
        else:
            row, at = np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))
        d = full[row, at]
    return _first(row, at, d, k)


def _kth(g: np.ndarray, k: int) -> np.ndarray:
    """A bound for each row that at least k of its values keep, near the k-th: the k-th of the least values of 16 columns each."""
    width = g.shape[1] // 16
    if width < 4 * k:
        return np.partition(g, k - 1, axis=1)[:, k - 1]
    least = g[:, :width].copy()
    for i in range(1, 16):
        np.fmin(least, g[:, i * width:(i + 1) * width], out=least)
    kth = np.partition(least, k - 1, axis=1)[:, k - 1]
    return np.partition(g, k - 1, axis=1)[:, k - 1] if np.isnan(kth).any() else kth


def _first(row: np.ndarray, at: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((at, d, row))
    row, at, d = row[order], at[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], at[keep], d[keep]


def _city_top(x: np.ndarray, y: np.ndarray, k: int, codes: tuple, slab: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """``_slab_top`` of Manhattan distances by ``city_codes``; None where the codes leave too many pairs open."""
    a, b, unit, wrong, off = codes
    sums = city_sums(a[slab], b)
    # k rows lie within the k-th sum and the two errors, and a row as near as those has a sum within these errors again
    limit = _kth(sums, k) + np.ceil(2 * (wrong[slab] + off.max()) / unit) + 2
    hit = np.flatnonzero(sums <= np.minimum(limit, 65_535).astype("uint16")[:, None])
    if len(hit) > max(sums.size // 20, 2 * k * len(sums)):
        return None
    row, at = np.divmod(hit, len(y))
    d, mine = np.zeros(len(row)), x[slab]
    for j in range(x.shape[1]):
        d += np.abs(mine[row, j] - y[at, j])
    return _first(row, at, d, k)


def knn_graph(df: DataFrame, key: str, columns: list[str] | str, k: int = 15, metric: str = "euclidean") -> DataFrame:
    """Neighbour graph (src, dst, distance, rank) without self loops."""
    return graph_edges(nearest_neighbors(df, df, k, key, columns, metric, include_self=False))


def graph_edges(near: DataFrame) -> DataFrame:
    return near.select(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"), "distance", "rank")
