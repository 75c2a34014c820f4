"""Exact top-k inner products by a dual-tree search over cover trees.

The top of the tree is a set of pivots; the rows under a pivot are cut into blocks, and every block
is a cover tree of its own (children cover their points within half the parent's radius and stand
at least that far apart).  Queries are treed in the same way.  A pair of nodes is dropped when

    <cq, cx> + rq |cx| + rx |cq| + rq rx

is below the worst k-th score of the query group.  First every query block searches its most promising
data blocks, which gives it a worst k-th score; then it visits the blocks whose bound reaches that score.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stored

PIVOTS, SAMPLE = 48, 4096        # the top of the tree comes from a bounded sample; it moves work, never results
BLOCK, QUERY_BLOCK, LEAF = 4096, 256, 128
FIRST = 2                        # blocks of the first visit
META = 1024                      # block bounds worked out at once
TOGETHER = 16                    # query blocks that share a read of a data block
BLOCKS = "block bigint, dim int, n int, radius double, center binary, ids binary, vectors binary"


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k rows, each the farthest from those before."""
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


class CoverTree:
    """Nodes over the rows of x: center, covering radius, children; leaves hold row numbers."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, most: int = 64):
        self.x, self.leaf, self.most = x, leaf, most
        self.center, self.radius, self.children, self.rows = [], [], [], []
        self.root = self._build(np.arange(len(x)), 0)
        self.center, self.radius = np.array(self.center), np.array(self.radius)
        self.norm = np.sqrt((self.center ** 2).sum(axis=1))

    def _build(self, rows: np.ndarray, center: int) -> int:
        d = np.sqrt(((self.x[rows] - self.x[center]) ** 2).sum(axis=1))
        node = len(self.children)
        self.center.append(self.x[center])
        self.radius.append(float(d.max()))
        self.children.append([])
        self.rows.append(rows)
        if len(rows) <= self.leaf or d.max() == 0:
            return node
        net, owner, far = [center], np.zeros(len(rows), dtype="int64"), d
        while far.max() > d.max() / 2 and len(net) < self.most:
            at = int(far.argmax())
            new = np.sqrt(((self.x[rows] - self.x[rows[at]]) ** 2).sum(axis=1))
            closer = new < far
            owner[closer], far = len(net), np.minimum(far, new)
            net.append(int(rows[at]))
        parts = [(rows[owner == k], c) for k, c in enumerate(net)]
        parts = [(r, c) for r, c in parts if len(r)]
        if len(parts) > 1:
            self.children[node] = [self._build(r, c) for r, c in parts]
        return node


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, through doubles where they are exact."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0 ** 53:
        return (a @ b.T).astype("int64")
    return a.astype("int64") @ b.astype("int64").T


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, worst: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best in one block; ``worst`` scores are known from elsewhere.

    Equal scores go to the smaller id.  A vector with the query's own id takes no part.
    """
    order = np.argsort(x_ids, kind="stable")
    x, x_ids = x[order], x_ids[order]
    none = np.iinfo("int64").min
    best, place = np.full((len(q), k), none), np.full((len(q), k), len(x))  # scores and places in the order of ids
    known = np.full(len(q), -np.inf) if worst is None else worst.astype("float64")
    tq, tx = CoverTree(q), CoverTree(x)

    def floor_of(rows):
        mine = best[rows].min(axis=1)
        return np.maximum(np.where(mine == none, -np.inf, mine.astype("float64")), known[rows]).min()

    def bounds(node, others):
        c, r = tq.center[node], tq.radius[node]
        dots = tx.center[others] @ c
        ub = dots + r * tx.norm[others] + tx.radius[others] * (tq.norm[node] + r)
        return ub + 1.0 + 1e-9 * np.abs(ub)

    def visit(node, others):
        rows = tq.rows[node]
        ub = bounds(node, others)
        others = others[ub >= floor_of(rows)]
        if not len(others):
            return
        if tq.children[node]:
            for child in tq.children[node]:
                visit(child, others)
            return
        heap = [(-u, o) for u, o in zip(bounds(node, others).tolist(), others.tolist())]
        heapq.heapify(heap)
        while heap:
            u, o = heapq.heappop(heap)
            if -u < floor_of(rows):
                return
            if tx.children[o]:
                down = np.array(tx.children[o])
                for v, c in zip(bounds(node, down).tolist(), down.tolist()):
                    heapq.heappush(heap, (-v, c))
                continue
            at = tx.rows[o]
            scores = products(q[rows], x[at])
            places = np.where(q_ids[rows][:, None] == x_ids[at][None, :], len(x), at[None, :])
            scores = np.concatenate([best[rows], np.where(places == len(x), none, scores)], axis=1)
            places = np.concatenate([place[rows], places], axis=1)
            order = np.lexsort((places, ~scores), axis=1)[:, :k]  # ~ turns the order round without an overflow
            best[rows], place[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(places, order, 1)

    visit(tq.root, np.array([tx.root]))
    out = []
    for i, j in zip(*np.nonzero(place < len(x))):
        out.append((int(q_ids[i]), int(x_ids[place[i, j]]), int(best[i, j])))
    return out


def whole_vectors(table: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, v, dim): components as floor(scale * x); rows that cannot take part are left out."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).where(finite)
    return rows.select(F.col(key).cast("bigint").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")).alias("v"), F.size(vector).alias("dim"))


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """One row for each block: rows near one pivot, at most about ``rows`` of them, spread by a hash of the id."""
    sample = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
    pivots = {d: farthest_first(np.array([r["v"] for r in sample if r["dim"] == d], dtype="float64"), PIVOTS) for d in {r["dim"] for r in sample}}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell, lists = np.zeros(len(dims), dtype="int64"), batch.column(1)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("float64"), np.concatenate([[0], np.cumsum(dims)])
            for d in np.unique(dims).tolist():
                here = np.flatnonzero(dims == d)
                p = pivots.get(d)
                if p is None:
                    continue
                x = flat[(at[here][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                cell[here] = ((p ** 2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2), pa.array(cell)], names=["id", "v", "dim", "cell"])

    placed = stored(vectors.select("id", "v", "dim").mapInArrow(near, "id bigint, v array<bigint>, dim int, cell bigint"), "placed")
    # at most PIVOTS cells for each vector length
    sizes = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n")).select("dim", "cell", F.ceil(F.col("n") / rows).cast("int").alias("parts"))
    numbered = placed.join(F.broadcast(sizes), ["dim", "cell"])
    block = F.xxhash64("dim", "cell", F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")))

    def pack(part: pa.Table) -> pa.Table:
        dim = part.column("dim")[0].as_py()
        x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        center = x.mean(axis=0)
        radius = float(np.sqrt(((x - center) ** 2).sum(axis=1).max()))
        ids = part.column("id").to_numpy().astype("<i8")
        row = [part.column("block")[0].as_py(), dim, len(x), radius, center.astype("<f8").tobytes(), ids.tobytes(), x.astype("<i8").tobytes()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([v], t) for v, t in zip(row, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return stored(numbered.select(block.alias("block"), "dim", "id", "v").groupBy("block").applyInArrow(pack, BLOCKS), "blocks")


def block_bounds(queries: DataFrame, data: DataFrame) -> DataFrame:
    """(qb, block, ub) for all pairs of blocks of one length: groups of block centers meet groups of query centers."""
    small = lambda t, name, per: t.select("dim", F.pmod(F.col("block"), F.lit(max(1, -(-t.count() // per)))).alias(name), "block", "radius", "center")
    q, x = small(queries, "qg", META), small(data, "xg", META)
    pairs = q.select("dim", "qg").distinct().join(x.select("dim", "xg").distinct(), "dim")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        centers = lambda t: np.array([np.frombuffer(c.as_buffer(), "<f8") for c in t.column("center")])
        a, b = centers(left), centers(right)
        ra, rb = left.column("radius").to_numpy()[:, None], right.column("radius").to_numpy()[None, :]
        na, nb = np.linalg.norm(a, axis=1)[:, None], np.linalg.norm(b, axis=1)[None, :]
        ub = a @ b.T + ra * nb + rb * na + ra * rb
        ub = ub + 1.0 + 1e-9 * np.abs(ub)
        return pa.table([pa.array(np.repeat(left.column("block").to_numpy(), b.shape[0])), pa.array(np.tile(right.column("block").to_numpy(), a.shape[0])), pa.array(ub.ravel())], names=["qb", "block", "ub"])

    left = q.join(pairs, ["dim", "qg"])
    right = x.join(pairs.withColumnsRenamed({"qg": "qh"}), ["dim", "xg"]).select("dim", "qh", F.col("xg").alias("xh"), "block", "radius", "center")
    return left.groupBy("dim", "qg", "xg").cogroup(right.groupBy("dim", "qh", "xh")).applyInArrow(run, "qb bigint, block bigint, ub double")


def visit_pairs(pairs: DataFrame, queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """(qb, query_id, vec_id, score): the k best of every query in every block of ``pairs`` (qb, block, worst)."""
    pairs = pairs.withColumn("share", F.pmod(F.xxhash64("qb"), F.lit(max(1, -(-queries.count() // TOGETHER)))))
    mine = queries.select(F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    left = pairs.join(mine, F.col("qb") == F.col("q_block")).select("block", "share", "qb", "worst", "q_dim", "q_ids", "q_vectors")
    right = data.join(pairs.select(F.col("block").alias("x_block"), F.col("share").alias("x_share")).distinct(), F.col("block") == F.col("x_block")).select("x_block", "x_share", "dim", "ids", "vectors")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            dim = right.column("dim")[0].as_py()
            array = lambda v, t: np.frombuffer(v.as_buffer(), t)
            x, x_ids = array(right.column("vectors")[0], "<i8").reshape(-1, dim).astype("float64"), array(right.column("ids")[0], "<i8")
            for i in range(left.num_rows):
                q, q_ids = array(left.column("q_vectors")[i], "<i8").reshape(-1, dim).astype("float64"), array(left.column("q_ids")[i], "<i8")
                w = left.column("worst")[i].as_py()
                out += [(left.column("qb")[i].as_py(), *r) for r in search(q, q_ids, x, x_ids, k, None if w is None else np.full(len(q), float(w)))]
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["qb", "query_id", "vec_id", "score"])

    return left.groupBy("block", "share").cogroup(right.groupBy("x_block", "x_share")).applyInArrow(run, "qb bigint, query_id bigint, vec_id bigint, score bigint")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_all(table: DataFrame, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose key is divisible by ``every``, against all other rows.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do null keys;
    vectors meet only vectors of their length.  Rows with the query's own key are no candidates; of
    repeated query keys one row asks (the least vector), other repeated rows are candidates each.  Scores must fit
    a long.  An empty table gives an empty one; other columns are not read.
    """
    vectors = whole_vectors(table, key, vector, scale)
    asked = vectors.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("v", "dim")).alias("s")).select("id", "s.v", "s.dim")
    data, queries = blocks(vectors, BLOCK), blocks(asked, QUERY_BLOCK)
    bounds = stored(block_bounds(queries, data), "bounds")
    order = Window.partitionBy("qb").orderBy(F.desc("ub"), "block")
    first = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST)
    seen = stored(visit_pairs(first.select("qb", "block", F.lit(None).cast("bigint").alias("worst")), queries, data, k), "first")
    # the worst k-th score of a query block, null while one of its queries has fewer than k scores
    lists = best(seen, k).groupBy("qb", "query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n"))
    sizes = queries.select(F.col("block").alias("qb"), F.col("n").alias("all"))
    worst = lists.groupBy("qb").agg(F.min(F.when(F.col("n") >= k, F.col("s"))).alias("s"), F.sum((F.col("n") >= k).cast("int")).alias("full")).join(sizes, "qb")
    worst = worst.select("qb", F.when(F.col("full") == F.col("all"), F.col("s")).alias("worst"))
    later = bounds.join(first.select("qb", "block"), ["qb", "block"], "left_anti").join(worst, "qb", "left").where(F.col("worst").isNull() | (F.col("ub") >= F.col("worst")))
    rest = visit_pairs(stored(later.select("qb", "block", "worst"), "pairs"), queries, data, k)
    return best(seen.unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
