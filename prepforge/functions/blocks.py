"""Joining two keyed tables block by block.

Rows that share a key are cut into blocks of bounded size by a hash of their id, and each pair of
blocks is one small numpy task.  A key that holds a third of the table becomes many tasks, and a
kernel returns summaries (a top-k, a count, a spanning forest), never the pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame import lookup, settle

BLOCK_ROWS = 4096
PIECE = 1 << 20  # distances of a piece: enough for a fast matrix product, few enough for the cache


def matrix(series) -> np.ndarray:
    """Arrow list column to a dense matrix."""
    return np.stack(series.to_numpy()).astype("float64") if len(series) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray, metric: str, slab: int = 2_000_000, product: bool = False) -> np.ndarray:
    """All distances between two bounded blocks, from direct differences (no cancellation).

    ``product`` takes Euclidean distances from a matrix product, and direct differences only where the
    product cancels more than four digits.
    """
    if metric == "cosine":
        return np.clip(1.0 - a @ b.T, 0.0, None)
    if metric == "euclidean" and product:
        na, nb, across = (a * a).sum(1), (b * b).sum(1), -2 * b.T
        out, step, few = np.empty((len(a), len(b))), max(1, PIECE // max(1, len(b))), max(1, slab // max(1, a.shape[1]))
        low = 2e-4 * max(na.max(initial=0.0), nb.max(initial=0.0))
        for at in range(0, len(a), step):
            x, piece = a[at:at + step], out[at:at + step]
            np.add(na[at:at + step, None], nb, out=piece)
            piece += x @ across
            if not len(b) or piece.min() > low:
                np.sqrt(piece, out=piece)
                continue
            i, j = np.nonzero(piece <= 1e-4 * (na[at:at + step, None] + nb))
            for s in range(0, len(i), few):
                diff = x[i[s:s + few]] - b[j[s:s + few]]
                piece[i[s:s + few], j[s:s + few]] = (diff * diff).sum(1)
            np.sqrt(piece, out=piece)
        return out
    if metric == "manhattan":
        return _city_blocks(a, b)
    out = np.empty((len(a), len(b)))
    step = max(1, slab // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt((diff * diff).sum(2))
    return out


def distances_to_limits(a: np.ndarray, b: np.ndarray, metric: str, limits: list[float]) -> np.ndarray:
    """Distances for comparisons with ``limits``: those of many columns come from a matrix product, and directly where they are near a limit."""
    out = distances(a, b, metric, product=a.shape[1] > 3)
    if metric == "euclidean" and a.shape[1] > 3:
        for s in range(0, len(a), step := max(1, PIECE // max(1, len(b)))):
            piece = out[s:s + step]
            for limit in limits:
                i, j = np.divmod(np.flatnonzero(np.abs(piece - limit) <= 1e-8 * limit), len(b))
                if len(i):
                    diff = a[s + i] - b[j]
                    piece[i, j] = np.sqrt((diff * diff).sum(1))
    return out


def _city_blocks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences, coordinate by coordinate on pieces that stay in the cache."""
    out, across = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    step = max(1, 16_384 // max(1, len(b)))
    gap = np.empty((step, len(b)))
    for i in range(0, len(a), step):
        piece, part = out[i:i + step], gap[:len(a) - i]
        for j in range(a.shape[1] if len(a) else 0):
            np.subtract(a[i:i + step, j, None], across[j], out=part)
            np.abs(part, out=part)
            piece += part
    return out


def city_codes(a: np.ndarray, b: np.ndarray) -> tuple | None:
    """(codes of a, codes of b, unit, error of each row of a, error of each row of b), None for coordinates that are not finite.

    The codes are whole numbers whose differences add up within 16 bits: a Manhattan distance is their sum in units, up to
    the errors of its two rows.
    """
    low, high = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
    with np.errstate(all="ignore"):
        ranges = high - low
        unit = max(ranges.sum() / (65_535 - a.shape[1]), ranges.max() / 32_766) or 1.0 if 0 < a.shape[1] <= 4096 else np.nan
        if not np.isfinite(65_535 * unit) or not np.isfinite(1 / unit):
            return None
    coded = []
    for x in (a, b):
        code = np.rint((x - low) / unit)
        coded.append((code.astype("int16"), np.abs(x - low - code * unit).sum(1)))
    return coded[0][0], coded[1][0], unit, coded[0][1], coded[1][1]


def city_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of the differences of codes, as unsigned 16-bit numbers."""
    out, across = np.zeros((len(a), len(b)), "uint16"), np.ascontiguousarray(b.T)
    step = max(1, 98_304 // max(1, len(b)))
    gap = np.empty((step, len(b)), "int16")
    for i in range(0, len(a), step):
        piece, part = out[i:i + step], gap[:len(a) - i]
        for j in range(a.shape[1]):
            np.subtract(a[i:i + step, j, None], across[j], out=part)
            np.abs(part, out=part)
            piece += part.view("uint16")
    return out


def block_join(left: DataFrame, right: DataFrame, key: str, kernel, schema: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Run ``kernel(left_block, right_block)`` for all block pairs of each key present on both sides.

    Both tables carry ``id``.  Block numbers come from exact counts per key.  Keys with a single
    block are packed together, about ``rows`` rows per task group, so that millions of small keys do
    not become millions of Arrow batches.
    """
    def counts(df, name):
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))

    # the inner join also drops keys that only one side has
    sizes = settle(counts(left, "__cl").join(counts(right, "__cr"), key)
                   .select(key, F.ceil(F.col("__cl") / rows).cast("int").alias("__nl"), F.ceil(F.col("__cr") / rows).cast("int").alias("__nr"),
                           (F.col("__cl") + F.col("__cr")).alias("__c")))
    single = (F.col("__nl") == 1) & (F.col("__nr") == 1)
    total = sizes.where(single).agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("c")).head()["c"]
    packs = max(1, -(-total // (2 * rows)))
    sizes = sizes.select(key, "__nl", "__nr", single.alias("__packed"),
                         F.when(single, F.expr(f"pmod(xxhash64({key}), {packs})")).otherwise(F.xxhash64(key)).alias("__g"))

    def cut(df, mine, theirs, own, other):
        out = (lookup(df, sizes, key).where("__nl IS NOT NULL")  # a hot key is split while its rows learn their blocks
               .withColumn(own, F.expr(f"CAST(pmod(xxhash64(id), {mine}) AS INT)"))
               .withColumn(other, F.explode(F.expr(f"sequence(0, {theirs} - 1)"))).drop("__nl", "__nr"))
        # fresh column ids: both sides often come from one table
        return out.select(*[F.col(c).alias(c) for c in out.columns])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ka, kb = a[key].to_numpy(), b[key].to_numpy()
        oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
        sa, sb = ka[oa], kb[ob]
        parts = []
        for k in np.intersect1d(sa, sb):
            ia = oa[np.searchsorted(sa, k):np.searchsorted(sa, k, "right")]
            ib = ob[np.searchsorted(sb, k):np.searchsorted(sb, k, "right")]
            parts.append(kernel(a.iloc[ia], b.iloc[ib]))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({n: [] for n in names})

    names = [f.split()[0] for f in schema.split(", ")]
    groups = ["__packed", "__g", "__l", "__r"]
    l, r = cut(left, "__nl", "__nr", "__l", "__r"), cut(right, "__nr", "__nl", "__r", "__l")
    return l.groupBy(*groups).cogroup(r.groupBy(*groups)).applyInPandas(run, schema)
