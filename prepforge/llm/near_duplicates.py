"""N-gram Jaccard join: texts whose sets of word n-grams overlap by a threshold or more.

1. Each text becomes its set of n-gram hashes; texts with equal sets are copies and count as one.
2. MinHash signatures in bands; band and row counts follow from the recall wanted at the threshold.
   The shuffle is on band hashes, and a bucket only ties its members to its smallest one.
3. Texts tied together form groups of candidates; a group is cut into blocks of bounded size, and
   each pair of blocks is verified on the full sets by a product of incidence matrices.
4. A task returns link counts and a spanning forest, never the pairs; forests give the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frame import lookup
from ..functions.graph import connected_components
from .storage import fits, free_names, stored
from .tokens import slices

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 5
BLOCK_TEXTS, BLOCK_GRAMS = 512, 1 << 20


def band_count(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` hashes that find a pair at the threshold with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows)))


class Grams:
    """Sets of n-gram hashes, lower case, words as the white space leaves them."""

    def __init__(self, n: int):
        self.n = n
        self.words: dict[bytes, int] = {}
        self.factors = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(n)], dtype="uint64")

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct hashes, sorted; a text of fewer words is one gram, a text without words has none."""
        words = (text or "").lower().encode().split()
        if not words:
            return np.zeros(0, dtype="uint64")
        if len(words) < self.n:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype="uint64")
        known = self.words
        if len(known) > 200_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype="uint64", count=len(words))
        grams = np.zeros(len(words) - self.n + 1, dtype="uint64")
        for i in range(self.n):
            x = h[i:len(grams) + i] * self.factors[i]
            grams = (grams ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x
        grams ^= grams >> np.uint64(31)
        return np.unique(grams)


def hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_003)
    return rng.integers(0, 1 << 63, k, dtype="uint64") * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype="uint64")


def signature(grams: np.ndarray, factors: np.ndarray, offsets: np.ndarray, piece: int = 4096) -> np.ndarray:
    low = np.full(len(factors), np.iinfo("uint64").max, dtype="uint64")
    for i in range(0, len(grams), piece):
        low = np.minimum(low, (grams[None, i:i + piece] * factors[:, None] + offsets[:, None]).min(axis=1))
    return low


def signatures(documents: DataFrame, n: int, bands: int, rows: int, text: str = "text") -> DataFrame:
    """(doc_id, fp, grams, bands): fp is a digest of the set, grams its size, bands the band hashes; no set, no fp."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, (factors, offsets) = Grams(n), hash_family(bands * rows)
        mix = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(rows)], dtype="uint64")
        for part in slices(batches, release=[make.words.clear]):
            fps, sizes, hashes = [], [], []
            for t in part.column(1).to_pylist():
                grams = make(t)
                sizes.append(len(grams))
                if not len(grams):
                    fps.append(None)
                    hashes.append(None)
                    continue
                fps.append(hashlib.md5(grams).digest())
                low = signature(grams, factors, offsets).reshape(bands, rows)
                h = ((low ^ (low >> np.uint64(32))) * mix).sum(axis=1, dtype="uint64")
                hashes.append((h ^ (h >> np.uint64(29))).view("int64").tolist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "fp", "grams", "bands"])

    return documents.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, fp binary, grams bigint, bands array<bigint>")


def candidate_edges(texts: DataFrame) -> DataFrame:
    """(src, dst): members of a band's bucket tied to its smallest member; ``texts`` has node and bands.  Large buckets are split."""
    rows = texts.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.struct("band", "hash").alias("bucket"))
    least = rows.groupBy("bucket").agg(F.min("node").alias("dst"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    return lookup(rows, stored(least, "buckets"), "bucket").where("node <> dst").select(F.col("node").alias("src"), "dst").distinct()


def overlap(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all sets of b."""
    out = np.zeros((len(a), len(b)), dtype="float32")
    grams, inverse = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    seen_a = np.zeros(len(grams), dtype=bool)
    cut = sum(map(len, a))
    seen_a[inverse[:cut]] = True
    seen_b = np.zeros(len(grams), dtype=bool)
    seen_b[inverse[cut:]] = True
    number = np.cumsum(seen_a & seen_b) - 1
    shared = int(number[-1]) + 1 if len(number) else 0
    use = (seen_a & seen_b)[inverse]
    col = number[inverse]
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    (ca, ra), (cb, rb) = (col[:cut][use[:cut]], ra[use[:cut]]), (col[cut:][use[cut:]], rb[use[cut:]])
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ca, ra, cb, rb = ca[oa], ra[oa], cb[ob], rb[ob]
    for lo in range(0, shared, width):
        hi = min(shared, lo + width)
        ma, mb = np.zeros((len(a), hi - lo), dtype="float32"), np.zeros((len(b), hi - lo), dtype="float32")
        ia, ib = slice(*np.searchsorted(ca, [lo, hi])), slice(*np.searchsorted(cb, [lo, hi]))
        ma[ra[ia], ca[ia] - lo] = 1
        mb[rb[ib], cb[ib] - lo] = 1
        out += ma @ mb.T
    return out


def forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of an edge list over n nodes."""
    root, kept = list(range(n)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(left.tolist(), right.tolist()):
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((x, y))
    return kept


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """(node, other, texts, documents) from (grp, node, copies, grams: sets) by blocks.

    Rows with ``other`` are edges of a forest; the others count the links a block pair found for a node,
    by different texts and by documents.  Small groups share a task, a large one becomes block pairs.
    """
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("set")).alias("g"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("g") / BLOCK_GRAMS)).cast("int")
    sizes = stored(sizes.select("grp", blocks.alias("blocks"), "g"), "groups")
    small = sizes.where("blocks = 1").agg(F.coalesce(F.sum("g"), F.lit(0))).head()[0]
    packs = max(1, -(-small // (BLOCK_GRAMS // 2)))
    rows = lookup(members, sizes.drop("g"), "grp")  # a large group is split while its rows learn their blocks
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("mine", "theirs")).withColumn("j", F.greatest("mine", "theirs"))
    rows = rows.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(packs))).otherwise(F.xxhash64("grp")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, i, j), group in part.groupby(["grp", "i", "j"], sort=False):
            group = group.sort_values("node")
            nodes, copies = group["node"].to_numpy(), group["copies"].to_numpy()
            sets = [np.asarray(s, dtype="int64") for s in group["set"]]
            size = np.array([len(s) for s in sets], dtype="float64")
            a, b = np.flatnonzero(group["mine"].to_numpy() == i), np.flatnonzero(group["mine"].to_numpy() == j)
            if not len(a) or not len(b):
                continue
            common = overlap([sets[k] for k in a], [sets[k] for k in b]).astype("float64")
            link = common >= threshold * (size[a][:, None] + size[b][None, :] - common) - 1e-9
            if i == j:
                np.fill_diagonal(link, False)
            for x, y, l in ((a, b, link), (b, a, link.T)) if i != j else ((a, b, link),):
                texts, docs = l.sum(axis=1), l @ copies[y]
                out += [(n, None, int(t), int(d)) for n, t, d in zip(nodes[x].tolist(), texts, docs) if t]
            left, right = np.nonzero(link)
            out += [(int(nodes[y]), int(nodes[x]), 0, 0) for x, y in forest(len(nodes), a[left], b[right])]
        columns = list(zip(*out)) or [[]] * 4
        # 64-bit numbers beside nulls must not become doubles
        return pd.DataFrame({name: pd.array(list(c), dtype="Int64") for name, c in zip(("node", "other", "texts", "documents"), columns)})

    return rows.groupBy("task", "i", "j").applyInPandas(run, "node bigint, other bigint, texts bigint, documents bigint")


def classes(documents: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, text: str = "text") -> DataFrame:
    """(doc_id, fp, class_id, links, text_links) for every row.

    Linked documents, directly or through others, share the smallest doc_id as their class.  ``links``
    counts the other documents at or above the threshold, copies among them; ``text_links`` counts
    different n-gram sets.  Repeated rows are copies.  Null and empty texts have no n-grams and no links:
    each row is its own class (a null doc_id gives a null class).  A row with a null doc_id takes part by
    its text.  An empty table gives an empty one.
    """
    bands = band_count(threshold, recall, rows)
    signed = stored(signatures(documents, n, bands, rows, text), "signatures")
    by_set = signed.where("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    # two sets may share a doc_id when rows repeat it, so a node is a number of its own
    texts = stored(by_set.select("fp", F.col("node").alias("least"), "copies", "bands", F.xxhash64("fp").alias("node")), "texts")
    groups = connected_components(candidate_edges(texts))
    members = stored(texts.join(groups.withColumnsRenamed({"id": "node", "root": "grp"}), "node").select("fp", "node", "least", "copies", "grp"), "members")
    found = stored(verified(stored(gram_sets(documents, members, n, text), "sets"), threshold), "links")
    joined = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    known = members.select("node", "fp", "least").join(joined.withColumnsRenamed({"id": "node"}), "node").join(counts, "node")
    least = known.groupBy("root").agg(F.min("least").alias("class_id"))
    known = known.join(least, "root").select("fp", "class_id", "texts", "documents")
    every = texts.select("fp", "least", "copies").join(known, "fp", "left")
    every = every.select("fp", F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("documents", F.lit(0))).alias("links"), F.coalesce("texts", F.lit(0)).alias("text_links"))
    out = lookup(signed.select("doc_id", "fp"), every, "fp")  # a set that many documents share is split
    return out.select("doc_id", "fp", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links"))


def gram_sets(documents: DataFrame, members: DataFrame, n: int, text: str = "text") -> DataFrame:
    """``members`` with their n-gram sets, made anew from one document of each."""
    wanted = members.select(F.col("least").alias("w_doc"), F.col("fp").alias("w_fp"), "node", "copies", "grp")
    small = fits(wanted, 200_000)
    picked = documents.select("doc_id", F.col(text).alias("text")).join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("w_doc")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Grams(n)
        for part in slices(batches, release=[make.words.clear]):
            sets, keep = [], []
            for i, (t, fp) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                grams = make(t)
                if len(grams) and hashlib.md5(grams).digest() == fp:
                    keep.append(i)
                    sets.append(grams.view("int64"))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype("int32")
            values = pa.array(np.concatenate(sets) if sets else np.zeros(0, "int64"))
            rows = part.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in (2, 3, 4)], pa.ListArray.from_arrays(pa.array(offsets), values)], names=["node", "copies", "grp", "set"])

    made = picked.select("text", "w_fp", "node", "copies", "grp").mapInArrow(run, "node bigint, copies bigint, grp bigint, set array<bigint>")
    # a doc_id that several rows share may bring one set more than once
    return made.dropDuplicates(["node"])


def keep_one(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """One document of each class, the smallest doc_id; all columns of any name, whole texts.

    Null and empty texts and rows with a null doc_id stay; of rows that repeat a doc_id one stays; an empty table
    gives an empty one.
    """
    l_doc, t_doc = free_names(documents, "l_doc", "t_doc")
    rows = stored(classes(documents, text=text, **options).select("doc_id", "class_id"), "classes")
    drop = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("times"), F.max(F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull())).alias("keep"))
    lost = drop.where("NOT keep").select(F.col("doc_id").alias(l_doc))
    twice = drop.where("times > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(t_doc))
    lost = F.broadcast(lost) if fits(lost, 200_000) else lost
    kept = documents.join(lost, F.col("doc_id") == F.col(l_doc), "left_anti")
    if fits(twice, 0):
        return kept
    twice = F.broadcast(twice) if fits(twice, 200_000) else twice
    single = kept.join(twice, F.col("doc_id") == F.col(t_doc), "left_anti")
    return single.unionByName(kept.join(twice, F.col("doc_id") == F.col(t_doc), "left_semi").dropDuplicates(["doc_id"]))
