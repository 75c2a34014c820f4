"""Document log probabilities under a log-bilinear neural language model.

1. Every text becomes word codes of a local dictionary, one table row for each chunk of texts.
2. Word counts of all training documents are summed over the cluster.
3. The model sees classes: the most frequent words stand for themselves, all others share classes by
   their endings.  Counts of (class before, class) are summed over all training tokens, at distances
   one and two: tables whose size depends on the class numbers only.
4. On those tables one log-bilinear model for each distance is trained in numpy by noise-contrastive
   estimation, in its expected form over all cells.  Matrix products then give the normalised
   log probabilities of all classes after all classes.
5. A token's probability mixes the distances and, inside a shared class, takes the word's smoothed
   share of it; summed over all words, with one place for unseen words in each class, it is one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .tokens import slices

TOP_WORDS, ENDINGS, WIDTH, NOISE, ROUNDS = 512, 160, 24, 8, 160
DISTANCES = 2
RIDGE = 10.0
CHUNK_BYTES = 8_000_000
PRIOR = 0.1
END = xxhash.xxh3_64_intdigest(b" end") - (1 << 63)  # no word holds a space
CHUNKS = "chunk bigint, doc_ids array<bigint>, held array<boolean>, sizes array<int>, codes binary, words array<bigint>, endings array<int>, counts array<bigint>"


def is_held_out(doc_id, folds: int = 10) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def ending_class(word: bytes, endings: int = ENDINGS) -> int:
    bare = word.rstrip(b".,;:!?\"')&%$#*|")
    return zlib.crc32(bare[-3:] + (b"," if len(bare) < len(word) else b"")) % endings


def chunks(documents: DataFrame, folds: int = 10, endings: int = ENDINGS, text: str = "text") -> DataFrame:
    """One row for each chunk of texts: documents, word codes, the distinct words' hashes and training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for part in slices(batches, limit=CHUNK_BYTES):
            texts = pc.fill_null(part.column(1).cast(pa.large_string()), "")
            lists = pc.ascii_split_whitespace(texts)
            encoded = lists.flatten().dictionary_encode()
            index: dict[bytes, int] = {}
            number_of = np.array([index.setdefault(w.encode().lower(), len(index)) for w in encoded.dictionary.to_pylist()], dtype="int64")
            words = list(index)  # lower case in A-Z only, as bytes do it
            where = number_of[encoded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype="int64")
            offsets = lists.offsets.to_numpy().astype("int64")
            offsets = offsets - offsets[0]
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
            if b"" in words:  # what a split leaves before leading or after trailing white space is no word
                real = where != words.index(b"")
                where, doc = where[real], doc[real]
            # frequent words get small codes, which leaves the upper bytes of most codes empty
            place = np.argsort(-np.bincount(where, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), dtype="int64")
            rank[place] = np.arange(len(words))
            where, words = rank[where] if len(words) else where, [words[i] for i in place.tolist()]
            sizes = np.bincount(doc, minlength=len(texts)) + 1
            ends = np.cumsum(sizes)
            codes = np.full(int(ends[-1]), len(words), dtype="int64")
            inner = np.ones(len(codes), dtype=bool)
            inner[ends - 1] = False
            codes[inner] = where
            doc_ids = part.column(0).to_pylist()
            held = np.array([is_held_out(d, folds) for d in doc_ids])
            counts = np.bincount(codes[~np.repeat(held, sizes)], minlength=len(words) + 1)
            row = {"chunk": number, "doc_ids": doc_ids, "held": held.tolist(), "sizes": sizes.astype("int32"), "codes": to_planes(codes),
                   "words": [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in words] + [END], "endings": [ending_class(w, endings) for w in words] + [0], "counts": counts}
            number += 1
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in zip(row, kinds)], names=list(row))

    return documents.select("doc_id", F.col(text).alias("text")).mapInArrow(run, CHUNKS)


def to_planes(codes: np.ndarray) -> bytes:
    """All lowest bytes first, then the next: empty upper bytes compress to nothing."""
    return np.ascontiguousarray(codes.astype("<u4").view("uint8").reshape(-1, 4).T).tobytes()


def from_planes(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype="uint8").reshape(4, -1).T).view("<u4").ravel()


class Classes:
    """Words as classes: 0 .. top - 1 the frequent words by hash, then endings, last the start of a text."""

    def __init__(self, top: list[tuple[int, int]], endings: int):
        order = sorted(top)
        self.top = np.array([h for h, _ in order], dtype="int64")
        self.top_counts = np.array([c for _, c in order], dtype="float64")
        self.endings = endings
        self.start = len(order) + endings
        self.size = self.start + 1

    def of(self, words: np.ndarray, endings: np.ndarray) -> np.ndarray:
        if not len(self.top):
            return endings.astype("int64")
        at = np.minimum(np.searchsorted(self.top, words), len(self.top) - 1)
        return np.where(self.top[at] == words, at, len(self.top) + endings)


def contexts(classes: np.ndarray, sizes: np.ndarray, start: int, distance: int) -> np.ndarray:
    """The class ``distance`` tokens before each token of its document."""
    before = np.full(len(classes), start, dtype="int64")
    before[distance:] = classes[:-distance] if len(classes) > distance else classes[:0]
    first = np.cumsum(sizes) - sizes
    for k in range(distance):
        at = first + k
        before[at[at < first + sizes]] = start
    return before


def pair_counts(table: DataFrame, classes: Classes) -> np.ndarray:
    """[distance, class before, class] over all training tokens; one partial table for each task, summed in two steps."""
    size = classes.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DISTANCES, size * size), dtype="int64")
        for batch in batches:
            for i in range(batch.num_rows):
                held, sizes, codes, words, endings = (batch.column(k)[i] for k in range(5))
                sizes = sizes.values.to_numpy(zero_copy_only=False).astype("int64")
                of = classes.of(words.values.to_numpy(zero_copy_only=False), endings.values.to_numpy(zero_copy_only=False).astype("int64"))
                seq = of[from_planes(codes.as_buffer())]
                train = ~np.repeat(held.values.to_numpy(zero_copy_only=False), sizes)
                for d in range(DISTANCES):
                    cells = contexts(seq, sizes, classes.start, d + 1) * size + seq
                    total[d] += np.bincount(cells[train], minlength=size * size)
        total = total.reshape(-1, size)
        rows = np.flatnonzero(total.any(axis=1))
        salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % 64
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array([total[r].tobytes() for r in rows.tolist()], pa.binary())], names=["row", "salt", "cells"])

    def add(part: pa.Table) -> pa.Table:
        cells = sum(np.frombuffer(x.as_buffer(), dtype="int64") for x in part.column("cells"))
        return pa.table([part.column("row")[:1], part.column("salt")[:1], pa.array([cells.tobytes()], pa.binary())], names=["row", "salt", "cells"])

    kind = "row int, salt int, cells binary"
    partial = table.select("held", "sizes", "codes", "words", "endings").mapInArrow(count, kind)
    summed = partial.groupBy("row", "salt").applyInArrow(add, kind).groupBy("row").applyInArrow(add, kind)
    out = np.zeros((DISTANCES * size, size), dtype="float64")
    for r in summed.select("row", "cells").collect():
        out[r["row"]] = np.frombuffer(r["cells"], dtype="int64")
    return out.reshape(DISTANCES, size, size)


def train_log_bilinear(pairs: np.ndarray, width: int = WIDTH, noise: int = NOISE, rounds: int = ROUNDS, rate: float = 0.05, seed: int = 5) -> np.ndarray:
    """Normalised ln P(class | class before) from counts [before, class].

    score(before, class) = r_before C q_class + b_class.  Noise-contrastive estimation tells each counted
    class from ``noise`` draws of the class shares; over counts, its expectation is a sum over all cells,
    so every step uses all tokens.  Adam steps; the last row and column (the start) is no target.
    """
    size = len(pairs)
    total = pairs.sum()
    share = (pairs.sum(axis=0) + 0.5) / (total + 0.5 * size)
    share[-1] = 1e-12
    share /= share.sum()
    rows = pairs.sum(axis=1, keepdims=True) / max(total, 1.0)
    seen = pairs / max(total, 1.0)
    drawn = noise * rows * share
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (size, width)), np.eye(width), rng.normal(0, 0.1, (size, width)), np.log(share)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    shift = np.log(noise * share)
    fade = RIDGE / max(total, 1.0)
    for t in range(1, rounds + 1):
        r, c, q, b = params
        h = r @ c
        told = 1 / (1 + np.exp(-np.clip(h @ q.T + b - shift, -30, 30)))
        g = drawn * told - seen * (1 - told)
        dh = g @ q
        # a penalty that fades with the corpus keeps few counts from being learned by heart
        grads = [dh @ c.T + fade * r, r.T @ dh, g.T @ h + fade * q, g.sum(axis=0)]
        step = rate * min(1.0, 2.0 * (1 - t / (rounds + 1)))
        for p, m, v, d in zip(params, first, second, grads):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p -= step * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-9)
    r, c, q, b = params
    scores = (r @ c) @ q.T + b
    scores[:, -1] = -np.inf
    top = scores.max(axis=1, keepdims=True)
    return scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))


class LanguageModel:
    """Class log probabilities after each class, for each distance, and the mixing weights of the contexts."""

    def __init__(self, classes: Classes, pairs: np.ndarray, ending_counts: np.ndarray, ending_words: np.ndarray, tokens: int, words: int):
        self.classes, self.tokens, self.words = classes, tokens, words
        self.ending_total = np.log10(ending_counts + PRIOR * (ending_words + 1))
        share = pairs[0].sum(axis=0) + 0.5
        share[-1] = 0
        self.share = share / share.sum()
        self.tables, gains = [], []
        for d in range(DISTANCES):
            p = np.exp(train_log_bilinear(pairs[d]))
            self.tables.append(p.astype("float32"))
            # how much a context tells: its divergence from the plain shares
            gains.append((p[:, :-1] * np.log((p[:, :-1] + 1e-30) / self.share[:-1])).sum(axis=1))
        self.gain = [np.maximum(g, 0) ** 2 + 1e-3 for g in gains]

    def class_log10(self, seq: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 P(class) of every token, from the classes before it."""
        top = np.full(len(seq), 0.02)
        mixed = top * self.share[seq]
        for d in range(DISTANCES):
            before = contexts(seq, sizes, self.classes.start, d + 1)
            weight = self.gain[d][before]
            mixed += weight * self.tables[d][before, seq]
            top += weight
        return np.log10(mixed / top)


def fit(table: DataFrame, counts: DataFrame, top_words: int = TOP_WORDS, endings: int = ENDINGS) -> LanguageModel:
    """``table`` are stored chunks, ``counts`` (word, ending, c) of all training tokens."""
    totals = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("bigint")).alias("v")).collect()
    best = counts.where("c > 0").orderBy(F.desc("c"), "word").limit(top_words).collect()
    classes = Classes([(r["word"], r["c"]) for r in best], endings)
    tokens, words = sum(r["c"] for r in totals), sum(r["v"] for r in totals)
    by_count, by_word = np.zeros(endings), np.zeros(endings)
    for r in totals:
        by_count[r["ending"]], by_word[r["ending"]] = r["c"], r["v"]
    for r in best:
        by_count[r["ending"]] -= r["c"]
        by_word[r["ending"]] -= 1
    return LanguageModel(classes, pair_counts(table, classes), by_count, by_word, tokens, words)


def score(documents: DataFrame, folds: int = 10, top_words: int = TOP_WORDS, endings: int = ENDINGS, text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every whole text.

    Documents whose crc32(doc_id as text) mod ``folds`` is 0 are held out of all counts.  Null and empty
    texts are their end token; a null doc_id is a training document; repeated rows are scored and counted
    each.  Without training documents all classes are alike.  Other columns are not read.
    """
    table = stored(chunks(documents, folds, endings, text), "chunks", "zstd")
    pairs = table.select("chunk", F.posexplode(F.arrays_zip("words", "endings", "counts")).alias("code", "w")).select("chunk", "code", F.col("w.words").alias("word"), F.col("w.endings").alias("ending"), F.col("w.counts").alias("n"))
    counts = stored(pairs.groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("c")), "counts")
    model = fit(table, counts, top_words, endings)
    known = pairs.select("chunk", "code", "word").join(counts.select("word", "c"), "word").select("chunk", "code", "c")
    holder = table.sparkSession.sparkContext.broadcast(model)  # its size follows from the class numbers

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lm = holder.value
        out = []
        c = np.zeros(right.num_rows, dtype="float64")
        c[right.column("code").to_numpy()] = right.column("c").to_numpy()
        for i in range(left.num_rows):
            get = lambda k: left.column(k).combine_chunks()[i]
            sizes = get("sizes").values.to_numpy(zero_copy_only=False).astype("int64")
            codes = from_planes(get("codes").as_buffer())
            ends = get("endings").values.to_numpy(zero_copy_only=False).astype("int64")
            of = lm.classes.of(get("words").values.to_numpy(zero_copy_only=False), ends)
            base = np.log10((c + PRIOR) / (lm.tokens + PRIOR * (lm.words + 1)))
            shared = of >= len(lm.classes.top)
            inside = np.where(shared, np.log10(c + PRIOR) - lm.ending_total[np.where(shared, of - len(lm.classes.top), 0)], 0.0)
            logs = lm.class_log10(of[codes], sizes) + inside[codes]
            first = np.cumsum(sizes) - sizes
            total = lambda x: np.add.reduceat(x, first)
            out.append(pa.table([get("doc_ids").values, get("held").values, pa.array(sizes), pa.array(total((c > 0).astype("int64")[codes])), pa.array(np.full(len(sizes), int(lm.tokens), dtype="int64")),
                                 pa.array(total(base[codes])), pa.array(total(logs))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out)

    texts = table.select(F.col("chunk").alias("part"), "doc_ids", "held", "sizes", "codes", "words", "endings")
    rows = texts.groupBy("part").cogroup(known.groupBy("chunk"))
    return rows.applyInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
