"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One inserted, deleted or replaced letter moves the vector of letter counts by a squared distance of 1 or
2.  Letters are dealt to a few groups; an edit touches at most two of them, so two near words agree
in the counts of all groups but two, and words are compared only where they do.  There the words are
ordered by length, cut into blocks, and one matrix product for each pair of adjacent blocks gives all squared distances.
Pairs at most two apart are verified letter by letter.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fits, stored
from .tokens import slices

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10             # a form is at least so many times as frequent
GROUPS = 4             # letter groups; all but two must agree
BLOCK_WORDS = 512      # side of a Gram matrix
BLOCK_BYTES = 8_000_000
BUCKET_WORDS = 16_384  # words that agree beyond this number are compared chunk by chunk
COUNTED_WORDS = 200_000
# Latin-1 codes of the letters: A-Z lower-cased, a-z and U+00C0 to U+00FF; all others part words.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """Runs of letters in Latin-1, A to Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def word_counts(documents: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int | None = None) -> DataFrame:
    """(word, n): words of at least ``min_length`` letters with at least ``min_count`` occurrences in all texts.

    With ``typo_every`` a run loses the letter at h modulo its length when that number divides h, the check sum
    of document and run.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in slices(batches):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not t:
                    continue
                if typo_every is None:
                    counts.update(r for r in runs_of(t) if len(r) >= min_length)
                    continue
                prefix = zlib.crc32(b":" if i is None else b"%d:" % i)
                for r, n in Counter(runs_of(t)).items():
                    if len(r) < min_length:
                        continue
                    h = zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), prefix)
                    if not h % typo_every:
                        h %= len(r)
                        r = r[:h] + r[h + 1:]
                        if len(r) < min_length:
                            continue
                    counts[r] += n
            if len(counts) > COUNTED_WORDS:
                yield flush()
        yield flush()

    partial = documents.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def letters(words: list[bytes], alphabet: np.ndarray) -> np.ndarray:
    """Counts of the letters of an alphabet, one row for each word."""
    code = np.full(256, len(alphabet), dtype="int64")
    code[alphabet] = np.arange(len(alphabet))
    flat = code[np.frombuffer(b"".join(words), dtype="uint8")]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    wide = len(alphabet) + 1
    return np.bincount(row * wide + flat, minlength=len(words) * wide).reshape(len(words), wide)[:, :-1]


def _by_bytes(words: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of at most BLOCK_WORDS words and about BLOCK_BYTES padded bytes."""
    start = longest = 0
    for i, w in enumerate(words):
        longest = max(longest, len(w))
        if i > start and (i - start >= BLOCK_WORDS or (i - start + 1) * longest > BLOCK_BYTES):
            yield start, i
            start, longest = i, len(w)
    if len(words) > start:
        yield start, len(words)


def letter_groups(words: DataFrame, groups: int = GROUPS) -> list[list[int]]:
    """The letters of a vocabulary dealt to groups of about equal variance; one row for each letter reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = np.arange(256)
        total = np.zeros((2, 256))
        for batch in batches:
            values = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for a, b in _by_bytes(values):
                counts = letters(values[a:b], alphabet)
                total += counts.sum(0), (counts * counts).sum(0)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[0, used]), pa.array(total[1, used])], names=["letter", "s", "q"])

    rows = words.select("word").mapInArrow(run, "letter int, s double, q double").groupBy("letter").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    n = max(1, words.count())
    spread = sorted(((r["q"] / n - (r["s"] / n) ** 2, r["letter"]) for r in rows), key=lambda x: (-x[0], x[1]))
    dealt: list[list[int]] = [[] for _ in range(groups)]
    load = [0.0] * groups
    for variance, letter in spread:
        k = load.index(min(load))
        dealt[k].append(letter)
        load[k] += variance + 1e-9
    return dealt


def bucket_rows(words: DataFrame, dealt: list[list[int]]) -> DataFrame:
    """(bucket, combo, length, word, n): a row for each choice of groups that must agree, with a hash of their counts."""
    combos = list(itertools.combinations(range(len(dealt)), max(1, len(dealt) - 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = np.array([x for g in dealt for x in g], dtype="int64")
        group = np.repeat(np.arange(len(dealt)), [len(g) for g in dealt])
        random = np.random.default_rng(11).integers(1, 1 << 62, (len(combos), len(alphabet)), dtype="int64") | 1
        for c, combo in enumerate(combos):
            random[c, ~np.isin(group, combo)] = 0
        for batch in batches:
            values = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for a, b in _by_bytes(values):
                counts = letters(values[a:b], alphabet)
                length = pa.array([len(w) for w in values[a:b]], pa.int64())
                for c in range(len(combos)):
                    with np.errstate(over="ignore"):
                        bucket = (counts * random[c]).sum(1) + c  # equal counts give equal hashes; a clash costs time only
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(b - a, c), pa.int32()), length, part.column(0), part.column(1)], names=["bucket", "combo", "length", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "bucket bigint, combo int, length bigint, word string, n bigint")


class _Block:
    """Words of one or more units, ordered by unit and length."""

    def __init__(self, columns: list[np.ndarray], words: list[bytes], alphabet: np.ndarray, group: np.ndarray):
        self.unit, self.combo, self.side, self.length, self.n = columns
        self.words, self.group = words, group
        self.counts = letters(words, alphabet)
        kind = "float32" if len(words) and self.counts.max() < 1000 else "float64"  # exact in either
        self.vectors = self.counts.astype(kind)
        self.norm = (self.vectors * self.vectors).sum(1)
        width = int(self.length.max()) + 1
        self.text = np.zeros((len(words), width), dtype="uint8")
        flat = np.frombuffer(b"".join(words), dtype="uint8")
        row = np.repeat(np.arange(len(words)), self.length)
        self.text[row, np.arange(len(flat)) - np.repeat(np.cumsum(self.length) - self.length, self.length)] = flat


def near_pairs(a: _Block, b: _Block, combos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in a, j in b) of words one edit apart, each pair in the first of its combinations only."""
    distance = a.norm[:, None] + b.norm[None, :] - 2 * (a.vectors @ b.vectors.T)
    i, j = np.nonzero(distance <= 2)
    if a is b:
        i, j = i[i < j], j[i < j]
    gap = np.abs(a.length[i] - b.length[j])
    keep = (a.unit[i] == b.unit[j]) & (a.combo[i] == b.combo[j]) & (gap + distance[i, j] == 2) & ((a.side[i] != b.side[j]) | (a.side[i] < 0))
    i, j = i[keep], j[keep]
    found = [_verified(a, b, i[s], j[s]) for s in _slabs(len(i), max(a.text.shape[1], b.text.shape[1]))]
    keep = np.concatenate(found) if found else np.zeros(0, dtype=bool)
    i, j = i[keep], j[keep]
    moved = np.zeros((len(i), combos.shape[1]), dtype=bool)  # groups whose counts differ
    for s in _slabs(len(i), a.counts.shape[1] * 8):
        differs = a.counts[i[s]] != b.counts[j[s]]
        for g in range(combos.shape[1]):
            moved[s, g] = differs[:, a.group == g].any(1)
    first = (~(moved[:, None, :] & combos[None, :, :]).any(2)).argmax(1)
    own = first == a.combo[i]
    return i[own], j[own]


def _slabs(n: int, width: int) -> list[slice]:
    step = max(1, BLOCK_BYTES // max(1, width))
    return [slice(s, min(n, s + step)) for s in range(0, n, step)]


def _verified(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one replaced, or one inserted, letter."""
    swap = a.length[i] > b.length[j]
    width = int(max(a.length[i].max(initial=0), b.length[j].max(initial=0)))
    x, y = (np.zeros((len(i), width + 1), dtype="uint8") for _ in range(2))
    wa, wb = min(width + 1, a.text.shape[1]), min(width + 1, b.text.shape[1])
    x[:, :wa], y[:, :wb] = a.text[i, :wa], b.text[j, :wb]
    x[swap], y[swap] = y[swap], x[swap]  # x is the shorter word
    differs = x != y
    replaced = (a.length[i] == b.length[j]) & (differs.sum(1) == 1)
    # behind the first difference the longer word continues one letter later
    behind = np.logical_or.accumulate(differs, axis=1)[:, :-1]
    shifted = (x[:, :-1] != y[:, 1:]) & behind
    return replaced | ((a.length[i] != b.length[j]) & ~shifted.any(1))


_SUMMED = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.struct([("m", pa.int64()), ("w", pa.string())]))])


def _summed(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Near pairs of two blocks summed up for each word."""
    names, near, least, best = [], [], [], []
    for own, other, p, q in ((a, b, i, j), (b, a, j, i)):
        text = np.array([other.words[k].decode("latin-1") for k in q.tolist()], dtype=str)
        order = np.lexsort((text, -other.n[q], p))
        at, first = np.unique(p[order], return_index=True)
        names += [own.words[k].decode("latin-1") for k in at.tolist()]
        near += np.diff(np.append(first, len(p))).tolist()
        least += (-other.n[q][order][first]).tolist()
        best += text[order][first].tolist()
    candidate = pa.StructArray.from_arrays([pa.array(least, pa.int64()), pa.array(best, pa.string())], names=["m", "w"])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(near, pa.int64()), candidate], schema=_SUMMED)


def near_words(words: DataFrame, groups: int = GROUPS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(word, n_near, best): the number of words one edit away, and the most frequent of them as (-n, word).

    ``words`` (word, n) must be distinct and settled.  Buckets beyond ``bucket_words`` words are cut into chunks
    by a hash of the word, and each pair of chunks is a unit of its own, so no task meets a whole hot bucket.
    """
    dealt = letter_groups(words, groups)
    combos = list(itertools.combinations(range(groups), max(1, groups - 2)))
    rows = bucket_rows(words, dealt)
    total = words.count() * len(combos)
    large = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > bucket_words).select(F.col("bucket").alias("l_bucket"), F.ceil(F.col("c") / bucket_words).cast("int").alias("chunks")), "large")
    chunked = rows.join(F.broadcast(large) if fits(large, 100_000) else large, F.col("bucket") == F.col("l_bucket"), "left")
    mine = F.pmod(F.xxhash64("word", F.lit(5)), F.col("chunks"))
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = chunked.withColumn("mine", mine.cast("int")).withColumn("other", other)
    # a chunk with itself and words of small buckets: side -1; two different chunks: 0 and 1
    side = F.when((F.col("other") < 0) | (F.col("mine") == F.col("other")), F.lit(-1)).when(F.col("mine") < F.col("other"), F.lit(0)).otherwise(F.lit(1))
    unit = F.when(F.col("other") < 0, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")))
    units = units.select(unit.alias("unit"), "combo", side.cast("int").alias("side"), "length", "n", "word")
    parts = max(words.sparkSession.sparkContext.defaultParallelism, math.ceil(total / 500_000))
    ordered = units.repartition(parts, "unit").sortWithinPartitions("unit", "length")
    member = np.array([[g in c for g in range(groups)] for c in combos])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = np.array([x for g in dealt for x in g], dtype="int64")
        group = np.repeat(np.arange(groups), [len(g) for g in dealt])
        held: list[_Block] = []  # blocks of the unit that is still open, of lengths that can still matter
        for batch in batches:
            columns = [batch.column(k).to_numpy().astype("int64") for k in range(5)]
            words_here, out = [w.encode("latin-1") for w in batch.column(5).to_pylist()], []
            for s, e in _by_bytes(words_here):
                block = _Block([c[s:e] for c in columns], words_here[s:e], alphabet, group)
                held = [h for h in held if h.unit[-1] == block.unit[0] and h.length[-1] >= block.length[0] - 1]
                held.append(block)
                out += [_summed(h, block, *near_pairs(h, block, member)) for h in held]
            yield from pa.Table.from_batches(out, _SUMMED).combine_chunks().to_batches()

    found = ordered.mapInArrow(run, "word string, near bigint, best struct<m: bigint, w: string>")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, largest: int, ratio: int = RATIO) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last one.

    Each step multiplies the count by ``ratio``, so the largest count bounds the steps, and each round doubles the steps done.
    """
    steps = 1
    while ratio ** steps <= largest:
        steps += 1
    state = forms.select("word", F.col("form").alias("root"))
    for k in range(max(0, math.ceil(math.log2(steps)))):
        state = stored(state, f"roots-{k}")
        further = state.select(F.col("word").alias("f_word"), F.col("root").alias("f_root"))
        state = state.join(further, F.col("root") == F.col("f_word"), "left").select("word", F.coalesce("f_root", "root").alias("root"))
    return state


def group_variants(documents: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, typo_every: int | None = None,
                   groups: int = GROUPS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least ``min_length`` letters and
    ``min_count`` occurrences.  ``form`` is the most frequent word one edit away (ties: the smallest), if it is
    at least ``ratio`` times as frequent, else null; ``root`` the last one of a chain of forms, the word itself without one.
    ``typo_every`` plants a deletion in every so-manieth run of a document by its check sum (a null doc_id counts as
    empty).  Null and empty texts have no words; repeated rows count each; an empty table gives an empty one;
    words of any length are compared whole; columns beyond the two named are not read.
    """
    if groups < 3:
        raise ValueError("an edit touches two groups of letters, so there must be three at least")
    words = stored(word_counts(documents, text, min_length, min_count, typo_every), "words")
    near = stored(near_words(words, groups, bucket_words).withColumnRenamed("word", "w_word"), "near")
    joined = words.join(near, F.col("word") == F.col("w_word"), "left")
    form_n = -F.col("best.m")
    has = F.coalesce(form_n >= ratio * F.col("n"), F.lit(False))
    formed = joined.select("word", F.when(has, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, form_n).alias("form_n"))
    formed = stored(formed, "forms")
    chains = formed.where("form IS NOT NULL").select("word", "form")
    largest = words.agg(F.max("n").alias("n")).head()["n"] or 1
    last = roots(chains, largest, ratio).select(F.col("word").alias("r_word"), "root")
    return formed.join(last, F.col("word") == F.col("r_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
