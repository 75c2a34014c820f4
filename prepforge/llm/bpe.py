"""Byte-pair encoding by speculation and verification, and decoding.

A greedy longest match proposes the tokens of every distinct word.  A sequence of tokens is what
the merges would give exactly when every two neighbours are compatible, that is, when no merge
across their border would have come before the merges inside them.  This is checked for all
neighbours of all words at once in numpy; only words with an incompatible pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .tokens import CACHE_PIECES, LEARN_PIECES, WORD_SPLIT, Known, PieceEncoder, kind_of, little_endian, open_tokenizer, slices

NEVER = np.int64(1) << 40
# The published pre-tokenizer pattern of byte-level vocabularies (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class HashTable:
    """Vectorised lookups of 64-bit keys: open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype="int64"), np.full(1 << bits, -1, dtype="int64")
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]
            placed = self.keys[at] == keys[todo]
            self.values[at[placed]] = values[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype("int64")

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class Merges:
    """A vocabulary with its merges as arrays, and the merges applied exactly."""

    LONG = 40

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, letters = config["model"], byte_letters()
        self.added = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        self.vocab = vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        # rank -1: a single byte, made by no merge
        self.rank = np.full(self.size, -1, dtype="int64")
        self.left, self.right = np.zeros(self.size, dtype="int64"), np.zeros(self.size, dtype="int64")
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            l, m, t = vocab[a], vocab[b], vocab[a + b]
            self.merge_of.setdefault((l, m), (r, t))
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, l, m
        pairs = np.array([(l << 32) | m for l, m in self.merge_of], dtype="int64")
        # rank and new token in one number
        self.pairs = HashTable(pairs, np.array([(r << 24) | t for r, t in self.merge_of.values()], dtype="int64"))
        by_byte = sorted(letters.items(), key=lambda x: x[1])
        self.byte_id = np.array([vocab[c] for c, _ in by_byte], dtype="int64")
        self.last_id = np.array([vocab[c + suffix] for c, _ in by_byte], dtype="int64")

    def merge(self, word: bytes) -> list[int]:
        """The merges of one word, lowest rank first and leftmost on ties; a heap over linked symbols."""
        ids = [*self.byte_id[np.frombuffer(word[:-1], "uint8")].tolist(), int(self.last_id[word[-1]])]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merge_of.get
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, token = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or (m := get((ids[i], ids[j]))) is None or m != (rank, token):
                continue
            ids[i], ids[j], k = token, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if m := get((token, ids[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := get((ids[h], token))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return [i for i in ids if i >= 0]

    def _costs(self, a, b):
        found = self.pairs.get(((a << 32) | b).ravel()).reshape(a.shape)
        return np.where(found < 0, NEVER << 22, found)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The merges of many words: words of one length are the rows of a matrix, one merge a round in each."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words])
        for i in np.flatnonzero(lengths > self.LONG).tolist():
            out[i] = little_endian(self.merge(words[i]))
        for n in np.unique(lengths[(lengths > 0) & (lengths <= self.LONG)]).tolist():
            rows = np.flatnonzero(lengths == n)
            data = np.frombuffer(b"".join([words[i] for i in rows.tolist()]), "uint8").reshape(-1, n)
            ids = np.concatenate([self.byte_id[data[:, :-1]], self.last_id[data[:, -1:]]], axis=1)
            cost = self._costs(ids[:, :-1], ids[:, 1:])
            while True:
                width = ids.shape[1]
                at = cost.argmin(axis=1) if width > 1 else np.zeros(len(rows), "int64")
                best = cost[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), NEVER << 22)
                done = best == NEVER << 22
                if done.any():
                    flat = ids[done].astype("<u4").tobytes()
                    for k, i in enumerate(rows[done].tolist()):
                        out[i] = flat[k * width * 4:(k + 1) * width * 4]
                    go = ~done
                    rows, ids, cost, at, best = rows[go], ids[go], cost[go], at[go], best[go]
                if not len(rows):
                    break
                line, cols = np.arange(len(rows)), np.arange(width - 1)
                ids[line, at] = best & 0xFFFFFF
                ids = np.take_along_axis(ids, cols + (cols > at[:, None]), axis=1)
                cost = np.take_along_axis(cost, cols[:-1] + (cols[:-1] >= at[:, None]), axis=1)
                for near in (at - 1, at):
                    ok = (near >= 0) & (near < width - 2)
                    r, c = line[ok], near[ok]
                    cost[r, c] = self._costs(ids[r, c], ids[r, c + 1])
        return out


class SpeculativeBpe(Merges):
    """Greedy proposals for all words, checked pair by pair, before any word is merged."""

    def __init__(self, path: str):
        super().__init__(path)
        letters = byte_letters()
        self.token_bytes: list[bytes] = [b""] * self.size
        for token, i in self.vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self._build_trie(self.vocab, letters)
        self.known = np.zeros(0, dtype="int64")
        self.known_good = np.zeros(0, dtype=bool)
        self.speculated = self.failed = 0
        self.find = regex.compile(BYTE_LEVEL).findall

    # -- proposal ---------------------------------------------------------------------------------
    def _build_trie(self, vocab, letters):
        """Edges (node, byte) -> node; only tokens that encode to themselves may be proposed."""
        made = np.flatnonzero(self.rank >= 0)
        itself = np.ones(len(self.rank), dtype=bool)
        itself[made] = self._compatible(self.left[made], self.right[made], self.rank[made])
        nodes: dict[tuple[int, int], int] = {}
        accept = {0: -1}
        for token, i in vocab.items():
            if not itself[i]:
                continue
            node = 0
            for c in token:
                node = nodes.setdefault((node, letters[c]), len(nodes) + 1)
            accept[node] = i
        keys = np.array([(n << 8) | b for n, b in nodes], dtype="int64")
        targets = np.fromiter(nodes.values(), dtype="int64", count=len(nodes))
        self.edges = HashTable(keys, targets)
        self.accept = np.full(len(nodes) + 1, -1, dtype="int64")
        self.accept[list(accept)] = list(accept.values())

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words side by side: (word number, token) in order of the words."""
        data = np.frombuffer(b"".join(words), dtype="uint8").astype("int64")
        ends = np.cumsum([len(w) for w in words])
        at = ends - np.array([len(w) for w in words])
        live = np.flatnonzero(at < ends)
        rows, tokens = [], []
        while len(live):
            start, stop = at[live], ends[live]
            best, length = np.full(len(live), -1, dtype="int64"), np.zeros(len(live), dtype="int64")
            walk, node, depth = np.arange(len(live)), np.zeros(len(live), dtype="int64"), 0
            while len(walk):
                node = self.edges.get((node << 8) | data[start[walk] + depth])
                depth += 1
                found = node >= 0
                walk, node = walk[found], node[found]
                token = self.accept[node]
                hit = token >= 0
                best[walk[hit]], length[walk[hit]] = token[hit], depth
                more = start[walk] + depth < stop[walk]
                walk, node = walk[more], node[more]
            rows.append(live)
            tokens.append(best)
            at[live] = start + length
            live = live[at[live] < ends[live]]
        row, token = np.concatenate(rows or [np.zeros(0, "int64")]), np.concatenate(tokens or [np.zeros(0, "int64")])
        order = np.argsort(row, kind="stable")
        return row[order], token[order]

    # -- verification -----------------------------------------------------------------------------
    def _pair_rank(self, a, b):
        found = self.pairs.get((a << 32) | b)
        return np.where(found < 0, NEVER, found >> 24)

    def _compatible(self, a: np.ndarray, b: np.ndarray, before=None) -> np.ndarray:
        """Would the merges leave the border between a and b alone (until rank ``before``)?

        The merges of both sides are undone from the latest to the first.  While a border stands
        between x and y, a merge of (x, y) that ranks below the next merge on either side would come
        first; on equal rank the pair further left wins.
        """
        good = np.ones(len(a), dtype=bool)
        rows = np.arange(len(a))
        x, y = a.astype("int64"), b.astype("int64")
        limit = np.full(len(a), NEVER) if before is None else before.astype("int64")
        while len(rows):
            bad = self._pair_rank(x, y) < limit
            good[rows[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            rows, x, y, rx, ry = rows[go], x[go], y[go], rx[go], ry[go]
            undo_left = rx > ry
            limit = np.where(undo_left, rx, ry + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return good

    def verify(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Compatibility of all neighbours; each distinct pair is worked out once."""
        keys, inverse = np.unique((a << 32) | b, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, keys), max(0, len(self.known) - 1))
        have = self.known[at] == keys if len(self.known) else np.zeros(len(keys), dtype=bool)
        good = np.zeros(len(keys), dtype=bool)
        good[have] = self.known_good[at[have]]
        new = keys[~have]
        if len(new):
            good[~have] = self._compatible(new >> 32, new & 0xFFFFFFFF)
            keep = len(self.known) < 2_000_000
            known = np.concatenate([self.known, new]) if keep else keys
            flags = np.concatenate([self.known_good, good[~have]]) if keep else good
            order = np.argsort(known)
            self.known, self.known_good = known[order], flags[order]
        return good[inverse]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        row, token = self.propose(words)
        if not len(row):
            return [b""] * len(words)
        together = row[:-1] == row[1:]
        good = self.verify(token[:-1][together], token[1:][together])
        failed = np.unique(row[:-1][together][~good]).tolist()
        self.speculated += len(words)
        self.failed += len(failed)
        data = token.astype("<u4").tobytes()
        ends = np.searchsorted(row, np.arange(len(words)), "right") * 4
        out, start = [], 0
        for i, end in enumerate(ends.tolist()):
            out.append(data[start:end])
            start = end
        for i, ids in zip(failed, self.merge_words([words[i] for i in failed])):
            out[i] = ids
        return out

    # -- pieces and texts -------------------------------------------------------------------------
    def _words(self, piece: str) -> list[str]:
        """The pre-tokenizer's words; letters with one space before or one mark behind need no pattern."""
        body = piece[1:] if piece[:1] == " " else piece
        if body.isalpha():
            return [piece]
        if body[-1:] in {".", ","} and body[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.find(piece)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        split = [self._words(p) for p in pieces]
        words = list({w for ws in split for w in ws})
        get = dict(zip(words, self.encode_words([w.encode() for w in words]))).__getitem__
        return [b"".join(map(get, ws)) for ws in split]

    def encode_whole(self, text: str) -> bytes:
        """Any text: the strings of added tokens are cut out first, as the library does."""
        parts = regex.split("(" + "|".join(regex.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")", text) if self.added else [text]
        return b"".join(little_endian([self.added[p]]) if p in self.added else self.encode_pieces([p])[0] for p in parts if p)


class WordBpe(Merges):
    """A lower-case word vocabulary with word ends; equal to the library's ids for pieces without white space."""

    PLAIN = re.compile(r"[\x21-\u012f\u0131-\u024f]*")  # here normal form C changes nothing and lower case is one to one

    def __init__(self, path: str):
        super().__init__(path)
        self.library = None
        self.path = path
        self.find = regex.compile(WORD_SPLIT).findall

    def encode_whole(self, text: str) -> bytes:
        self.library = self.library or open_tokenizer(self.path)
        return little_endian(self.library.encode(text, add_special_tokens=False).ids)

    def _words(self, piece: str) -> list[str] | None:
        if not self.PLAIN.fullmatch(piece):
            return None
        low = piece.lower()
        if low.isalpha():
            return [low]
        if low[-1:] in {".", ","} and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.find(low)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        split = [self._words(p) for p in pieces]
        words = list({w for ws in split if ws for w in ws})
        get = dict(zip(words, self.merge_words([w.encode() for w in words]))).__getitem__
        return [self.encode_whole(p) if ws is None else b"".join(map(get, ws)) for p, ws in zip(pieces, split)]


def piece_encoder(path: str, **options) -> PieceEncoder:
    """The fastest exact encoder for a vocabulary file; unknown kinds go through the library."""
    with open(path, encoding="utf-8") as f:
        kind = kind_of(json.load(f))
    model = {"byte": SpeculativeBpe, "word": WordBpe}.get(kind)
    bpe = model(path) if model else None
    return PieceEncoder(path, bpe.encode_pieces, bpe.encode_whole, **options) if bpe else PieceEncoder(path, **options)


class CorpusEncoder(PieceEncoder):
    """Ids of a byte vocabulary for texts with many rare words: pieces and words stay in Arrow arrays.

    A new piece that is a line end or nothing, letters with a space before or none, and ASCII marks or nothing has these three as
    the pre-tokenizer's words; words new to the worker are merged side by side.  All other pieces go through ``SpeculativeBpe``.
    """

    MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    WORD = r" ?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+"  # letters to every engine
    MERGED = 1 << 17  # words merged at a time

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        self.model = SpeculativeBpe(path)
        self.pieces, self.words = Known(cache_pieces), Known(cache_pieces)
        super().__init__(path, self.model.encode_pieces, self.model.encode_whole, cache_pieces)

    def forget(self):
        super().forget()
        self.pieces.forget()
        self.words.forget()

    def _learn(self, distinct: pa.Array) -> np.ndarray:
        codes = self.pieces.learn(distinct, self._ids)
        self.store, self.used, self.start, self.length = self.pieces.store, self.pieces.used, self.pieces.start, self.pieces.length
        return codes

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, number of ids of each piece)."""
        none = pa.scalar("", pa.large_string())
        first, line = pc.starts_with(pieces, "\x01"), pc.starts_with(pieces, "\n")
        behind = pc.utf8_slice_codeunits(pieces, 1)
        texts = pc.if_else(first, behind, pc.if_else(line, pieces, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pieces, none)))
        bodies = pc.if_else(line, behind, texts)
        stems = pc.utf8_rtrim(bodies, characters=self.MARKS)
        plain = pc.match_substring_regex(stems, f"^{self.WORD}$")
        rows, rest = np.flatnonzero(plain), np.flatnonzero(pc.invert(plain))
        sizes, parts = np.zeros(len(pieces), dtype="int64"), []
        if len(rows):
            at = pa.array(rows)
            heads = pc.if_else(line.take(at), pa.scalar("\n", pa.large_string()), none)
            tails = pc.replace_substring_regex(bodies.take(at), f"^{self.WORD}", "")
            words = pa.concat_arrays([heads, stems.take(at), tails]).dictionary_encode()
            codes = self.words.learn(words.dictionary, self._merge)[words.indices.to_numpy()]
            codes = codes.reshape(3, -1).T.reshape(-1)
            sizes[rows] = self.words.length[codes].reshape(-1, 3).sum(1)
            parts.append((rows, self.words.ids(codes)))
        for i in range(0, len(rest), LEARN_PIECES):
            some = rest[i:i + LEARN_PIECES]
            found = self.encode_pieces(texts.take(pa.array(some)).to_pylist())
            sizes[some] = [len(x) // 4 for x in found]
            parts.append((some, np.frombuffer(b"".join(found), dtype="<u4")))
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), dtype="<u4")
        for some, ids in parts:
            n = sizes[some]
            flat[np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, sizes

    def _merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for i in range(0, len(words), self.MERGED):
            found += self.model.merge_words(words.slice(i, self.MERGED).cast(pa.large_binary()).to_pylist())
        return np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(x) for x in found], dtype="int64") // 4


def corpus_encoder(path: str, cache_pieces: int = CACHE_PIECES) -> PieceEncoder:
    """An encoder for a worker that lives through many tasks; vocabularies of other kinds have ``piece_encoder``'s."""
    with open(path, encoding="utf-8") as f:
        kind = kind_of(json.load(f))
    return CorpusEncoder(path, cache_pieces) if kind == "byte" else piece_encoder(path, cache_pieces=cache_pieces)


class Decoder:
    """Ids to texts: one Arrow take gathers the bytes of all tokens of all documents."""

    def __init__(self, token_bytes: list[bytes]):
        self.tokens = pa.array(token_bytes, type=pa.large_binary())

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """Bytes of each document; bytes that are no UTF-8 become the replacement character."""
        ids = np.frombuffer(b"".join(encoded), dtype="<u4")
        taken = self.tokens.take(pa.array(ids, type=pa.uint32()))
        offsets = np.frombuffer(taken.buffers()[1], dtype="int64", count=len(ids) + 1)
        data = memoryview(taken.buffers()[2] or b"")
        cuts = offsets[np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])])].tolist()
        out = []
        for a, b in zip(cuts, cuts[1:]):
            raw = bytes(data[a:b])
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = raw.decode("utf-8", "replace").encode()
            out.append(raw)
        return out


def encode(documents: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``, the ids of ``text`` as binary little-endian unsigned 32-bit integers.

    No shuffle; rows keep their order and all other columns, an older column ``out`` is replaced.  A
    null or empty text has no ids.  Repeated rows are encoded alike.  ``path`` names a byte-level
    vocabulary file present on every executor.
    """
    from pyspark.sql import types as T
    kept = [f for f in documents.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SpeculativeBpe(path)
        encoder = PieceEncoder(path, bpe.encode_pieces, bpe.encode_whole)
        for part in slices(batches, text):
            ids = encoder.encode_bytes(part.column(part.schema.get_field_index(text)))
            columns = [part.column(part.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=[*names, out])

    return documents.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add ``out``, the text of the binary column ``ids``; null ids give a null text, no ids an empty one."""
    from pyspark.sql import types as T
    kept = [f for f in encoded.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(SpeculativeBpe(path).token_bytes)
        for part in slices(batches, ids):
            values = part.column(part.schema.get_field_index(ids)).to_pylist()
            texts = [None if v is None else t.decode() for v, t in zip(values, decoder.decode([v or b"" for v in values]))]
            columns = [part.column(part.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*names, out])

    return encoded.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ``ids`` and ``decoded`` (built-in functions only)."""
    from pyspark.sql import functions as F
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def round_trip_digests(documents: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text in one pass over Arrow batches and keep the digests.

    The same operators as ``encode`` and ``decode``, fused so that ids and texts need not travel
    between Python and the JVM twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = SpeculativeBpe(path)
        encoder, decoder = PieceEncoder(path, bpe.encode_pieces, bpe.encode_whole), Decoder(bpe.token_bytes)
        for part in slices(batches, "text"):
            ids = encoder.encode_bytes(part.column(1))
            texts = decoder.decode(ids)
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
