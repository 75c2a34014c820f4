"""Token ids of whole texts, equal to the tokenizers library's, at the speed of a dictionary.

Texts are cut at places where the library's pre-tokenizer always cuts too, and each distinct piece
is encoded once.  A text for which this is not certain (runs of white space in a byte vocabulary,
odd white space in a word vocabulary, an added token inside the text) goes through the library as a
whole, so the ids are the library's in every case.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 200_000
LEARN_PIECES = 16_384  # pieces encoded at a time, which bounds the matrices of the merges
SLICE_BYTES = 6_000_000


def little_endian(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def open_tokenizer(path: str):
    """The library's tokenizer without truncation and padding, one thread."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def kind_of(config: dict) -> str | None:
    """Which cut is proven for a tokenizer file: ``byte``, ``word`` or none."""
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "byte"
    parts = [p.get("type") for p in pre.get("pretokenizers", [])]
    norms = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    splits = [p.get("pattern", {}).get("Regex") for p in pre.get("pretokenizers", [])][:1]
    if parts == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and splits == [WORD_SPLIT]:
        return "word"
    return None


# The split pattern of the word vocabulary: no alternative matches white space.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# All characters that any of the engines takes for white space, two in a row; or a character of our own.
_RUNS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|\x01"
_ODD = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class PieceEncoder:
    """Ids of texts, flat, with the offsets of the documents.

    ``encode_pieces`` turns a list of distinct pieces into a list of little-endian id bytes and
    ``encode_whole`` does so with a whole text; the default is the library.  Beyond ``cache_pieces`` known
    pieces the cache starts anew, which moves time and memory, never results.
    """

    def __init__(self, path: str, encode_pieces: Callable | None = None, encode_whole: Callable | None = None, cache_pieces: int = CACHE_PIECES):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.kind = kind_of(config)
        self.added = [t["content"] for t in config.get("added_tokens", [])]
        self.tokenizer = None if encode_pieces and encode_whole else open_tokenizer(path)
        self.encode_pieces = encode_pieces or self._library
        self.encode_whole = encode_whole or (lambda text: self._library([text])[0])
        self.cache_pieces = cache_pieces
        self.forget()

    def forget(self):
        self.code: dict[str, int] = {}
        self.store, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.start = np.zeros(0, dtype="int64")
        self.length = np.zeros(0, dtype="int64")

    def _library(self, pieces: list[str]) -> list[bytes]:
        return [little_endian(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts have no proven cuts."""
        if self.kind is None:
            return np.ones(len(texts), dtype=bool)
        found = pc.match_substring_regex(texts, _RUNS if self.kind == "byte" else _ODD)
        for a in self.added:
            found = pc.or_(found, pc.match_substring(texts, a))
        return found.to_numpy(zero_copy_only=False)

    def _store(self, new: list[str]) -> None:
        strings = [p[1:] if p[:1] == "\x01" else p if p[:1] == "\n" else " " + p for p in new] if self.kind == "byte" else new
        ids = self.encode_pieces(strings)
        sizes = np.array([len(i) for i in ids], dtype="int64") // 4
        total = int(sizes.sum())
        while self.used + total > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used:self.used + total] = np.frombuffer(b"".join(ids), dtype="<u4")
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.used += total

    def _learn(self, distinct: pa.Array) -> np.ndarray:
        """Codes of distinct pieces; new ones are encoded and stored."""
        pieces = distinct.to_pylist()
        if len(self.code) > self.cache_pieces:
            self.forget()
        new = [p for p in pieces if p not in self.code]
        for at in range(0, len(new), LEARN_PIECES):
            self._store(new[at:at + LEARN_PIECES])
        return np.fromiter(map(self.code.__getitem__, pieces), dtype="int64", count=len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts); a null text counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = self._whole(texts)
        cut = pc.if_else(pa.array(whole), "", texts) if whole.any() else texts
        if self.kind == "byte":
            # the first piece of a text, the first of a line and all others can be told apart
            cut = pc.binary_join_element_wise(pa.scalar("\x01", pa.large_string()), pc.replace_substring(cut, "\n", " \n"), pa.scalar("", pa.large_string()))
            lists = pc.split_pattern(cut, " ")
        else:
            lists = pc.ascii_split_whitespace(cut)
        encoded = lists.flatten().dictionary_encode()
        codes = self._learn(encoded.dictionary)
        where = encoded.indices.to_numpy(zero_copy_only=False)
        first = lists.offsets.to_numpy()
        first = first - first[0]
        sizes = self.length[codes][where]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        small = np.int32 if max(total, self.used) < 1 << 31 else np.int64
        take = np.repeat((self.start[codes][where] - (ends - sizes)).astype(small), sizes)
        take += np.arange(total, dtype=small)
        ids = self.store[take]
        offsets = np.concatenate([[0], ends])[first]
        if whole.any():
            parts = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
            for i in np.flatnonzero(whole).tolist():
                parts[i] = np.frombuffer(self.encode_whole(texts[i].as_py()), dtype="<u4")
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets

    def encode_bytes(self, texts: pa.Array) -> list[bytes]:
        """One little-endian byte string for each text."""
        ids, offsets = self.encode(texts)
        data, cuts = ids.tobytes(), (offsets * 4).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class Known:
    """Strings met so far in an Arrow array, with the ids of each in one flat array.

    Beyond ``limit`` strings only those met again since the last time stay, or none if these are too many.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self):
        self.strings, self.met = pa.array([], pa.large_string()), np.zeros(0, dtype=bool)
        self.store, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        self.start, self.length = np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")

    def _add(self, strings: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        self.store[self.used:self.used + len(ids)] = ids
        self.strings, self.met = pa.concat_arrays([self.strings, strings]), np.concatenate([self.met, np.zeros(len(strings), dtype=bool)])
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.length = np.concatenate([self.length, sizes])
        self.used += len(ids)

    def _thin(self) -> None:
        kept = np.flatnonzero(self.met)
        strings, sizes, ids = self.strings.take(pa.array(kept)), self.length[kept], self.ids(kept)
        self.forget()
        if len(kept) <= self.limit // 2:
            self._add(strings, ids, sizes)

    def learn(self, distinct: pa.Array, encode: Callable) -> np.ndarray:
        """Codes of distinct strings; ``encode`` gives (flat ids, number of ids of each) of new ones."""
        if len(self.strings) > self.limit:
            self._thin()
        place = pc.index_in(self.strings, value_set=distinct).fill_null(-1).to_numpy()
        old = np.flatnonzero(place >= 0)
        codes = np.full(len(distinct), -1, dtype="int64")
        codes[place[old]] = old
        self.met[old] = True
        new = codes < 0
        if new.any():
            strings = distinct.filter(pa.array(new))
            codes[new] = len(self.strings) + np.arange(len(strings))
            self._add(strings, *encode(strings))
        return codes

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Flat ids of the strings of these codes, one after the other."""
        sizes = self.length[codes]
        ends = np.cumsum(sizes)
        return self.store[np.repeat(self.start[codes] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Join small Arrow batches until their texts have about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def give_back() -> None:
    """Return freed memory to the machine: workers live on between tasks, beside tasks of the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not a glibc system
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, release=()) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice have about ``limit`` bytes; a longer text is alone.

    ``release`` are called behind the last slice, to empty caches before freed memory is given back.
    """
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0)
        total = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype("int64"))
        start = 0
        while start < len(total):
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
    for f in release:
        f()
    give_back()
