"""Packing documents into training sequences of even cost.

A sequence costs the sum of ``linear * n + quadratic * n * n`` over its pieces of n tokens, since
attention stays inside a piece.  The documents of a window are taken in descending length, and each
goes to the sequence of lowest cost that has token capacity left; what does not fit goes on to the
next such sequence.  The capacities of a window add up to its tokens exactly: full sequences, and
powers of two for the rest, so nothing is padded.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import piece_encoder
from .tokens import CACHE_PIECES, give_back, slices

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
WINDOW_TOKENS = 1 << 20


def capacities(total: int, size: int) -> list[int]:
    """Full sequences, then the binary digits of the rest."""
    rest = total % size
    return [size] * (total // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_lengths(lengths, size: int, linear: float = 1.0, quadratic: float = 1.0 / 4096) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of the given lengths.

    Ties between documents go to the earlier one, ties between sequences to the lower number.  Documents
    without tokens give no piece.
    """
    sizes = capacities(int(sum(lengths)), size)
    free, fill = list(sizes), [0] * len(sizes)
    heap = [(0.0, i) for i in range(len(sizes))]
    pieces = []
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, left = 0, int(lengths[doc])
        while left:
            cost, seq = heap[0]
            n = min(left, free[seq])
            pieces.append((doc, start, n, seq, fill[seq]))
            free[seq] -= n
            fill[seq] += n
            if free[seq]:
                heapq.heapreplace(heap, (cost + linear * n + quadratic * n * n, seq))
            else:
                heapq.heappop(heap)
            start, left = start + n, left - n
    return pieces


def pack(documents: DataFrame, path: str, size: int = 4096, end_id: int = 2, window_tokens: int = WINDOW_TOKENS,
         linear: float = 1.0, quadratic: float = 1.0 / 4096, cache_pieces: int = CACHE_PIECES, keep_cache: bool = False) -> DataFrame:
    """One row for each piece of each document's ids (with the end id) in its sequence.

    Every task packs its own rows in windows of about ``window_tokens`` tokens, so there is no shuffle and
    a task holds one window of ids; a document longer than a window is a window of its own.  A null or
    empty text is its end id alone.  Repeated rows are packed once each; other columns are not read; an empty
    table gives an empty one.  ``cache_pieces`` words are remembered with their ids (about 250 bytes each), until the
    end of a task or, with ``keep_cache``, as long as the worker lives.
    """
    if size & (size - 1):
        raise ValueError("the sequence length must be a power of two")

    worker = documents.sparkSession.sparkContext.broadcast({})  # a worker keeps its copy from task to task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known = worker.value if keep_cache else {}
        if "encoder" not in known:
            known["encoder"] = piece_encoder(path, cache_pieces=cache_pieces)
        encoder = known["encoder"]
        base, used = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0
        tail = np.uint32(end_id).astype("<u4").tobytes()
        doc_ids, ids, held = [], [], 0

        def flush():
            nonlocal doc_ids, ids, held, used
            lengths = [len(x) // 4 for x in ids]
            pieces = pack_lengths(lengths, size, linear, quadratic)
            d, start, n, seq, offset = (np.array(c, dtype="int64") for c in zip(*pieces))
            crc = [zlib.crc32(memoryview(ids[i])[4 * s:4 * (s + m)]) for i, s, m, _, _ in pieces]
            columns = [np.array(lengths, dtype="int64")[d], base + used + seq, offset]
            used += int(seq.max()) + 1
            out = pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()).take(pa.array(d)), pa.array(start), pa.array(n), pa.array(crc, pa.int64()), *map(pa.array, columns)],
                                             names=[c.split()[0] for c in PIECES.split(", ")])
            doc_ids, ids, held = [], [], 0
            return out

        for part in slices(batches, limit=4_000_000, release=[] if keep_cache else [encoder.forget]):
            for i, x in zip(part.column(0).to_pylist(), encoder.encode_bytes(part.column(1))):
                x += tail
                if held and held + len(x) // 4 > window_tokens:
                    yield flush()
                doc_ids.append(i)
                ids.append(x)
                held += len(x) // 4
        if held:
            yield flush()

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)
