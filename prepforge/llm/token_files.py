"""Token files: whole corpora of ids, ordered by document, in range-coded blocks.

A set of files is a folder with one sub-folder ``file=<n>`` for each range of document ids, in
ascending order.  Every file is written by one task through Spark's committer, so a retried task
leaves no half file and any store that Spark writes to will do.  A file is a table of blocks; a block
holds whole documents (ids and lengths) and their ids as coded by ``range_coder``, with checksums, and
can be read on its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import corpus_encoder
from .range_coder import decode_block, encode_block
from .tokens import CACHE_PIECES, gathered, slices

BLOCKS = "file int, first_token bigint, n_docs bigint, n_tokens bigint, block binary"
DOCUMENTS = "file int, doc_id bigint, file_start bigint, ids binary"
BLOCK_TOKENS = 1 << 20
FILE_DOCS = 4096
SLICE_BYTES = 24_000_000  # known pieces are looked up once a slice
MAX_FILES = 50_000
_HEAD = "<4sIQI"  # magic, documents, bytes of the document table, its crc
_MAGIC = b"ptok"


def pack_block(doc_ids: list, lengths: list[int], ids: np.ndarray, alphabet: int) -> bytes:
    """Document table and coded ids; a null document id is kept as such."""
    known = np.array([d is not None for d in doc_ids])
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    table = zlib.compress(np.packbits(known).tobytes() + keys.tobytes() + np.array(lengths, dtype="<u4").tobytes(), 1)
    return struct.pack(_HEAD, _MAGIC, len(doc_ids), len(table), zlib.crc32(table)) + table + encode_block(ids, alphabet)


def unpack_block(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids); a damaged block raises ValueError."""
    magic, n, size, crc = struct.unpack_from(_HEAD, block)
    table = block[struct.calcsize(_HEAD):struct.calcsize(_HEAD) + size]
    if magic != _MAGIC or zlib.crc32(table) != crc:
        raise ValueError("damaged document table")
    raw, bits = zlib.decompress(table), -(-n // 8)
    known = np.unpackbits(np.frombuffer(raw, "uint8", count=bits), count=n).astype(bool)
    keys = np.frombuffer(raw, "<i8", offset=bits, count=n)
    lengths = np.frombuffer(raw, "<u4", offset=bits + 8 * n, count=n).astype("int64")
    doc_ids = [k if ok else None for k, ok in zip(keys.tolist(), known.tolist())]
    return doc_ids, lengths, decode_block(block[struct.calcsize(_HEAD) + size:])


def file_bounds(documents: DataFrame, key: str, file_docs: int) -> list[int]:
    """Document ids at which a new file begins; reads the key column only."""
    rows = documents.agg(F.count(key)).head()[0]
    files = min(MAX_FILES, -(-rows // file_docs))
    if files < 2:
        return []
    cuts = [i / files for i in range(1, files)]
    found = documents.agg(F.percentile_approx(key, cuts, max(10_000, 20 * files))).head()[0]
    return sorted(set(found))


def write_tokens(documents: DataFrame, path: str, tokenizer: str, alphabet: int, end_id: int = 0, file_docs: int = FILE_DOCS,
                 block_tokens: int = BLOCK_TOKENS, cache_pieces: int = CACHE_PIECES, keep_cache: bool = False) -> None:
    """Encode every whole text, append ``end_id`` and write the files in ascending ``doc_id`` order.

    Ids go through one shuffle by range of documents, two bytes each where the alphabet allows.  A task
    holds one block at a time; a document is never cut.  A null or empty text is its end id alone, rows
    with one doc_id stay apart and are ordered by their ids, null doc_ids come first.  ``cache_pieces`` words are
    remembered with their ids (about 60 bytes each), until the end of a task or, with ``keep_cache``, as long as the worker lives.
    """
    bounds = np.array(file_bounds(documents, "doc_id", file_docs), dtype="int64")
    kind = "<u2" if alphabet <= 1 << 16 else "<u4"
    worker = documents.sparkSession.sparkContext.broadcast({})  # a worker keeps its copy from task to task

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker.value if keep_cache else {}
        if "encoder" not in known:
            known["encoder"] = corpus_encoder(tokenizer, cache_pieces)
        encoder = known["encoder"]
        for part in slices(gathered(batches, limit=SLICE_BYTES), limit=SLICE_BYTES, release=[] if keep_cache else [encoder.forget]):
            keys = part.column(0)
            ids, offsets = encoder.encode(part.column(1))
            data, cuts = ids.astype(kind).tobytes(), (offsets * np.dtype(kind).itemsize).tolist()
            file = np.searchsorted(bounds, keys.fill_null(np.iinfo("int64").min).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.int32()), keys, pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["file", "doc_id", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, first, doc_ids, parts, held = None, 0, [], [], 0

        def flush():
            nonlocal first, doc_ids, parts, held
            row = [file, first, len(doc_ids), held, pack_block(doc_ids, [len(p) for p in parts], np.concatenate(parts), alphabet)]
            first, doc_ids, parts, held = first + held, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=[c.split()[0] for c in BLOCKS.split(", ")])

        end = np.array([end_id], dtype=kind)
        for batch in batches:
            for f, d, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (f != file or held + len(raw) // end.itemsize + 1 > block_tokens):
                    yield flush()
                if f != file:
                    file, first = f, 0
                doc_ids.append(d)
                parts.append(np.concatenate([np.frombuffer(raw, dtype=kind), end]))
                held += len(parts[-1])
        if held:
            yield flush()

    coded = documents.select("doc_id", "text").mapInArrow(tokens, "file int, doc_id bigint, ids binary")
    spread = coded.repartition(max(1, len(bounds) + 1), "file").sortWithinPartitions("file", "doc_id", "ids")
    spread.mapInArrow(blocks, BLOCKS).write.partitionBy("file").option("compression", "uncompressed").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: file, doc_id, file_start (ids before it in its file) and its ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, first, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc_ids, lengths, ids = unpack_block(block)
                data, ends = ids.tobytes(), np.cumsum(lengths)
                values = [data[a:b] for a, b in zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(first + ends - lengths), pa.array(values, pa.binary())],
                                                 names=["file", "doc_id", "file_start", "ids"])

    return read_blocks(spark, path).select("file", "first_token", "block").mapInArrow(run, DOCUMENTS)


def with_starts(tokens: DataFrame, path: str) -> DataFrame:
    """Add ``start``, the ids of all documents before; the files (at most ``MAX_FILES``) are summed first."""
    totals = read_blocks(tokens.sparkSession, path).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return tokens.join(F.broadcast(before), "file").withColumn("start", F.col("before") + F.col("file_start")).drop("before")
