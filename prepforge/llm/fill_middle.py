"""Fill-in-the-middle: texts cut at two unit boundaries and put together anew.

A Fenwick tree over blocks of a fixed number of bytes holds how many units end and how many code points
begin in them.  A cut is found by binary-lifting descent to its block; only that block is searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import slices

BLOCK = 1024                        # bytes of a block
SENTINELS = ("<P>", "<S>", "<M>")   # before prefix, suffix and middle
UNITS = ("line", "char")


class CutTree:
    """Units and code points of one UTF-8 text by blocks."""

    def __init__(self, data: bytes, unit: str = "line", block: int = BLOCK):
        self.data, self.block = np.frombuffer(data, dtype="uint8"), block
        self.first = (self.data & 0xC0) != 0x80  # bytes that begin a code point
        if unit == "line":
            self.ends = self.data == 10
            self.ends[-1:] = True  # the last line needs no line feed
        else:
            self.ends = np.append(self.first[1:], [True] * bool(len(data)))
        self.blocks = -(-len(data) // block)
        self.tree = np.zeros((self.blocks + 1, 2), dtype="int64")
        if self.blocks:
            cuts = np.arange(0, len(data), block)
            for i, flags in enumerate((self.ends, self.first)):
                self.tree[1:, i] = np.add.reduceat(flags, cuts, dtype="int64")
        step = 1
        while 2 * step <= self.blocks:  # every node takes the sums of its children
            nodes = np.arange(2 * step, self.blocks + 1, 2 * step)
            self.tree[nodes] += self.tree[nodes - step]
            step *= 2
        self.top = step

    def totals(self) -> tuple[int, int]:
        """Units and code points of the whole text."""
        units = chars = 0
        node = self.blocks
        while node:
            units, chars = units + int(self.tree[node, 0]), chars + int(self.tree[node, 1])
            node &= node - 1
        return units, chars

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before the end of the k-th unit; k is at most the number of units."""
        if not k:
            return 0, 0
        at = units = chars = 0
        step = self.top
        while step:
            node = at + step
            if node <= self.blocks and units + self.tree[node, 0] < k:
                at, units, chars = node, units + int(self.tree[node, 0]), chars + int(self.tree[node, 1])
            step //= 2
        low = at * self.block
        end = low + int(np.flatnonzero(self.ends[low:low + self.block])[k - units - 1]) + 1
        return end, chars + int(np.count_nonzero(self.first[low:end]))


def choices(doc_id, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document; a missing id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def rearranged(doc_id, data: bytes, seed: int, rate: int, spm: int, unit: str, marks: tuple[bytes, bytes, bytes]) -> tuple:
    """(units, form, prefix code points, middle code points, output bytes)."""
    tree = CutTree(data, unit)
    n = tree.totals()[0]
    a, b, use, order = choices(doc_id, seed)
    if not data or use % 100 >= rate or any(m in data for m in marks):
        return n, "plain", None, None, data
    low, high = sorted((a % (n + 1), b % (n + 1)))
    (i, before), (j, through) = tree.cut(low), tree.cut(high)
    p, s, m = marks
    prefix, middle, suffix = data[:i], data[i:j], data[j:]
    if order % 100 < spm:
        return n, "spm", before, through - before, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", before, through - before, b"".join((p, prefix, s, suffix, m, middle))


def check_marks(sentinels) -> None:
    """A sentinel must not begin inside another one, or an output could be read in two ways."""
    for a in sentinels:
        for b in sentinels:
            if any(b.startswith(a[i:]) for i in range(1 if a == b else 0, len(a))) or not a or sentinels.count(a) > 1:
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")


def transform(documents: DataFrame, text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line",
              sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row.

    ``n`` counts the units (lines with their line feed, or code points).  Of 100 documents ``rate`` are
    rearranged, ``spm`` of those with the suffix first; both and the cuts follow from the seed and doc_id
    alone.  A null text counts as empty; empty texts and texts that hold a sentinel stay plain, with null
    counts of code points.  A null doc_id counts as an empty one.  Repeated rows give equal rows, an empty
    table an empty one, texts of any length are cut whole, and columns beyond the two named are not read.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    check_marks(sentinels)
    marks = tuple(s.encode() for s in sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).fill_null("").cast(pa.binary()).to_pylist()
            n, form, before, middle, out = zip(*[rearranged(i, t, seed, rate, spm, unit, marks) for i, t in zip(batch.column(0).to_pylist(), texts)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(middle, pa.int64()),
                                              pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return documents.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text an output was made of, by string functions alone."""
    p, s, m = sentinels
    between = lambda left, right: F.substring_index(F.substring_index(output, left, -1), right, 1)
    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(moved: DataFrame) -> DataFrame:
    """The counts with the digests of output and restored text instead of the texts."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle(table: str = "documents", seed: int = 7, rate: int = 100, spm: int = 50) -> str:
    """The digests of all rows in DuckDB SQL."""
    p, s, m = SENTINELS
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {table}),
u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS us, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS lo, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS hi FROM u),
x AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(us[1:lo], '') AS prefix, array_to_string(us[lo + 1:hi], '') AS middle, array_to_string(us[hi + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM x"""
