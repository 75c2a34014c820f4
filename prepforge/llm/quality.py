"""Quality rules: lines that many documents of a host share are removed, depleted documents rejected.

Lines are normalised and hashed, and for each host and line the *distinct* documents are counted.
Documents are told apart by the hash of their whole text, so only exact copies count once: a block of
boilerplate amid different texts is removed however many lines it has, and a text that was copied
often is left to near-duplicate removal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import fits, free_names, stored
from .tokens import slices

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"  # fixed values of the rule
_SPACE = " \t\n\x0b\x0c\r"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_DOCUMENTS = 3     # a line in so many distinct documents of a host is removed, however large the host
SHARE = 0.01          # of the host's documents, for callers who ask for a share
MAX_REMOVED = 0.5     # share of a document's words
MIN_WORDS = 50
MAX_REPEATED = 0.5


class _Codes(dict):
    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def text_stats(text: str, codes: dict | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    words = text.encode().split()  # splits at exactly the six white-space bytes of the word rule
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    n, repeated = len(words), 0
    if n > 3:
        codes = _Codes() if codes is None else codes
        ids = np.fromiter(map(codes.__getitem__, words), dtype="int64", count=n)
        if len(codes) < 1 << 21:
            windows = ids[:-2] << 42 | ids[1:-1] << 21 | ids[2:]
        else:  # more distinct words than 21 bits: number the pairs first
            pairs = np.unique(ids[:-1] * np.int64(len(codes)) + ids[1:], return_inverse=True)[1]
            windows = pairs[:-1] * np.int64(len(codes)) + ids[2:]
        order = np.argsort(windows, kind="stable")
        alike = windows[order][1:] == windows[order][:-1]
        if alike.any():
            found = np.zeros(n, dtype=bool)
            at = np.unique(np.concatenate([order[1:][alike], order[:-1][alike]]))
            for k in range(3):
                found[at + k] = True
            repeated = int(found.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def with_stats(documents: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_key, five counts): one row for each document, null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for batch in slices(batches, release=[codes.clear]):
            rows = []
            for t in batch.column(2).to_pylist():
                if len(codes) > 300_000:
                    codes.clear()
                rows.append(text_stats(t or "", codes))
            counts = np.array(rows, dtype="int64").reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(counts[:, i]) for i in range(5)]], names=["doc_id", "text_key", *STATS])

    keyed = documents.select("doc_id", text_key(text).alias("text_key"), F.col(text).alias("text"))
    return keyed.mapInArrow(run, "doc_id bigint, text_key bigint, " + ", ".join(f"{c} bigint" for c in STATS))


def text_key(text: str = "text"):
    """Rows with one doc_id and one text share all verdicts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def normalised(line):
    """Lower case, digits as 0, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def line_number(line):
    """60 bits of a normalised line that other engines can repeat."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("bigint")


def line_rows(documents: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, text_key, host, line, words): lines with a word."""
    lines = documents.select("doc_id", text_key(text).alias("text_key"), F.col(host).alias("host"), F.split(F.col(text), "\n").alias("lines"))
    hashed = lines.withColumn("lines", F.filter(F.transform("lines", lambda x: normalised(x)), lambda x: x != ""))
    rows = hashed.select("doc_id", "text_key", "host", F.explode("lines").alias("l"))
    return rows.select("doc_id", "text_key", "host", line_number(F.col("l")).alias("line"), F.size(F.split("l", " ")).alias("words"))


def frequent_lines(lines: DataFrame, documents: DataFrame, text: str = "text", host: str = "source", min_documents: int = MIN_DOCUMENTS, share: float | None = None) -> DataFrame:
    """(host, line) in at least ``min_documents`` distinct documents of the host, and in more than a ``share`` of them if asked for.

    Distinct (host, line, text_key) rows come first, with map-side combine, so neither a hot line nor a hot
    host meets in one task.
    """
    seen = lines.select("host", "line", "text_key").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_documents)
    if share is None:
        return seen.select("host", "line")
    hosts = documents.select(F.col(host).alias("host"), text_key(text).alias("text_key")).distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    return seen.join(hosts, seen.host.eqNullSafe(hosts.host)).where(F.col("docs") > share * F.col("all")).select(seen.host, "line")


def judge(documents: DataFrame, text: str = "text", host: str = "source", min_documents: int = MIN_DOCUMENTS, share: float | None = None,
          max_removed: float = MAX_REMOVED) -> DataFrame:
    """doc_id, text_key, the counts, removed_words, base_failed and kept for every row.

    A document fails the base with fewer than 50 words, or when more than half of its words lie in
    3-word windows that occur twice or more.  It is depleted when more than ``max_removed`` of its
    words stand in frequent lines.  A null text has no words and fails; a null host is a host of its own;
    repeated rows get equal verdicts and count once in the line counts; an empty table gives an empty
    one.  Columns beyond the three named ones are not read.
    """
    lines = line_rows(documents, text, host)
    frequent = frequent_lines(lines, documents, text, host, min_documents, share)
    hit = lines.join(frequent.withColumnsRenamed({"host": "f_host", "line": "f_line"}), (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")), "left_semi")
    # rows that repeat a document repeat its lines: divide by how often it occurs
    removed = hit.groupBy("doc_id", "text_key", "host").agg(F.sum("words").alias("words"))
    stats = with_stats(documents.withColumn("text", F.col(text)) if text != "text" else documents)
    times = stats.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"), *[F.first(c).alias(c) for c in STATS])
    removed = removed.groupBy("doc_id", "text_key").agg(F.sum("words").alias("words"))
    removed = removed.select(F.col("doc_id").alias("r_doc"), F.col("text_key").alias("r_key"), "words")
    joined = times.join(removed, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("text_key") == F.col("r_key")), "left")
    joined = joined.withColumn("removed_words", F.coalesce((F.col("words") / F.col("times")).cast("bigint"), F.lit(0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    out = joined.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("removed_words") <= max_removed * F.col("n_words")))
    repeated = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return repeated.select("doc_id", "text_key", *STATS, "removed_words", "base_failed", "kept")


def strip_lines(documents: DataFrame, text: str = "text", host: str = "source", min_documents: int = MIN_DOCUMENTS, share: float | None = None, min_words: int = 1) -> DataFrame:
    """All rows and columns; ``text`` without the lines that are frequent on their host, ``n_chars`` follows it.

    Only lines of at least ``min_words`` words go.  Each document brings the numbers of its own frequent lines, so no text
    is shuffled.  Texts without such a line, null and empty ones too, stay as they are; repeated rows are stripped alike; an
    empty table gives an empty one; columns of any name are kept.
    """
    lines = line_rows(documents, text, host).where(F.col("words") >= min_words)
    frequent = frequent_lines(lines, documents, text, host, min_documents, share).withColumnsRenamed({"host": "f_host", "line": "f_line"})
    hit = lines.join(frequent, (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")), "left_semi")
    doc, key, own, gone = free_names(documents, "l_doc", "l_key", "l_own", "l_gone")
    lists = stored(hit.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key), "host").agg(F.collect_set("line").alias(gone)), "lines")
    at = free_names(documents.withColumns({doc: F.lit(0), key: F.lit(0), own: F.lit(0), gone: F.lit(0)}), "l_host")[0]
    lists = lists.withColumnRenamed("host", at)
    joined = documents.withColumn(own, text_key(text)).join(lists, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)) & F.col(host).eqNullSafe(F.col(at)), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x: ~F.array_contains(F.col(gone), line_number(normalised(x)))), "\n")
    new = F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept)
    return joined.select(*[new.alias(c) if c == text else F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(kept)).cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in documents.columns])


def keep_good(documents: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that ``judge`` keeps, all columns, whole texts.

    Null and empty texts go, since they fail the base; repeated rows stay or go together; an empty table gives
    an empty one; columns of any name are kept as they are.
    """
    bad = stored(judge(documents, text, host).where(~F.col("kept")).select("doc_id", "text_key").distinct(), "rejected")
    return without(documents, bad, text)


def without(documents: DataFrame, bad: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose (doc_id, text) is not listed; the list is broadcast only when a count proves it small."""
    doc, key, own = free_names(documents, "b_doc", "b_key", "b_text")
    bad = bad.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key))
    bad = F.broadcast(bad) if fits(bad, 200_000) else bad
    marked = documents.withColumn(own, text_key(text))
    return marked.join(bad, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(key)), "left_anti").drop(own)


def oracle(table: str = "documents") -> str:
    """The same verdicts in DuckDB SQL (doc_id must be a key there)."""
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM {table}),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM d)),
t AS (SELECT *, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS hit FROM t),
p AS (SELECT doc_id, hit OR coalesce(lag(hit, 1) OVER o, false) OR coalesce(lag(hit, 2) OVER o, false) AS hit FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE hit) AS n_repeat_words FROM p GROUP BY 1),
c AS (SELECT doc_id, sum(length(w)) AS word_chars FROM w GROUP BY 1),
l AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT doc_id, host, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '{space}+', ' ', 'g')) AS norm FROM l),
h AS (SELECT doc_id, host, line, ('0x' || substr(md5(norm), 1, 15))::BIGINT AS h, len(string_split(norm, ' ')) AS words FROM n WHERE norm <> ''),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM h GROUP BY 1),
q AS (SELECT DISTINCT h.host, h, md5(text) AS t FROM h JOIN d USING (doc_id)),
k AS (SELECT host, h FROM q GROUP BY host, h HAVING count(*) >= {MIN_DOCUMENTS}),
g AS (SELECT doc_id, sum(words) AS removed_words FROM h JOIN k ON h.h = k.h AND h.host IS NOT DISTINCT FROM k.host GROUP BY 1),
b AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN g USING (doc_id)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * MAX_REPEATED)} * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, removed_words::BIGINT AS removed_words, base_failed, NOT base_failed AND removed_words <= {MAX_REMOVED} * n_words AS kept FROM v"""
