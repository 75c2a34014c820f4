"""Benchmark decontamination with a generalised suffix automaton of the benchmark's items.

Item words become numbers, and one automaton takes all items of a shard.  The words of a document are
streamed through it; after each word the automaton knows the longest run of words, ending there, that
some item holds.  A run as long as the window, or a whole shorter item, is a hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import text_key
from .storage import fits, free_names, stored
from .tokens import slices

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHARD_WORDS = 200_000   # item words of an automaton; a benchmark with more is matched shard by shard
PART_WORDS = 20_000     # a longer item is cut into parts that share window - 1 words
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SPANS = "spans array<struct<start: bigint, end: bigint>>, items array<string>, longest bigint"
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A to Z only) words: runs of ASCII letters, digits and all characters beyond ASCII."""
    return text.encode().translate(_WORDS).split() if text else []


class SuffixAutomaton:
    """All runs of words of a set of items, with the items that hold a window or are a whole short run."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(name, [self.codes.setdefault(w, len(self.codes)) for w in words]) for name, words in items if words]
        for _, item in coded:
            last = 0
            for c in item:
                last = self._extend(last, c)
        self._mark(coded)

    def _state(self, edges: dict[int, int], link: int, size: int) -> int:
        self.edges.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state behind p for c that has exactly the runs of p with c; q itself or a copy of it."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(dict(self.edges[q]), self.link[q], self.size[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.edges[p].get(c) == q:
            self.edges[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        known = self.edges[last].get(c)
        if known is not None:
            return self._split(last, c, known)
        new, p = self._state({}, 0, self.size[last] + 1), last
        while p >= 0 and c not in self.edges[p]:
            self.edges[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.edges[p][c])
        return new

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """Which state stands for the last ``window`` words, where short items end, and their items."""
        order = sorted(range(len(self.size)), key=self.size.__getitem__)
        self.short: dict[int, set[str]] = {}
        self.full: dict[int, set[str]] = {}
        self.top = list(range(len(self.size)))  # the ancestor whose runs include the one of window length
        for s in order:
            if self.link[s] >= 0 and self.size[self.link[s]] >= self.window:
                self.top[s] = self.top[self.link[s]]
        for name, item in coded:
            state = 0
            for i, c in enumerate(item):
                state = self.edges[state][c]
                if i + 1 >= self.window:
                    self.full.setdefault(self.top[state], set()).add(name)
            if len(item) < self.window:  # the whole item is the longest run of its state
                self.short.setdefault(state, set()).add(name)
        # the nearest short item at a state or above it, and the length from which on a match there is a hit
        self.above, self.need = [-1] * len(self.size), [self.window] * len(self.size)
        for s in order[1:]:
            up = self.link[s]
            self.above[s] = s if s in self.short else self.above[up]
            self.need[s] = min(self.need[up], self.size[s] if s in self.short else self.window)

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str], int]:
        """(hit spans of words, items that hit, longest run shared with an item) of one document."""
        edges, link, size, need, window = self.edges, self.link, self.size, self.need, self.window
        spans: list[list[int]] = []
        items: set[str] = set()
        state = length = longest = i = 0
        for c in map(self.codes.get, words):
            i += 1
            if c is None:
                if length > longest:
                    longest = length
                state = length = 0
                continue
            step = edges[state].get(c)
            if step is None:
                if length > longest:
                    longest = length
                while step is None:
                    state = link[state]
                    step = edges[state].get(c)  # every coded word leaves the root
                length = size[state]
            state, length = step, length + 1
            if length >= need[state]:
                reach = 0
                if length >= window:
                    reach = window
                    items |= self.full[self.top[state]]
                up = self.above[state]
                while up >= 0:
                    if size[up] <= length:
                        reach = max(reach, size[up])
                        items |= self.short[up]
                    up = self.above[link[up]]
                start = i - reach
                while spans and start <= spans[-1][1]:
                    start = min(start, spans.pop()[0])
                spans.append([start, i])
        return spans, items, max(longest, length)


def item_parts(benchmark: DataFrame, window: int, text: str = "text", item: str = "item_id", part_words: int = PART_WORDS) -> DataFrame:
    """(item, words, n): items in normal form; long ones in parts that share ``window - 1`` words, so no window is lost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(t)
                for at in range(0, max(1, len(words) - window + 1), part_words) if words else ():
                    part = words[at:at + part_words + window - 1]
                    rows.append((name, b" ".join(part).decode(), len(part)))
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "words", "n"), r)) for r in rows], schema=pa.schema([("item", pa.string()), ("words", pa.string()), ("n", pa.int64())]))

    named = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(run, "item string, words string, n bigint").distinct()


def shards(parts: DataFrame, limit: int = SHARD_WORDS) -> Iterator[list[tuple[str, str]]]:
    """The parts in shards of at most ``2 * limit`` words each, proved by a count before one is fetched."""
    count = max(1, -(-(parts.agg(F.sum("n").alias("n")).head()["n"] or 0) // limit))
    while True:
        number = F.pmod(F.xxhash64("item", "words"), F.lit(count))
        sizes = parts.groupBy(number.alias("shard")).agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).head()["n"] or 0
        if sizes <= 2 * max(limit, PART_WORDS + WINDOW):
            break
        count *= 2
    for k in range(count):
        yield [(r["item"], r["words"]) for r in parts.where(number == k).select("item", "words").collect()]


def matched(documents: DataFrame, shard: list[tuple[str, str]], window: int, text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words, spans, items, longest) of every row against one shard; no shuffle."""
    held = documents.sparkSession.sparkContext.broadcast(shard)  # at most 2 * SHARD_WORDS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton([(name, words.encode().split()) for name, words in held.value], window)
        for batch in slices(batches):
            columns: tuple[list, ...] = ([], [], [], [])
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                spans, items, longest = automaton.scan(words)
                for column, value in zip(columns, (len(words), [{"start": a, "end": b} for a, b in spans], sorted(items), longest)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[0], pa.int64()), pa.array(columns[1], ARROW_SPANS), pa.array(columns[2], pa.list_(pa.string())), pa.array(columns[3], pa.int64())],
                                             names=["doc_id", "text_key", "n_words", "spans", "items", "longest"])

    keyed = documents.select("doc_id", text_key(text).alias("text_key"), F.col(text).alias("text"))
    return keyed.mapInArrow(run, f"doc_id bigint, text_key bigint, n_words bigint, {SPANS}")


def _merged(spans):
    """Overlapping and touching spans of an array joined."""
    kind = "array<struct<start: bigint, end: bigint>>"

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))
        return F.when(last.isNotNull() & (s["start"] <= last["end"]), joined).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text_key, n_words, spans, items, longest) for every row of ``documents``.

    ``spans`` are the hit words [start, end), merged; ``items`` the ids, as strings, of items whose windows
    occur; ``longest`` the longest run of words shared with an item (with a part of it beyond 20,000 words).
    Items shorter than the window count as a whole; items without words never hit.  A null text has no words;
    a null item id counts as an empty one; repeated documents get equal rows; repeated items count once; an
    empty benchmark hits nothing and an empty table gives an empty one.  Columns beyond the named are not read.

    One shard is one pass without a shuffle.  More shards are one pass each, which keeps hit rows only.
    """
    parts = stored(item_parts(benchmark, window, text="text", item=item), "items")
    pieces = shards(parts, shard_words)
    first, second = next(pieces), next(pieces, None)
    if second is None:
        return matched(documents, first, window, text)
    base, hits = matched(documents, first, window, text), []
    for shard in [second, *pieces]:
        hits.append(stored(matched(documents, shard, window, text).where("longest > 0").drop("n_words"), "hits"))
    base = stored(base, "hits")
    rows = base.where("longest > 0").drop("n_words")
    for h in hits:
        rows = rows.unionByName(h)
    total = rows.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("longest").alias("longest"))
    total = total.select(F.col("doc_id").alias("t_doc"), F.col("text_key").alias("t_key"), _merged(F.col("spans")).alias("spans"), "items", "longest")
    plain = base.select("doc_id", "text_key", "n_words")
    joined = plain.join(total, F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("text_key") == F.col("t_key")), "left")
    nothing = base.schema
    return joined.select("doc_id", "text_key", "n_words", *[F.coalesce(c, F.lit(0) if c == "longest" else F.array().cast(nothing[c].dataType)).alias(c) for c in ("spans", "items", "longest")])


def hit_words(spans="spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_share: float = 0.5, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents, all columns, without the hit spans; those hit in more than ``max_share`` of their words go.

    A span is cut from the first character of its first word to the last of its last one; what stands between
    words stays.  Rows without a hit are unchanged, null texts included.
    """
    found = find(documents, benchmark, window, text, item).where("size(spans) > 0").select("doc_id", "text_key", "spans", (hit_words() > max_share * F.col("n_words")).alias("goes"))
    f_doc, f_key, f_spans, f_goes, own = free_names(documents, "f_doc", "f_key", "f_spans", "f_goes", "own_key")
    found = stored(found.toDF(f_doc, f_key, f_spans, f_goes).distinct(), "contaminated")
    found = F.broadcast(found) if fits(found, 10_000) else found
    marked = documents.withColumn(own, text_key(text)).join(found, F.col("doc_id").eqNullSafe(F.col(f_doc)) & (F.col(own) == F.col(f_key)), "left")
    marked = marked.where(~F.coalesce(F.col(f_goes), F.lit(False))).drop(f_doc, f_key, f_goes, own)
    pattern = re.compile(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))  # lower-casing keeps every position

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            at, spans = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index(f_spans)).to_pylist()
            texts = batch.column(at)
            if any(spans):
                values = texts.to_pylist()
                for i, s in enumerate(spans):
                    if s:
                        places = [m.span() for m in pattern.finditer(values[i])]
                        kept, end = [], 0
                        for x in s:
                            kept.append(values[i][end:places[x["start"]][0]])
                            end = places[x["end"] - 1][1]
                        values[i] = "".join([*kept, values[i][end:]])
                texts = pa.array(values, texts.type)
            out = batch.set_column(at, batch.schema.field(at), texts)
            yield out.drop_columns([f_spans])

    return marked.mapInArrow(cut, documents.schema)


def verdicts(found: DataFrame) -> DataFrame:
    """Counts and digest of the items for each document."""
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def oracle(window: int = WINDOW) -> str:
    """The same verdicts in DuckDB SQL (doc_id must be a key there)."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all(coalesce({low}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS ws FROM benchmark),
s AS (SELECT *, least({window}, len(ws)) AS m FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, m, array_to_string(ws[p:p + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, CAST(len(ws) - m + 2 AS BIGINT))) AS p FROM s)),
d AS (SELECT doc_id, {words} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, CAST(len(ws) + 1 AS BIGINT))) AS p FROM d),
g AS (SELECT doc_id, p, m, array_to_string(ws[p:p + m - 1], ' ') AS g FROM p, (SELECT DISTINCT m FROM w) WHERE p + m - 1 <= len(ws)),
h AS (SELECT doc_id, p, g.m, item FROM g JOIN w ON g.g = w.g AND g.m = w.m),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, CAST(p + m AS BIGINT))) AS q FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""
