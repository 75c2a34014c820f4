"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is a short given list and what labelled documents add to it: words and word beginnings
that stand in toxic documents far more often than chance allows.  A word is run through the
Levenshtein automata of all terms at once, as one automaton over the trie of the lexicon whose states
are built when first met.  A hit is weighed by its context: near a quoting mark or word it counts
as a quotation, otherwise as abuse, more so near a form of address.  A logistic model on these sums,
fitted to a bounded sample of labelled documents, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices


SEED = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "bastard", "asshole", "bitch"]
QUOTING = {"said", "says", "wrote", "quoted", "quote", "term", "word", "called", "phrase", "definition", "means"}
ADDRESS = {"you", "your", "youre", "u", "ur", "yourself"}
SAMPLE_ROWS = 20_000   # labelled rows the lexicon and the model are fitted on
MAX_TERMS = 2_000      # terms learned from labels
PREFIXES = range(4, 9)
WINDOW = 4             # words on either side
WORD = re.compile(r"[^\W_]+(?:[@$!*'’][^\W_]+)*")
FEATURES = 7
NO_MATCH = (0.0, 0.0, 0.0)


class Lexicon:
    """Trie of whole terms and beginnings with the automaton over it."""

    def __init__(self, terms: dict[str, float], beginnings: dict[str, float], tolerant: set[str] | None = None):
        """``tolerant`` terms may be misspelled by one edit (all given ones of five letters or more)."""
        self.children: list[dict[str, int]] = [{}]
        self.word: list[float] = [0.0]
        self.begin: list[float] = [0.0]
        self.fuzzy: list[bool] = [False]
        for source, value in ((terms, self.word), (beginnings, self.begin)):
            for term, weight in source.items():
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        for column, empty in ((self.children, {}), (self.word, 0.0), (self.begin, 0.0), (self.fuzzy, False)):
                            column.append(dict(empty) if isinstance(empty, dict) else empty)
                    node = self.children[node][c]
                value[node] = max(value[node], weight)
                if value is self.word and tolerant and term in tolerant:
                    self.fuzzy[node] = True
        # which nodes still lead to a term that may be misspelled
        self.leads = list(self.fuzzy)
        for node in range(len(self.children) - 1, -1, -1):
            self.leads[node] = self.leads[node] or any(self.leads[c] for c in self.children[node].values())
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.best_begin: list[float] = []
        self.accept: list[tuple[float, float]] = []
        self.start = self._state(frozenset({(0, 0)}))
        self.cache: dict[str, tuple[float, float, float]] = {}

    def _closed(self, pairs) -> frozenset:
        """With deletions from the term: one edit moves down without reading a letter."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, edits = todo.pop()
            if best.get(node, 2) <= edits:
                continue
            best[node] = edits
            if edits == 0:
                todo += [(c, 1) for c in self.children[node].values() if self.leads[c]]
        return frozenset(best.items())

    def _state(self, pairs) -> int:
        key = self._closed(pairs)
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(key)
            self.next.append({})
            self.best_begin.append(max((self.begin[n] for n, e in key if e == 0), default=0.0))
            self.accept.append((max((self.word[n] for n, e in key if e == 0), default=0.0),
                                max((self.word[n] for n, e in key if e == 1 and self.fuzzy[n]), default=0.0)))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        pairs = []
        for node, edits in self.members[state]:
            down = self.children[node].get(c)
            if down is not None and (edits == 0 or self.leads[down]):
                pairs.append((down, edits))
            if edits == 0 and self.leads[node]:
                pairs.append((node, 1))                                            # an added letter
                pairs += [(x, 1) for x in self.children[node].values() if x != down and self.leads[x]]  # a wrong one
        self.next[state][c] = to = self._state(pairs) if pairs else -1
        return to

    def match(self, word: str) -> tuple[float, float, float]:
        """(weight of the term it is, of the term it misspells, of its beginning)."""
        found = self.cache.get(word)
        if found is not None:
            return found
        state, begin = self.start, 0.0
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                break
            if self.best_begin[state] > begin:
                begin = self.best_begin[state]
        exact, near = self.accept[state] if state >= 0 else (0.0, 0.0)
        result = (exact, 0.0 if exact else near, begin) if exact or near or begin else NO_MATCH
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[word] = result
        return result


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Context-weighted sums of the hits of a text: strongest hit, abuse, misspelled abuse, beginnings, quotations, address, their density."""
    low = text.lower()
    words = WORD.findall(low)
    match = lexicon.match
    at = [i for i, w in enumerate(words) if any(match(w))]
    if not at:
        return [0.0] * FEATURES
    spans = list(WORD.finditer(low))
    top = abuse = near = begins = quoted = address = 0.0
    for i in at:
        exact, fuzzy, begin = match(words[i])
        weight = max(exact, 0.8 * fuzzy, begin)
        a, b = spans[max(0, i - WINDOW)].start(), spans[min(len(spans), i + WINDOW + 1) - 1].end()
        around = words[max(0, i - WINDOW):i] + words[i + 1:i + 1 + WINDOW]
        before, behind = low[a:spans[i].start()], low[spans[i].end():b]
        marks = any(before.count(q) % 2 for q in '"“«') and any(q in behind for q in '"”»')
        if marks or QUOTING.intersection(around):
            quoted += weight
            weight *= 0.3
        elif ADDRESS.intersection(around):
            address += weight
        top = max(top, weight)
        if exact:
            abuse += weight
        elif fuzzy:
            near += weight
        else:
            begins += weight
    return [top, math.log1p(abuse), math.log1p(near), math.log1p(begins), math.log1p(quoted), math.log1p(address), math.log1p(abuse + near + begins) / math.log(len(words) + 8)]


def is_training(column, buckets: int = 5):
    return F.crc32(column.cast("string")) % buckets != 0


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled training documents, chosen by a hash of doc_id."""
    chosen = labels.where(F.col("toxic").isin(0, 1) & is_training(F.col("doc_id"))).select(F.col("doc_id").alias("s_doc"), F.col("toxic").cast("int").alias("s_toxic"))
    chosen = chosen.orderBy(F.xxhash64("s_doc"), "s_doc", "s_toxic").limit(rows)
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("s_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("s_doc")).select("s_doc", "s_text", "s_toxic")


def learned_terms(sample: DataFrame, max_terms: int = MAX_TERMS) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with their log odds, where chance would give fewer than one such term.

    Document counts by word are summed in Spark; only terms with no more than a fifth of their documents
    clean come to the driver, at most ``max_terms`` of them.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall(text.lower()))
                terms = {"w" + w for w in words} | {"b" + w[:n] for w in words for n in PREFIXES if len(w) > n}
                (toxic if label else clean).update(terms)
        terms = list(toxic.keys())
        extra = [t for t in clean if t not in toxic]
        yield pa.RecordBatch.from_arrays([pa.array(terms + extra, pa.string()), pa.array([toxic[t] for t in terms] + [0] * len(extra), pa.int64()), pa.array([clean[t] for t in terms + extra], pa.int64())], names=["term", "toxic", "clean"])

    sums = sample.select("s_text", "s_toxic").mapInArrow(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    total = sample.agg(F.sum("s_toxic"), F.count(F.lit(1))).head()
    if not total[0] or total[0] == total[1]:
        return {}, {}
    rate = total[0] / total[1]
    tail = F.col("t") * F.log(F.col("t") / ((F.col("t") + F.col("c")) * rate)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / ((F.col("t") + F.col("c")) * (1 - rate)))).otherwise(0.0)
    good = sums.where((F.col("t") >= 3) & (F.col("c") * 4 <= F.col("t"))).withColumn("gain", tail)
    # e ** -gain bounds the chance; about e ** 11 terms are looked at
    rows = good.where("gain > 11").orderBy(F.desc("gain"), "term").limit(max_terms).collect()
    odds = {r["term"]: math.log((r["t"] + 0.5) / (r["c"] + 0.5) * (1 - rate) / rate) for r in rows}
    return {t[1:]: v for t, v in odds.items() if t[0] == "w"}, {t[1:]: v for t, v in odds.items() if t[0] == "b"}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton steps for an L2-regularised logistic model; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1, len(x)) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """A lexicon and the weights of a logistic model over its context sums."""

    def __init__(self, terms: dict[str, float], beginnings: dict[str, float], weights: list[float]):
        self.terms, self.beginnings, self.weights = terms, beginnings, weights

    @staticmethod
    def fit(documents: DataFrame, labels: DataFrame, seed: list[str] | None = None, rows: int = SAMPLE_ROWS) -> ToxicityModel:
        """Two halves of the sample by hash: each half's features use the lexicon learned on the other half.

        Without labelled documents of both kinds the given list alone decides.
        """
        given = SEED if seed is None else seed
        base = {w: 4.0 for w in given}
        sample = labelled_sample(documents, labels, rows)
        half = F.pmod(F.xxhash64("s_doc", F.lit(3)), F.lit(2))
        xs, ys = [], []
        for k in (0, 1):
            words, begins = learned_terms(sample.where(half == 1 - k))
            model = ToxicityModel(base | words, begins, [])
            found = model.feature_rows(sample.where(half == k))
            xs.append(np.array([r["f"] for r in found], dtype=float).reshape(-1, FEATURES))
            ys.append(np.array([r["s_toxic"] for r in found], dtype=float))
        x, y = np.concatenate(xs), np.concatenate(ys)
        if not len(y) or y.min() == y.max():
            return ToxicityModel(base, {}, [1.5] + [0.0] * (FEATURES - 1) + [-3.0])
        words, begins = learned_terms(sample)
        return ToxicityModel(base | words, begins, fit_logistic(x, y).tolist())

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.beginnings, {t for t in self.terms if len(t) >= 5 and self.terms[t] >= 2})

    def feature_rows(self, sample: DataFrame) -> list:
        """Features and labels of the bounded sample."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = self.lexicon()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([features(t, lexicon) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["f", "s_toxic"])

        return sample.select("s_text", "s_toxic").mapInArrow(run, "f array<double>, s_toxic int").collect()

    def score(self, documents: DataFrame, text: str = "text") -> DataFrame:
        """(doc_id, text_key, score) of every row; null and empty texts get the score of a text without hits."""
        from .quality import text_key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon, w = self.lexicon(), np.array(self.weights)
            for batch in slices(batches, release=[lexicon.cache.clear]):
                x = np.array([features(t or "", lexicon) for t in batch.column(2).to_pylist()], dtype=float).reshape(-1, FEATURES)
                scores = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["doc_id", "text_key", "score"])

        return documents.select("doc_id", text_key(text).alias("text_key"), F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, text_key bigint, score double")


def held_out(column, buckets: int = 5):
    return F.coalesce(~is_training(column, buckets), F.lit(False))


def keep_civil(documents: DataFrame, model: ToxicityModel, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, all columns of any name, whole texts.

    Null and empty texts score like a text without hits; repeated rows stay or go together; an empty table gives
    an empty one.
    """
    from .quality import without
    from .storage import stored
    bad = stored(model.score(documents, text).where(F.col("score") >= limit).select("doc_id", "text_key").distinct(), "toxic")
    return without(documents, bad, text)
