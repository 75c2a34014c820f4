import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from prepforge.llm import decontaminate, fill_middle, queries, variants

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- spelling variants ---------------------------------------------------------------------------------
def brute_variants(rows, every):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    without = {}
    for w in n:  # words that share a form with one letter taken out, or are such a form
        for k in range(len(w)):
            without.setdefault(w[:k] + w[k + 1:], set()).add(w)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return abs(len(a) - len(b)) == 1

    out = {}
    for w in n:
        around = set(without.get(w, ())) | {s for k in range(len(w)) if (s := w[:k] + w[k + 1:]) in n}
        around |= {x for k in range(len(w)) for x in without[w[:k] + w[k + 1:]] if near(w, x)}
        around.discard(w)
        best = min(around, key=lambda x: (-n[x], x), default=None)
        out[w] = [best if best and n[best] >= 10 * n[w] else None, None, n[w], len(around), None]
        out[w][4] = n[out[w][0]] if out[w][0] else None
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def as_rows(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_of_the_given_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = as_rows(queries.QUERIES["op11_spelling_variants"](spark, SF))
    assert found == brute_variants([tuple(r) for r in table], 31)
    assert any(v[0] for v in found.values())


@pytest.mark.parametrize("bucket_words, groups", [(4, 3), (1000, 4), (10, 5)])
def test_variants_in_hot_buckets(docs, bucket_words, groups):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(7, 9))) for _ in range(120)]  # all share the letters
    words += [w + "é" for w in words[:20]] + ["Übergröße", "ubergröße", "übergröß", "straßen×bahn", "x" * 3000, "x" * 3001]
    texts = [" ".join(rnd.choices(words, k=300)) + " " + " ".join(words) for _ in range(3)] + [(words[0] + ",") * 900, (words[1] + "\u0100") * 9000]
    want = brute_variants(list(enumerate(texts)), None)
    assert as_rows(variants.group_variants(docs(texts), groups=groups, bucket_words=bucket_words)) == want
    assert {v[3] for v in want.values()} > {0, 1, 2}


def test_variants_follow_chains(docs):
    text = "abcdefgh " * 5000 + "abcdefgx " * 400 + "abcdefyx " * 30 + "abcdezyx " * 2
    found = as_rows(variants.group_variants(docs([text])))
    assert found["abcdezyx"] == ("abcdefyx", "abcdefgh", 2, 1, 30) and found["abcdefgh"][:2] == (None, "abcdefgh")


def test_variants_of_odd_rows(odd, docs):
    assert as_rows(variants.group_variants(odd, typo_every=31)) == brute_variants([(r.doc_id, r.text) for r in odd.collect()], 31)
    assert as_rows(variants.group_variants(docs([]))) == {}
    assert as_rows(variants.group_variants(docs([None, ""]))) == {}


# -- fill in the middle --------------------------------------------------------------------------------
@pytest.mark.parametrize("unit, pattern", [("line", r"[^\n]*\n|[^\n]+"), ("char", r"(?s).")])
def test_cut_tree_finds_every_boundary(unit, pattern):
    rnd = random.Random(4)
    for size in (0, 1, 7, 64, 700):
        for block in (1, 3, 16, 1024):
            text = "".join(rnd.choice("ab\n\né\u20ac\U0001f600") for _ in range(size))
            units = re.findall(pattern, text)
            tree = fill_middle.CutTree(text.encode(), unit, block)
            assert tree.totals() == (len(units), len(text))
            for k in range(len(units) + 1):
                before = "".join(units[:k])
                assert tree.cut(k) == (len(before.encode()), len(before))


def test_fill_middle_restores_every_text(docs, odd):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["<", "P", "S>", "M", ">", "\n", "é ", "word "]) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    texts += ["no mark <P> moved", "x\n" * 30_000, "\n", "\n\n"]
    table = docs(texts)
    moved = fill_middle.transform(table, spm=50)
    rows = {r.doc_id: r for r in moved.select("*", fill_middle.restored(moved.output, moved.form).alias("back")).collect()}
    assert [rows[i].back for i in range(len(texts))] == texts
    assert {r.form for r in rows.values()} == {"plain", "psm", "spm"}
    for i, t in enumerate(texts):
        r = rows[i]
        if r.form == "plain":
            assert r.output == t and r.prefix_chars is None and (not t or any(m in t for m in fill_middle.SENTINELS))
        else:
            p, m = t[:r.prefix_chars], t[r.prefix_chars:r.prefix_chars + r.middle_chars]
            s = t[len(p) + len(m):]
            assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}")
    assert {r.form for r in fill_middle.transform(table, rate=0).collect()} == {"plain"}
    again = fill_middle.transform(odd)
    assert sorted(str(r.back) for r in again.select(fill_middle.restored(again.output, again.form).alias("back")).collect()) == sorted(r.text or "" for r in odd.collect())
    assert fill_middle.digests(fill_middle.transform(docs([]))).collect() == []


def test_sentinels_must_be_distinct(docs):
    for bad in (("<a", "a>", "b"), ("", "x", "y"), ("x", "x", "y"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            fill_middle.transform(docs(["a"]), sentinels=bad)


# -- decontamination -----------------------------------------------------------------------------------
def brute_hits(text, items, window):
    words = re.findall(decontaminate.WORD, (text or "").translate(LOWER))
    hit, names = np.zeros(len(words), dtype=bool), set()
    for name, item in items:
        w = re.findall(decontaminate.WORD, (item or "").translate(LOWER))
        m = min(window, len(w))
        windows = {tuple(w[k:k + m]) for k in range(len(w) - m + 1)} if w else set()
        for k in range(len(words) - m + 1):
            if tuple(words[k:k + m]) in windows:
                hit[k:k + m] = True
                names.add("" if name is None else str(name))
    return len(words), int(hit.sum()), sorted(names)


@pytest.fixture(scope="module")
def exam(spark):
    rnd = random.Random(6)
    items = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 3, 4, 5, 9, 10, 12, 40])))) for i in range(40)]
    items += [(7, "A b, C a"), (None, "a é a b é a"), (41, None), (42, "..."), (40, items[30][1]), (43, "a b " * 300)]
    return items, spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, items string")


def test_automaton_against_brute_force(exam, docs):
    rnd = random.Random(7)
    items, table = exam
    texts = [" ".join(rnd.choice(["a", "b", "c", "C!", "é", "zz"] if k % 2 else "abc") for _ in range(rnd.randint(0, 60))) for k in range(150)]
    texts += [t for _, t in items[:10]] + ["a b " * 20_000, None, ""]
    for window in (4, 6, 10):
        want = [brute_hits(t, items, window) for t in texts]
        for shard in (200_000, 150):  # one automaton, and several
            rows = {r.doc_id: r for r in decontaminate.find(docs(texts), table, window, shard_words=shard).collect()}
            assert len(rows) == len(texts)
            got = [(rows[i].n_words, sum(s.end - s.start for s in rows[i].spans), sorted(rows[i]["items"])) for i in range(len(texts))]
            assert got == want
            assert all(a.end < b.start for r in rows.values() for a, b in zip(r.spans, r.spans[1:]))


def test_long_items_keep_their_windows(spark, docs):
    rnd = random.Random(8)
    words = [f"w{rnd.randint(0, 300)}" for _ in range(500)]
    table = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    parts = decontaminate.item_parts(table, 10, part_words=30).collect()
    assert max(r.n for r in parts) <= 39
    windows = {tuple(p.words.split()[k:k + 10]) for p in parts for k in range(len(p.words.split()) - 9)}
    assert windows == {tuple(words[k:k + 10]) for k in range(491)}


def test_spans_are_cut_and_leaked_documents_go(spark, docs):
    item = "one two three four five six seven eight nine ten eleven"
    table = spark.createDataFrame([(1, item), (2, "short item")], "item_id bigint, text string")
    clean = " ".join(f"c{i}" for i in range(40))
    texts = [f"{clean}: ONE Two three, four five six seven eight nine ten eleven! {clean}", item, clean, None, "", f"{clean} Short-item. {clean}"]
    rows = {r.doc_id: r for r in decontaminate.decontaminate(docs(texts), table).collect()}
    assert rows[0].text == f"{clean}: ! {clean}" and 1 not in rows
    assert rows[2].text == clean and rows[3].text is None and rows[4].text == "" and rows[5].text == f"{clean} . {clean}"
    assert rows[2].ids == "x" and rows[2].host == "h"


def test_decontamination_of_odd_rows(spark, odd, docs, exam):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {(r.n_hit, r.contaminated) for r in decontaminate.verdicts(decontaminate.find(odd, none)).collect()} == {(0, False)}
    assert decontaminate.find(docs([]), exam[1]).collect() == []
    kept = decontaminate.decontaminate(odd, exam[1])  # the text "a" is an item
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(r.text) for r in odd.collect() if r.text != "a")
