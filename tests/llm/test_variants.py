"""Spelling variants against all pairs: words, near words, forms and roots."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from feltloom.llm import registry, variants


def plain_words(docs, spoiled=31):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if spoiled and h % spoiled == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += len(run) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def near(a, b):
    """Differ by exactly one inserted, deleted or replaced letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(n, pairs):
    form = {}
    for w, k in n.items():
        best = min(pairs.get(w, ()), key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * k else None
    out = set()
    for w, k in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, k, len(pairs.get(w, ())), n[form[w]] if form[w] else None))
    return out


def all_pairs(n):
    """Near words by their deletions: every word one edit away shares one, at one place or as a whole; then the plain definition."""
    by = {}
    for w in n:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(x, set()).add(w)
    pairs = {}
    for group in by.values():
        for a in group:
            for b in group:
                if near(a, b):
                    pairs.setdefault(a, set()).add(b)
    return pairs


def test_op11(spark):
    df = registry.queries()["op11_spelling_variants"](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    n = plain_words([(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()])
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(n) and set(rows) == plain_forms(n, all_pairs(n)) and any(r[1] for r in rows)


def test_chains_ties_anagrams_and_letters_beyond_ascii(spark):
    rng = random.Random(5)
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "xbcdefg": 2, "élèveßñ": 3, "elèveßñ": 30, "élèveßnñ": 30, "aaaaaaa": 5, "aaaaaaaa": 49, "ÉLÈVESSÑ".lower(): 2, "Élèveßñ": 2}
    n |= {"".join(rng.sample("abcdefg", 7)): rng.choice([2, 3, 50]) for _ in range(300)}  # anagrams
    n |= {"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))): rng.choice([2, 30, 400]) for _ in range(300)}  # few letters, many words
    pairs = {a: {b for b in n if near(a, b)} for a in n}
    found = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.forms(found).collect()}
    assert got == plain_forms(n, {a: b for a, b in pairs.items() if b})
    assert next(r[2] for r in got if r[0] == "abcdefg") == "abcdefghij"


def test_words_of_odd_rows(spark):
    long = "Zyxwvut" * 3000
    rows = [(1, None, 1), (None, "Letters letters LETTERS", 2), (2, "", 3), (2, "Éclairs éclairs Éclairs a1b letters×letters", 3), (2, "Éclairs éclairs Éclairs a1b letters×letters", 3), (3, f"{long} {long}", 4), (4, "word\x00letters " * 50_000, 5)]
    rows += [(i, "spelling variants of every document " * 2, i) for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    for spoiled in (31, 2, None):
        got = variants.words(docs, variants.Params(spoiled=spoiled)).collect()
        assert {r.word: r.n for r in got} == plain_words([(d, t) for d, t, _ in rows], spoiled) and len(got) == len({r.word for r in got})
    assert variants.forms(variants.words(docs.limit(0))).count() == 0


def test_checksums_of_pairs():
    rng = random.Random(2)
    heads, tails = ([rng.randbytes(rng.randint(0, 40)) for _ in range(500)] for _ in range(2))
    got = variants.checksums(*(np.array([*map(zlib.crc32, x)], np.uint32) for x in (heads, tails)), np.array([*map(len, tails)]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(heads, tails, strict=True)]


def test_no_join_broadcasts_words_or_signatures(spark, monkeypatch):
    """Their sizes are taken from few and packed bytes, some twenty signatures a word with them: the estimate stays small as they grow."""
    plans = []
    written = variants.written
    monkeypatch.setattr(variants, "written", lambda df, name, **how: plans.append(df) or written(df, name, **how))
    rows = [(f"letters{chr(97 + i % 26)}{chr(97 + i // 26)}", 1 + 100 * (i % 7 == 0)) for i in range(200)]
    plans.append(variants.forms(spark.createDataFrame(rows, "word string, n long")))
    for df in plans:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert any("SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString() for df in plans)
