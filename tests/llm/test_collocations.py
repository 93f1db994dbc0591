"""Collocations against plain counting, transducers against dictionaries."""

import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from feltloom.llm import collocations, registry

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain(docs, least=30, top=2000, covered=80):
    n, f = Counter(), {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, b in found.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * b >= covered * found[p[i : i + m]]}
        rows = []
        for p, a in found.items():
            if p not in gone:
                cuts = [(floor(Fraction(2_000_000 * a, counts[p[:k]] + counts[p[k:]])), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                score, _, first, last = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), first, last))
        out |= {(lang, i, p.decode(), -a, first, last, n[lang], -score) for i, (score, a, p, first, last) in enumerate(sorted(rows)[:top], 1)}
    return out


def got(df):
    return [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()]


def test_op13(spark):
    sf = "/root/testdata/sf0.001"
    df = registry.queries()["op13_collocations"](spark, sf)
    assert dict(df.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")
    rows = got(df)
    want = plain([(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert len(rows) == len(set(rows)) and set(rows) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert set(con.execute(registry.oracle_sql()["op13_collocations"]).fetchall()) == want


def test_many_ranges_and_segments(spark, monkeypatch):
    """Bounds inside of frequent prefixes, segments of a few words, a word of a third of all rows, ties, null languages, odd words, long texts, clashing columns."""
    monkeypatch.setattr(collocations, "RANGE_WINDOWS", 300)
    rng = random.Random(4)
    words = ["the", "The", "of", "a", "new", "york", "\x1c", "\x85", "é", "É", "x\x00y", "漢", "is"]
    rows = [(i, " ".join(rng.choice(words[: 3 + i % 11]) + rng.choice(["", "", "", ",", ".", "\t", " "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", None, "und", "de"]), i) for i in range(300)]
    rows += [(None, None, "en", 1), (1, "", None, 1), (1, " . ", "xx", 1), (2, "of the new york times\n" * 4000, "en", 2), *[(5, "the the the the the", "en", 3)] * 150]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, words int").repartition(5)
    for least, top in ((30, 2000), (3, 40)):
        rows_ = got(collocations.collocations(docs, collocations.Params(least=least, top=top)))
        assert len(rows_) == len(set(rows_)) and set(rows_) == plain([(r[2], r[1]) for r in rows], least, top)
    assert got(collocations.collocations(spark.createDataFrame([], DOC))) == []


def table(names, rows, n):
    return Counter({tuple(names[c - 1].as_py() for c in r if c): k for r, k in zip(rows.tolist(), n.tolist(), strict=True)})


def test_transducers():
    """What is built can be read back, shares its ends, unites by sums, survives its bytes and composes with any row."""
    rng = random.Random(9)
    for size, n_words in ((0, 3), (1, 3), (400, 6), (3000, 40), (2000, 70_000)):
        made = []
        for _ in range(3):
            words = pa.array([rng.choice([".", *map(str, range(n_words))]) if size < 2000 or rng.random() < 0.3 else str(rng.randrange(n_words)) for _ in range(size)], pa.string())
            names, rows = collocations.windows(words)
            rows, n = collocations.summed(rows, np.ones(len(rows), np.int64), len(names))
            plain_rows = Counter()
            for piece in " ".join(words.to_pylist()).split("."):
                w = piece.split()
                plain_rows.update(tuple(w[i : i + 4]) for i in range(len(w)))
            assert table(names, rows, n) == plain_rows
            t = collocations.part(names, rows, n)
            t = collocations.Transducer.from_bytes(t.to_bytes())
            assert table(t.words, *t.rows()) == plain_rows
            made.append((t, plain_rows))
        t, total = collocations.united([t for t, _ in made]), sum((c for _, c in made), Counter())
        assert table(t.words, *t.rows()) == total
        assert not size or len(t.starts[3]) - 1 <= len({w[:3] for w in total if len(w) > 2}) + 1
        label = {w: i for i, w in enumerate(t.words.to_pylist(), 1)}
        asked = [*total, *(tuple(rng.choice([*label]) for _ in range(rng.randint(1, 4))) for _ in range(200) if label)]
        found = t.composed(np.array([[*map(label.get, w), 0, 0, 0][:4] for w in asked], np.int64).reshape(-1, 4))
        prefixes = Counter()
        for w, k in total.items():
            for d in range(1, len(w) + 1):
                prefixes[w[:d]] += k
        for least in (1, 2, 5):
            kept = {tuple(t.words[c - 1].as_py() for c in r): k for p, f in t.frequent(least) for r, k in zip(p.tolist(), f.tolist(), strict=True)}
            assert {w: k for w, k in kept.items() if k >= least} == {w: k for w, k in prefixes.items() if k >= least} and all(prefixes[w] == k for w, k in kept.items())
        assert found.tolist() == [[prefixes[w[:d]] if d <= len(w) else 0 for d in range(1, 5)] for w in asked]


class Dealt:
    """Parts as a range's task gets them, without a shuffle."""

    def repartition(self, *_):
        return self

    def sortWithinPartitions(self, *_):
        return self


def test_a_range_in_little_memory(monkeypatch):
    """A range's task holds its parts packed and unites some at a time; opened all at once they took 174 bytes a window."""
    rng, parts, prefixes, n_windows = np.random.default_rng(3), [], Counter(), 0
    for _ in range(60):
        label = np.minimum(rng.zipf(1.3, 6000), 20_000)
        names, rows = collocations.windows(pa.array(np.char.add("w", label.astype(str)).tolist(), pa.string()))
        n_windows += len(rows)
        prefixes.update(f"w{x}" for x in label)
        prefixes.update((f"w{x}", f"w{y}") for x, y in zip(label, label[1:]))
        prefixes.update(zip(*(np.char.add("w", label[i : len(label) - 3 + i].astype(str)).tolist() for i in range(4))))
        parts.append(collocations.part(names, *collocations.summed(rows, np.ones(len(rows), np.int64), len(names))).to_bytes())
    runs = []
    monkeypatch.setattr(collocations, "map_batches", lambda df, run, schema: runs.append(run) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        collocations.frequent(Dealt(), 4, 30)
    rows = pa.RecordBatch.from_arrays([pa.array(["en"] * 60), pa.array([0] * 60, pa.int32()), pa.array([6000] * 60), pa.array(parts, pa.binary())], ["lang", "range", "n", "part"])
    tracemalloc.start()
    try:
        found = [r for b in runs[0](iter([rows])) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = {tuple(r["words"]): r["f"] for r in found if r["f"] >= 30}
    assert {w[0] if len(w) == 1 else w: f for w, f in got.items() if len(w) != 3} == {w: f for w, f in prefixes.items() if f >= 30}
    assert peak < 100 * n_windows, peak / n_windows


def test_ended_rows_and_two_keys():
    """Rows ended where they get rare keep the weights of all frequent prefixes and of those at the edges; rows of many words, as two keys, come in the same order and back."""
    rng = np.random.default_rng(5)
    for most in (4, 40, 70_000):
        rows = rng.integers(0, most, (4000, 4), endpoint=True).astype(np.int32)
        rows[:, 0] = rng.integers(1, 5, 4000)
        for i in range(1, 4):
            rows[:, i] *= rows[:, i - 1] > 0
        n = rng.integers(1, 4, 4000)
        want = Counter()
        for r, k in zip(rows.tolist(), n.tolist()):
            want[tuple(r)] += k
        distinct, total = collocations.summed(rows, n, most)
        assert list(zip(map(tuple, distinct.tolist()), total.tolist())) == sorted(want.items())
        ended, left = collocations.trimmed(distinct, total, 30, most)
        sums = [Counter(), Counter()]
        for count, (r, k) in zip(sums, ((distinct, total), (ended, left))):
            for row, f in zip(r.tolist(), k.tolist()):
                for d in range(1, 5):
                    if row[d - 1]:
                        count[tuple(row[:d])] += f
        edges = {tuple(distinct[i, :d].tolist()) for i in (0, -1) for d in range(1, 5) if distinct[i, d - 1]}
        assert sums[1] == {p: f for p, f in sums[0].items() if f >= 30 or p in edges}
