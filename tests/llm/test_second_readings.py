"""Families, clashing columns and plain scorers for operators whose results no SQL gives."""

import math
import random
import string
import unicodedata
import zlib
from collections import Counter

from pyspark.sql import functions as F

from feltloom.llm import language, mixing, quality, secrets, toxicity
from feltloom.llm.common import passing_tables, shared_dir, written

DOC = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def test_candidates_inside_base_spans_are_no_part_of_the_family(spark):
    """Keys that the base patterns take don't let structured tokens pass: the cut is that of the tokens beside them, by a plain Benjamini-Hochberg."""
    rng = random.Random(11)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    tokens = ["/".join(rng.choice(["Report", "Annual", "Summary", "Index", "Page2"]) for _ in range(5)) for _ in range(60)] + [key(60) for _ in range(6)]
    rows = [(i, f"token={hexes(40)} and password: {key(30)} end") for i in range(300)] + [(1000 + i, f"see {t} there") for i, t in enumerate(tokens)]
    p = secrets.Params()
    found = secrets.scanned(spark.createDataFrame(rows, DOC), p).persist()
    family = []
    for _, text in rows:
        base = secrets.base_spans(text)
        family += [q for a, b, q in secrets.candidates(text, p) if not any(x <= a and b <= y for x, y, *_ in base)]
    assert 0 < len(family) < 100
    plain = max((q for i, q in enumerate(sorted(family), 1) if q <= p.discovery_rate * i / len(family)), default=0.0)
    cut = secrets.cut(found, p)
    assert cut <= p.discovery_rate and sum(q <= cut for q in family) <= sum(q <= plain for q in family)
    few = secrets.cut(secrets.scanned(spark.createDataFrame(rows[300:], DOC), p), p)
    assert math.isclose(cut, few)
    taken = {r.doc_id for r in secrets.confirmed(found, p).where(F.exists("spans", lambda s: s.kind == "random")).collect()}
    assert taken <= {1000 + i for i in range(60, 66)}
    found.unpersist()


def test_annotate_keeps_a_column_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "mine", "yours")], "doc_id long, text string, _verdict string, __VERDICT string")
    row = quality.annotate(docs).first()
    assert (row["_verdict"], row["__VERDICT"], row.n_words) == ("mine", "yours", 3)


def plain_sentences(text):
    """Words of each sentence, read letter by letter: a sentence ends at a line's end, or where white space follows an end mark."""
    text, out, now = (text or "").lower(), [], ""
    for i, c in enumerate(text):
        if c == "\n" or c.isspace() and now and now[-1] in ".!?…":
            out.append(now)
            now = ""
        elif not (c.isspace() and not now and i and (text[i - 1].isspace())):
            now += c
    return [w for s in (*out, now) if (w := [x for part in s.split() if (x := part.strip(toxicity.EDGE))])]


def test_noisy_or_by_a_plain_scorer(spark):
    """The score of every document from the fitted weights, by a product over sentences; 0.5 stands at the fitted threshold."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    long = "A quiet day. " * 150_000
    extra = [(-1, long), (-2, ""), (-3, None), (-4, "?! ... \n\n -"), (-5, "one.\n\ntwo! three… four")]
    every = docs.union(spark.createDataFrame(extra, DOC))
    texts = {r.doc_id: r.text for r in every.collect()}
    got = {r.doc_id: r for r in toxicity.scored(every, model).collect()}
    assert model.weights and set(got) == set(texts)
    seen = set()
    for i, text in texts.items():
        clean, worst = 1.0, 0.0
        bag = plain_sentences(text)
        for words in bag:
            z = model.bias
            for w in words:
                z += model.weights.get("=" + w, 0.0) + sum(model.weights.get("^" + w[:n], 0.0) for n in (3, 4, 5, 6) if len(w) >= n)
            q = 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
            worst, clean = max(worst, q), clean * (1 - min(q, 1 - 1e-9))
        raw = 1 - clean
        want = raw * (1 - model.at) / (raw * (1 - model.at) + (1 - raw) * model.at) if bag else 0.0
        assert math.isclose(got[i].score, want, abs_tol=1e-6) and math.isclose(got[i].worst_probability, worst, abs_tol=1e-9)
        seen.add(got[i].score >= 0.5)
    assert seen == {False, True}


def plain_grams(text):
    out, word = Counter(), ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
        elif word:
            padded = f" {word} "
            out.update(padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1))
            word = ""
    return out


def test_language_by_plain_sets_of_grams(spark):
    """The decision of the filters against exact sets: no n-gram is missed, and predictions differ only where the sets' own two best are next to equal."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    counts = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            counts.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    p = language.Params()
    assert max(Counter(r.lang for r in rows).values()) <= p.max_docs  # all are learned from
    sets = {lang: {g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: p.grams]} for lang, c in counts.items()}
    model = language.train(docs)
    assert model.langs == sorted(sets)
    for i, lang in enumerate(model.langs):
        assert all(model.languages(g) >> i & 1 for g in sets[lang])
    long = next(r.text for r in rows if r.text and r.lang == model.langs[-1]) + "\n"
    every = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, long * (2_000_000 // len(long))), (-2, "12 ... 7"), (-3, "")], DOC))
    texts = {r.doc_id: r.text for r in every.collect()}
    equal = 0
    for r in language.identified(every, model).collect():
        grams = plain_grams(texts[r.doc_id])
        n = grams.total()
        if not n:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = {lang: sum(k for g, k in grams.items() if g in sets[lang]) / n for lang in model.langs}
        best = max(model.langs, key=share.get)
        assert r.lang_pred == best or share[best] - share[r.lang_pred] < 0.01
        equal += r.lang_pred == best
        total = sum(x**8 for x in share.values())
        assert abs(r.score - share[r.lang_pred] ** 8 / total) < 0.05
        assert r.doc_id != -1 or r.lang_pred == model.langs[-1]
    assert equal >= 0.98 * (len(texts) - 2)


def test_a_secret_at_the_end_of_a_very_long_text(spark):
    long = "plain words and more of them, " * 70_000
    rows = spark.createDataFrame([(1, long + "token=" + "ab12" * 10), (2, long), (3, None)], DOC)
    got = {r.doc_id: r for r in secrets.confirmed(secrets.scanned(rows, secrets.Params()), secrets.Params()).collect()}
    assert [(s.start, s.end) for s in got[1].spans if s.kind == "assign"] == [(len(long), len(long) + 46)] and not got[2].spans and not got[3].spans


def dealt(children, budget):
    """name -> share of a budget by weight, with capacities: the siblings that are full first leave the others more."""
    out, left, rest = {}, budget, sum(w for _, _, w in children)
    for at, (name, c, w) in enumerate(order := sorted(children, key=lambda x: (x[1] / x[2], x[0]))):
        if c > left / rest * w:
            return out | {n: left / rest * v for n, _, v in order[at:]}
        out[name], left, rest = c, left - c, rest - w
    return out


def test_budgets_of_many_sources_in_ranges(spark):
    """Thousands of sources of one language, many alike in size, dealt in ranges as by one plain pass."""
    rng = random.Random(9)
    rows = [(d, lang, f"host{i}", rng.choice([0, 1, 1, 5, 5, 5, rng.randrange(1, 5000)])) for d, lang, n in (("web", "en", 3000), ("web", "de", 40), ("books", "en", 300), ("code", "xx", 1)) for i in range(n)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    for permille, epochs in ((400, 1), (1500, 2), (5000, 2)):
        p = mixing.Params(budget_permille=permille, max_epochs=epochs)
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, p).collect()}
        assert len(got) == len(rows)
        whole = sum(r[3] for r in rows)
        weight = lambda level, name: p.weights.get(level, {}).get(name, 1)
        cap = lambda *path: sum(t * epochs for *at, t in rows if tuple(at[: len(path)]) == path)
        for d, b in dealt([(d, cap(d), weight("domain", d)) for d in {r[0] for r in rows}], min(whole * permille // 1000, whole * epochs)).items():
            for lang, bl in dealt([(x, cap(d, x), weight("lang", x)) for x in {r[1] for r in rows if r[0] == d}], b).items():
                for source, bs in dealt([(r[2], r[3] * epochs, 1) for r in rows if r[:2] == (d, lang)], bl).items():
                    assert math.isclose(got[d, lang, source], bs, rel_tol=1e-9, abs_tol=1e-9)


def test_tables_of_a_block_are_removed(spark, tmp_path):
    with passing_tables(spark) as outer:
        inner = shared_dir(spark)
        assert inner.startswith(outer) and inner != outer
        kept = written(written(spark.range(5), "on-the-way"), "kept", path=f"file://{tmp_path}/kept")
    assert shared_dir(spark) == outer and kept.count() == 5
    at = spark._jvm.org.apache.hadoop.fs.Path(inner)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
