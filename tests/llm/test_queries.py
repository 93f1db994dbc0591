"""Every opN query on the smallest tables: its columns and types, and a second reading of what it returns; and empty tables for all operators."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from feltloom.llm import html, language, mixing, near_dup, neighbours, pieces, quality, registry, secrets, token_file, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    df = registry.queries()[name](spark, SF)
    return dict(df.dtypes), df.collect()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_op1(spark):
    types, rows = run(spark, "op1_nearest_neighbours")
    assert types == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array(sorted(vectors))
    x, found, hit = np.array([vectors[i] for i in ids]), {}, 0
    for r in rows:
        found.setdefault(r.query_id, {})[r.rank] = r
    assert set(found) == {i for i in vectors if i % 20 == 0}
    for q, got in found.items():
        scores = x @ vectors[q]
        order = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        assert sorted(got) == list(range(1, 21)) and all(abs(r.score - vectors[q] @ vectors[r.vec_id]) < 1e-12 for r in got.values())
        assert [(-r.score, r.vec_id) for _, r in sorted(got.items())] == sorted((-r.score, r.vec_id) for r in got.values())
        hit += len(set(order) & {r.vec_id for r in got.values()})
    assert hit >= 0.9 * 20 * len(found)


def test_op2(spark, docs):
    types, rows = run(spark, "op2_quality_rules")
    assert {k: types[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")} == dict.fromkeys(
        ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "bigint"
    ) | {"base_failed": "boolean", "kept": "boolean"}
    assert {r.doc_id: (r.n_words, r.n_symbols) for r in rows} == {i: (len(words(d.text)), len(re.findall(r"[#*$%&|<>]", d.text or ""))) for i, d in docs.items()}


def test_op4_and_op8(spark, docs):
    import sentencepiece
    from tokenizers import Tokenizer

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    _, rows = run(spark, "op4_sentencepiece")
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert {r.doc_id: r.ids_crc32 for r in rows} == {i: crc(sp.encode(d.text or "")) for i, d in docs.items()} and all(r.round_trip for r in rows)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    types, rows = run(spark, "op8_token_file")
    assert types == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    start = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*t.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(rows) == len(docs)


def test_op6(spark, docs):
    types, rows = run(spark, "op6_toxicity")
    assert {k: types[k] for k in ("doc_id", "held_out", "score", "predicted")} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert {r.doc_id for r in rows} == set(docs) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_on_held_out_labels(spark):
    """Fitted without the fold; labels of the fold are found again on the larger table."""
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic is not None}
    rows = [r for r in toxicity.op6_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels]
    good = sum(r.predicted == labels[r.doc_id] for r in rows)
    assert len(rows) > 40 and good >= 0.9 * len(rows)


def test_op7(spark, docs):
    types, rows = run(spark, "op7_language_id")
    assert types == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    known = [r for r in rows if held_out(r.doc_id) and docs[r.doc_id].lang and any(map(str.isalpha, docs[r.doc_id].text or ""))]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in known) >= 0.95 * len(known) and all(r.held_out == held_out(r.doc_id) for r in rows)


def test_texts_without_letters_have_no_language(spark):
    rows = [(i, w, lang, "s", 1) for i, (w, lang) in enumerate([("the old house is there", "en"), ("das alte haus ist da", "de")] * 20)]
    table = spark.createDataFrame([*rows, (90, "² ½ Ⅷ ① 1 23", "de", "s", 5), (91, "²das½ alte", None, "s", 5)], DOC)
    got = {r.doc_id: tuple(r)[1:] for r in language.identified(table, language.train(table)).collect()}
    assert got[90] == ("und", 0.0) and got[91][0] == "de"


def test_op9(spark, docs):
    types, rows = run(spark, "op9_secret_scan")
    assert {k: types[k] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")} == {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    patterns = (("assign", secrets.ASSIGN, 6, 2), ("access", secrets.ACCESS, 20, 0), ("hex", secrets.HEX, 24, 0))
    for r in rows:
        base = [(m.start(), k, kind, m.end()) for k, (kind, p, least, g) in enumerate(patterns) for m in p.finditer(docs[r.doc_id].text or "") if len(m[g]) >= least]
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(base))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_op10(spark, docs):
    types, rows = run(spark, "op10_minhash_near_dedup")
    assert types == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    sets = {}
    for i, d in docs.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), d.text or ""))
        sets[i] = frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])
    least = {i: i for i in docs}
    ids = sorted(docs)
    changed = True
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(sets[i]), least[i], least[i] == i) for i in docs}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    piece, word = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        quality.annotate(none), quality.keep(none), html.extracted(spark.createDataFrame([], "page_id long, url string, html string")), pieces.encoded(none, piece), pieces.digests(none, piece), mixing.selected(none), mixing.mixed(none),
        toxicity.scored(none, toxicity.train(none, labels)), language.identified(none, language.train(none)), token_file.digests(spark, token_file.write(none, word, 2)), secrets.redacted(none),
        near_dup.classes(none, near_dup.Params()), near_dup.keep_one(none), neighbours.search(spark, vectors, vectors, neighbours.Params())[0],
    ):
        assert df.count() == 0


def test_clashing_columns_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "src1", "a", "b", "c"), (2, text + " x", "en", "src1", "d", "e", "f"), (3, "other " * 9, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, component_id string, n string, `text_key` string")
    for df, least in ((near_dup.keep_one(table), 2), (mixing.mixed(table), 1), (secrets.redacted(table), 3)):
        assert df.columns == table.columns
        got = [tuple(r) for r in df.collect()]
        assert set(got) <= set(rows) and len(got) >= least


def test_repeated_rows_keep_the_budget(spark):
    rows = [(7, "a b c d", "en", "src1", 7)] * 4 + [(i, "a b c d", "en", "src1", 7) for i in range(20, 24)]
    table = spark.createDataFrame(rows, DOC)
    for p in (mixing.Params(budget_permille=500, max_epochs=1), mixing.Params(budget_permille=1700, max_epochs=2)):
        want = Counter(r.doc_id for r in mixing.selected(table, p).collect())
        assert Counter(r.doc_id for r in mixing.mixed(table, p).collect()) == want and want


def test_nulls_and_repeated_ids_in_a_token_file(spark):
    word = public_tokenizers.path("word_bpe_49k.json")
    table = spark.createDataFrame([(None, "no id"), (5, "twice"), (5, "twice"), (5, None), (2, "first"), (None, None)], "doc_id long, text string")
    rows = sorted(token_file.digests(spark, token_file.write(table, word, 2)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 2, 5, 5, 5] and [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])


def second_reading(sf):
    """The pipeline by other means: SQL for the quality rules and the mixture, all pairs for near duplicates, plain Python and the library for the rest."""
    import duckdb
    import sentencepiece

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    good = {i for (i,) in con.execute(f"SELECT doc_id FROM ({registry.oracle_sql()['op2_quality_rules']}) WHERE kept").fetchall()}
    docs = {r[0]: r for r in con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall() if r[0] in good}

    sets = {}
    for i, d in docs.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), d[1]))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    least = {i: i for i in docs}
    find = lambda i: i if least[i] == i else find(least[i])
    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    docs = {i: d for i, d in docs.items() if find(i) == i}

    p = secrets.Params()
    tested = {i: secrets.candidates(d[1], p) for i, d in docs.items()}
    values = sorted(q for found in tested.values() for *_, q in found)
    most = max((q for k, q in enumerate(values, 1) if q <= p.discovery_rate * k / len(values)), default=0.0)
    rows = []
    for i, (_, text, lang, source) in docs.items():
        spans = sorted([s[:2] for s in secrets.base_spans(text)] + [s[:2] for s in tested[i] if s[2] <= most])
        out, last = "", 0
        for a, b in spans:
            if a >= last:
                out += text[last:a] + "[SECRET]"
            last = max(last, b)
        rows.append((i, out + text[last:], lang, source))
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    taken = {r[0] for r in con.execute(f"SELECT doc_id FROM ({mixing.oracle(mixing.Params(max_epochs=1))})").fetchall()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return {i: sp.encode(text) for i, text, *_ in rows if i in taken}


def test_pipeline_matches_a_second_reading(spark):
    import corpus_pipeline

    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == second_reading(SF)
