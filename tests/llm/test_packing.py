"""Best-fit packing: ids against the library, bins against a plain scan, and the query's columns and values."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from feltloom.llm import packing, registry

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library():
    rng, encoder, t = random.Random(3), packing.ByteEncoder(PATH), library()
    signs = ["a", "Bc", " ", " d", "\n", "\n\n", "'", "'s", "'ll", "1", "é", "’", ".", "\t", "\xa0", "_", "-", "ß"]
    odd = [*signs, "漢", "Ł", "<|endoftext|>", "\x1c", "\x85", "\x00", " ", "😀"]
    texts = [None, "", " ", "\n", *("".join(rng.choice(s) for _ in range(rng.randint(0, 30))) for s in (signs, odd) for _ in range(2000))]
    for text, ids in zip(texts, encoder.texts(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_the_fullest_bin_with_room_and_the_fullest_closes_first():
    rng = random.Random(1)
    for most in (1, 2, 7, 50):
        bins, open_, n_closed = packing.Bins(40, most), [], 0
        for i in range(600):
            n, used = rng.randint(1, 40), lambda x: sum(m for _, m in x)
            bins.put((i, n), n)
            fits = [used(x) for x in open_ if 40 - used(x) >= n]
            if not fits and len(open_) == most:
                assert used(bins.closed[n_closed]) == max(map(used, open_))
            home = next(x for x in [*bins.rest(), *bins.closed] if (i, n) in x)
            assert used(home) - n == max(fits, default=0)
            open_, n_closed = [list(x) for x in bins.rest()], len(bins.closed)
            assert len(open_) == bins.n <= most and all(used(x) < 40 for x in open_)
        assert sorted(x[0] for b in [*bins.closed, *open_] for x in b) == list(range(600))


def held(rows, expected, size):
    """Every piece of these (doc_id, ids), cut as stated, gapless in its sequence."""
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    wanted = []
    for doc, ids in expected:
        first = len(ids) % size or size
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), size)], [*range(first, len(ids), size), len(ids)])):
            wanted.append((doc, k, a, b - a, crc(ids[a:b])))
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(wanted, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= size
    return len(by)


def test_op12(spark):
    df = registry.queries()["op12_best_fit_packing"](spark, "/root/testdata/sf0.001")
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    t = library()
    docs = [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    n = held(df.collect(), docs, 2048)
    assert n <= 1.02 * -(-sum(len(x) for _, x in docs) // 2048) + 1


def test_odd_rows_and_many_splits(spark):
    """Nulls, empty and very long texts, repeated rows, other columns; the bins left open by many tasks are packed together."""
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (None, "a b", 3), (2, "word " * 60_000, 4), (3, None, 5), *((10 + i, "x y z " * (i % 37), i) for i in range(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id int").repartition(40)
    t = library()
    expected = [(d, [*t.encode(x or "", add_special_tokens=False).ids, 50256]) for d, x, _ in rows]
    sequences = packing.packed(docs, PATH, packing.Params(size=512, open_bins=8, end_id=50256))
    n = held(packing.pieces(sequences).collect(), expected, 512)
    assert n <= 1.03 * sum(len(x) for _, x in expected) / 512 + 1
    for r in sequences.collect():
        assert len(r.ids) == 2 * r.n_tokens == 2 * sum(r.lengths) and len(r.doc_ids) == len(r.pieces) == len(r.starts) == len(r.lengths)


def test_empty(spark):
    assert packing.pieces(packing.packed(spark.createDataFrame([], DOC), PATH)).count() == 0
