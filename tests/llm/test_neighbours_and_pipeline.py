"""Nearest neighbours against brute force, and the pipeline against what its stages promise."""

import random

import numpy as np

from feltloom.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def vectors(n, seed=1):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, 12)) * rng.uniform(0.2, 2, (n, 1))).astype(np.float32)


def test_recall_ranks_and_scores(spark):
    x = vectors(1500)
    x[100:400] = x[5]  # one vector that a fifth of all rows share
    bad = [(9000, None, 0), (9001, [float("nan")] * 12, 0), (9002, [0.0] * 12, 0), (9003, [1.0] * 5, 0), (None, [1.0] * 12, 0), (9004, [None] + [1.0] * 11, 0)]
    rows = table(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)] + bad + [(7, x[7].tolist(), 0)])
    p = neighbours.Params(leaf=40)
    found, info = neighbours.search(spark, rows, rows.where("vec_id % 20 = 0"), p)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(range(0, 1500, 20)) and info["recall"] >= 0.9
    wide, hit = x.astype(float), 0
    for q, out in got.items():
        out.sort(key=lambda r: r.rank)
        assert [r.rank for r in out] == list(range(1, 21)) and q not in [r.vec_id for r in out]
        assert len({r.vec_id for r in out}) == 20
        s = wide @ wide[q]
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in out)
        order = [i for i in np.lexsort((np.arange(1500), -s.round(12))) if i != q][:20]
        hit += len(set(order) & {r.vec_id for r in out})
    assert hit >= 0.9 * 20 * len(got)


def test_few_and_no_vectors(spark):
    rows = table(spark, [(20 * i, [float(i), 1.0], 0) for i in range(1, 4)])
    found, _ = neighbours.search(spark, rows, rows, neighbours.Params())
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found.collect()) == [(20, 1, 60), (20, 2, 40), (40, 1, 60), (40, 2, 20), (60, 1, 40), (60, 2, 20)]
    none = table(spark, [])
    assert neighbours.search(spark, none, none, neighbours.Params())[0].count() == 0


def test_best_bin_first_visits_every_leaf_once():
    x = vectors(800).astype(float)
    tree = neighbours.grow(x, 30, neighbours.Params())
    leaves = tree.send(x)
    assert set(leaves) <= set(tree.leaf_of.values())
    order = tree.orders(x[:1], len(tree.leaf_of))[0]
    assert sorted(order) == sorted(tree.leaf_of.values())
    assert order[0] == leaves[0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    clean = [" ".join(rng.choice("the of and in to a".split()) + f" w{rng.randrange(4000)}" for _ in range(60)) for _ in range(30)]
    texts = [*clean, clean[0], clean[1] + " tail", "short", None, "### $$$ " * 60, clean[2] + ' token = "0123abcd4567ef890123abcd"']
    rows = [(i, t, "en", f"src{i % 10}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = stages["quality rules"](spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in one.collect()) == sorted([*range(32), 4, 35])
    two = stages["near duplicates"](spark, one, str(tmp_path))
    assert sorted(r.doc_id for r in two.collect()) == list(range(30))
    three = stages["secret scan"](spark, one, str(tmp_path))
    assert "[SECRET]" in {r.doc_id: r.text for r in three.collect()}[35] and three.count() == one.count()
    four = stages["source mixing"](spark, two, str(tmp_path))
    assert four.columns == docs.columns and 26 <= four.count() <= 30
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    assert all(r.n_tokens == len(r.ids) > 60 for r in out.collect()) and 26 <= out.count() <= 30
