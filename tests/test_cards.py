"""Card expressions against enumeration in plain Python."""

import itertools
import random
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from feltloom.functions import cards, hand_scores
from feltloom.plans import logs

DECK = [r + s for r in cards.RANKS for s in cards.SUITS]


def five(cs):
    ranks = [cards.RANKS.index(c[0]) + 2 for c in cs]
    count = Counter(ranks)
    order = sorted(count, key=lambda r: (-count[r], -r))
    shape = sorted(count.values(), reverse=True)
    flush = len({c[1] for c in cs}) == 1
    top = max(ranks) if len(count) == 5 and max(ranks) - min(ranks) == 4 else 5 if sorted(ranks) == [2, 3, 4, 5, 14] else 0
    if flush and top:
        return (8, top)
    if shape[0] == 4:
        return (7, *order)
    if shape[:2] == [3, 2]:
        return (6, *order)
    if flush:
        return (5, *order)
    if top:
        return (4, top)
    return ({(3, 1): 3, (2, 2): 2, (2, 1): 1}.get(tuple(shape[:2]), 0), *order)


def test_scores_order_hands_as_their_best_five(spark):
    rng = random.Random(3)
    hands = [rng.sample(DECK, 7) for _ in range(150)]
    hands += [["Ac", "2c", "3c", "4c", "5c", "Kd", "Kh"], ["9c", "9d", "9h", "9s", "2c", "2d", "2h"], ["Tc", "Jc", "Qc", "Kc", "Ac", "9c", "8c"], ["3c", "3d", "3h", "5c", "5d", "5h", "9s"]]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hands)], "i int, h array<string>")
    got = {r.i: r.s for r in rows.select("i", cards.score(F.col("h")).alias("s")).collect()}
    want = {i: max(five(x) for x in itertools.combinations(h, 5)) for i, h in enumerate(hands)}
    order = sorted(want, key=lambda i: want[i])
    for a, b in itertools.pairwise(order):
        assert (got[a] < got[b]) if want[a] < want[b] else got[a] == got[b]


def test_scores_of_many_hands_and_of_impossible_ones(spark):
    """A hundred thousand hands as the matrix form scores them, which is held against enumeration; cards held twice have no score."""
    rng = np.random.default_rng(7)
    dealt = rng.random((100_000, 52)).argsort(1)[:, :7]
    want = hand_scores.score(dealt)
    rows = spark.createDataFrame([(i, [DECK[c] for c in h]) for i, h in enumerate(dealt.tolist())], "i int, h array<string>")
    got = np.array([r.s for r in rows.select("i", cards.score(F.col("h")).alias("s")).orderBy("i").collect()])
    order = np.argsort(want, kind="stable")
    assert ((np.diff(want[order]) > 0) == (np.diff(got[order]) > 0)).all() and (np.diff(got[order]) >= 0).all()
    odd = [["Ac", "Ac", "3c", "4c", "5c", "Kd", "Kh"], ["Ac", "2c", "??", "4c", "5c"], None, []]
    found = spark.createDataFrame([(h,) for h in odd], "h array<string>").select(cards.score(F.col("h")).alias("s")).collect()
    assert [r.s for r in found[:3]] == [None] * 3


def test_no_card_is_dealt_twice(spark):
    hands = logs.hands(spark, "/root/testdata/sf0.01")
    dealt = hands.select("n_players", cards.cards(F.regexp_replace(F.array_join(F.filter("actions", lambda x: x.startswith("d ") & ~x.endswith("????")), ""), r"d (db|dh p\d+) ", "")).alias("c"))
    most, twice = dealt.agg(F.max("n_players"), F.count_if(F.size(F.array_distinct("c")) < F.size("c"))).first()
    assert most >= 10 and twice == 0


def test_flops_and_their_classes(spark):
    flops = cards.flops(spark).withColumn("key", cards.canonical(F.col("cards")))
    assert flops.agg(F.count("*"), F.countDistinct("key")).first()[:] == (22100, 1755)


def test_labels(spark):
    rows = [("AsAh", "2c7d9h", "overpair_pair"), ("AsKh", "Ac7d9h", "pair"), ("2c3c", "4c5c9d", "flush_draw"), ("????", "2c7d9h", "unknown"), ("AsKh", "", "preflop"), ("AcKc", "QcJcTc", "straight_flush"), ("7s7h", "7d2c2h", "full_house")]
    got = spark.createDataFrame(rows, "h string, b string, want string").select("want", cards.made_hand(F.col("h"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    b = spark.createDataFrame([("2c3c4c", "3umc"), ("KsKdTc4s", "4ptg"), ("", "preflop")], "b string, want string").select("want", cards.board_bucket(F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in b)
    c = spark.createDataFrame([("KhAh", "AKs"), ("7c7d", "77"), ("2cTd", "T2o"), ("????", None)], "h string, want string").select("want", cards.hole_class(F.col("h")).alias("got")).collect()
    assert all(r.want == r.got for r in c)
