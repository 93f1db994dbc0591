"""Scores, dynamicness and what is made of it, against the column expressions, exact enumeration and plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feltloom.functions import cards, hand_scores
from feltloom.operators import texture
from feltloom.plans import base, estimators, ledger

SF = "/root/testdata/sf0.001"
NAMES = [r + s for r in hand_scores.RANKS for s in hand_scores.SUITS]


def test_scores_are_those_of_the_column_expression(spark):
    rng = random.Random(3)
    few = [NAMES[:16], NAMES[-20:], NAMES[0::4] + NAMES[1:20:4]]  # many pairs, straights and flushes
    hands = [rng.sample(NAMES if i % 4 == 3 else few[i % 4 % 3], 7) for i in range(1500)]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hands)], "i int, h array<string>")
    want = [r.s for r in rows.select("i", cards.score(F.col("h")).alias("s")).orderBy("i").collect()]
    got = hand_scores.score(np.array([[NAMES.index(c) for c in h] for h in hands]))
    assert got.tolist() == want and len(set(w // 15**5 for w in want)) == 9


def exact(board, hero):
    """The hero's equity on a four-card board, over every river and opponent."""
    left = [c for c in range(52) if c not in (*board, *hero)]
    deals = np.array([(r, *o) for r in left for o in itertools.combinations([c for c in left if c != r], 2)])
    full = np.hstack([np.tile(board, (len(deals), 1)), deals[:, :1]])
    return hand_scores.won(full, np.tile(hero, (len(deals), 1)), deals[:, 1:]).mean()


@pytest.mark.parametrize("flop", ["9h8h7h"])
def test_sampled_changes_approach_exact_ones(flop):
    hero, turn, change = hand_scores.changes(flop, 1, 47, 4000, 1500, "t")
    board = [NAMES.index(flop[i : i + 2]) for i in (0, 2, 4)]
    after = np.array([exact([*board, t], hero[0]) for t in turn])
    assert sorted([*turn, *board, *hero[0]]) == list(range(52))
    assert np.abs(change - (after - after.mean())).max() < 0.06  # a flop's equity is the mean over its turns
    assert abs(np.abs(change).mean() - np.abs(after - after.mean()).mean()) < 0.01


def test_dynamicness_of_a_table(spark):
    flops = spark.createDataFrame([("a", "2c7dKh"), ("b", "AsAdAc"), ("c", "9h8h7h")], "key string, flop string")
    got = {r.flop: r.dscore for r in texture.dynamicness(spark, flops).collect()}
    assert got == {f: float(np.abs(hand_scores.changes(f, 16, 20, 120, 30, "d")[2]).mean()) for f in ("2c7dKh", "AsAdAc", "9h8h7h")}
    assert texture.dynamicness(spark, flops.limit(0)).count() == 0


def tiles(rows, key):
    """Labels by weighted terciles, as they are defined."""
    order = sorted(rows, key=lambda r: r[key])
    total, up_to, cuts = sum(r["n"] for r in rows), 0, []
    for r in order:
        up_to += r["n"]
        while len(cuts) < 2 and up_to >= total * (len(cuts) + 1) / 3:
            cuts.append(r[key])
    return {r["key"]: 0 if r[key] <= cuts[0] else 1 if r[key] <= cuts[1] else 2 for r in rows}


def ranks(values):
    """Plain ranks, ties sharing the mean of their places."""
    order = sorted(values)
    return [(order.index(v) + len(order) - order[::-1].index(v) + 1) / 2 for v in values]


def test_texture_queries_match_plain_python(spark, monkeypatch):
    """With fewer samples for each flop; all else as registered."""
    small = texture.dynamicness
    monkeypatch.setattr(texture, "dynamicness", lambda s, f: small(s, f, heroes=2, turns=3, flop_runs=8, turn_runs=4))
    monkeypatch.setattr(ledger, "_tables", {})
    rows = [r.asDict() for r in ledger.textured(spark, SF).collect()]
    w, d = tiles(rows, "w3"), tiles(rows, "dscore")
    x, y, n = np.array(ranks([r["w3"] for r in rows])), np.array(ranks([r["dscore"] for r in rows])), np.array([r["n"] for r in rows])
    x, y = x - np.average(x, weights=n), y - np.average(y, weights=n)
    (got,) = base.QUERIES["g8_texture_distinctness"](spark, SF).collect()
    assert abs(got.corr - (n * x * y).sum() / np.sqrt((n * x * x).sum() * (n * y * y).sum())) < 1e-5
    assert (got.min_dscore, got.max_dscore) == (round(min(r["dscore"] for r in rows), 6), round(max(r["dscore"] for r in rows), 6))

    key_of = {r.flop: r.key for r in texture.seen_flops(ledger.boards(spark, SF)).collect()}
    decisions = ledger.enriched(spark, SF).select("street", "board", "s_core").collect()
    want, states = {}, {}
    for r in decisions:
        k = key_of.get(r.board[:6])
        t = (r.street, w.get(k), d.get(k))
        want[t] = want.get(t, 0) + 1
        s = f"{r.s_core}|W{w[k]}|D{d[k]}" if len(r.board) >= 6 else r.s_core
        states[s] = states.get(s, 0) + 1
    assert {(r.street, r.wtile, r.dtile): r.n for r in base.QUERIES["g9_texture_join"](spark, SF).collect()} == want
    assert {r.s: r.n for r in base.QUERIES["c12_texture_state"](spark, SF).collect()} == states

    rows = [r.asDict() for r in estimators.textured(spark, SF).select("site", "player", "hand_id", "day", "a", "s_core", "s_fine", "board", "reward_bb").collect()]
    key = {"core": lambda r: r["s_core"], "fine": lambda r: r["s_fine"]}
    for name, of in list(key.items()):
        key[name + "_texture"] = lambda r, of=of: of(r) + (f"|W{w[key_of[r['board'][:6]]]}|D{d[key_of[r['board'][:6]]]}" if len(r["board"]) >= 6 else "")
    p = estimators.P_REPLAY
    nets = {}
    for r in ledger.seats(spark, SF).select("site", "player", "day", "net_bb").where("net_bb IS NOT NULL").collect():
        nets.setdefault((r.site, r.player), ([], []))[r.day > p.split_day].append(r.net_bb)
    members = {k: round(100 * sum(b) / len(b), 6) for k, (a, b) in nets.items() if len(a) >= p.min_train and len(b) >= p.min_test}
    got = {r.label: r for r in base.QUERIES["f20_texture_states"](spark, SF).collect()}
    assert set(got) == set(key) and members
    for label, of in key.items():
        by_state, by_action, own, crowd = {}, {}, {}, {}
        for r in rows:
            who = r["site"], r["player"]
            if r["day"] <= p.split_day and who in members:
                crowd.setdefault(of(r), set()).add(who)
                own.setdefault(who, {}).setdefault((of(r), r["a"]), []).append(r["reward_bb"])
                by_action.setdefault((of(r), r["a"]), []).append(r["reward_bb"])
        common = {s for s, who in crowd.items() if len(who) >= p.min_eligible}
        known = lambda xs: [x for x in xs if x is not None]
        mean = lambda xs: sum(xs) / len(xs)
        skill = {who: 0.0 for who in members}
        for who, made in own.items():
            seen = {sa: xs for sa, xs in made.items() if sa[0] in common}
            gains = [len(xs) * (mean(known(xs)) - mean(known(by_action[sa]))) for sa, xs in seen.items() if len(known(xs)) >= p.nmin_sa]
            skill[who] = round(sum(gains) / sum(map(len, seen.values())), 6) if gains else 0.0
        x, y = ([v[k] for k in sorted(members)] for v in (skill, members))
        assert (got[label].n, got[label].n_states) == (len(members), len(common))
        for found, a, b in ((got[label].pearson, x, y), (got[label].spearman, ranks(x), ranks(y))):
            assert abs(found - np.corrcoef(a, b)[0, 1]) < 1e-5 if np.std(a) else found is None

    played = {}
    for r in rows:
        played.setdefault((r["site"], r["player"]), set()).add(r["hand_id"])
    rows = [r for r in rows if len(played[r["site"], r["player"]]) >= estimators.MIN_HANDS]
    got = {(r.value, r.label): r for r in base.QUERIES["h4_texture_eta_squared"](spark, SF).collect()}
    for value, of_row in (("reward", lambda r: r["reward_bb"]), ("fold", lambda r: float(r["a"] == "f"))):
        before = None
        for label in ("core", "core_texture", "fine", "fine_texture"):
            groups = {}
            for r in rows:
                if of_row(r) is not None:
                    groups.setdefault(key[label](r), []).append(of_row(r))
            every = np.concatenate([np.array(g) for g in groups.values()])
            eta = sum(len(g) * (np.mean(g) - every.mean()) ** 2 for g in groups.values()) / (every.var() * len(every))
            r = got[value, label]
            assert (r.n_groups, r.n) == (len(groups), len(every)) and abs(r.eta2 - eta) < 2e-6
            assert r.gain is None if before is None else abs(r.gain - (eta - before)) < 4e-6
            before = eta


def test_all_classes_of_the_deck(spark):
    rows = base.QUERIES["g3_class_representatives"](spark, SF).collect()
    assert len(rows) == 1755 and sum(r.of_deck for r in rows) == 22100
    pairs = base.QUERIES["g1_flop_combinations"](spark, SF).collect()
    assert len({r.pair for r in pairs}) == 1326 and sum(r.n for r in pairs) == 3 * sum(r.n for r in rows)
