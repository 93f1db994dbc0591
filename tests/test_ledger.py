"""The replay: a worked hand, and random hands against a sequential replay in plain Python."""

import random

import pytest

from feltloom.operators import ledger
from feltloom.sources.parse import HANDS


def hand(actions, blinds=(1.0, 2.0), stacks=(100.0, 100.0, 100.0), finishing=(), winnings=(), site="S", level=200, players=None):
    players = players or [f"P{i}" for i in range(len(stacks))]
    return (site, level, "1", "T", len(players), len(players), players, list(blinds), list(stacks), list(finishing), list(winnings), actions, 2009, 7, 1, "t")


def replay(spark, *hands):
    rows = [(*h[:2], str(i), *h[3:]) for i, h in enumerate(hands)]
    return ledger.settled(ledger.replayed(spark.createDataFrame(rows, HANDS)))


def test_worked_hand(spark):
    h = hand(
        ["d dh p1 ????", "d dh p2 8sAh", "d dh p3 ????", "d dh p4 ????", "p3 f", "p4 cbr 0.75", "p1 f", "p2 cc", "d db 2c3c4d", "p2 cc", "p4 cc", "d db 9h", "p2 cc", "p4 cc", "d db Kd", "p2 cc", "p4 cc", "p2 sm 8sAh", "p4 sm ????"],
        (0.10, 0.25), (25.0, 54.75, 16.35, 24.65), site="PS", level=25,
    )
    done = replay(spark, h)
    rows = {r.pos_idx: r for r in ledger.hand_player(done).collect()}
    assert {i: round(r.net_bb, 6) for i, r in rows.items()} == {0: -0.4, 1: 3.08, 2: 0.0, 3: -3.0}
    assert {r.net_source for r in rows.values()} == {"sd_heuristic"}
    assert ledger.decisions(done).count() == 10


def sequential(h):
    """Pot, amounts to call and payments, token by token."""
    n = len(h[6])
    stack = list(h[8])
    put = [min(h[7][i], stack[i]) if i < len(h[7]) else 0.0 for i in range(n)]
    stack = [s - p for s, p in zip(stack, put, strict=True)]
    pot, bet, out = sum(put), max(put), []
    for t in h[11]:
        w = t.split()
        if w[:2] == ["d", "db"]:
            put, bet = [0.0] * n, 0.0
        elif w[1] in ("f", "cc", "cbr"):
            i = int(w[0][1:]) - 1
            call = max(0.0, bet - put[i])
            paid = 0.0 if w[1] == "f" else min(float(w[2]) - put[i], stack[i]) if w[1] == "cbr" else min(call, stack[i]) if call > 1e-9 else 0.0
            out.append((round(pot, 6), round(call, 6), round(stack[i], 6)))
            put[i] += paid
            stack[i] -= paid
            pot += paid
            if w[1] == "cbr":
                bet = put[i]
    return out


def test_random_hands_match_a_sequential_replay(spark):
    rng = random.Random(5)
    hands = []
    for _ in range(40):
        n = rng.randrange(2, 6)
        acts = []
        for street in range(4):
            if street:
                acts.append("d db " + ["2c3c4d", "9h", "Kd"][street - 1])
            for _ in range(rng.randrange(0, 7)):
                p = rng.randrange(1, n + 1)
                acts.append(f"p{p} " + rng.choice(["f", "cc", "cc", f"cbr {rng.randrange(1, 40)}"]))
        hands.append(hand(acts, stacks=[float(rng.randrange(5, 60)) for _ in range(n)]))
    got = {}
    for r in ledger.decisions(replay(spark, *hands)).orderBy("hand_id", "seq").collect():
        got.setdefault(int(r.hand_id), []).append((round(r.pot_before_bb * 2, 6), round(r.to_call_bb * 2, 6), round(r.hero_stack_before_bb * 2, 6)))
    for i, h in enumerate(hands):
        assert got.get(i, []) == sequential(h)


def test_long_hand_and_seats_still_to_act(spark):
    """Five hundred actions on one street; for every decision the seats that act later on its street and have not folded yet, and those that have not folded."""
    rng = random.Random(8)
    acts = [f"p{rng.randrange(1, 7)} " + rng.choice(["cc"] * 30 + ["cbr 4", "f"]) for _ in range(500)] + ["d db 2c3c4d", "p2 cc", "p9 cc", "p1 cc", "p2 f"]
    got = ledger.decisions(replay(spark, hand(acts, stacks=[500.0] * 6))).orderBy("seq").select("n_to_act_after", "n_active_before", "pos_idx").collect()
    boards, folded, n_folds, want = 0, set(), 0, []
    for i, t in enumerate(acts):
        if t.startswith("d db"):
            boards += 1
            continue
        street = [a for a in acts[i + 1 :] if not a.startswith("d db")] if boards else acts[i + 1 : 500]
        seat = int(t.split()[0][1:])
        later = {int(a.split()[0][1:]) for a in street if int(a.split()[0][1:]) <= 6} - folded
        want.append((len(later), 6 - n_folds, seat - 1))
        if t.endswith(" f"):
            folded.add(seat)
            n_folds += 1
    assert [tuple(r) for r in got if r.pos_idx < 6] == [w for w in want if w[2] < 6] and len(got) == len(want)


@pytest.mark.parametrize(("n", "labels"), [(2, ["SB/BTN", "BB"]), (3, ["SB", "BB", "BTN"]), (6, ["SB", "BB", "LJ", "HJ", "CO", "BTN"]), (9, ["SB", "BB", "UTG", "MP1", "MP2", "LJ", "HJ", "CO", "BTN"])])
def test_position_labels(n, labels):
    assert ledger.position_labels(n) == labels


def test_single_seat_gives_nothing(spark):
    assert replay(spark, hand([], stacks=(5.0,))).count() == 0


def test_named_decisions_are_those_of_all_columns(spark):
    rng = random.Random(6)
    odd = ["d db Ah", "d dh p2 AhAh", "p9 cbr 4", "p0 cc", "p1 cbr x", "p1 cc extra", "# note", "d db 2c3c\n", "p1 sm KdKc", "p2 f\n", ""]
    rows = [hand([rng.choice([*odd, "p1 cc", "p2 cc", "p3 cc", "p1 cbr 6", "p2 f"]) for _ in range(25)]) for _ in range(50)]
    done = replay(spark, *rows)
    every = ledger.decisions(done)
    for name in every.columns:
        one = ledger.decisions(done, "hand_id", "seq", name) if name not in ("hand_id", "seq") else ledger.decisions(done, "hand_id", "seq")
        assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, every.select(one.columns).collect()), key=repr)
    assert every.where("pos_idx = 8 AND pos_label = '?' AND player IS NULL").count() > 0
