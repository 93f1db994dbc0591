"""Scores of many seven-card hands at once, and equities by sampled deals, for tasks that compare millions of hands.

Cards are indices, 4 * rank + suit; scores are the same numbers as ``cards.score`` gives. Ranks are held as bits of 13, so what is asked
of them (the highest, the best straight) comes from tables of 2**13 entries that are built here by rule.
"""

from __future__ import annotations

import zlib

import numpy as np

RANKS, SUITS = "23456789TJQKA", "cdhs"
BIT = 1 << np.arange(13)
MASKS = np.arange(1 << 13)
#: The highest rank of each set of ranks, as 2 to 14; 0 of none.
HIGH = np.where(MASKS > 0, np.floor(np.log2(np.maximum(MASKS, 1))).astype(np.int64) + 2, 0)
#: The top rank of the best straight in each set of ranks; 0 without one. An ace is low too.
STRAIGHT = np.zeros(1 << 13, np.int64)
for top in range(3, 13):
    need = sum(1 << (r % 13) for r in range(top - 4, top + 1))
    STRAIGHT[(MASKS & need) == need] = top + 2


def without(mask: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return mask & ~np.where(rank > 0, 1 << np.maximum(rank - 2, 0), 0)


def tops(mask: np.ndarray, k: int) -> list[np.ndarray]:
    """The k highest ranks of each set."""
    out = []
    for _ in range(k):
        out.append(HIGH[mask])
        mask = without(mask, out[-1])
    return out


def score(cards: np.ndarray) -> np.ndarray:
    """A number for each row of five to seven cards that orders hands as their best five cards do."""
    rank, suit = cards >> 2, cards & 3
    counts = (rank[:, :, None] == np.arange(13)).sum(1)
    every, twice, thrice, four = (((counts >= k) * BIT).sum(1) for k in (1, 2, 3, 4))
    flush = np.zeros(len(cards), np.int64)
    for s in range(4):
        mine = suit == s
        flush = np.where(mine.sum(1) >= 5, np.bitwise_or.reduce(np.where(mine, BIT[rank], 0), axis=1), flush)
    none = np.zeros(len(cards), np.int64)

    def pack(category: int, *kickers: np.ndarray) -> np.ndarray:
        out = none + category
        for x in [*kickers, *[none] * (5 - len(kickers))]:
            out = out * 15 + x
        return out

    quad, trip, pair = HIGH[four], HIGH[thrice], tops(twice, 2)
    over = HIGH[without(twice, trip)]
    kinds = [
        (STRAIGHT[flush] > 0, pack(8, STRAIGHT[flush])),
        (quad > 0, pack(7, quad, *tops(without(every, quad), 1))),
        ((trip > 0) & (over > 0), pack(6, trip, over)),
        (flush > 0, pack(5, *tops(flush, 5))),
        (STRAIGHT[every] > 0, pack(4, STRAIGHT[every])),
        (trip > 0, pack(3, trip, *tops(without(every, trip), 2))),
        (pair[1] > 0, pack(2, *pair, *tops(without(without(every, pair[0]), pair[1]), 1))),
        (pair[0] > 0, pack(1, pair[0], *tops(without(every, pair[0]), 3))),
    ]
    return np.select([k for k, _ in kinds], [v for _, v in kinds], pack(0, *tops(every, 5)))


def deal(rng: np.random.Generator, used: np.ndarray, runs: int, k: int) -> np.ndarray:
    """(rows * runs, k) distinct cards for each row of cards that are gone, in random order."""
    draw = rng.random((len(used), runs, 52))
    np.put_along_axis(draw, np.broadcast_to(used[:, None, :], (len(used), runs, used.shape[1])), 2.0, axis=2)
    draw = draw.reshape(-1, 52)
    few = np.argpartition(draw, k, axis=1)[:, :k]
    return np.take_along_axis(few, np.take_along_axis(draw, few, axis=1).argsort(axis=1), axis=1)


def won(full: np.ndarray, hero: np.ndarray, other: np.ndarray) -> np.ndarray:
    """1 where the hero's hand on a full board is better, 0.5 where they tie."""
    mine, theirs = score(np.hstack([full, hero])), score(np.hstack([full, other]))
    return np.where(mine > theirs, 1.0, np.where(mine == theirs, 0.5, 0.0))


def equity(rng: np.random.Generator, board: np.ndarray, hero: np.ndarray, runs: int) -> np.ndarray:
    """The hero's equity on each row's board, by that many deals of an opponent and of the rest of the board."""
    got = deal(rng, np.hstack([board, hero]), runs, 7 - board.shape[1])
    again = lambda x: np.repeat(x, runs, axis=0)
    return won(np.hstack([again(board), got[:, 2:]]), again(hero), got[:, :2]).reshape(-1, runs).mean(1)


def changes(flop: str, heroes: int, turns: int, flop_runs: int, turn_runs: int, seed: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hero cards, turn card, change of equity from flop to turn) for different heroes and, for each, different turns; the same for a flop in every run."""
    rng = np.random.Generator(np.random.Philox(zlib.crc32(f"{seed}:{flop}".encode())))
    board = np.array([4 * RANKS.index(flop[i]) + SUITS.index(flop[i + 1]) for i in (0, 2, 4)])
    free = np.setdiff1d(np.arange(52), board)
    pairs = np.stack(np.triu_indices(len(free), 1), axis=1)
    hero = free[pairs[rng.choice(len(pairs), min(heroes, len(pairs)), replace=False)]]
    boards = np.tile(board, (len(hero), 1))
    before = equity(rng, boards, hero, flop_runs)
    turn = deal(rng, np.hstack([boards, hero]), 1, min(turns, 47)).ravel()
    again = lambda x: np.repeat(x, len(turn) // len(hero), axis=0)
    after = equity(rng, np.hstack([again(boards), turn[:, None]]), again(hero), turn_runs)
    return again(hero), turn, after - again(before)
