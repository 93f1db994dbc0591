"""The ledger of many hands at once: one token of every hand at a time, over matrices of (hand, seat).

NULL is NaN: a seat beyond the table has a column of its own, which reads as NULL and keeps nothing. Comparisons with NaN are false, as those with NULL choose no branch.
What is not a number of chips, as from a raise to infinity with an unknown stack, is NULL too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from feltloom.functions import hand_scores

EPS = 1e-9
# Labels by the distance to the button, and by the place after the big blind for seats farther away.
BY_BUTTON = ("BTN", "CO", "HJ", "LJ", "MP2", "MP1")
BY_BLIND = ("UTG", "UTG1", "UTG2", "MP", "MP1")
#: Hands that are replayed at once.
ROWS = 2048
RANKS, SUITS = "23456789TJQKA", "cdhs"
#: Java's line ends: what a dot does not match, and what may stand after a $.
ENDS = "\n\r\u0085\u2028\u2029"
CLOSE = rf"(?=(?:\r\n|[{ENDS}])?\Z)"
VERB = re.compile(rf"p(\d+) (f|cc|cbr|sm)(?: ([^{ENDS}]+))?{CLOSE}", re.A)
BOARD = re.compile(rf"d db [^{ENDS}]+{CLOSE}")
DEAL = re.compile(rf"d dh p\d+ ([^{ENDS}]+){CLOSE}", re.A)
SEAT = re.compile(r"(?:d dh )?p(\d+) ", re.A)
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[dDfF]?", re.A)
INFINITE = re.compile(r"([+-]?)inf(?:inity)?", re.I)
OTHER, DB, DH, SM, F, CC, CBR = range(7)
KINDS = {"f": F, "cc": CC, "cbr": CBR, "sm": SM}
FACED = ("no_wager", "bet", "raise", "reraise")
POTS = ("limped", "SRP", "3bet", "4bet+")
ACTS = ("fold", "check", "call", "bet", "raise")
SOURCES = ("finishing", "uncontested", "showdown_eval", "sd_heuristic", "winnings_winner", "unknown")
MADE = ("high_card", "flush_draw", "pair", "overpair_pair", "two_pair", "trips", "straight", "flush", "full_house", "quads", "straight_flush", "preflop", "unknown")


def position_labels(n: int) -> list[str]:
    """Labels of the seats of a table of n, from the small blind on."""

    def of(seat: int) -> str:
        if seat < 2:
            return ("SB", "BB")[seat] if n > 2 or seat else "SB/BTN"
        button, blind = n - 1 - seat, seat - 2
        return BY_BUTTON[button] if button < len(BY_BUTTON) else BY_BLIND[blind] if blind < len(BY_BLIND) else "MP"

    return [of(seat) for seat in range(n)]


def number(text: str) -> float:
    """A text as a double; NaN if it is none."""
    text = text.strip("".join(map(chr, range(33))))
    if NUMBER.fullmatch(text):
        return float(text.rstrip("dDfF"))
    if m := INFINITE.fullmatch(text):
        return float(m[1] + "inf")
    return float("nan")


def meaning(token: str | None) -> tuple[int, int, str]:
    """(kind, seat from 0, argument) of a token."""
    if token is None:
        return OTHER, -1, ""
    verb = None
    if BOARD.match(token):
        kind, arg = DB, token[5:105]
    elif m := DEAL.match(token):
        kind, arg = DH, m[1]
    elif verb := VERB.match(token):
        kind, arg = KINDS[verb[2]], verb[3] or ""
    else:
        kind, arg = OTHER, ""
    seat = verb or SEAT.match(token)
    seat = int(seat[1]) if seat else 0
    return kind, (seat if seat < 1 << 31 else 0) - 1, arg


TWO = re.compile(rf"([^{ENDS}])[^{ENDS}]")


def pairs(text: str) -> list[str]:
    """The two-character cards of a text."""
    if text.isalnum():
        return [text[i : i + 2] for i in range(0, len(text) - 1, 2)]
    return [x[0] for x in TWO.finditer(text)]


CARD = {r + s: 4 * i + j for i, r in enumerate(RANKS) for j, s in enumerate(SUITS)}


def tallied(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each rank and each suit occurs in each text."""
    ranks, suits = np.zeros((len(texts) + 1, 13), np.int16), np.zeros((len(texts) + 1, 4), np.int16)
    row, found = [], []
    for i, x in enumerate(texts):
        for c in pairs(x):
            if (k := CARD.get(c)) is not None:
                row.append(i)
                found.append(k)
            else:
                if (r := RANKS.find(c[0])) >= 0:
                    ranks[i, r] += 1
                if (s := SUITS.find(c[1])) >= 0:
                    suits[i, s] += 1
    row, found = np.array(row, np.int64), np.array(found, np.int64)
    np.add.at(ranks, (row, found >> 2), 1)
    np.add.at(suits, (row, found & 3), 1)
    return ranks, suits


def bucket(board: str) -> str:
    """{cards}{p/u}{m/t/r}{c/g} of a board."""
    if not board:
        return "preflop"
    cs = pairs(board)
    ranks = [RANKS.find(c[0]) for c in cs]
    suits = [c[1] for c in cs if c[1] in SUITS]
    different, most = len(set(ranks)), max(map(suits.count, set(suits)), default=0)
    near = different >= 3 and max(ranks) - min(ranks) <= 4
    return f"{len(cs)}{'p' if different < len(ranks) else 'u'}{'m' if most >= 3 else 't' if most == 2 else 'r'}{'c' if near else 'g'}"


def known(hole: str) -> bool:
    return len(hole) == 4 and hole != "????"


def hole_class(hole: str) -> str | None:
    if not known(hole):
        return None
    a, b = hole[0], hole[2]
    if a == b:
        return a + b
    hi, lo = (a, b) if RANKS.find(a) >= RANKS.find(b) else (b, a)
    return hi + lo + ("s" if hole[1] == hole[3] else "o")


def matrix(x: pa.Array, width: int, fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A list column as (rows, width), missing places filled and NULLs as NaN, and the sizes."""
    sizes = x.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    out = np.full((len(x), max(width, sizes.max(initial=0))), fill)
    out[np.arange(out.shape[1]) < sizes[:, None]] = x.flatten().to_numpy(zero_copy_only=False).astype(float)
    return out, sizes


def total(x: np.ndarray) -> np.ndarray:
    """Row sums in the order of the columns."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out = out + x[:, k]
    return out


class Replay:
    """Some hands after their last token, and a row for each decision on the way."""

    def __init__(self, b: pa.RecordBatch) -> None:
        with np.errstate(all="ignore"):
            self.read(b)
            self.play()

    def column(self, name: str) -> pa.Array:
        return self.b.column(self.b.schema.get_field_index(name))

    def read(self, b: pa.RecordBatch) -> None:
        self.b, hands = b, b.num_rows
        self.n = self.column("players").value_lengths().to_numpy().astype(np.int64)
        self.seats = seats = int(self.n.max(initial=0))
        self.there = np.arange(seats) < self.n[:, None]
        (blinds, n_blinds), (stacks, n_stacks) = (matrix(self.column(c), seats) for c in ("blinds", "starting_stacks"))
        self.blinds, self.stacks = blinds, stacks
        level = self.column("nl_level").fill_null(0).to_numpy()
        most = np.fmax.reduce(np.where(np.arange(blinds.shape[1]) < n_blinds[:, None], blinds, -np.inf), axis=1, initial=-np.inf)
        self.bb = np.where(level > 0, level / 100.0, np.where(most > 0, most, 1.0))
        blind, stack = blinds[:, :seats], stacks[:, :seats]
        posted = np.where(self.there & (blind > 0), np.fmin(blind, stack), 0.0)
        own = np.full((hands, 1), np.nan)
        self.contrib, self.invested = np.hstack([posted, own]), np.hstack([posted, own])
        self.stack = np.hstack([stack - posted, own])
        self.folded = np.zeros((hands, seats + 1), bool)
        self.hole, self.shown = np.full((hands, seats + 1), -1), np.zeros((hands, seats + 1), bool)
        self.pot, self.bet = total(posted), posted.max(1, initial=0.0)
        actions = self.column("actions")
        self.sizes = actions.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        coded = actions.flatten().dictionary_encode()
        read = [meaning(x) for x in [*coded.dictionary.to_pylist(), None]]
        at = coded.indices.fill_null(len(read) - 1).to_numpy()
        self.kind = np.array([x[0] for x in read], np.int8)[at]
        self.seat = np.array([x[1] for x in read], np.int64)[at]
        places: dict[str, int] = {}
        self.arg = np.array([places.setdefault(x[2], len(places)) for x in read])[at]
        self.args = list(places)
        self.given = np.array([x != "" for x in self.args], bool)[self.arg]
        self.named = np.array([x not in ("", "????") for x in self.args], bool)[self.arg]
        self.value = np.array([number(x[2]) if x[0] == CBR else np.nan for x in read])[at]
        self.hand = np.repeat(np.arange(hands), self.sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.place = self.seat
        self.seat = np.where((self.seat >= 0) & (self.seat < self.n[self.hand]), self.seat, seats)
        # A part is what a hand plays on one street: it has its board.
        board = self.kind == DB
        inside = np.cumsum(board)
        before = np.concatenate([[0], inside])[self.begin] if hands else inside
        self.street = inside - before[self.hand]
        streets = np.bincount(self.hand[board], minlength=hands) + 1
        self.last_part = np.cumsum(streets) - 1
        self.part = (self.last_part - streets + 1)[self.hand] + self.street
        self.boards = [""] * int(streets.sum())
        for part, street, arg in zip(self.part[board].tolist(), self.street[board].tolist(), self.arg[board].tolist(), strict=True):
            self.boards[part] = (self.boards[part - 1] if street > 1 else "") + self.args[arg]

    def play(self) -> None:
        hands, seats, acting = len(self.n), self.seats, self.kind >= F
        last = np.full((len(self.boards), seats + 1), -1)
        place = np.arange(len(self.hand)) - self.begin[self.hand]
        last[self.part[acting], self.seat[acting]] = place[acting]
        self.acts = np.flatnonzero(acting)
        row = np.cumsum(acting) - 1
        self.out = {k: np.zeros(len(self.acts)) for k in "pot call stack prev committed to frac".split()} | {k: np.zeros(len(self.acts), np.int64) for k in "hole faced kind active after act".split()}
        wagers, raises, n_folds = (self.bet > 0).astype(np.int64), np.zeros(hands, np.int64), np.zeros(hands, np.int64)
        inc, ref = self.bet.copy(), np.zeros(hands)
        order = np.argsort(-self.sizes, kind="stable")
        left = np.searchsorted(-self.sizes[order], -np.arange(self.sizes.max(initial=0)), side="left")
        for k, m in enumerate(left.tolist()):
            every = order[:m]
            tokens = self.begin[every] + k
            kinds = self.kind[tokens]
            h = every[kinds == DB]
            if len(h):
                self.contrib[h, :seats] = 0.0
                self.bet[h], wagers[h], inc[h], ref[h] = 0.0, 0, 0.0, self.pot[h]
            for what in (DH, SM):
                if len(t := tokens[kinds == what]):
                    t = t[self.seat[t] < seats]
                    dealt = t[self.named[t]]
                    self.hole[self.hand[dealt], self.seat[dealt]] = self.arg[dealt]
                    if what == SM:
                        t = t[self.given[t]]
                        self.shown[self.hand[t], self.seat[t]] = True
            t = tokens[kinds >= F]
            if not len(t):
                continue
            h, c, kind, at = self.hand[t], self.seat[t], self.kind[t], row[t]
            contrib, stack, bet, pot = self.contrib[h, c], self.stack[h, c], self.bet[h], self.pot[h]
            fold, wager, cc = kind == F, kind == CBR, kind == CC
            call = np.fmax(0.0, bet - contrib)
            free = call <= EPS
            to = np.where(np.isnan(self.value[t]), bet, self.value[t])
            paid = np.where(fold, 0.0, np.where(wager, np.fmin(to - contrib, stack), np.where(free, 0.0, np.fmin(call, stack))))
            checks = cc & free
            o = self.out
            o["pot"][at], o["call"][at], o["stack"][at], o["committed"][at] = pot, call, stack, self.invested[h, c]
            o["hole"][at] = self.hole[h, c]
            o["faced"][at] = np.where(free, 0, np.clip(wagers[h], 1, 3))
            o["prev"][at] = np.where(ref[h] > EPS, inc[h] / ref[h], np.where(inc[h] > 0, 99.0, 0.0))
            o["kind"][at] = np.minimum(raises[h], 3)
            o["active"][at] = self.n[h] - n_folds[h]
            o["after"][at] = ((last[self.part[t], :seats] > k) & ~self.folded[h, :seats]).sum(1)
            o["act"][at] = np.where(fold, 0, np.where(checks, 1, np.where(cc, 2, np.where(bet > EPS, 4, 3))))
            o["to"][at] = np.where(wager, to, np.where(cc & ~free, paid, 0.0))
            o["frac"][at] = np.where(fold | checks, 0.0, np.where(pot > EPS, paid / pot, np.where(wager, 99.0, 0.0)))
            mine = contrib + paid
            self.contrib[h, c], self.invested[h, c], self.stack[h, c] = mine, self.invested[h, c] + paid, stack - paid
            self.folded[h[fold], c[fold]] = True
            n_folds[h[fold]] += 1
            self.pot[h] = pot + paid
            r = h[wager]
            self.bet[r], inc[r], ref[r] = mine[wager], paid[wager], pot[wager]
            wagers[r] += 1
            raises[r] += self.street[t[wager]] == 0

    # ------------------------------------------------------------ outcome

    def settle(self) -> None:
        with np.errstate(all="ignore"):
            self._settle()

    def _settle(self) -> None:
        hands, seats, every, there = len(self.n), self.seats, np.arange(len(self.n)), self.there
        contrib = np.where(there & ~np.isnan(self.contrib[:, :seats]), self.contrib[:, :seats], -np.inf)
        order = -np.sort(-contrib, axis=1)
        excess = order[:, 0] - order[:, 1]
        self.top, self.excess = contrib.argmax(1), np.where(excess > EPS, excess, 0.0)
        self.left = self.invested[:, :seats].copy()
        self.left[every, self.top] -= self.excess
        self.final_pot = self.pot - self.excess
        boards = [self.boards[p] for p in self.last_part.tolist()]
        bots = np.array([x is not None and x.startswith("ACPC") for x in self.column("site").to_pylist()], bool)
        cap = np.fmin(np.where(self.bb > 0, 3.0 / self.bb, 3.0), 3.0)
        flop = np.array([x != "" for x in boards], bool)
        self.rake = np.where(~flop | bots, 0.0, np.fmin(cap, 0.05 * (self.final_pot / self.bb))) * self.bb
        finishing, n_finishing = matrix(self.column("finishing_stacks"), seats)
        exact = (n_finishing == self.n) & (np.abs(total(finishing) - total(self.stacks)) < 1e-6)
        alive = there & ~self.folded[:, :seats]
        n_alive = alive.sum(1)
        seen = alive & (self.hole[:, :seats] >= 0)
        full = np.array([len(x) == 10 for x in boards], bool)
        score, decided = self.scores(boards, alive & (full & (seen.sum(1) == n_alive) & (n_alive > 1))[:, None])
        winnings, n_winnings = matrix(self.column("winnings"), seats)
        paid = (winnings > 0)[:, :seats] & there
        kinds = [exact, n_alive == 1, decided, full & (seen.sum(1) == 1), (n_winnings == self.n) & paid.any(1)]
        self.source = np.select(kinds, range(5), 5)
        best = alive & (score == score.max(1, initial=-1)[:, None])
        self.winners = np.select([(self.source == k)[:, None] for k in (1, 2, 3, 4)], [alive, best, seen, paid], False)
        self.has_winners = (self.source > 0) & (self.source < 5)
        share = (self.final_pot - self.rake) / self.winners.sum(1)
        nets = np.where(self.winners, share[:, None] - self.left, -self.left)
        self.net = np.where(exact[:, None], finishing[:, :seats] - self.stacks[:, :seats], np.where(self.has_winners[:, None], nets, np.nan))

    def scores(self, boards: list[str], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the seats asked for, -1 elsewhere, and the hands that they decide: cards dealt twice and what is no card decide nothing."""
        out, decided = np.full(asked.shape, -1), asked.any(1)
        hand, seat = np.nonzero(asked)
        by_width: dict[int, list] = {}
        mine: dict[str, list] = {}
        for h, s, a in zip(hand.tolist(), seat.tolist(), self.hole[hand, seat].tolist(), strict=True):
            board = boards[h]
            if board not in mine:
                mine[board] = [CARD.get(x, -1) for x in pairs(board)]
            held = self.args[a]
            if held not in mine:
                mine[held] = [CARD.get(x, -1) for x in pairs(held)]
            cs = mine[held] + mine[board]
            if min(cs) < 0 or len(set(cs)) < len(cs):
                decided[h] = False
            else:
                by_width.setdefault(len(cs), []).append((h, s, cs))
        for found in by_width.values():
            out[[x[0] for x in found], [x[1] for x in found]] = hand_scores.score(np.array([x[2] for x in found]))
        return out, decided

    # ------------------------------------------------------------ columns

    def seat_lists(self, x: np.ndarray, null: np.ndarray | None = None, there: np.ndarray | None = None) -> pa.Array:
        """A list for each hand of its seats' values, NaN as NULL."""
        there = self.there if there is None else there
        values = x[:, : self.seats][there]
        values = pa.array(values, from_pandas=values.dtype.kind == "f")
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(there.sum(1))]), pa.int32()), values, mask=None if null is None else pa.array(null))

    def texts(self, places: np.ndarray, words: list[str]) -> pa.Array:
        return pa.array([*words, ""], pa.string()).take(pa.array(np.where(places < 0, len(words), places)))

    def ended(self) -> dict:
        holes = self.texts(self.hole[:, : self.seats][self.there], self.args)
        offsets = pa.array(np.concatenate([[0], np.cumsum(self.n)]), pa.int32())
        end = {
            "board": self.texts(self.last_part, self.boards), "contrib": self.seat_lists(self.contrib), "invested": self.seat_lists(self.invested), "folded": self.seat_lists(self.folded),
            "hole": pa.ListArray.from_arrays(offsets, holes), "shown": self.seat_lists(self.shown), "pot": pa.array(self.pot, from_pandas=True),
        }
        padded = lambda x, n: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(x[np.arange(x.shape[1]) < n[:, None]], from_pandas=True))
        size = lambda c: np.maximum(self.n, self.column(c).value_lengths().fill_null(0).to_numpy())
        return {
            "bl": padded(self.blinds, size("blinds")), "st": padded(self.stacks, size("starting_stacks")), "bb": pa.array(self.bb),
            "end": pa.StructArray.from_arrays(list(end.values()), list(end)),
        }

    def outcome(self) -> dict:
        unknown = (self.source > 0) & ~self.has_winners
        at = np.broadcast_to(np.arange(self.seats), self.there.shape)
        return {
            "back": pa.StructArray.from_arrays([pa.array(self.top, pa.int32()), pa.array(self.excess)], ["seat", "excess"]),
            "invested": self.seat_lists(self.left), "pot": pa.array(self.final_pot, from_pandas=True), "rake": pa.array(self.rake, from_pandas=True),
            "net_source": pa.array(SOURCES).take(pa.array(self.source)),
            "winners": self.seat_lists(at, ~self.has_winners, self.winners), "net": self.seat_lists(self.net, unknown),
        }

    def made(self) -> pa.Array:
        """The made-hand label of every decision."""
        hole, part = self.out["hole"], self.part[self.acts]
        good = np.array([*[known(x) for x in self.args], False], bool)[hole]
        bare = np.array([x == "" for x in self.boards], bool)[part]
        label = np.where(good, MADE.index("preflop"), MADE.index("unknown"))
        (at,) = np.nonzero(good & ~bare)
        if len(at):
            (hr, hs), (br, bs) = tallied([x if known(x) else "" for x in self.args]), tallied(self.boards)
            hole, part = hole[at], part[at]
            counts, suited = hr[hole] + br[part], (hs[hole] + bs[part]).max(1)
            straight = hand_scores.STRAIGHT[((counts > 0) * hand_scores.BIT).sum(1)] > 0
            high = counts.argmax(1)
            top = counts[np.arange(len(at)), high]
            counts[np.arange(len(at)), high] = 0
            second, flush = counts.max(1), suited >= 5
            # With a single pair: is it the pocket pair?
            names = [(x[0] if known(x) and x[0] == x[2] else "") for x in self.args]
            pair = np.flatnonzero((top == 2) & (second != 2))
            pocket = np.zeros(len(at), bool)
            for i, a, p in zip(pair.tolist(), hole[pair].tolist(), part[pair].tolist(), strict=True):
                if names[a]:
                    pocket[i] = names[a] not in TWO.sub(r"\1", self.boards[p])
            label[at] = np.select(
                [flush & straight, top == 4, (top == 3) & (second == 2), flush, straight, top == 3, (top == 2) & (second == 2), (top == 2) & pocket, top == 2, suited == 4],
                [MADE.index(x) for x in ("straight_flush", "quads", "full_house", "flush", "straight", "trips", "two_pair", "overpair_pair", "pair", "flush_draw")], 0,
            )
        return pa.array(MADE).take(pa.array(label))

    def decided(self, names: list[str]) -> dict:
        """Columns of a row for each decision."""
        if {"hand_net_bb", "reward_bb", "net_source"} & set(names):
            self.settle()
        with np.errstate(all="ignore"):
            return {name: self._decided(name) for name in names}

    def _decided(self, name: str) -> pa.Array:
        o, t = self.out, self.acts
        h, c = self.hand[t], self.seat[t]
        bb, n = self.bb[h], self.n[h]
        number = lambda x: pa.array(x, from_pandas=True)
        whole = lambda x: pa.array(x, pa.int32())
        among = lambda words, x: pa.array(words, pa.string()).take(pa.array(x))
        place = self.place[t] if name in ("pos_idx", "pos_label") else None
        net = lambda: np.hstack([self.net, np.full((len(self.n), 1), np.nan)])[h, c] / bb
        if name in ("site", "nl_level", "hand_id", "seat_count", "year", "month", "day"):
            return self.column(name).take(pa.array(h))
        if name == "seq":
            first = np.cumsum(np.bincount(h, minlength=len(self.n)))
            return whole(np.arange(len(h)) - np.concatenate([[0], first])[h])
        if name == "player":
            players = self.column("players")
            at = (np.cumsum(self.n) - self.n)[h] + c
            return players.flatten().take(pa.array(at, mask=c == self.seats))
        if name == "pos_idx":
            return whole(place)
        if name == "pos_label":
            sizes = sorted(set(self.n.tolist()))
            words = [position_labels(x) for x in sizes]
            begin = np.cumsum([0, *map(len, words)])
            at = begin[np.searchsorted(sizes, n)] + place
            return among([*[x for w in words for x in w], "?"], np.where(c == self.seats, begin[-1], at))
        if name in ("hero_hole", "hero_hole_class"):
            words = [*self.args, None] if name == "hero_hole" else [*map(hole_class, self.args), None]
            return among(words, np.where(o["hole"] < 0, len(words) - 1, o["hole"]))
        if name == "hero_hand_bucket":
            return self.made()
        if name == "board_bucket":
            return among([bucket(x) for x in self.boards], self.part[t])
        if name == "n_players":
            return whole(n)
        if name == "street":
            return whole(self.street[t])
        if name == "board":
            return among(self.boards, self.part[t])
        if name == "spr":
            return number(np.where(o["pot"] > EPS, o["stack"] / o["pot"], 99.0))
        if name in ("action_faced", "pot_type", "act"):
            words, key = {"action_faced": (FACED, "faced"), "pot_type": (POTS, "kind"), "act": (ACTS, "act")}[name]
            return among(words, o[key])
        if name in ("n_active_before", "n_to_act_after"):
            return whole(o["active" if name == "n_active_before" else "after"])
        if name in ("prev_wager_frac", "act_frac"):
            return number(o["prev" if name == "prev_wager_frac" else "frac"])
        if name == "net_source":
            return among(SOURCES, self.source[h])
        if name == "hand_net_bb":
            return number(net())
        if name == "reward_bb":
            return number(net() + o["committed"] / bb)
        key = {"pot_before_bb": "pot", "to_call_bb": "call", "hero_stack_before_bb": "stack", "committed_before_bb": "committed", "act_to_bb": "to"}[name]
        return number(o[key] / bb)
