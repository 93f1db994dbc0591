"""Cards as Column expressions: two-character cards, hand classes, buckets, and a total order of seven-card hands.

A card is a rank of 23456789TJQKA and a suit; a card index is 4 * rank + suit, in the order of RANKS and SUITS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS, SUITS = "23456789TJQKA", "cdhs"


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def cards(text: Column) -> Column:
    """The two-character cards of a string."""
    return F.regexp_extract_all(text, F.lit("(..)"), F.lit(1))


def rank(card: Column) -> Column:
    return F.instr(F.lit(RANKS), F.substring(card, 1, 1)) - 1


def suit(card: Column) -> Column:
    return F.instr(F.lit(SUITS), F.substring(card, 2, 1)) - 1


def card_name(index: Column) -> Column:
    i = index.cast("int")
    return F.concat(F.substring(F.lit(RANKS), F.floor(i / 4).cast("int") + 1, F.lit(1)), F.substring(F.lit(SUITS), i % 4 + 1, F.lit(1)))


def known_hole(hole: Column) -> Column:
    return hole.isNotNull() & (F.length(hole) == 4) & (hole != "????")


def hole_class(hole: Column) -> Column:
    """AA, AKs or AKo; NULL if unknown."""
    a, b = F.substring(hole, 1, 1), F.substring(hole, 3, 1)
    first = F.instr(F.lit(RANKS), a) >= F.instr(F.lit(RANKS), b)
    hi, lo = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    suited = F.when(F.substring(hole, 2, 1) == F.substring(hole, 4, 1), "s").otherwise("o")
    return F.when(known_hole(hole), F.when(a == b, F.concat(a, b)).otherwise(F.concat(hi, lo, suited)))


def tallies(items: Column, values: int) -> Column:
    """How often each of 0 .. values - 1 occurs."""
    return F.transform(F.sequence(F.lit(0), F.lit(values - 1)), lambda v: F.size(F.filter(items, lambda x: x == v)))


def straight_high(present: Column) -> Column:
    """Top rank (index) of the best straight among the ranks for which ``present`` (13 booleans) is true; -1 if none. An ace is low too."""
    out = F.lit(-1)
    for top in range(3, 13):
        need = [12 if r < 0 else r for r in range(top - 4, top + 1)]
        all_ = present[need[0]]
        for r in need[1:]:
            all_ = all_ & present[r]
        out = F.when(all_, F.lit(top)).otherwise(out)
    return out


def board_bucket(board: Column) -> Column:
    """{cards}{p/u}{m/t/r}{c/g}: paired, suits (three alike, two, none) and connection (three ranks within five); preflop without a board."""

    def of(cs: Column) -> Column:
        def of_ranks(r: Column) -> Column:
            distinct = F.array_distinct(r)
            paired = F.when(F.size(distinct) < F.size(r), "p").otherwise("u")
            most = F.array_max(tallies(F.transform(cs, suit), 4))
            suited = F.when(most >= 3, "m").when(most == 2, "t").otherwise("r")
            near = F.when((F.size(distinct) >= 3) & (F.array_max(r) - F.array_min(r) <= 4), "c").otherwise("g")
            return F.concat(F.size(r).cast("string"), paired, suited, near)

        return let(F.transform(cs, rank), of_ranks)

    return F.when(F.coalesce(F.length(board), F.lit(0)) == 0, "preflop").otherwise(let(cards(board), of))


def made_hand(hole: Column, board: Column) -> Column:
    """The made-hand label of hole and board together. A straight and a flush need not be of the same cards to be a straight flush here."""

    def of(cs: Column) -> Column:
        def with_counts(n: Column) -> Column:
            most_suited = F.array_max(tallies(F.transform(cs, suit), 4))
            ordered = F.sort_array(n, asc=False)
            top, second = ordered[0], ordered[1]
            straight = let(F.transform(n, lambda x: x > 0), straight_high) >= 0
            flush = most_suited >= 5
            # With a single pair: is it the pocket pair?
            pocket = (F.substring(hole, 1, 1) == F.substring(hole, 3, 1)) & ~F.contains(F.regexp_replace(board, "(.).", "$1"), F.substring(hole, 1, 1))
            return (
                F.when(flush & straight, "straight_flush")
                .when(top == 4, "quads")
                .when((top == 3) & (second == 2), "full_house")
                .when(flush, "flush")
                .when(straight, "straight")
                .when(top == 3, "trips")
                .when((top == 2) & (second == 2), "two_pair")
                .when(top == 2, F.when(pocket, "overpair_pair").otherwise("pair"))
                .when(most_suited == 4, "flush_draw")
                .otherwise("high_card")
            )

        return let(tallies(F.transform(cs, rank), 13), with_counts)

    return F.when(~F.coalesce(known_hole(hole), F.lit(False)), "unknown").when(F.coalesce(F.length(board), F.lit(0)) == 0, "preflop").otherwise(let(cards(F.concat(hole, board)), of))


def _table(of) -> Column:
    """of(mask) for every set of ranks, as one literal array: it is parsed once for a plan."""
    return F.split(F.lit(",".join(str(of(m)) for m in range(1 << 13))), ",").cast("array<int>")


def _top(mask: int, k: int) -> list[int]:
    return [r + 2 for r in range(12, -1, -1) if mask >> r & 1][:k]


def _packed(mask: int) -> int:
    """The five highest ranks (2 to 14) as digits to the base 15, the highest first; 0 where there are fewer."""
    out = 0
    for r in [*_top(mask, 5), 0, 0, 0, 0, 0][:5]:
        out = 15 * out + r
    return out


def _straight(mask: int) -> int:
    """The top rank (2 to 14) of the best straight, 0 if none; an ace is low too."""
    low = mask << 1 | mask >> 12
    return next((5 + t for t in range(9, -1, -1) if low >> t & 31 == 31), 0)


def score(cs: Column) -> Column:
    """A number that orders hands of five to seven cards (array of strings) as their best five cards do; equal hands tie. NULL if a card is there twice or is none.

    Category * 15**5 and five kickers of 0 to 14. The cards are one number with 16 bits for each suit; ranks held twice, three and four times come from the suits by
    bit operations, and kickers and straights from tables over the 8,192 sets of ranks.
    """
    top, runs = _table(_packed), _table(_straight)
    bit = lambda c: F.when((rank(c) >= 0) & (suit(c) >= 0), F.call_function("shiftleft", F.lit(1).cast("bigint"), suit(c) * 16 + rank(c)))
    held = F.aggregate(cs, F.lit(0).cast("bigint"), lambda a, c: a.bitwiseOR(bit(c)))
    both = lambda a, b: a.bitwiseAND(b)
    either = lambda a, *more: a if not more else a.bitwiseOR(either(*more))
    without = lambda a, b: a.bitwiseAND(F.bitwise_not(b))

    def first(mask: Column, k: int) -> Column:
        """The k highest ranks as digits."""
        return F.floor(F.get(top, mask) / 15 ** (5 - k))

    one = lambda rank: F.when(rank > 0, F.call_function("shiftleft", F.lit(1), (rank - 2).cast("int"))).otherwise(0)
    pack = lambda category, kickers: (F.lit(category * 15**5) + kickers).cast("bigint")

    def of(x: Column) -> Column:
        quad, trip, over, high, low = (x[k] for k in ("quad", "trip", "over", "high", "low"))
        run, flush_run = F.get(runs, x.any), F.get(runs, x.flush)
        return (
            F.when(flush_run > 0, pack(8, flush_run * 15**4))
            .when(quad > 0, pack(7, quad * 15**4 + first(without(x.any, one(quad)), 1) * 15**3))
            .when((trip > 0) & (over > 0), pack(6, trip * 15**4 + over * 15**3))
            .when(x.flush > 0, pack(5, F.get(top, x.flush)))
            .when(run > 0, pack(4, run * 15**4))
            .when(trip > 0, pack(3, trip * 15**4 + first(without(x.any, one(trip)), 2) * 15**2))
            .when(low > 0, pack(2, high * 15**4 + low * 15**3 + first(without(x.any, either(one(high), one(low))), 1) * 15**2))
            .when(high > 0, pack(1, high * 15**4 + first(without(x.any, one(high)), 3) * 15))
            .otherwise(pack(0, F.get(top, x.any)))
        )

    def ranked(x: Column) -> Column:
        trip, high = first(x.three, 1), first(x.two, 1)
        return F.struct(
            x.any.alias("any"), x.flush.alias("flush"), first(x.four, 1).alias("quad"), trip.alias("trip"), first(without(x.two, one(trip)), 1).alias("over"),
            high.alias("high"), first(without(x.two, one(high)), 1).alias("low"),
        )

    def counted(suits: Column) -> Column:
        c, d, h, s = (suits[i] for i in range(4))
        flush = F.coalesce(F.get(F.filter(suits, lambda m: F.bit_count(m) >= 5), F.lit(0)), F.lit(0))
        cd, hs, cd1, hs1 = both(c, d), both(h, s), either(c, d), either(h, s)
        return F.struct(
            either(cd1, hs1).alias("any"), either(cd, hs, both(cd1, hs1)).alias("two"), either(both(cd, hs1), both(hs, cd1)).alias("three"), both(cd, hs).alias("four"), flush.alias("flush")
        )

    def suits(x: Column) -> Column:
        masks = F.array(*[F.call_function("shiftright", x, F.lit(16 * i)).bitwiseAND(F.lit(0x1FFF)).cast("int") for i in range(4)])
        return F.when(F.bit_count(x) == F.size(cs), let(let(let(masks, counted), ranked), of))

    return let(held, suits)


def category(s: Column) -> Column:
    """0 high card .. 8 straight flush of a score."""
    return F.floor(s / F.lit(15**5)).cast("int")


def canonical(cs: Column) -> Column:
    """The same key for card sets that differ by a renaming of suits only: sorted ranks of each suit, suits in order."""
    by_suit = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.array_join(F.sort_array(F.transform(F.filter(cs, lambda c: suit(c) == s), lambda c: F.lpad(rank(c).cast("string"), 2, "0"))), "."))
    return F.array_join(F.sort_array(F.filter(by_suit, lambda x: x != "")), "|")


def deck(spark: SparkSession) -> DataFrame:
    return spark.range(52).select(F.col("id").cast("int").alias("i"), card_name(F.col("id")).alias("card"))


def flops(spark: SparkSession) -> DataFrame:
    """All 22,100 three-card sets."""
    d = deck(spark)
    a, b, c = (d.select(F.col("i").alias(f"i{x}"), F.col("card").alias(f"c{x}")) for x in "123")
    return a.join(b, F.col("i1") < F.col("i2")).join(c, F.col("i2") < F.col("i3")).select(F.array("c1", "c2", "c3").alias("cards"), F.concat("c1", "c2", "c3").alias("flop"))
