"""Pairwise policy evaluation: who met whom, what each does in common states, and whether that predicts who won.

The value of a policy in a state is computed once for each (player, state) and joined twice to the pairs that actually met, so the work
grows with meetings and common states, not with the square of all players.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltloom.functions.stats import correlations, ratio
from feltloom.operators.profile import QUANTILE_K
from feltloom.sources.scratch import written


def seated(rows: DataFrame, hand: str = "hand_id") -> DataFrame:
    """One row for each hand: its rows (_seats) and its players (_players). A hand has few seats; rows without a hand or a player have no seat."""
    own = F.struct(*[c for c in rows.columns if c != hand])
    known = rows.where(F.col(hand).isNotNull() & F.col("player").isNotNull())
    return known.groupBy(hand).agg(F.collect_list(own).alias("_seats"), F.collect_set("player").alias("_players"))


def others(player: Column) -> Column:
    return F.filter("_players", lambda x: x != player)


def meetings(rows: DataFrame, hand: str = "hand_id") -> DataFrame:
    """Each row of a hand with every other player of that hand, made from the hand's own seats: one exchange by hand, no join."""
    own = seated(rows, hand).select(hand, "_players", F.explode("_seats").alias("_own"))
    return own.select(hand, "_own.*", F.explode(others(F.col("_own.player"))).alias("opponent"))


def faced(rows: DataFrame, d: DataFrame, hand: str = "hand_id") -> DataFrame:
    """Each decision with every other player of its hand: seats and decisions are stacked and meet in the hand's group, again by one exchange and no join.

    Decisions of a hand without seats, or without a hand or a player, face nobody. The group holds one hand.
    """
    decision = F.struct(*[c for c in d.columns if c != hand])
    made = d.select(hand, decision.alias("_d"), F.lit(None).cast(rows.schema["player"].dataType).alias("_p"))
    seats = rows.select(hand, F.lit(None).cast(made.schema["_d"].dataType).alias("_d"), F.col("player").alias("_p"))
    both = made.union(seats).where(F.col(hand).isNotNull()).groupBy(hand).agg(F.collect_list("_d").alias("_made"), F.collect_set("_p").alias("_players"))
    own = both.select(hand, "_players", F.explode("_made").alias("_own"))
    return own.select(hand, "_own.*", F.explode(others(F.col("_own.player"))).alias("opponent"))


def actual(rows: DataFrame) -> DataFrame:
    """bb per hundred of each directed pair."""
    return meetings(rows).groupBy("player", "opponent").agg(F.count("*").alias("n_hands"), (F.sum("net_c") / F.count("net_c") / 10000.0).alias("actual"))


def continuation(d: DataFrame, state: str = "s_core", action: str = "a") -> DataFrame:
    """Mean reward of an action in a state over everyone."""
    known = d.where("r_c IS NOT NULL")
    return known.groupBy(F.col(state).alias("s"), F.col(action).alias("a")).agg((F.sum("r_c") / F.count("*") / 100.0).alias("q"), F.count("*").alias("n"))


def supported(d: DataFrame, nmin: int, state: str = "s_core") -> DataFrame:
    return d.groupBy("player", F.col(state).alias("s")).agg(F.count("*").alias("n")).where(F.col("n") >= nmin)


def policies(d: DataFrame, nmin: int, state: str = "s_core", action: str = "a") -> DataFrame:
    """p(a | player, s) in supported states."""
    each = d.groupBy("player", F.col(state).alias("s"), F.col(action).alias("a")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(W.partitionBy("player", "s"))
    return each.withColumn("n", total).where(F.col("n") >= nmin).select("player", "s", "a", ratio(F.col("c"), F.col("n")).alias("p"))


def state_weights(d: DataFrame, state: str = "s_core", uniform: bool = False) -> DataFrame:
    """The weight of each state: how often it was met, or 1."""
    return d.groupBy(F.col(state).alias("s")).agg(F.count("*").cast("double").alias("w")).withColumn("w", F.lit(1.0) if uniform else F.col("w"))


def policy_values(d: DataFrame, nmin: int, state: str = "s_core", action: str = "a") -> DataFrame:
    """v(player, s): what the player's policy is worth at everyone's rewards; NULL where no action has a value."""
    p = policies(d, nmin, state, action)
    return p.join(continuation(d, state, action).select("s", "a", "q"), ["s", "a"], "left").groupBy("player", "s").agg(F.sum(F.col("p") * F.col("q")).alias("v"))


def common_states(pairs: DataFrame, d: DataFrame, nmin: int, state: str = "s_core", action: str = "a", uniform: bool = False) -> DataFrame:
    """For each pair the states both support, with values and weights that sum to 1 within the pair."""
    v = policy_values(d, nmin, state, action).join(state_weights(d, state, uniform), "s")
    mine = v.withColumnRenamed("v", "v1")
    theirs = v.select(F.col("player").alias("opponent"), "s", F.col("v").alias("v2"))
    both = pairs.select("player", "opponent").join(mine, "player").join(theirs, ["opponent", "s"])
    return both.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("player", "opponent")))


def pair_scores(pairs: DataFrame, d: DataFrame, nmin: int, state: str = "s_core", action: str = "a", uniform: bool = False) -> DataFrame:
    """A hundred times the weighted difference of values over common states; pairs without any are left out."""
    common = common_states(pairs, d, nmin, state, action, uniform)
    known = lambda c: F.sum(F.when(F.col(c).isNotNull(), 1).otherwise(0))
    out = common.groupBy("player", "opponent").agg(
        (F.sum(F.col("w") * (F.coalesce("v1", F.lit(0.0)) - F.coalesce("v2", F.lit(0.0)))) * 100).alias("score"), F.count("*").alias("n_states"), known("v1").alias("_k1"), known("v2").alias("_k2")
    )
    return out.where("_k1 > 0 AND _k2 > 0").drop("_k1", "_k2")


def evaluated(rows: DataFrame, d: DataFrame, nmin: int, min_hands: int, keep_unsupported: bool = False, **how) -> DataFrame:
    """Score and actual result of each directed pair that met often enough."""
    pairs = actual(rows).where(F.col("n_hands") >= min_hands)
    return pairs.join(pair_scores(pairs, d, nmin, **how), ["player", "opponent"], "left" if keep_unsupported else "inner")


def agreement(scored: DataFrame) -> DataFrame:
    return correlations(scored.withColumns({c: F.round(c, 9) for c in ("score", "actual")}), "score", "actual", many=True)


def sweep(rows: DataFrame, d: DataFrame, grid: list[tuple[str, int, str]], min_hands: int) -> DataFrame:
    """Agreement for each (state, nmin, action) of a grid of settings; n is 0 where no pair has a score.

    One plan for the whole grid: decisions are stacked once for each (state, action), values don't depend on nmin, pairs are joined to them once, and a common state
    counts for every setting whose nmin both sides reach.
    """
    spark = d.sparkSession
    keys = list(dict.fromkeys((state, action) for state, _, action in grid))
    settings = spark.createDataFrame([(i, keys.index((state, action)), state, nmin, action) for i, (state, nmin, action) in enumerate(grid)], "i int, k int, state string, nmin int, action string")
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(state).alias("s"), F.col(action).alias("a")) for i, (state, action) in enumerate(keys)]))
    cell = d.select("player", "r_c", stack.alias("_k")).select("player", "r_c", "_k.*").groupBy("k", "player", "s", "a").agg(F.count("*").alias("c"), F.count("r_c").alias("known"), F.sum("r_c").alias("r"))
    cell = written(cell, "sweep-cells")
    q = cell.groupBy("k", "s", "a").agg((ratio(F.sum("r"), F.sum("known")) / 100.0).alias("q"))
    weight = cell.groupBy("k", "s").agg(F.sum("c").cast("double").alias("w"))
    least = settings.groupBy("k").agg(F.min("nmin").alias("least"))
    valued = cell.join(q, ["k", "s", "a"], "left").groupBy("k", "player", "s").agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("q")) / F.sum("c")).alias("v"))
    valued = valued.join(F.broadcast(least), "k").where("n >= least").drop("least").join(weight, ["k", "s"])
    theirs = valued.select("k", "s", F.col("player").alias("opponent"), F.col("n").alias("n2"), F.col("v").alias("v2"))
    both = actual(rows).where(F.col("n_hands") >= min_hands).join(valued, "player").join(theirs, ["k", "s", "opponent"])
    each = both.join(F.broadcast(settings), "k").where(F.least("n", "n2") >= F.col("nmin"))
    diff = F.col("w") * (F.coalesce("v", F.lit(0.0)) - F.coalesce("v2", F.lit(0.0)))
    scored = each.groupBy("i", "player", "opponent").agg((F.sum(diff) / F.sum("w") * 100).alias("score"), F.max("actual").alias("actual"), F.count("v").alias("_k1"), F.count("v2").alias("_k2"))
    rounded = scored.where("_k1 > 0 AND _k2 > 0").withColumns({c: F.round(c, 9) for c in ("score", "actual")})
    out = correlations(rounded, "score", "actual", ("i",), many=True)
    return settings.join(out, "i", "left").select("state", "nmin", "action", F.coalesce("n", F.lit(0)).alias("n"), "pearson", "spearman")


def opponent_actions(rows: DataFrame, d: DataFrame, state: str = "s_core", action: str = "a") -> DataFrame:
    """How often a player took each action in each state with an opponent at the table."""
    met = faced(rows, d)
    return met.groupBy("player", "opponent", F.col(state).alias("s"), F.col(action).alias("a")).agg(F.count("*").alias("c"))


def sized(rows: DataFrame, d: DataFrame, prefixes: tuple[str, ...], state: str, action: str, size: str) -> DataFrame:
    """player, opponent, s, a, size of each decision with a known size and one of the prefixes, for every other player of its hand."""
    test = F.lit(False)
    for x in prefixes:
        test = test | F.col(action).startswith(x)
    met = faced(rows, d.where(F.col(size).isNotNull() & test))
    return met.select("player", "opponent", F.col(state).alias("s"), F.col(action).alias("a"), F.col(size).alias("size"))


CELL = ("player", "opponent", "s", "a")


def sizes(rows: DataFrame, d: DataFrame, prefixes: tuple[str, ...], state: str = "s_core", action: str = "a", size: str = "size") -> DataFrame:
    """The sizes seen for actions with one of the prefixes, as value counts in ascending order: lists bounded by the distinct sizes. See ``size_sketches`` where these are many."""
    each = sized(rows, d, prefixes, state, action, size).groupBy(*CELL, "size").agg(F.count("*").alias("c"))
    return each.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("size", "c"))).alias("sizes"), F.sum("c").alias("n"))


def size_sketches(rows: DataFrame, d: DataFrame, prefixes: tuple[str, ...], k: int = QUANTILE_K, state: str = "s_core", action: str = "a", size: str = "size") -> DataFrame:
    """The same distributions as quantile sketches: a cell takes bounded memory, however many sizes it saw, and sketches of several shards merge. Error as in ``profile.value_sketch``."""
    each = sized(rows, d, prefixes, state, action, size).where(~F.isnan(F.col("size").cast("double")))
    x = F.col("size").cast("double")
    return each.groupBy(*CELL).agg(F.kll_sketch_agg_double(x, k).alias("sketch"), F.min(x).alias("min"), F.max(x).alias("max"), F.count("*").alias("n"))


def size_quantiles(sketches: DataFrame, shares: dict[str, float], k: int = QUANTILE_K) -> DataFrame:
    """Rows, ends and quantiles of each cell from the sketches of any shards."""
    one = sketches.groupBy(*CELL).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n").alias("n"))
    return one.select(*CELL, "n", "min", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in shares.items()], "max")


def population_actions(counts: DataFrame) -> DataFrame:
    return counts.groupBy("s", "a").agg(F.sum("c").alias("c"))
