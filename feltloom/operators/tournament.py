"""Winrates with confidence intervals, head-to-head chances and stakes matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltloom.functions.stats import correlations, phi, ratio

ENTITY = ("site", "player")


def winrates(rows: DataFrame, min_hands: int, entity: tuple[str, ...] = ENTITY) -> DataFrame:
    """Mean, deviation and count of known nets of each entity of the cohort; bb per hundred, its standard error and 95 % interval."""
    each = rows.where("net_bb IS NOT NULL").groupBy(*entity).agg(F.count("*").alias("n_hands"), F.avg("net_bb").alias("m"), F.stddev_samp("net_bb").alias("sd"))
    each = each.where(F.col("n_hands") >= min_hands).withColumns({"bb100": F.col("m") * 100, "se": F.col("sd") / F.sqrt("n_hands") * 100})
    return each.withColumns({"lo": F.col("bb100") - 1.96 * F.col("se"), "hi": F.col("bb100") + 1.96 * F.col("se")})


def rounded(rates: DataFrame, digits: int = 6) -> DataFrame:
    return rates.withColumns({c: F.round(c, digits) for c in ("m", "sd", "bb100", "se", "lo", "hi") if c in rates.columns})


def resolvable(rates: DataFrame) -> DataFrame:
    win, lose = F.col("lo") > 0, F.col("hi") < 0
    return rates.agg(F.count("*").alias("players"), F.count_if(win).alias("winning"), F.count_if(lose).alias("losing"), F.count_if(~win & ~lose).alias("neither"))


def spread(rates: DataFrame) -> DataFrame:
    q = lambda c, p: F.round(F.percentile(c, p), 6)
    return rates.agg(q("bb100", 0.05).alias("p5"), q("bb100", 0.5).alias("median"), q("bb100", 0.95).alias("p95"), F.round(F.median((F.col("hi") - F.col("lo")) / 2), 6).alias("half_width"), F.round(F.median("n_hands"), 6).alias("median_hands"))


def leaderboard(rates: DataFrame, top: int = 12, bottom: int = 6) -> DataFrame:
    """The best and the worst; two top-k passes, no full sort."""
    key = ["bb100", *ENTITY]
    best = rates.orderBy(F.desc("bb100"), *ENTITY).limit(top).withColumn("part", F.lit("top"))
    worst = rates.orderBy(*key).limit(bottom).withColumn("part", F.lit("bottom"))
    return best.unionByName(worst)


def head_to_head(rates: DataFrame, top: int = 6) -> DataFrame:
    """P(A beats B) of the best, from the difference of their rates; top squared rows."""
    best = rates.orderBy(F.desc("bb100"), *ENTITY).limit(top).select(F.concat_ws("|", *ENTITY).alias("p"), "bb100", "se")
    a, b = (best.select(*[F.col(c).alias(f"{x}_{c}") for c in best.columns]) for x in "ab")
    pairs = a.crossJoin(F.broadcast(b)).where("a_p <> b_p")
    z = F.try_divide(F.col("a_bb100") - F.col("b_bb100"), F.sqrt(F.col("a_se") ** 2 + F.col("b_se") ** 2))
    return pairs.select("a_p", "b_p", F.round(phi(z), 6).alias("p_a"))


def stakes_matched(rows: DataFrame, min_hands: int) -> DataFrame:
    """Winrate as it were with everyone's hands spread over the levels as all hands are, over the levels the entity played."""
    known = rows.where("net_bb IS NOT NULL")
    levels = known.groupBy("nl_level").agg(F.count("*").alias("_n"))
    share = levels.crossJoin(F.broadcast(levels.agg(F.sum("_n").alias("_all")))).select("nl_level", ratio(F.col("_n"), F.col("_all")).alias("w"))
    each = known.groupBy(*ENTITY, "nl_level").agg(F.avg("net_bb").alias("m"), F.count("*").alias("n"))
    matched = each.join(share, "nl_level").groupBy(*ENTITY).agg((F.sum(F.col("w") * F.col("m")) / F.sum("w") * 100).alias("matched"), F.sum("n").alias("n_hands"))
    return matched.where(F.col("n_hands") >= min_hands)


def agreement(rows: DataFrame, min_hands: int) -> DataFrame:
    """Rank agreement of raw and stakes-matched winrates."""
    both = winrates(rows, min_hands).select(*ENTITY, F.round("bb100", 9).alias("bb100")).join(stakes_matched(rows, min_hands).select(*ENTITY, F.round("matched", 9).alias("matched")), list(ENTITY))
    return correlations(both, "bb100", "matched")
