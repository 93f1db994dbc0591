"""Common support: how many states a cohort of entities shares, and how much of its volume they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltloom.functions.stats import ratio

ENTITY = ("site", "player")


def entity_summary(d: DataFrame) -> DataFrame:
    return d.groupBy(*ENTITY).agg(F.count("*").alias("decisions"), F.countDistinct("hand_id").alias("n_hands"))


def cohort(summary: DataFrame, min_hands: int) -> DataFrame:
    return summary.where(F.col("n_hands") >= min_hands).select(*ENTITY)


def cohort_sizes(d: DataFrame, min_hands: tuple[int, ...]) -> DataFrame:
    """For each cut the players that reach it and their decisions, from one aggregation."""
    cuts = F.explode(F.array(*map(F.lit, min_hands))).alias("min_hands")
    each = entity_summary(d).select("*", cuts).where("n_hands >= min_hands")
    return each.groupBy("min_hands").agg(F.count("*").alias("players"), F.sum("decisions").alias("decisions"))


def cohort_states(d: DataFrame, members: DataFrame, state: str) -> DataFrame:
    """How often each member met each state."""
    return d.join(members, list(ENTITY), "left_semi").groupBy(*ENTITY, F.col(state).alias("s")).agg(F.count("*").alias("n"))


def state_support(counts: DataFrame) -> DataFrame:
    return counts.groupBy("s").agg(
        F.count("*").alias("eligible"),
        *[F.count_if(F.col("n") >= k).alias(f"obs_{k}") for k in (3, 5, 10)],
        F.sum("n").alias("decisions"),
    )


def supported_fraction(counts: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    return counts.agg(*[F.round(ratio(F.sum(F.when(F.col("n") >= k, F.col("n")).otherwise(0)), F.sum("n")), 6).alias(f"frac_{k}") for k in cuts])


def coverage_grid(counts: DataFrame, members: DataFrame, cuts: tuple[int, ...], shares: tuple[float, ...], min_eligible: int = 20) -> DataFrame:
    """For each (n, x): states that x of the cohort met n times, and their share of decisions; one pass for the whole grid."""
    size = F.broadcast(members.agg(F.count("*").alias("size")))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(x)).alias("x"), F.col(f"obs_{n}").alias("obs")) for n in cuts for x in shares]))
    each = state_support(counts).crossJoin(size).select("decisions", "eligible", "size", cells.alias("g"))
    ok = (F.col("g.obs") >= F.col("g.x") * F.col("size")) & (F.col("eligible") >= min_eligible)
    return each.groupBy(F.col("g.n").alias("n"), F.col("g.x").alias("x")).agg(
        F.count_if(ok).alias("states"), F.round(ratio(F.sum(F.when(ok, F.col("decisions")).otherwise(0)), F.sum("decisions")), 6).alias("share")
    )
