"""Feasibility profiling: volumes, visibility, quantiles and integrity of participant rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feltloom.functions import stats
from feltloom.functions.stats import ratio
from feltloom.sources.scratch import written

ENTITY = ("site", "player")
HAND = ("site", "hand_id")
QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def totals(decisions: DataFrame, hand_player: DataFrame) -> DataFrame:
    """One row: how many decisions and participant rows there are."""
    return decisions.agg(F.count("*").alias("n_decisions")).crossJoin(hand_player.agg(F.count("*").alias("n_rows")))


def distinct_hands(rows: DataFrame, hand: tuple[str, ...] = HAND) -> DataFrame:
    return rows.agg(F.countDistinct(F.struct(*hand)).alias("n_hands"))


def volume(rows: DataFrame, by: tuple[str, ...], top: int | None = None) -> DataFrame:
    """Rows and distinct players of each group, largest first; a top-k where one is asked for."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(F.struct(*ENTITY)).alias("n_players"))
    out = out.orderBy(F.desc("n"), *by)
    return out.limit(top) if top else out


def entity_counts(rows: DataFrame, entity: tuple[str, ...] = ENTITY) -> DataFrame:
    """Hands of each entity, and in how many it was voluntarily in, at showdown, and shown."""
    return rows.groupBy(*entity).agg(
        F.count("*").alias("hands"),
        F.count_if("vpip").alias("vpip_hands"),
        F.count_if("reached_showdown").alias("showdowns"),
        F.count_if(F.col("reached_showdown") & F.col("saw_hole")).alias("shown"),
    )


def quantiles(df: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """Exact quantiles by interpolation; ``percentile`` partially aggregates value counts, not rows."""
    x = F.col(value)
    return df.agg(
        F.min(x).alias("min"),
        *[F.round(F.percentile(x, p), digits).alias(k) for k, p in QUANTILES.items()],
        F.max(x).alias("max"),
        F.round(F.avg(x), digits).alias("mean"),
    )


#: Size of a quantile sketch: the rank of an answer is off by less than 1.4 percent of the rows with probability 0.99. Larger is nearer, at most 65535.
QUANTILE_K = 200
#: Registers of a distinct-count sketch, as a power of two: a relative standard error of 0.8 percent at 14, half of it for each two more; at most 21.
DISTINCT_LG = 14


def value_sketch(df: DataFrame, value: str, by: tuple[str, ...] = (), k: int = QUANTILE_K) -> DataFrame:
    """A quantile sketch of an integer column for each group, with its least and greatest value, sum and rows; NULLs don't count. Its size is bounded, whatever the rows."""
    x = F.col(value).cast("bigint")
    return df.where(x.isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_bigint(x, k).alias("sketch"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x).alias("total"), F.count("*").alias("n"))


def sketched_quantiles(sketches: DataFrame, k: int = QUANTILE_K, digits: int = 6) -> DataFrame:
    """The columns of ``quantiles`` from the sketches of any shards; quantiles are values that occur, off by the sketch's error in rank. Without rows all are NULL."""
    one = sketches.agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"), F.min("min").alias("min"), F.max("max").alias("max"), ratio(F.sum("total"), F.sum("n")).alias("mean"))
    at = lambda p: F.when(F.col("min").isNotNull(), F.kll_sketch_get_quantile_bigint("sketch", F.lit(p))).cast("double")
    return one.select("min", *[at(p).alias(name) for name, p in QUANTILES.items()], "max", F.round("mean", digits).alias("mean"))


def distinct_sketch(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = (), lg: int = DISTINCT_LG) -> DataFrame:
    """A distinct-count sketch of each column for each group; NULLs don't count."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(c, lg).alias(c) for c in columns])


def sketched_distinct(sketches: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: the distinct values of each column (n_...) over the sketches of any shards, within their error; 0 without rows."""
    return sketches.agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(f"n_{c}") for c in columns])


def at_least(df: DataFrame, value: str, cuts: tuple[int, ...]) -> DataFrame:
    """One row: how many rows reach each cut."""
    return df.agg(*[F.count_if(F.col(value) >= c).alias(f"ge_{c}") for c in cuts])


def volume_share(df: DataFrame, value: str, cuts: tuple[int, ...]) -> DataFrame:
    """One row: the share of all volume that entities at or above each cut have."""
    return df.agg(*[F.round(ratio(F.sum(F.when(F.col(value) >= c, F.col(value)).otherwise(0)), F.sum(value)), 6).alias(f"share_{c}") for c in cuts])


def rate(of: Column, within: Column | None = None) -> Column:
    """Share of true values, over the rows within a condition only."""
    x = of.cast("int")
    return F.round(F.avg(F.when(within, x) if within is not None else x), 6)


def visibility(rows: DataFrame) -> DataFrame:
    hole, shown, vpip = F.col("saw_hole"), F.col("reached_showdown"), F.col("vpip")
    return rows.agg(rate(hole).alias("hole_rate"), rate(shown).alias("showdown_rate"), rate(hole, shown).alias("hole_at_showdown"), rate(hole, ~shown).alias("hole_elsewhere"), rate(vpip).alias("vpip_rate"))


def missing_bias(rows: DataFrame) -> DataFrame:
    """How participants with known cards differ: shown rate by vpip, mean net and investment by visibility."""
    hole, vpip = F.col("saw_hole"), F.col("vpip")
    mean = lambda c, w: F.round(F.avg(F.when(w, F.col(c))), 6)
    return rows.agg(
        rate(hole, vpip).alias("shown_if_vpip"),
        rate(hole, ~vpip).alias("shown_if_not"),
        mean("net_c", hole).alias("net_shown"),
        mean("net_c", ~hole).alias("net_hidden"),
        mean("invested_c", hole).alias("invested_shown"),
        mean("invested_c", ~hole).alias("invested_hidden"),
    )


def outcome_sources(rows: DataFrame) -> DataFrame:
    return rows.groupBy("net_source").agg(F.count("*").alias("n"), F.round(F.avg("net_c"), 6).alias("mean_net_c")).orderBy(F.desc("n"))


def conservation(rows: DataFrame, hand: tuple[str, ...] = HAND) -> DataFrame:
    """Money audit: the sum of the known nets of each hand in big blinds (minus what was raked), and how it is spread."""
    s = rows.where("net_bb IS NOT NULL").groupBy(*hand).agg((F.round(F.sum("net_bb"), 6) + F.lit(0.0)).alias("s"))
    s = written(s, "hand-sums")
    spread = stats.quantiles(s, "s", {"p01": 0.01, "p50": 0.5, "p99": 0.99}).select(*[F.round(k, 6).alias(k) for k in ("p01", "p50", "p99")])
    return s.agg(
        F.count("*").alias("hands"),
        F.round(F.avg("s"), 6).alias("mean"),
        F.count_if(F.col("s") > 0.01).alias("created"),
        F.count_if(F.abs("s") < 0.01).alias("balanced"),
    ).crossJoin(F.broadcast(spread))
