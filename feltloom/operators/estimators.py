"""Peer-comparison estimators over (entity, state, action, reward) with a temporal holdout.

The (entity, state, action) table is aggregated once and feeds every later step: population values, state weights,
policies and skills are sums over it, so the decisions are scanned and shuffled a single time.
Rewards are summed as given (whole cents in the bindings); ``scale`` turns sums into units.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltloom.functions.stats import correlations, pearson, ratio, tie_rank


@dataclass(frozen=True)
class Params:
    state: str = "s_core"
    action: str = "a"
    reward: str = "r_c"
    scale: float = 100.0
    entity: tuple[str, ...] = ("site", "player")
    split_day: int = 18
    nmin: int = 2
    nmin_sa: int = 2
    min_eligible: int = 20
    min_train: int = 30
    min_test: int = 20


def realised(rows: DataFrame, p: Params, net: str = "net_c", scale: float = 1000000.0) -> DataFrame:
    """Winrate per hundred of each entity before and after the split day, with counts of known nets."""
    train, known = F.col("day") <= p.split_day, F.col(net).isNotNull()
    mean = lambda w: F.round(ratio(F.sum(F.when(w, F.col(net))), F.count_if(w & known)) * 100 / scale, 6)
    return rows.groupBy(*p.entity).agg(
        F.count_if(train & known).alias("n_train"), F.count_if(~train & known).alias("n_test"), mean(train).alias("wr_train"), mean(~train).alias("wr_test")
    )


def cohort(sheet: DataFrame, min_train: int, min_test: int) -> DataFrame:
    return sheet.where((F.col("n_train") >= min_train) & (F.col("n_test") >= min_test))


def train_decisions(d: DataFrame, members: DataFrame, p: Params) -> DataFrame:
    return d.where(F.col("day") <= p.split_day).join(members, list(p.entity), "left_semi")


def cells(cd: DataFrame, p: Params, state: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, reward sums and known rewards of each (entity, state, action): everything else is made from these."""
    s = F.col(p.state) if state is None else state
    return cd.groupBy(*by, *p.entity, s.alias("s"), F.col(p.action).alias("a")).agg(F.count("*").alias("c"), F.sum(p.reward).alias("total"), F.count(p.reward).alias("known"))


def eligible(cell: DataFrame, p: Params, by: tuple[str, ...] = ()) -> DataFrame:
    """States that enough distinct entities met, with their decisions and weight."""
    seen = cell.groupBy(*by, "s").agg(F.countDistinct(F.struct(*p.entity)).alias("entities"), F.sum("c").alias("decisions")).where(F.col("entities") >= p.min_eligible)
    total = seen.groupBy(*by).agg(F.sum("decisions").alias("_all"))
    out = seen.join(F.broadcast(total), list(by)) if by else seen.crossJoin(F.broadcast(total))
    return out.withColumn("w", ratio(F.col("decisions"), F.col("_all"))).drop("_all")


def action_values(cell: DataFrame, met: DataFrame, p: Params, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean known reward of each action in an eligible state, over all entities."""
    seen = cell.join(met.select(*by, "s"), [*by, "s"], "left_semi")
    q = seen.groupBy(*by, "s", "a").agg(F.sum("total").alias("_r"), F.sum("known").alias("known")).where("known > 0")
    return q.select(*by, "s", "a", (ratio(F.col("_r"), F.col("known")) / p.scale).alias("action_mean"), "known")


def state_values(q: DataFrame) -> DataFrame:
    return q.groupBy("s").agg((F.sum(F.col("action_mean") * F.col("known")) / F.sum("known")).alias("state_mean"))


def valued(cell: DataFrame, q: DataFrame, state_mean: DataFrame) -> DataFrame:
    """Cells with the population value of their action, or else of their state."""
    return cell.join(q, ["s", "a"], "left").join(state_mean, "s", "left").withColumn("val", F.coalesce("action_mean", "state_mean"))


def population_policy(cell: DataFrame, met: DataFrame, q: DataFrame, state_mean: DataFrame) -> DataFrame:
    seen = cell.join(met.select("s"), "s", "left_semi").groupBy("s", "a").agg(F.sum("c").alias("c"))
    return valued(seen, q, state_mean).groupBy("s").agg((F.sum(F.col("c") * F.col("val")) / F.sum("c")).alias("population_value"))


def entity_policy(cell: DataFrame, q: DataFrame, state_mean: DataFrame, p: Params) -> DataFrame:
    """What an entity's own choices in a state are worth at population values; NULL in states without any."""
    total = F.sum("c").alias("n_state")
    return valued(cell, q, state_mean).groupBy(*p.entity, "s").agg(F.sum(F.col("c") * F.col("val")).alias("_v"), total).select(*p.entity, "s", (F.col("_v") / F.col("n_state")).alias("entity_value"), "n_state")


def alignment_edge(cell: DataFrame, met: DataFrame, q: DataFrame, state_mean: DataFrame, p: Params) -> DataFrame:
    """Weighted gain of an entity's policy over the population's, in states it met often enough."""
    own = entity_policy(cell, q, state_mean, p).where(F.col("n_state") >= p.nmin)
    both = own.join(met.select("s", "w"), "s").join(population_policy(cell, met, q, state_mean), "s")
    return both.groupBy(*p.entity).agg(F.sum(F.col("w") * (F.col("entity_value") - F.col("population_value"))).alias("edge"))


def like_for_like(cell: DataFrame, met: DataFrame, q: DataFrame, p: Params, by: tuple[str, ...] = ()) -> DataFrame:
    """Reward above the population in the same state with the same action, by the entity's own frequencies; and the share so covered."""
    seen = cell.join(met.select(*by, "s"), [*by, "s"], "left_semi")
    total = seen.groupBy(*by, *p.entity).agg(F.sum("c").alias("ntot"))
    own = seen.where(F.col("known") >= p.nmin_sa).join(q.select(*by, "s", "a", "action_mean"), [*by, "s", "a"])
    gain = F.col("c") * (F.col("total") / F.col("known") / p.scale - F.col("action_mean"))
    sums = own.groupBy(*by, *p.entity).agg(F.sum(gain).alias("_g"), F.sum("c").alias("_c"))
    return sums.join(total, [*by, *p.entity]).select(*by, *p.entity, ratio(F.col("_g"), F.col("ntot")).alias("skill"), ratio(F.col("_c"), F.col("ntot")).alias("cov"))


def score_sheet(members: DataFrame, edge: DataFrame, skill: DataFrame, p: Params) -> DataFrame:
    key = list(p.entity)
    out = members.join(edge, key, "left").join(skill, key, "left")
    return out.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("edge", "skill", "cov")})


def with_combined(sheet: DataFrame) -> DataFrame:
    """Edge and skill as one score: the sum of their standardised ranks."""
    out = sheet.withColumns({"_ra": tie_rank("edge"), "_rb": tie_rank("skill")})
    every = W.partitionBy()
    z = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(every), F.stddev_pop(c).over(every)), F.lit(0.0))
    return out.withColumn("combined", F.round(z("_ra") + z("_rb"), 6)).drop("_ra", "_rb")


def subset_correlations(sheet: DataFrame, x: str, y: str, cuts: tuple[int, ...], on: str = "n_test", least: int = 100) -> DataFrame:
    """Correlations over the rows with ``on`` at each cut or above, ranked anew; cuts with fewer than ``least`` rows are left out."""
    stacked = sheet.select("*", F.explode(F.array(*map(F.lit, cuts))).alias("cut")).where(F.col(on) >= F.col("cut"))
    return correlations(stacked, x, y, ("cut",)).where(F.col("n") >= least)


@dataclass(frozen=True)
class Evaluation:
    """All tables of one run."""

    sheet: DataFrame
    members: DataFrame
    cell: DataFrame
    met: DataFrame
    q: DataFrame
    state_mean: DataFrame
    edge: DataFrame
    skill: DataFrame
    scores: DataFrame


def evaluate(d: DataFrame, p: Params = Params(), sheet: DataFrame | None = None) -> Evaluation:
    """sheet: winrates from participant rows, where there are such; otherwise from the decisions' rewards."""
    sheet = realised(d, p, p.reward, p.scale) if sheet is None else sheet
    members = cohort(sheet, p.min_train, p.min_test)
    cell = cells(train_decisions(d, members, p), p)
    met = eligible(cell, p)
    q = action_values(cell, met, p)
    state_mean = state_values(q)
    edge = alignment_edge(cell, met, q, state_mean, p)
    skill = like_for_like(cell, met, q, p)
    return Evaluation(sheet, members, cell, met, q, state_mean, edge, skill, score_sheet(members, edge, skill, p))


def summary(scores: DataFrame, met: DataFrame) -> DataFrame:
    """One row: cohort size, eligible states, and how each score's rank agrees with the later winrate's."""
    with_all = with_combined(scores)
    ranked = with_all.withColumns({f"_r_{c}": tie_rank(c) for c in ("wr_train", "wr_test", "edge", "skill", "combined")})
    rho = lambda c: F.round(pearson(F.col(f"_r_{c}"), F.col("_r_wr_test")), 6)
    out = ranked.agg(F.count("*").alias("n_players"), rho("wr_train").alias("ceiling"), rho("edge").alias("edge"), rho("skill").alias("skill"), rho("combined").alias("combined"), F.round(F.avg("cov"), 6).alias("mean_cov"))
    return out.crossJoin(F.broadcast(met.agg(F.count("*").alias("n_states"))))


def ablation(d: DataFrame, states: dict[str, Column], p: Params = Params(), sheet: DataFrame | None = None) -> DataFrame:
    """The skill's rank agreement for each way of keying states: the keys are stacked as rows, so that one pass serves all. sheet as in ``evaluate``."""
    members = cohort(realised(d, p, p.reward, p.scale) if sheet is None else sheet, p.min_train, p.min_test)
    cd = train_decisions(d, members, p)
    labels = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), c.alias("key")) for k, c in states.items()])).alias("_k")
    stacked = cd.select(*p.entity, p.action, p.reward, labels).select(*p.entity, p.action, p.reward, "_k.label", "_k.key").where("key IS NOT NULL")
    cell = cells(stacked, p, F.col("key"), ("label",))
    met = eligible(cell, p, ("label",))
    skill = like_for_like(cell, met, action_values(cell, met, p, ("label",)), p, ("label",))
    named = members.crossJoin(F.broadcast(met.select("label").distinct())).join(skill, ["label", *p.entity], "left")
    named = named.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("skill", "cov")})
    return correlations(named, "skill", "wr_test", ("label",)).join(met.groupBy("label").agg(F.count("*").alias("n_states")), "label")
