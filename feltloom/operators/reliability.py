"""Label reliability: split halves, mergeable moments and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltloom.functions.stats import correlations, cumulative, ratio
from feltloom.operators import pairs
from feltloom.sources import layout
from feltloom.sources.scratch import written


def half(key: Column) -> Column:
    """0 or 1 by the last hex digit of the key's md5: the same half in every engine and every run."""
    return (F.ascii(F.substring(F.md5(key.cast("string")), 32, 1)) % 2).cast("int")


def moments(rows: DataFrame, by: tuple[str, ...], x: str = "net_c") -> DataFrame:
    """n, sum and sum of squares; partial sums merge in any order. Squares are exact decimals."""
    square = F.col(x).cast("decimal(19,0)") * F.col(x).cast("decimal(19,0)")
    return rows.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(square).cast("double").alias("ss"))


def split_state(rows: DataFrame, shard: str | None = None) -> DataFrame:
    """Moments of each player (opponent NULL) and of each directed pair in each half, in one pass: a seat counts once for itself and once for each opponent.

    ss stays an exact decimal, so states of several shards merge to what one run over all gives. A shard holds whole hands; rows without a hand or a player count nowhere.
    """
    by = (shard,) if shard else ()
    own = rows.withColumn("split", half(F.concat_ws(":", "site", "hand_id"))).select(*by, "hand_id", "player", "split", "net_c")
    seats = pairs.seated(own).select("_players", F.explode("_seats").alias("_own"))
    nobody = F.array(F.lit(None).cast("string"))
    each = seats.select("_own.*", F.explode(F.concat(nobody, pairs.others(F.col("_own.player")))).alias("opponent"))
    square = F.col("net_c").cast("decimal(19,0)") * F.col("net_c").cast("decimal(19,0)")
    kind = F.when(F.col("opponent").isNull(), "player").otherwise("pair").alias("kind")
    known = each.where(F.col("net_c").isNotNull())
    return known.groupBy(*by, kind, "player", "opponent", "split").agg(F.count("*").alias("n"), F.sum("net_c").alias("s"), F.sum(square).alias("ss"))


def merged(states: DataFrame) -> DataFrame:
    """The moments of states of any shards, in any order."""
    out = states.groupBy("kind", "player", "opponent", "split").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    return out.withColumn("ss", F.col("ss").cast("double"))


def keep_state(rows: DataFrame, path: str, shard: str) -> None:
    """Write the states of the shards that rows hold; a shard that is there already is replaced, the others stay, and none of them is read."""
    layout.partitioned(split_state(rows, shard), path, shard)


def split_moments(rows: DataFrame) -> DataFrame:
    """Moments of each player and of each directed pair in each half, from one pass over the rows."""
    return split_state(rows).withColumn("ss", F.col("ss").cast("double"))


def with_errors(m: DataFrame, scale: float = 1000000.0) -> DataFrame:
    """Mean, sample variance (at least 0; 0 for one row) and standard error per hundred."""
    mean = F.col("s") / F.col("n") / scale
    var = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.col("ss") / scale / scale - F.col("n") * mean * mean) / (F.col("n") - 1))).otherwise(0.0)
    return m.select(*[c for c in m.columns if c not in ("s", "ss")], (mean * 100).alias("bb100"), (F.sqrt(var / F.col("n")) * 100).alias("se"))


def halves(m: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row for each key with both halves side by side, where both are known."""
    mean = F.first(F.round(F.col("s") / F.col("n") / 10000.0, 9))
    out = m.groupBy(*key).pivot("split", [0, 1]).agg(mean.alias("bb"), F.first("n").alias("n"))
    return out.where("`0_bb` IS NOT NULL AND `1_bb` IS NOT NULL").toDF(*key, "bb_0", "n_0", "bb_1", "n_1")


def split_summary(m: DataFrame) -> DataFrame:
    """Agreement of the two halves, for players and for pairs: halves of both kinds are one table, ranked within their kind in one go."""
    return correlations(halves(m, ("kind", "player", "opponent")), "bb_0", "bb_1", ("kind",), many=True)


def pair_rollup(m: DataFrame, top: int = 40) -> DataFrame:
    """Hands of each pair and the plain mean of its halves' rates; the pairs with the most hands."""
    each = m.where("kind = 'pair'").groupBy("player", "opponent").agg(F.sum("n").alias("hands"), F.round(F.avg(F.round(F.col("s") / F.col("n") / 10000.0, 9)), 6).alias("bb100"))
    return each.orderBy(F.desc("hands"), "player", "opponent").limit(top)


def counters(rows: DataFrame, file: Column) -> DataFrame:
    return rows.agg(F.countDistinct(file).alias("files"), F.countDistinct("hand_id").alias("hands"), F.count("*").alias("entries"))


def integrity(decisions: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: volumes, the largest imbalance of a hand whose nets are known (what was raked, if nothing else is wrong), and how many rows have known cards."""
    hand = rows.groupBy("hand_id").agg(F.abs(F.sum("net_bb")).alias("s"))
    return (
        rows.agg(F.countDistinct("hand_id").alias("hands"), F.count("*").alias("n_rows"), F.round(F.avg(F.col("saw_hole").cast("int")), 6).alias("hole_coverage"))
        .crossJoin(hand.agg(F.round(F.max("s"), 6).alias("max_abs_sum")))
        .crossJoin(decisions.agg(F.count("*").alias("decisions")))
    )


def pair_target(rows: DataFrame) -> DataFrame:
    """Rate, standard error and z of each directed pair."""
    out = pairs.meetings(rows).groupBy("player", "opponent").agg(F.count("*").alias("n"), F.avg("net_bb").alias("m"), F.stddev_samp("net_bb").alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return out.select("player", "opponent", "n", (F.col("m") * 100).alias("bb100"), (se * 100).alias("se"), F.try_divide("m", se).alias("z"))


def unordered_split(rows: DataFrame) -> DataFrame:
    """Halves of each unordered pair; the net is that of the player whose name sorts first."""
    met = pairs.meetings(rows.withColumn("split", half(F.concat_ws(":", "site", "hand_id"))))
    sign = F.when(F.col("player") < F.col("opponent"), 1).otherwise(-1)
    signed = met.select(F.least("player", "opponent").alias("p1"), F.greatest("player", "opponent").alias("p2"), "split", (sign * F.col("net_c")).alias("net_c"))
    return halves(moments(signed, ("p1", "p2", "split")), ("p1", "p2"))


def action_table(d: DataFrame) -> DataFrame:
    out = d.groupBy("a").agg(F.count("*").alias("n"), F.round(F.avg("reward_bb"), 6).alias("mean"), F.round(F.stddev_samp("reward_bb"), 6).alias("sd"))
    return out.orderBy("mean", "a")


def residual_scores(d: DataFrame, rows: DataFrame, least: int = 10, state: str = "s_core") -> DataFrame:
    """Mean reward above that of the same state and action, against the actual rate."""
    q = d.groupBy(F.col(state).alias("s"), "a").agg(F.count("*").alias("n"), (F.sum("r_c") / F.count("*") / 100.0).alias("q")).where(F.col("n") >= least).drop("n")
    score = d.withColumn("s", F.col(state)).join(q, ["s", "a"]).groupBy("player").agg(F.round(F.avg(F.col("reward_bb") - F.col("q")), 6).alias("residual"))
    rate = rows.groupBy("player").agg(F.round(ratio(F.sum("net_c"), F.count("net_c")) / 10000.0, 6).alias("actual"))
    return score.join(rate, "player")


def ranked_names(scores: DataFrame, by: str = "residual", top: int | None = None) -> DataFrame:
    """rank and player, best first, ties by name: all of them, or the top ones only.

    Places come from the counts of the scores, range by range; only players of one score are put in order together. Players without a score are left out.
    """
    scores = written(scores.where(F.col(by).isNotNull()).select("player", (-F.col(by)).alias("_s")), "scores")
    before = cumulative(scores, "_s").select(F.col("_v").alias("_s"), "_start")
    ranked = scores.join(before, "_s").select((F.col("_start") + F.row_number().over(W.partitionBy("_s").orderBy("player"))).cast("int").alias("rank"), "player")
    return (ranked.where(F.col("rank") <= top) if top else ranked).orderBy("rank")
