"""Range-relative features: where a hand class stands among all classes seen in the same public context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltloom.functions import buckets
from feltloom.functions.stats import pearson, quantiles, ratio
from feltloom.sources.scratch import written

CONTEXT = ("ctx", "board")
#: What everybody at the table knows of a decision, besides the board.
PUBLIC = ("street", "pot_type", "pos", "action_faced", "faced_sz", "spr_b", "nactive")


def keyed(d: DataFrame) -> DataFrame:
    """Replayed decisions with states, by their public context and the class of the hole cards."""
    return d.withColumns({"ctx": buckets.joined(*PUBLIC), "hole_class": F.col("hero_hole_class"), "hand_bucket": F.col("hero_hand_bucket")})


def source(d: DataFrame) -> DataFrame:
    """Decisions with the score of their made hand in tenths, and whether it is strong."""
    return d.withColumns({"hv": F.round(buckets.hand_score(F.col("hand_bucket")) * 10).cast("bigint"), "strong": buckets.is_strong(F.col("hand_bucket")).cast("int")})


def distribution(rows: DataFrame) -> DataFrame:
    """Mean score, strong rate and count of each known class in a context."""
    return rows.where("hole_class IS NOT NULL").groupBy(*CONTEXT, "hole_class").agg(
        F.round(F.sum("hv") / F.count("*") / 10, 9).alias("hv"), F.sum("strong").alias("n_strong"), F.count("*").alias("n")
    ).withColumn("strong_rate", ratio(F.col("n_strong"), F.col("n")))


def contexts(dist: DataFrame) -> DataFrame:
    """Wetness (strong rate of all hands) and dispersion (spread of class scores) of each context."""
    return dist.groupBy(*CONTEXT).agg(F.sum("n").alias("total_n"), ratio(F.sum("n_strong"), F.sum("n")).alias("wetness"), (F.stddev_pop("hv") / 8.0).alias("dispersion"))


def board_meta(rows: DataFrame) -> DataFrame:
    return rows.where("hole_class IS NOT NULL").groupBy(*CONTEXT).agg(F.min("board_bucket").alias("board_bucket"), F.min("street").alias("street"))


def percentiles(dist: DataFrame) -> DataFrame:
    """Share of a context's hands whose class scores no better: a running sum over equal scores together, not a self-join."""
    up_to = F.sum("n").over(W.partitionBy(*CONTEXT).orderBy("hv").rangeBetween(W.unboundedPreceding, W.currentRow))
    return dist.withColumn("h_pct", ratio(up_to, F.sum("n").over(W.partitionBy(*CONTEXT))))


def features(rows: DataFrame) -> DataFrame:
    """h_pct, wetness and dynamicness of each class in its context, and their terciles low, mid and high."""
    dist = distribution(rows)
    pct = percentiles(dist).join(contexts(dist).select(*CONTEXT, "wetness", "dispersion"), list(CONTEXT)).join(board_meta(rows), list(CONTEXT))
    proxy = buckets.board_dynamic(F.col("board_bucket"), F.col("street"))
    pct = pct.withColumn("dynamicness", F.round(F.coalesce("dispersion", F.lit(0.0)) + proxy, 9)).withColumns({c: F.round(c, 9) for c in ("h_pct", "wetness")})
    named = {"h": "h_pct", "w": "wetness", "d": "dynamicness"}
    # The table grows with the decisions: its three columns are ranked stacked, range by range, and only their cuts meet.
    pct = written(pct, "range-features")
    stacked = pct.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in named.items()])).alias("x")).select("x.k", "x.v")
    found = quantiles(stacked, "v", {"low": 0.333, "high": 0.667}, ("k",))
    cuts = found.agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{k}{i}") for k in named for i, c in ((1, "low"), (2, "high"))])
    pct = pct.crossJoin(F.broadcast(cuts))
    bins = {f"{k}_bin": F.when(F.col(c) <= F.round(f"{k}1", 9), "low").when(F.col(c) <= F.round(f"{k}2", 9), "mid").otherwise("high") for k, c in named.items()}
    return pct.withColumns(bins).select(*CONTEXT, "hole_class", "h_pct", "wetness", "dynamicness", *bins)


def attach(d: DataFrame, found: DataFrame) -> DataFrame:
    """Decisions with their bins, mid where unknown, and the key s_range."""
    out = d.join(found, [*CONTEXT, "hole_class"], "left")
    mid = lambda c: F.coalesce(F.col(c), F.lit("mid"))
    return out.withColumn("s_range", F.concat("s_fine", F.lit("|Hq="), mid("h_bin"), F.lit("|W="), mid("w_bin"), F.lit("|D="), mid("d_bin")))


def summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("n"), F.round(pearson(F.col("wetness"), F.col("dynamicness")), 6).alias("corr_wd"))
