"""Is a state key fine enough? The variance of rewards, or of an action, that lies between its states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltloom.functions.stats import eta_squared


def cohort(d: DataFrame, min_hands: int, entity: tuple[str, ...] = ("site", "player")) -> DataFrame:
    """Decisions of entities with enough distinct hands."""
    members = d.groupBy(*entity).agg(F.countDistinct("hand_id").alias("n")).where(F.col("n") >= min_hands)
    return d.join(members, list(entity), "left_semi")


def explained(d: DataFrame, states: dict[str, Column], value: Column) -> DataFrame:
    """For each way of keying states, in the order given: groups, rows, eta squared and its gain over the one before."""
    labels = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("label"), c.alias("key")) for i, (k, c) in enumerate(states.items())]
    stacked = d.select(value.cast("double").alias("value"), F.explode(F.array(*labels)).alias("k")).select("value", "k.*").where("key IS NOT NULL")
    out = eta_squared(stacked, "key", "value", ("i", "label")).withColumn("eta2", F.round("eta2", 6))
    gain = F.col("eta2") - F.lag("eta2").over(W.partitionBy().orderBy("i"))
    return out.select("label", "n_groups", "n", "eta2", F.round(gain, 6).alias("gain"))
