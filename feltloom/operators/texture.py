"""Flop texture: wetness by exact count over hole cards, dynamicness by sampled deals, and weighted terciles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltloom.functions import cards, hand_scores
from feltloom.functions.stats import tie_rank, weighted_correlation, weighted_cuts


def canonical_flops(spark: SparkSession) -> DataFrame:
    """One representative of each class of flops, with the size of the class."""
    keyed = cards.flops(spark).withColumn("key", cards.canonical(F.col("cards")))
    return keyed.groupBy("key").agg(F.min("flop").alias("flop"), F.count("*").alias("n_flops"))


def holes(spark: SparkSession) -> DataFrame:
    d = cards.deck(spark)
    a, b = (d.select(F.col("i").alias(f"i{x}"), F.col("card").alias(f"h{x}")) for x in "12")
    return a.join(b, F.col("i1") < F.col("i2")).select("h1", "h2")


def wetness(spark: SparkSession, flops: DataFrame) -> DataFrame:
    """Share of hole cards that make trips or better with the flop; every free pair of cards is counted.

    The 1,326 pairs are a fixed set, so the join makes 1,176 rows of each flop class and no more.
    """
    b = [F.substring("flop", 2 * i + 1, 2) for i in range(3)]
    board = flops.select("key", "flop", *[f(c).alias(f"{n}{i}") for i, c in enumerate(b) for n, f in (("r", cards.rank), ("s", cards.suit))])
    pairs = holes(spark).select(*[f(F.col(h)).alias(f"{n}{i}") for i, h in ((3, "h1"), (4, "h2")) for n, f in (("r", cards.rank), ("s", cards.suit))])
    free = board.crossJoin(F.broadcast(pairs))
    for i in range(3):
        for j in (3, 4):
            free = free.where((F.col(f"r{i}") != F.col(f"r{j}")) | (F.col(f"s{i}") != F.col(f"s{j}")))
    free = free.withColumn("o", F.sort_array(F.array(*[f"r{i}" for i in range(5)])))
    o = [F.col("o")[i] for i in range(5)]
    different = F.size(F.array_distinct("o"))
    flush = (F.col("s0") == F.col("s1")) & (F.col("s1") == F.col("s2")) & (F.col("s2") == F.col("s3")) & (F.col("s3") == F.col("s4"))
    straight = (different == 5) & ((o[4] - o[0] == 4) | ((o[4] == 12) & (o[3] == 3)))
    three = (o[0] == o[2]) | (o[1] == o[3]) | (o[2] == o[4])
    strong = flush | straight | three
    return free.groupBy("key", "flop").agg(F.count_if(strong).alias("n_strong"), F.count("*").alias("n_holes"), F.avg(strong.cast("int")).alias("w3"))


def dynamicness(spark: SparkSession, flops: DataFrame, heroes: int = 16, turns: int = 20, flop_runs: int = 120, turn_runs: int = 30, seed: str = "d") -> DataFrame:
    """flop, dscore: the mean absolute change of a hero's equity from flop to turn, over samples drawn by a hash of the flop: the same in every run.

    A flop's deals are a matrix of its own in one task, 1,920 and 9,600 runs at the default sizes, so memory stays the same for any number of flops.
    """
    cloudpickle.register_pickle_by_value(hand_scores)
    schema = pa.schema([("flop", pa.string()), ("dscore", pa.float64())])
    changes = hand_scores.changes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            found = [float(np.abs(changes(x, heroes, turns, flop_runs, turn_runs, seed)[2]).mean()) for x in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.float64())], schema=schema)

    # A flop takes some 50 ms: as many tasks as there are cores, whatever the size of the table.
    spread = flops.select("flop").repartition(max(spark.sparkContext.defaultParallelism * 4, 32), "flop")
    return spread.mapInArrow(run, "flop string, dscore double")


def observed(boards: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flops seen, with how often and their class; and those that are no three distinct cards."""
    seen = boards.where(F.length("board") >= 6).groupBy(F.substring("board", 1, 6).alias("flop")).agg(F.count("*").alias("n"))
    seen = seen.withColumn("key", cards.canonical(cards.cards(F.col("flop"))))
    return seen.join(F.broadcast(classes.select("key")), "key"), seen.join(F.broadcast(classes.select("key")), "key", "left_anti")


def terciles(df: DataFrame, value: str, weight: str, out: str) -> DataFrame:
    """0, 1 or 2 by weighted terciles: the first values at which a third and two thirds of the weight are reached."""
    cuts = weighted_cuts(df, value, weight, {"_t1": 1 / 3, "_t2": 2 / 3})
    return df.crossJoin(F.broadcast(cuts)).withColumn(out, F.when(F.col(value) <= F.col("_t1"), 0).when(F.col(value) <= F.col("_t2"), 1).otherwise(2)).drop("_t1", "_t2")


def distinctness(df: DataFrame, x: str, y: str, weight: str) -> DataFrame:
    """Weighted correlation of plain ranks, and the ranges of both."""
    ranked = df.withColumns({"_rx": tie_rank(x), "_ry": tie_rank(y)})
    corr = weighted_correlation(ranked, "_rx", "_ry", weight).select(F.round("corr", 6).alias("corr"))
    return corr.crossJoin(df.agg(*[F.round(f(c), 6).alias(f"{n}_{c}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max))]))


def attach(d: DataFrame, texture: DataFrame) -> DataFrame:
    """Decisions with the labels of their flop, NULL without one. The texture table has a row for each distinct flop seen, 132,600 in their orders at most."""
    return d.withColumn("flop", F.substring("board", 1, 6)).join(F.broadcast(texture), "flop", "left")


def ranked_classes(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.orderBy(F.desc(value), "flop")))


def combinations(boards: DataFrame) -> DataFrame:
    """The three two-card combinations of each flop, in the flop's own order."""
    f = F.substring("board", 1, 6)
    part = lambda a, b: F.concat(F.substring(f, 2 * a - 1, 2), F.substring(f, 2 * b - 1, 2))
    return boards.where(F.length("board") >= 6).select(F.explode(F.array(part(1, 2), part(1, 3), part(2, 3))).alias("pair"))


def seen_flops(boards: DataFrame) -> DataFrame:
    """Distinct flops with counts and canonical keys; keys are made once for each flop, not for each hand."""
    seen = boards.where(F.length("board") >= 6).groupBy(F.substring("board", 1, 6).alias("flop")).agg(F.count("*").alias("n"))
    return seen.withColumn("key", cards.canonical(cards.cards(F.col("flop"))))


def class_table(spark: SparkSession, boards: DataFrame) -> DataFrame:
    """All 1,755 classes: key, representative, how many hands and distinct flops of each were seen, and how many flops of the deck it holds."""
    seen = seen_flops(boards).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("n_flops"))
    every = canonical_flops(spark).withColumnRenamed("n_flops", "of_deck").join(seen, "key", "left")
    return every.select("key", "flop", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_flops", F.lit(0)).alias("n_flops"), "of_deck")


def deck_combinations(spark: SparkSession, boards: DataFrame) -> DataFrame:
    """Every two-card combination of the deck, the lower card first, and the hands on whose flop it lay."""
    card = lambda text, at: 4 * cards.rank(F.substring(text, at, 2)) + cards.suit(F.substring(text, at, 2))
    pair = combinations(boards).select(F.when(card("pair", 1) < card("pair", 3), F.col("pair")).otherwise(F.concat(F.substring("pair", 3, 2), F.substring("pair", 1, 2))).alias("pair"))
    seen = pair.groupBy("pair").agg(F.count("*").alias("n"))
    return holes(spark).select(F.concat("h1", "h2").alias("pair")).join(seen, "pair", "left").select("pair", F.coalesce("n", F.lit(0)).alias("n"))
