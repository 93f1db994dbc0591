"""Connected components as Spark joins: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _to_least(pairs: DataFrame, keep_own: bool) -> DataFrame:
    """For (u, v): every v is hung on the least id that u knows.

    keep_own: u itself hangs on it as well (small star, where v < u); else only the v above u do (large star).
    The minimum is aggregated before the join, so a node that a third of all edges touch is summed up in every task,
    and the join that follows is one whose large partitions Spark may split.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    if not keep_own:
        least = least.withColumn("m", F.least("u", "m"))
    joined = pairs.join(least, "u")
    moved = joined.where("v > u" if not keep_own else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep_own:
        moved = moved.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node on an edge; the component is its least id. Null ends are no edges.

    Converges in a number of rounds logarithmic in the graph's diameter; each round is written to the shared folder.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND u <> v").distinct()
    now = written(now, "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_to_least(both, keep_own=False), "large-star")
        now = written(_to_least(large, keep_own=True), "small-star")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    stars = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.select(F.col("u").alias("id"), "component").union(roots).groupBy("id").agg(F.min("component").alias("component"))
