"""Statistics as Spark expressions and small DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltloom.sources.scratch import written


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision; NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def tie_rank(value: str, by: tuple[str, ...] = ()) -> Column:
    """Rank from 1, ties sharing the mean of their places. NULLs are ranked too; filter them first."""
    ordered, equal = W.partitionBy(*by).orderBy(value), W.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(equal) - 1) / F.lit(2.0)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of an aggregate; NULL where a side has no variance or fewer than two rows."""
    return F.when(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) > 1, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


#: How many ranges the distinct values of a column are cut into before they are put in order.
RANGES = 64


def cumulative(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The distinct values of a column, with the rows of each (_n) and the rows before it (_start), without one task for all.

    Rows are counted by value first, into a table that the later steps share; approximate quantiles of the values cut them into ranges, which are put in order each by
    itself, and a range adds the rows of the ranges before it. Where the cuts fall doesn't change the result.
    """
    counted = written(df.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    cuts = counted.groupBy(*by).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"))
    cut = counted.join(F.broadcast(cuts), list(by)) if by else counted.crossJoin(F.broadcast(cuts))
    placed = cut.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    sizes = placed.groupBy(*by, "_range").agg(F.sum("_n").alias("_rows"))
    before = sizes.withColumn("_before", F.sum("_rows").over(W.partitionBy(*by).orderBy("_range")) - F.col("_rows")).drop("_rows")
    inside = F.sum("_n").over(W.partitionBy(*by, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    return placed.withColumn("_inside", inside).join(F.broadcast(before), [*by, "_range"]).select(*by, "_v", "_n", (F.col("_before") + F.col("_inside")).alias("_start"))


def with_tie_rank(df: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with the same rank as tie_rank, from the counts of its values: for tables that grow faster than their entities. Values are not NULL."""
    ranks = cumulative(df, value, by).select(*by, F.col("_v").alias(value), (F.col("_start") + 1 + (F.col("_n") - 1) / F.lit(2.0)).alias(out))
    return df.join(ranks, [*by, value])


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each group: exact quantiles, interpolated between the two values whose places are nearest; NULLs don't count."""
    placed = cumulative(df.where(F.col(value).isNotNull()), value, by)
    total = placed.groupBy(*by).agg((F.sum("_n") - 1).alias("_last"))
    at = lambda place: F.max(F.when((F.col("_start") <= place) & (place < F.col("_start") + F.col("_n")), F.col("_v")))
    both = placed.join(F.broadcast(total), list(by)) if by else placed.crossJoin(F.broadcast(total))
    ends = both.groupBy(*by).agg(F.max("_last").alias("_last"), *[at(f(F.col("_last") * F.lit(x))).alias(f"{k}_{n}") for k, x in shares.items() for n, f in (("low", F.floor), ("high", F.ceil))])
    part = lambda x: F.col("_last") * F.lit(x) - F.floor(F.col("_last") * F.lit(x))
    return ends.select(*by, *[(F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * part(x)).alias(k) for k, x in shares.items()])


def correlations(df: DataFrame, x: str, y: str, by: tuple[str, ...] = (), many: bool = False) -> DataFrame:
    """n, pearson and tie-aware spearman of two columns over the rows where both are known; many: of a table that grows faster than its entities."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if many:
        known = written(known.select(*by, x, y), "ranked-rows")
        ranked = with_tie_rank(with_tie_rank(known, x, "_rx", by), y, "_ry", by)
    else:
        ranked = known.withColumns({"_rx": tie_rank(x, by), "_ry": tie_rank(y, by)})
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(pearson(F.col(x), F.col(y)), 6).alias("pearson"),
        F.round(pearson(F.col("_rx"), F.col("_ry")), 6).alias("spearman"),
    )


def weighted_correlation(df: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """One row: the correlation of x and y with weights w, by centred moments."""
    total = df.agg(F.sum(w).alias("_w"), (F.sum(F.col(x) * F.col(w)) / F.sum(w)).alias("_mx"), (F.sum(F.col(y) * F.col(w)) / F.sum(w)).alias("_my"))
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    return df.crossJoin(F.broadcast(total)).agg(
        F.try_divide(F.sum(F.col(w) * dx * dy), F.sqrt(F.sum(F.col(w) * dx * dx) * F.sum(F.col(w) * dy * dy))).alias("corr")
    )


def weighted_cuts(df: DataFrame, value: str, w: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the first value at which the cumulative weight reaches that share of all.

    Equal values are summed first, so the ordered pass has a row for each distinct value only.
    """
    distinct = df.groupBy(F.col(value).alias("_v")).agg(F.sum(w).alias("_n"))
    up_to = F.sum("_n").over(W.orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    share = up_to / F.sum("_n").over(W.partitionBy())
    return distinct.select("_v", share.alias("_c")).agg(*[F.min(F.when(F.col("_c") >= s, F.col("_v"))).alias(name) for name, s in shares.items()])


def eta_squared(df: DataFrame, group: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Share of the variance of value that lies between groups: sum of n_g (m_g - m)^2 over n var_pop."""
    known = df.where(F.col(value).isNotNull())
    each = known.groupBy(*by, group).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"))
    all_ = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"))
    joined = each.join(all_, list(by)) if by else each.crossJoin(F.broadcast(all_))
    between = F.sum(F.col("_n") * (F.col("_m") - F.col("_mean")) ** 2)
    return joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), F.max("n").alias("n"), ratio(between, F.max("_var") * F.max("n")).alias("eta2"))


def phi(z: Column) -> Column:
    """Normal distribution function, by the rational approximation of erf with error below 1.5e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = ((((F.lit(1.061405429) * t - F.lit(1.453152027)) * t + F.lit(1.421413741)) * t - F.lit(0.284496736)) * t + F.lit(0.254829592)) * t
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.lit(0.5) * (F.lit(1.0) + F.when(z < 0, -erf).otherwise(erf))


def phi_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * {x}))"
    poly = f"((((1.061405429::DOUBLE * {t} - 1.453152027::DOUBLE) * {t} + 1.421413741::DOUBLE) * {t} - 0.284496736::DOUBLE) * {t} + 0.254829592::DOUBLE) * {t}"
    return f"(0.5::DOUBLE * (1.0::DOUBLE + sign({z}) * (1.0::DOUBLE - {poly} * exp(-{x} * {x}))))"
