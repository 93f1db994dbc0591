"""Statistics and buckets against plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from feltloom.functions import buckets, stats


def test_tie_rank_and_spearman(spark):
    xs = [3.0, 1.0, 3.0, 2.0, 5.0]
    rows = spark.createDataFrame([(i, x, -x) for i, x in enumerate(xs)], "i int, x double, y double")
    got = {r.i: r.r for r in rows.withColumn("r", stats.tie_rank("x")).collect()}
    assert got == {0: 3.5, 1: 1.0, 2: 3.5, 3: 2.0, 4: 5.0}
    r = stats.correlations(rows, "x", "y").first()
    assert (r.n, r.pearson, r.spearman) == (5, -1.0, -1.0)


def test_constant_column_has_no_correlation(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert stats.correlations(rows, "x", "y").first().pearson is None


def test_weighted_cuts(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 4)], "v double, w int")
    r = stats.weighted_cuts(rows, "v", "w", {"a": 1 / 3, "b": 2 / 3}).first()
    assert (r.a, r.b) == (2.0, 3.0)


def test_phi(spark):
    zs = [-3.0, -1.0, 0.0, 0.5, 2.5]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").withColumn("p", stats.phi(F.col("z")))
    for r in rows.collect():
        assert abs(r.p - 0.5 * (1 + math.erf(r.z / math.sqrt(2)))) < 1e-6


def test_eta_squared(spark):
    rng = random.Random(1)
    data = [(rng.choice("abc"), rng.random()) for _ in range(200)]
    mean = sum(x for _, x in data) / 200
    groups = Counter(g for g, _ in data)
    means = {g: sum(x for h, x in data if h == g) / n for g, n in groups.items()}
    want = sum(n * (means[g] - mean) ** 2 for g, n in groups.items()) / sum((x - mean) ** 2 for _, x in data)
    got = stats.eta_squared(spark.createDataFrame(data, "g string, x double"), "g", "x").first()
    assert abs(got.eta2 - want) < 1e-9


def test_size_bucket_edges(spark):
    rows = spark.createDataFrame([(None,), (0.39,), (0.4,), (0.75,), (1.25,)], "x double")
    assert [r[0] for r in rows.select(buckets.size_bucket(F.col("x"))).collect()] == ["na", "1", "2", "3", "4"]


def test_state_refuses_other_names(spark):
    import pytest

    rows = spark.createDataFrame([("s",)], "s_core string")
    with pytest.raises(ValueError):
        buckets.state(rows, "s_core; drop")
