"""Registered queries of every module against their SQL on the smallest tables, and the distributed ranks against plain ones."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from feltloom.functions import stats
from feltloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = (
    "a1_section_blocks a9_transcript_blocks a15_fixed_limit_hands a16_sampled_files a18_bucketed_join a21_enriched_by_street a21_persisted_table b13_position_label b17_rake b18_exact_nets b21_hand_scores b22_hand_player c7_state_keys d6_hands_quantiles d13_conservation e6_coverage_grid e6_grid_of_replay f10_entity_policy f13_score_sheet f13_scores_of_replay "
    "h4_incremental_eta_squared i6_head_to_head j1_opponent_self_join j9_score_agreement j11_sensitivity_sweep j12_opponent_actions j13_action_sizes k7_tercile_bins k8_attached_bins l3_merged_shards l3_split_moments l5_split_half_correlations l8_integrity l12_unordered_pair_halves l14_residual_score l15_ranked_names s1_incremental_replay"
).split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want and got


def test_ranks_and_quantiles_from_value_counts(spark):
    rng = random.Random(5)
    rows = [(g, float(rng.choice([1, 1, 1, 2, 7]) if rng.random() < 0.4 else rng.gauss(0, 9) ** 3)) for g in "ab" for _ in range(700)]
    df = spark.createDataFrame(rows, "g string, x double")
    both = stats.with_tie_rank(df, "x", "r", ("g",)).select("g", "x", "r").distinct().collect()
    want = df.withColumn("r", stats.tie_rank("x", ("g",))).distinct().collect()
    assert sorted(map(tuple, both)) == sorted(map(tuple, want))
    shares = {"a": 0.01, "b": 0.333, "c": 0.5, "d": 1.0}
    (got,) = stats.quantiles(df, "x", shares).collect()
    (exact,) = df.agg(*[F.percentile("x", p).alias(k) for k, p in shares.items()]).collect()
    assert all(abs(got[k] - exact[k]) < 1e-9 for k in shares)
    assert stats.with_tie_rank(df.limit(0), "x", "r").count() == 0
    assert [tuple(r) for r in stats.quantiles(df.limit(0), "x", {"p": 0.5}).collect()] == [(None,)]
    one, other = (stats.correlations(df.withColumn("y", F.col("x") % 3), "x", "y", ("g",), many=m).orderBy("g").collect() for m in (True, False))
    assert one == other
