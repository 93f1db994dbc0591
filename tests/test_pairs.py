"""Pairs of a hand, grids of settings and merged states against plain Python and against one setting at a time."""

import random
from collections import Counter

from pyspark.sql import functions as F

from feltloom.functions import stats
from feltloom.operators import pairs, profile, reliability
from feltloom.sources.scratch import folder

ROWS = "site string, hand_id string, player string, net_c bigint"
DECISIONS = "hand_id string, player string, s_core string, a string, r_c bigint"


def hands(seed, n=60, least=2):
    rng = random.Random(seed)
    rows, made = [], []
    for h in range(n):
        for p in rng.sample("abcdef", rng.randint(least, 4)):
            rows.append(("x", f"h{h}", p, rng.choice([None, *range(-5, 6)])))
            made += [(f"h{h}", p, rng.choice("st"), rng.choice(["A1", "A2", "R1"]), rng.choice([None, *range(-9, 10)])) for _ in range(rng.randint(0, 6))]
    return rows, made


def test_pairs_within_the_hand(spark):
    rows, made = hands(1, least=1)
    rows += [rows[0], ("x", None, "a", 1), ("x", None, "b", 2), ("x", "h1", None, 3), ("x", "alone", "a", 4)]
    made += [(None, "a", "s", "A1", 1), ("h1", None, "s", "A1", 1), ("nobody", "a", "s", "A1", 1), made[0]]
    seats, d = spark.createDataFrame(rows, ROWS), spark.createDataFrame(made, DECISIONS)
    at = {}
    for _, h, p, _ in rows:
        if h and p:
            at.setdefault(h, set()).add(p)
    want = Counter((h, "x", p, net, o) for _, h, p, net in rows if h and p for o in at[h] - {p})
    met = pairs.meetings(seats)
    assert met.columns == ["hand_id", "site", "player", "net_c", "opponent"] and Counter(map(tuple, met.collect())) == want
    want = Counter((*r, o) for r in made if r[0] and r[1] for o in at.get(r[0], set()) - {r[1]})
    assert Counter(map(tuple, pairs.faced(seats, d).collect())) == want
    assert pairs.meetings(seats.limit(0)).count() == pairs.faced(seats.limit(0), d).count() == pairs.faced(seats, d.limit(0)).count() == 0
    for plan in (met, pairs.faced(seats, d)):
        assert "Join" not in plan._jdf.queryExecution().toString()


def test_a_grid_is_its_settings(spark):
    rows, made = hands(2, 300)
    seats, d = spark.createDataFrame(rows, ROWS), spark.createDataFrame(made, DECISIONS).withColumn("a_base", F.substring("a", 1, 1))
    d = d.withColumn("one", F.lit("z")).unionByName(d.limit(1).select("hand_id", "player", F.lit(None).cast("string").alias("s_core"), F.lit(None).cast("string").alias("a"), "r_c", "a_base", F.lit("z").alias("one")))
    grid = [("s_core", 2, "a"), ("s_core", 30, "a"), ("one", 2, "a_base"), ("s_core", 10**6, "a")]
    got = {tuple(r[:3]): tuple(r[3:]) for r in pairs.sweep(seats, d, grid, 5).collect()}
    assert len(got) == 4 and got[grid[3]] == (0, None, None) and got[grid[0]][0] > 0
    for state, nmin, action in grid:
        one = pairs.evaluated(seats, d, nmin, 5, state=state, action=action).withColumns({c: F.round(c, 9) for c in ("score", "actual")})
        (want,) = stats.correlations(one, "score", "actual").collect()
        assert got[state, nmin, action] == (want.n, want.pearson, want.spearman)


def test_states_of_shards_merge_to_one_run(spark):
    rows, _ = hands(3, 80)
    rows += [("x", "h0", "a", 3 * 10**9), ("x", "h0", "b", None)]
    seats = spark.createDataFrame(rows, ROWS).withColumn("shard", F.substring("hand_id", -1, 1).cast("int"))
    path = folder(spark, "moments-test")
    for part in ("shard < 4", "shard >= 4", "shard < 2"):
        reliability.keep_state(seats.where(part), path, "shard")
    got = sorted(map(tuple, reliability.merged(spark.read.parquet(path)).collect()), key=repr)
    assert got == sorted(map(tuple, reliability.split_moments(seats).collect()), key=repr) and got
    own = seats.withColumn("split", reliability.half(F.concat_ws(":", "site", "hand_id")))
    one = [("player", r.player, None, r.split, r.n, r.s, r.ss) for r in reliability.moments(own, ("player", "split")).collect()]
    two = [("pair", *r) for r in reliability.moments(pairs.meetings(own), ("player", "opponent", "split")).collect()]
    assert got == sorted(one + two, key=repr)


def test_ranked_names(spark):
    rng = random.Random(4)
    rows = [(f"p{i}", rng.choice([0.5, -1.0, rng.random()])) for i in range(300)]
    df = spark.createDataFrame([*rows, ("none", None)], "player string, residual double")
    want = [p for p, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [tuple(r) for r in reliability.ranked_names(df).collect()] == list(enumerate(want, 1))
    assert [r.player for r in reliability.ranked_names(df, top=5).collect()] == want[:5]
    assert reliability.ranked_names(df.limit(0)).count() == 0


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(5)
    values = [int(rng.paretovariate(0.7)) for _ in range(60000)]
    df = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)] + [(0, None)], "shard int, x bigint")
    got = profile.sketched_quantiles(profile.value_sketch(df, "x", ("shard",))).first()
    order = sorted(values)
    for name, p in profile.QUANTILES.items():
        low, high = order[int((p - 0.02) * len(order))], order[min(int((p + 0.02) * len(order)), len(order) - 1)]
        assert low <= got[name] <= high
    assert (got["min"], got["max"]) == (order[0], order[-1]) and abs(got["mean"] - sum(values) / len(values)) < 1e-6 * got["mean"]
    shards = profile.distinct_sketch(df.withColumn("y", F.col("x") % 5), ("x", "y"), ("shard",))
    many = profile.sketched_distinct(shards, ("x", "y")).first()
    assert many.n_y == 5 and abs(many.n_x / len(set(values)) - 1) < 0.04
    assert tuple(profile.sketched_distinct(shards.limit(0), ("x", "y")).first()) == (0, 0)
    assert set(profile.sketched_quantiles(profile.value_sketch(df.limit(0), "x")).first()) == {None}


def test_size_sketches_of_cells(spark):
    rng = random.Random(6)
    seats = spark.createDataFrame([("x", "h", p, 0) for p in "ab"], ROWS)
    values = {("s", "A1"): [rng.lognormvariate(0, 2) for _ in range(20000)], ("t", "R1"): [3.0, 1.0, 2.0, 2.0], ("t", "C1"): [5.0]}
    made = [("h", "a", s, a, x) for (s, a), xs in values.items() for x in xs] + [("h", "a", "t", "R1", None), ("h", "a", "t", "R1", float("nan"))]
    d = spark.createDataFrame(made, "hand_id string, player string, s_core string, a string, size double")
    one, two = (pairs.size_sketches(seats, d.where(part), ("A", "R")) for part in ("size < 1", "NOT size < 1"))
    shares = {"low": 0.1, "mid": 0.5, "high": 0.9}
    got = {(r.s, r.a): r for r in pairs.size_quantiles(one.union(two), shares).collect()}
    assert set(got) == {("s", "A1"), ("t", "R1")} and {(r.player, r.opponent) for r in got.values()} == {("a", "b")}
    for cell, r in got.items():
        order = sorted(values[cell])
        assert (r.n, r.min, r.max) == (len(order), order[0], order[-1])
        for name, p in shares.items():
            low, high = int((p - 0.02) * len(order)) - 1, int((p + 0.02) * len(order)) + 1
            assert order[max(low, 0)] <= r[name] <= order[min(high, len(order) - 1)]
    assert pairs.size_quantiles(one.limit(0), shares).count() == 0
