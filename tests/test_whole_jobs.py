"""Queries do the whole job of their operators."""

import pathlib

from pyspark.sql import functions as F

from feltloom.operators import ranges, reliability, texture
from feltloom.plans import base, ledger, pairs, sources
from feltloom.sources import layout, parse

SF = "/root/testdata/sf0.001"


def test_dynamicness_runs_with_the_operators_own_samples(spark, monkeypatch):
    flops = spark.createDataFrame([("k", "2c7dKh")], "key string, flop string")
    given = []
    monkeypatch.setattr(ledger, "classes", lambda *_: flops)
    monkeypatch.setattr(texture, "dynamicness", lambda _, rows, **how: given.append(how) or rows)
    base.QUERIES["g5_dynamicness"](spark, "")
    assert given == [{}]


HAND = "hand_id string, site string, nl_level int, `table` string, seat_count int, players array<string>, blinds array<double>, starting_stacks array<double>, finishing_stacks array<double>, winnings array<double>, actions array<string>, year int, month int, day int"


def test_every_hand_is_a_file_of_its_own(spark, monkeypatch):
    ids = [1, 2, 39, 40, 41, 80]
    rows = [(str(i), "S", 200, "T", 2, ["a", f"b{i}"], [1.0, 2.0], [100.0, 100.0], [], [], ["p1 f"] * (i % 3 + 1), 2009, 7, 1) for i in ids]
    monkeypatch.setattr(sources, "hands", lambda *_: spark.createDataFrame(rows, HAND))
    got = base.QUERIES["a7_one_hand_files"](spark, "whole-jobs").collect()
    assert sorted(tuple(r) for r in got) == sorted((f"f={i}/{i}", 200, 2, f"a,b{i}", i % 3 + 1) for i in ids)


FEATURES = "ctx string, board string, hole_class string, h_bin string, w_bin string, d_bin string"


def test_known_bins_are_attached_and_unknown_ones_are_mid(spark, monkeypatch):
    rows = spark.createDataFrame([("x", "b", c, f"s{c}") for c in ("C4", "C5", "C6")], "ctx string, board string, hole_class string, s_fine string")
    known = spark.createDataFrame([("x", "b", "C4", "low", "high", "low"), ("x", "b", "C5", "high", "low", "high")], FEATURES)
    monkeypatch.setattr(pairs, "_source", lambda *_: rows)
    monkeypatch.setattr(ranges, "features", lambda _: known)
    got = {r.s_range: r.n for r in base.QUERIES["k8_attached_bins"](spark, "").collect()}
    assert got == {"sC4|Hq=low|W=high|D=low": 1, "sC5|Hq=high|W=low|D=high": 1, "sC6|Hq=mid|W=mid|D=mid": 1}


def test_every_player_is_ranked(spark):
    scores = [(f"p{i:02}", float(-(i // 2)), 0.0) for i in range(45)]
    rows = spark.createDataFrame(scores[::-1], "player string, residual double, actual double")
    got = reliability.ranked_names(rows)
    assert [tuple(r) for r in got.collect()] == [(i + 1, p) for i, (p, *_) in enumerate(scores)]
    assert [r.player for r in reliability.ranked_names(rows, top=3).collect()] == ["p00", "p01", "p02"]


def test_halves_in_natural_order_without_one_task_for_all(spark):
    rows = [(f"d{i % 3}", f"h{i}" if i % 10 else f"x{i % 20}y") for i in range(401)]
    files = spark.createDataFrame(rows, "d string, s string").repartition(5)
    out = parse.natural_halves(files, F.col("d"), F.col("s"))
    order = sorted(rows, key=lambda r: (r[0], int("".join(c for c in r[1] if c.isdigit())), r[1]))
    want = sorted((*r, 1 if i < len(rows) // 2 else 2) for i, r in enumerate(order))
    assert sorted(tuple(r) for r in out.collect()) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_d" not in plan


def test_a_query_makes_no_more_of_the_replay_than_it_shows(spark, monkeypatch):
    made = []
    kept = ledger.kept
    monkeypatch.setattr(ledger, "kept", lambda spark, d, name, make: made.append(name) or kept(spark, d, name, make))
    monkeypatch.setattr(ledger, "has", lambda *_: False)
    for name in ("b8_action_faced", "b11_to_act_after", "b14_active_before", "b15_resolved_action", "b23_forward_reward", "c5_sized_action", "c7_state_keys", "c8_chosen_state", "c13_flop_prefix"):
        base.QUERIES[name](spark, SF).schema
    assert set(made) == {"hands"}


def test_boards_need_no_replay(spark, monkeypatch):
    made = []
    monkeypatch.setattr(ledger, "kept", lambda spark, d, name, make: made.append(name) or make())
    for name in ("b27_card_split", "g1_flop_combinations", "g3_class_representatives", "g6_observed_flops"):
        base.QUERIES[name](spark, SF).schema
    assert set(made) == {"hands"}
    rows = [(["p1 cc", "d db 2c3c4d", "d dh p1 AhAd", "d db ", "d db 9h"],), (["p1 f"],), ([None, "d db Kd\n"],)]
    got = spark.createDataFrame(rows, "actions array<string>").select(ledger.ledger.board(F.col("actions")).alias("b"))
    assert sorted(r.b for r in got.collect()) == ["", "2c3c4d9h", "Kd\n"]


def test_one_hand_files_lie_on_disk_some_at_a_time(spark, monkeypatch):
    """Every hand is read from a file of its own; of 90 hands no more than a part are there at once, and none afterwards."""
    rows = [(str(i), "S", 200, "T", 2, ["a", f"b{i}"], [1.0, 2.0], [100.0, 100.0], [], [], ["p1 f"], 2009, 7, 1) for i in range(90)]
    monkeypatch.setattr(sources, "hands", lambda *_: spark.createDataFrame(rows, HAND))
    there, reader = [], parse.one_hand_files

    def counted(spark, path):
        found = reader(spark, path)
        there.append(path)
        sizes.append(found.count())
        return found

    sizes = []
    monkeypatch.setattr(parse, "one_hand_files", counted)
    got = sources._one_hand(spark, "whole-jobs", most=30)
    assert sorted(r.hand_id for r in got.collect()) == sorted(f"f={i}/{i}" for i in range(90))
    assert len(sizes) == 3 and sum(sizes) == 90 and max(sizes) < 60
    assert not any(pathlib.Path(p.removeprefix("file://")).exists() for p in there)


def test_decisions_by_street_are_written_once(spark, tmp_path, monkeypatch):
    made, settings = [], []
    kept, written = ledger.kept, layout.partitioned
    monkeypatch.setattr(ledger, "kept", lambda spark, d, name, make: made.append(name) or kept(spark, d, name, make))
    monkeypatch.setattr(ledger, "has", lambda *_: False)
    monkeypatch.setattr(layout, "partitioned", lambda rows, path, *by: settings.append(rows.columns) or written(rows, path, *by))
    base.QUERIES["a21_enriched_by_street"](spark, SF).collect()
    assert set(made) == {"hands"} and len(settings[0]) > 30
    rows = spark.range(1000).selectExpr("id % 4 AS street", "id")
    layout.partitioned(rows, f"file://{tmp_path}/t", "street")
    assert spark.read.parquet(f"file://{tmp_path}/t").groupBy("street").count().where("count = 250").count() == 4
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) in (None, "0")
