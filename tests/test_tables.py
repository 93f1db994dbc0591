"""Sampling before reading, batches committed as one, and the layout of tables."""

import pytest

from feltloom.operators import ledger
from feltloom.sources import layout, parse
from feltloom.streaming import incremental
from tests.test_ledger import HANDS, hand


def test_a_sample_of_files_is_all_that_is_read(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"d{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"d{i % 3}" / f"{i:02}.phhs").write_text(f"[{i}]\nhand = {i}\n" * (50 if i == 19 else 1 + i % 2))
    names = sorted(str(p) for p in tmp_path.rglob("*.phhs"))
    kept = lambda df: sorted(x.removeprefix("file://") for x in df.inputFiles())
    read = lambda **how: parse.sampled_blocks(spark, str(tmp_path), **how)
    assert kept(read(first=3)) == names[:3] and kept(read(spread=5)) == names[::4] and kept(read(spread=5, first=9)) == names[:9:4] and kept(read()) == names
    small = [n for n in names if not n.endswith("/19.phhs")]
    assert kept(read(largest=100)) == small and kept(read(largest=100, first=100)) == small
    files = read(first=2)
    assert {r.file.split("/")[-1] for r in files.select("file").distinct().collect()} == {n.split("/")[-1] for n in names[:2]}
    assert "Location: InMemoryFileIndex(2 paths)" in files._jdf.queryExecution().toString()
    assert read(largest=0).count() == 0
    listed = parse.listed(spark, str(tmp_path))
    assert "ReadSchema: struct<path:string,length:bigint>" in listed._jdf.queryExecution().toString() and listed.count() == 20


def test_a_batch_is_read_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = lambda *ids: spark.createDataFrame([(*hand(["p1 cc", "p2 cc"])[:2], str(i), *hand(["p1 cc", "p2 cc"])[3:]) for i in ids], HANDS).coalesce(1)
    rows(1, 2).write.parquet(source)
    found = lambda: {n: sorted(r.hand_id for r in incremental.read(spark, out, n).select("hand_id").distinct().collect()) for n in incremental.TABLES}
    incremental.run(spark, source, out, state)
    columns = incremental.read(spark, out, "hand_player").columns
    assert found() == dict.fromkeys(incremental.TABLES, ["1", "2"])

    def dies(done):
        raise RuntimeError("lost between the writes")

    monkeypatch.setitem(incremental.TABLES, "hand_player", dies)
    rows(3).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost between the writes"):
        incremental.run(spark, source, out, state)
    monkeypatch.setitem(incremental.TABLES, "hand_player", ledger.hand_player)
    assert spark.read.parquet(f"{out}/decisions").where("hand_id = '3'").count() == 2  # written, not committed
    assert found() == dict.fromkeys(incremental.TABLES, ["1", "2"])
    for _ in range(2):
        incremental.run(spark, source, out, state)
        assert found() == dict.fromkeys(incremental.TABLES, ["1", "2", "3"])
        assert incremental.read(spark, out, "hand_player").count() == 9 and incremental.read(spark, out, "decisions").count() == 6
    # A batch that is committed but not ticked off comes again and changes nothing.
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    incremental.run(spark, source, out, state)
    assert incremental.read(spark, out, "hand_player").count() == 9
    empty = str(tmp_path / "none")
    spark.createDataFrame([], HANDS).write.parquet(f"{empty}-in")
    incremental.run(spark, f"{empty}-in", empty, f"{empty}-state")
    assert incremental.read(spark, empty, "hand_player").columns == columns and incremental.read(spark, empty, "hand_player").count() == 0


def test_partitions_are_replaced_one_by_one_and_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    layout.partitioned(spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2)], "x int, street int"), path, "street")
    layout.partitioned(spark.createDataFrame([(9, 1)], "x int, street int"), path, "street")
    rows = spark.read.parquet(path)
    assert sorted(map(tuple, rows.select("x", "street").collect())) == [(1, 0), (2, 0), (4, 2), (9, 1)]
    plan = rows.where("street = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(street" in plan and len(rows.where("street = 1").inputFiles()) >= 1


def test_buckets_are_joined_without_a_shuffle(spark):
    one = layout.bucketed(spark.range(2000).selectExpr("concat('s', id % 3) site", "concat('p', id % 50) player", "id hand_id"), "one", 8, "site", "player")
    two = layout.bucketed(spark.range(900).selectExpr("concat('s', id % 3) site", "concat('p', id % 40) player", "id % 2 = 0 vpip"), "two", 8, "site", "player")
    df = layout.joined_counts(one, two)
    rows = {(r.site, r.player): (r.decisions, r.hands, r.vpip) for r in df.collect()}
    assert sum(v[1] for v in rows.values()) == 900 and sum(v[2] for v in rows.values()) == 450
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
