"""The driver's tables seen as decision logs: three bindings, each as a DataFrame and as a SQL CTE for the oracles.

N: one row for each participant of a hand, from lineitem and its dimensions.
V: one row for each decision, from events.
M: one row for each decision that shares its hands with N, from lineitem.
Money is whole cents (bigint) up to the last projection, so that sums don't depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.floor(F.col(column) * 100 + 0.5).cast("bigint")


def n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hand_player: one row for each (order, supplier) of orders with two suppliers or more."""
    line = load(spark, sf_dir, "lineitem")
    seats = line.groupBy("l_orderkey", "l_suppkey").agg(
        F.sum(cents("l_extendedprice")).alias("gross_c"),
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("hole"),
        F.max(F.col("l_returnflag").isin("R", "A").cast("int")).alias("shown"),
        F.max((F.col("l_linestatus") == "F").cast("int")).alias("vol"),
    )
    hand = W.partitionBy("l_orderkey")
    seats = seats.withColumns(
        {
            "n_players": F.count("*").over(hand).cast("int"),
            "total_c": F.sum("gross_c").over(hand),
            "pos_idx": (F.row_number().over(hand.orderBy("l_suppkey")) - 1).cast("int"),
        }
    ).where("n_players >= 2")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    where = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    where = where.join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")
    joined = seats.join(orders, seats.l_orderkey == orders.o_orderkey).join(where, seats.l_suppkey == where.s_suppkey)
    net = F.col("n_players") * F.col("gross_c") - F.col("total_c")
    return joined.select(
        F.col("r_name").alias("site"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 100).alias("nl_level"),
        F.col("l_orderkey").cast("string").alias("hand_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("player"),
        "pos_idx",
        "n_players",
        F.col("gross_c").alias("invested_c"),
        net.alias("net_c"),
        (net / F.lit(1000000.0)).alias("net_bb"),
        (F.col("hole") == 1).alias("saw_hole"),
        (F.col("shown") == 1).alias("reached_showdown"),
        (F.col("vol") == 1).alias("vpip"),
        F.when(F.col("hole") == 1, "showdown_eval").when(F.col("shown") == 1, "sd_heuristic").otherwise("uncontested").alias("net_source"),
        (F.pmod(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")), F.lit(26)) + 1).cast("int").alias("day"),
    )


N_SQL = """
n_seats AS (SELECT l_orderkey, l_suppkey, sum(cast(floor(l_extendedprice * 100 + 0.5) AS BIGINT))::BIGINT AS gross_c,
                   bool_or(l_returnflag = 'R') AS saw_hole, bool_or(l_returnflag IN ('R', 'A')) AS reached_showdown, bool_or(l_linestatus = 'F') AS vpip
            FROM lineitem GROUP BY ALL),
n_hands AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey)::INTEGER AS n_players, (sum(gross_c) OVER (PARTITION BY l_orderkey))::BIGINT AS total_c,
                   (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey) - 1)::INTEGER AS pos_idx FROM n_seats),
n AS (SELECT r_name AS site, (left(o_orderpriority, 1)::INTEGER * 100) AS nl_level, l_orderkey::VARCHAR AS hand_id, 'S' || l_suppkey AS player, pos_idx, n_players,
             gross_c AS invested_c, n_players * gross_c - total_c AS net_c, (n_players * gross_c - total_c) / 1000000.0::DOUBLE AS net_bb, saw_hole, reached_showdown, vpip,
             CASE WHEN saw_hole THEN 'showdown_eval' WHEN reached_showdown THEN 'sd_heuristic' ELSE 'uncontested' END AS net_source,
             ((date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 26 + 26) % 26 + 1)::INTEGER AS day
      FROM n_hands JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE n_players >= 2)"""


def v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of event users: state keys s_core (20) and s_fine (80), action a, reward r_c in cents."""
    k, h = F.get_json_object("props", "$.k").cast("int"), F.hour("ts")
    part = lambda x, by: F.floor(x / by).cast("bigint").cast("string")
    r = cents("value") - 2000
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("z"), (F.col("user_id") % 3).cast("string")).alias("site"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("player"),
        F.concat_ws("|", F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string")).alias("hand_id"),
        F.dayofmonth("ts").alias("day"),
        F.col("event_type").alias("a"),
        F.concat(part(k, 20), F.lit("|"), part(h, 6)).alias("s_core"),
        F.concat(part(k, 10), F.lit("|"), part(h, 3)).alias("s_fine"),
        k.alias("k"),
        r.alias("r_c"),
        (r / F.lit(100.0)).alias("reward_bb"),
    )


V_SQL = """
v0 AS (SELECT *, (props->>'$.k')::INTEGER AS k FROM events),
v AS (SELECT event_id, 'z' || (user_id % 3) AS site, 'U' || user_id AS player, user_id || '|' || day(ts) AS hand_id, day(ts)::INTEGER AS day, event_type AS a,
             floor(k / 20)::BIGINT || '|' || floor(hour(ts) / 6)::BIGINT AS s_core, floor(k / 10)::BIGINT || '|' || floor(hour(ts) / 3)::BIGINT AS s_fine, k,
             cast(floor(value * 100 + 0.5) AS BIGINT) - 2000 AS r_c, (cast(floor(value * 100 + 0.5) AS BIGINT) - 2000) / 100.0::DOUBLE AS reward_bb FROM v0)"""


def m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that share hands with N: 40 states, 9 actions."""
    whole = lambda x: F.floor(x).cast("bigint")
    r = cents("l_extendedprice") - 3000000
    return load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("player"),
        F.col("l_orderkey").cast("string").alias("hand_id"),
        F.concat_ws("|", whole((F.col("l_quantity") - 1) / 10).cast("string"), (whole(F.col("l_discount") * 100 + 0.5) % 4).cast("string"), "l_linestatus").alias("s_core"),
        F.concat(F.col("l_returnflag"), (whole(F.col("l_tax") * 100 + 0.5) % 3).cast("string")).alias("a"),
        F.col("l_quantity").alias("size"),
        r.alias("r_c"),
        (r / F.lit(100.0)).alias("reward_bb"),
    )


M_SQL = """
m AS (SELECT 'S' || l_suppkey AS player, l_orderkey::VARCHAR AS hand_id,
             floor((l_quantity - 1) / 10)::BIGINT || '|' || (floor(l_discount * 100 + 0.5)::BIGINT % 4) || '|' || l_linestatus AS s_core,
             l_returnflag || (floor(l_tax * 100 + 0.5)::BIGINT % 3) AS a, l_quantity AS size,
             cast(floor(l_extendedprice * 100 + 0.5) AS BIGINT) - 3000000 AS r_c, (cast(floor(l_extendedprice * 100 + 0.5) AS BIGINT) - 3000000) / 100.0::DOUBLE AS reward_bb
      FROM lineitem)"""
