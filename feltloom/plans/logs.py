"""Decision logs rendered from the driver's tables: one hand for each order of two suppliers or more (a deck deals 23 seats and a board), as arrays and as text.

``hands`` gives the arrays that a log holds; ``sections``, ``limit_sections`` and ``transcripts`` write them as the text of three log formats.
Everything follows from md5 of the order key, so that the oracle renders the same hands in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from feltloom.functions import deals
from feltloom.functions.cards import RANKS, SUITS
from feltloom.sources import bindings, parse


#: What 52 cards can deal with five on the board.
SEATS = (52 - 5) // 2


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As many tasks as there are slots, however small the table: what follows is bound by CPU, not by bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    n = bindings.n(spark, sf_dir).where(f"n_players <= {SEATS}").repartition(tasks, "hand_id")
    seats = n.groupBy("hand_id", "nl_level", "day").agg(
        F.sort_array(F.collect_list(F.struct("pos_idx", "player", "site", "saw_hole", "reached_showdown"))).alias("s")
    )
    cloudpickle.register_pickle_by_value(deals)
    schema = to_arrow_schema(_parse_datatype_string(parse.HANDS))
    rendered, most = deals.rendered, deals.ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                yield rendered(b.slice(at, most), schema)

    return seats.select("hand_id", "nl_level", "day", "s").mapInArrow(run, parse.HANDS)


def hands_sql() -> str:
    """CTEs of the same hands, the last one named l."""
    code = lambda t, s: f"(ascii(substr(md5(hand_id || ':' || ({t}) || ':' || ({s})), 32, 1)) % 8)"

    def street(t: int) -> str:
        order = "CASE WHEN n_players > 2 THEN list_concat(generate_series(3, n_players), [1, 2]) ELSE [1, 2] END" if t == 0 else "generate_series(1, n_players)"
        return f"""t{t} AS (SELECT * EXCLUDE (ord), list_transform(ord, lambda s, j: CASE WHEN {code(t, 's')} = 0 AND s <> 1 THEN 'p' || s || ' f' WHEN {code(t, 's')} = 1
            THEN 'p' || s || ' cbr ' || ((nl_level // 100) * 3 * (len(list_filter(ord[:j - 1], lambda x: {code(t, 'x')} = 1)) + {2 if t == 0 else 1})) ELSE 'p' || s || ' cc' END) AS a{t}
            FROM (SELECT *, list_filter({order}, lambda s: folds[s] >= {t}) AS ord FROM {f't{t - 1}' if t else 'lf'}))"""

    return f"""{bindings.N_SQL},
    ls AS (SELECT hand_id, nl_level, day, first(site ORDER BY pos_idx) AS site, count(*)::INTEGER AS n_players, list(player ORDER BY pos_idx) AS players, list(saw_hole ORDER BY pos_idx) AS saw, list(reached_showdown ORDER BY pos_idx) AS showed,
                  (nl_level / 100.0)::DOUBLE AS bb FROM n WHERE n_players <= {SEATS} GROUP BY ALL),
    ld AS (SELECT hand_id, list(('{RANKS}')[(i // 4 + 1)::BIGINT : (i // 4 + 1)::BIGINT] || ('{SUITS}')[(i % 4 + 1)::BIGINT : (i % 4 + 1)::BIGINT] ORDER BY md5(hand_id || ':' || i), i) AS deck FROM ls, generate_series(0, 51) g(i) GROUP BY ALL),
    lf AS (SELECT *, list_transform(generate_series(1, n_players), lambda i: CASE WHEN i = 1 THEN bb / 2 WHEN i = 2 THEN bb ELSE 0.0 END)::DOUBLE[] AS blinds,
                  list_transform(players, lambda p: bb * (20 + substr(p, 2)::BIGINT % 181)) AS starting_stacks,
                  list_transform(generate_series(1, n_players), lambda i: CASE WHEN saw[i] THEN deck[2 * i - 1] || deck[2 * i] ELSE '????' END) AS holes,
                  list_transform(generate_series(1, n_players), lambda i: CASE WHEN i = 1 THEN 9 ELSE coalesce(list_min(list_filter([0, 1, 2, 3], lambda t: {code('t', 'i')} = 0)), 9) END) AS folds FROM ls JOIN ld USING (hand_id)),
    {', '.join(street(t) for t in range(4))},
    l AS (SELECT site, nl_level, hand_id, 'T' || (hand_id::BIGINT % 7) AS "table", greatest(9, n_players)::INTEGER AS seat_count, n_players, players, blinds, starting_stacks,
                 CASE WHEN hand_id::BIGINT % 5 = 0 THEN list_reverse(starting_stacks) ELSE [] END AS finishing_stacks,
                 CASE WHEN hand_id::BIGINT % 5 = 1 THEN list_transform(generate_series(0, n_players - 1), lambda i: CASE WHEN i = hand_id::BIGINT % n_players THEN 1.0 ELSE 0.0 END)::DOUBLE[] ELSE [] END AS winnings,
                 list_concat(list_concat(list_concat(list_transform(generate_series(1, n_players), lambda i: 'd dh p' || i || ' ' || holes[i]), a0), list_concat(['d db ' || deck[2 * n_players + 1] || deck[2 * n_players + 2] || deck[2 * n_players + 3]], a1)),
                             list_concat(list_concat(['d db ' || deck[2 * n_players + 4]], a2), list_concat(list_concat(['d db ' || deck[2 * n_players + 5]], a3),
                             list_transform(list_filter(generate_series(1, n_players), lambda i: showed[i] AND folds[i] = 9), lambda i: 'p' || i || ' sm ' || holes[i])))) AS actions,
                 2009 AS year, 7 AS month, day, '12:00:00' AS "time" FROM t3)"""


# ---------------------------------------------------------------- text


def quoted(items: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def numbers(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items.cast("array<string>"), ", "), F.lit("]"))


def section(fields: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{k} = "), v.cast("string")) for k, v in fields.items()]
    return F.concat_ws("\n", F.concat(F.lit("["), F.col("hand_id"), F.lit("]")), *lines)


def sections(h: DataFrame) -> DataFrame:
    """One section of a cash log for each hand."""
    c = F.col
    text = section(
        {
            "variant": F.lit("'NT'"), "actions": quoted(c("actions")), "players": quoted(c("players")), "blinds_or_straddles": numbers(c("blinds")),
            "starting_stacks": numbers(c("starting_stacks")), "finishing_stacks": numbers(c("finishing_stacks")), "winnings": numbers(c("winnings")),
            "hand": c("hand_id"), "table": F.concat(F.lit("'"), c("table"), F.lit("'")), "seat_count": c("seat_count"), "year": c("year"), "month": c("month"), "day": c("day"), "time": F.lit("'12:00:00'"),
        }
    )
    return h.select("site", "nl_level", "day", text.alias("value"))


def limit_sections(h: DataFrame) -> DataFrame:
    """Fixed-limit sections of the heads-up hands: the big blind's seat first, results in place of finishing stacks."""
    c = F.col
    swapped = F.transform("actions", lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\bp1\b", "p#"), r"\bp2\b", "p1"), "p#", "p2"))
    results = F.transform(F.reverse("starting_stacks"), lambda x, i: F.when(i == 0, c("day").cast("double")).otherwise(-c("day").cast("double")))
    text = section({"variant": F.lit("'FT'"), "players": quoted(F.reverse("players")), "_results": numbers(results), "starting_stacks": numbers(F.reverse("starting_stacks")), "blinds_or_straddles": numbers(F.reverse("blinds")), "actions": quoted(swapped), "hand": c("hand_id")})
    return h.where("n_players = 2").select("hand_id", "day", text.alias("value"))


def transcripts(h: DataFrame) -> DataFrame:
    """Transcripts of the heads-up hands; seat 2 holds the button and is the first player."""
    c = F.col
    name = lambda token: F.when(F.substring(token, 2, 1) == "1", c("players")[0]).otherwise(c("players")[1])

    def line(t: Column, i: Column) -> Column:
        kind, arg = F.split(t, " ")[1], F.element_at(F.split(t, " "), -1)
        n_board = F.size(F.filter(F.slice("actions", 1, i + 1), lambda x: x.startswith("d db")))
        head = F.when(n_board == 1, "*** FLOP *** [").when(n_board == 2, "*** TURN *** [..] [").otherwise("*** RIVER *** [..] [")
        spaced = F.trim(F.regexp_replace(arg, "(..)", "$1 "))
        return (
            F.when(t.startswith("d db"), F.concat(head, spaced, F.lit("]")))
            .when(kind == "f", F.concat(name(t), F.lit(": folds")))
            .when(kind == "cc", F.concat(name(t), F.lit(": calls")))
            .when(kind == "cbr", F.concat(name(t), F.lit(": raises $1 to $"), arg))
        )

    acts = F.filter(F.transform("actions", line), lambda x: x.isNotNull())
    shown = F.transform(F.filter("actions", lambda t: t.startswith("d dh") & ~t.endswith("????")), lambda t: F.concat(name(F.split(t, " ")[2]), F.lit(": shows ["), F.substring(t, -4, 2), F.lit(" "), F.substring(t, -2, 2), F.lit("]")))
    seat = lambda k, i: F.concat(F.lit(f"Seat {k}: "), c("players")[i], F.lit(" ($"), c("starting_stacks")[i].cast("string"), F.lit(" in chips)"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("PokerStars Hand #"), c("hand_id"), F.lit(": Hold'em No Limit ($"), c("blinds")[0].cast("string"), F.lit("/$"), c("blinds")[1].cast("string"), F.lit(" USD)")),
        F.lit("Table 'A' 2-max Seat #2 is the button"),
        seat(1, 1),
        seat(2, 0),
        F.lit("*** HOLE CARDS ***"),
        acts,
        F.lit("*** SHOW DOWN ***"),
        shown,
        F.lit("*** SUMMARY ***"),
        F.lit(""),
    )
    return h.where("n_players = 2").select("day", text.alias("value"))
