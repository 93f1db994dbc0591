"""Queries over the readers and sinks: A1 to A22. Hands are rendered as log text, written to the shared folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from feltloom.plans import ledger_sql as q
from feltloom.plans.base import query
from feltloom.plans.ledger import decisions, hands, kept, seats, stamp
from feltloom.plans.profile import COUNTS
from feltloom.operators import profile
from feltloom.operators.ledger import DECIDED
from feltloom.plans import logs
from feltloom.sources import bindings, layout, parse
from feltloom.sources.scratch import folder, remove_files, write_files

H = q.HANDS


def _text(spark, d, name: str, make, *by: str) -> str:
    """The folder of a rendered log, written once for each session and input."""
    key = (spark.sparkContext.applicationId, d, stamp(spark, d), f"text-{name}")
    if key not in _texts:
        path = folder(spark, name)
        # Many small files: tasks move their own into place, as the driver would take them one by one.
        writer = make(hands(spark, d)).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        (writer.partitionBy(*by) if by else writer).text(path)
        _texts[key] = path
    return _texts[key]


_texts: dict[tuple, str] = {}


def sections(spark, d):
    def make(h):
        rows = logs.sections(h)
        place = F.concat(F.regexp_replace("site", " ", ""), F.lit("-2009"))
        return rows.select(place.alias("table"), F.concat(F.lit("x_"), F.col("nl_level").cast("string"), F.lit("NLH_OBFU")).alias("level"), "value")

    return parse.blocks(spark, _text(spark, d, "sections", make, "table", "level"))


def cash(spark, d):
    return kept(spark, d, "cash", lambda: parse.cash_hands(sections(spark, d)))


def limit(spark, d):
    return parse.blocks(spark, _text(spark, d, "limit", lambda h: logs.limit_sections(h).select("value")))


def transcripts(spark, d):
    def make(h):
        rows = logs.transcripts(h)
        return rows.select(F.col("day"), "value")

    return parse.transcript_blocks(spark, _text(spark, d, "transcripts", make, "day"))


def flat(name: str) -> str:
    return f"list_aggregate({name}, 'string_agg', ',')"


def joined(c: str):
    return F.when(F.size(c) > 0, F.array_join(F.col(c).cast("array<string>"), ","))


@query("a1_section_blocks", f"{H} SELECT hand_id, 14 AS n_fields, nl_level::VARCHAR AS lvl FROM l")
def _(spark, d):
    kv = sections(spark, d)
    return kv.select(parse.unquoted(parse.value("hand")).alias("hand_id"), F.size("kv").alias("n_fields"), parse.level_of(F.col("file")).cast("string").alias("lvl"))


@query("a2_quoted_lists", f"{H} SELECT hand_id, {flat('players')} AS players, len(actions)::INTEGER AS n_actions, actions[len(actions)] AS last FROM l")
def _(spark, d):
    rows = sections(spark, d).select(parse.unquoted(parse.value("hand")).alias("hand_id"), parse.strings(parse.value("players")).alias("p"), parse.strings(parse.value("actions")).alias("a"))
    return rows.select("hand_id", F.array_join("p", ",").alias("players"), F.size("a").alias("n_actions"), F.element_at("a", -1).alias("last"))


@query("a3_number_lists", f"{H} SELECT hand_id, round(list_sum(blinds), 6) AS blinds, round(list_sum(starting_stacks), 6) AS stacks, round(coalesce(list_sum(winnings), 0), 6) AS winnings FROM l")
def _(spark, d):
    total = lambda k: F.round(F.aggregate(parse.numbers(parse.value(k)), F.lit(0.0), lambda a, x: a + x), 6)
    return sections(spark, d).select(parse.unquoted(parse.value("hand")).alias("hand_id"), total("blinds_or_straddles").alias("blinds"), total("starting_stacks").alias("stacks"), total("winnings").alias("winnings"))


@query("a4_path_metadata", f"{H} SELECT 'table=' || replace(site, ' ', '') AS site, nl_level, count(*) AS n FROM l GROUP BY ALL")
def _(spark, d):
    return sections(spark, d).groupBy(parse.site_of(F.col("file")).alias("site"), parse.level_of(F.col("file")).alias("nl_level")).agg(F.count("*").alias("n"))


HAND = f"hand_id, \"table\", seat_count, n_players, {flat('players')} AS players, list_sum(starting_stacks)::DOUBLE AS stacks, len(actions)::INTEGER AS n_actions, year, month, day, \"time\""


@query("a5_cash_hands", f"{H} SELECT 'table=' || replace(site, ' ', '') AS site, nl_level, {HAND} FROM l")
def _(spark, d):
    return cash(spark, d).select("site", "nl_level", "hand_id", "table", "seat_count", "n_players", F.array_join("players", ",").alias("players"), F.aggregate("starting_stacks", F.lit(0.0), lambda a, x: a + x).alias("stacks"), F.size("actions").alias("n_actions"), "year", "month", "day", "time")


@query("a6_balanced_scan", f"{H} SELECT count(*) AS hands, sum(len(actions))::BIGINT AS actions FROM l")
def _(spark, d):
    """Files of any size are cut and packed into even splits by the reader (spark.sql.files.maxPartitionBytes)."""
    return cash(spark, d).agg(F.count("*").alias("hands"), F.sum(F.size("actions")).alias("actions"))


#: Single-hand files that lie on disk at a time: a file and its folder take two blocks, whatever the hand's length.
FILES = 50_000


def _one_hand(spark, d, most: int = FILES):
    """A file for each hand, below one of three folders. Some of the files at a time are written, read and removed, so that the disk holds the hands read and no more than these files."""
    number = F.regexp_extract("value", r"(?m)^hand = (\d+)$", 1)
    read = folder(spark, "one-hand-read")
    every = hands(spark, d)
    parts = max(1, -(-every.count() // most))
    for part in range(parts):
        path = folder(spark, "one-hand")
        some = every.where(F.pmod(F.xxhash64("hand_id"), F.lit(parts)) == part)
        rows = logs.sections(some).select(F.concat(F.lit("d=dir"), (number.cast("bigint") % 3).cast("string"), F.lit("/f="), number, F.lit("/hand.txt")).alias("name"), "value")
        if not write_files(rows, path):
            continue
        with layout.small_files(spark):
            parse.one_hand_files(spark, path).write.mode("append").option("compression", "zstd").parquet(read)
        remove_files(rows, path)
    return spark.read.schema(parse.HANDS).parquet(read)


@query("a7_one_hand_files", f"{H} SELECT 'f=' || hand_id || '/' || hand_id AS hand_id, nl_level, n_players, {flat('players')} AS players, len(actions)::INTEGER AS n_actions FROM l")
def _(spark, d):
    """A reader for sets of single-hand files; every hand is such a file here."""
    rows = _one_hand(spark, d)
    return rows.select("hand_id", "nl_level", "n_players", F.array_join("players", ",").alias("players"), F.size("actions").alias("n_actions"))


@query("a8_natural_halves", f"{H} SELECT hand_id, CASE WHEN row_number() OVER (ORDER BY site, hand_id::BIGINT, hand_id) - 1 < (SELECT count(*) FROM l) // 2 THEN 1 ELSE 2 END AS day FROM l")
def _(spark, d):
    files = hands(spark, d).select("site", "hand_id")
    return parse.natural_halves(files, F.col("site"), F.concat(F.lit("h"), F.col("hand_id"))).select("hand_id", "day")


TWO = "l WHERE n_players = 2"


@query("a9_transcript_blocks", f"{H} SELECT hand_id, dense_rank() OVER (ORDER BY day::VARCHAR)::INTEGER AS day FROM {TWO}")
def _(spark, d):
    """Days are ordinals of files; here a folder for each day, so that the files of a day sort together."""
    rows = transcripts(spark, d).select(F.regexp_extract("block", r"^(\d+)", 1).alias("hand_id"), F.regexp_extract("file", r"day=(\d+)", 1).alias("k"))
    ordinal = rows.select("k").distinct().withColumn("day", F.dense_rank().over(parse.W.orderBy("k")))
    return rows.join(ordinal, "k").select("hand_id", "day")


def _played_two(spark, d):
    return kept(spark, d, "transcript-hands", lambda: parse.transcript_hands(transcripts(spark, d)))


@query("a10_transcript_headers", f"{H} SELECT hand_id, nl_level, {flat('players')} AS players, starting_stacks[1] AS stack_1, starting_stacks[2] AS stack_2, blinds[1] AS sb FROM {TWO}")
def _(spark, d):
    rows = _played_two(spark, d)
    return rows.select("hand_id", "nl_level", F.array_join("players", ",").alias("players"), F.col("starting_stacks")[0].alias("stack_1"), F.col("starting_stacks")[1].alias("stack_2"), F.col("blinds")[0].alias("sb"))


@query("a11_shown_cards", f"{H} SELECT hand_id, actions[1] AS first, actions[2] AS second FROM {TWO}")
def _(spark, d):
    return _played_two(spark, d).select("hand_id", F.col("actions")[0].alias("first"), F.col("actions")[1].alias("second"))


@query("a12_board_tokens", f"{H} SELECT hand_id, list_aggregate(list_filter(actions, lambda x: starts_with(x, 'd db')), 'string_agg', ',') AS boards FROM {TWO}")
def _(spark, d):
    return _played_two(spark, d).select("hand_id", F.array_join(F.filter("actions", lambda x: x.startswith("d db")), ",").alias("boards"))


@query("a13_action_grammar", f"{H}, t AS (SELECT unnest(actions) AS tok FROM {TWO}) SELECT string_split(tok, ' ')[2] AS verb, count(*) AS n FROM t WHERE NOT starts_with(tok, 'd ') AND NOT contains(tok, ' sm ') GROUP BY ALL")
def _(spark, d):
    tok = _played_two(spark, d).select(F.explode("actions").alias("tok")).where(~F.col("tok").startswith("d "))
    return tok.groupBy(F.split("tok", " ")[1].alias("verb")).agg(F.count("*").alias("n"))


@query("a14_reassembled_tokens", f"{H} SELECT hand_id, list_aggregate(list_filter(actions, lambda x: NOT contains(x, ' sm ')), 'string_agg', ',') AS actions FROM {TWO}")
def _(spark, d):
    return _played_two(spark, d).select("hand_id", F.array_join("actions", ",").alias("actions"))


@query("a15_fixed_limit_hands", f"{H} SELECT hand_id, nl_level, {flat('players')} AS players, starting_stacks[1] - day AS finish_1, starting_stacks[2] + day AS finish_2, {flat('actions')} AS actions FROM {TWO}")
def _(spark, d):
    rows = parse.limit_hands(limit(spark, d))
    return rows.select("hand_id", "nl_level", F.array_join("players", ",").alias("players"), F.col("finishing_stacks")[0].alias("finish_1"), F.col("finishing_stacks")[1].alias("finish_2"), F.array_join("actions", ",").alias("actions"))


@query(
    "a16_sampled_files",
    f"""{H}, f AS (SELECT DISTINCT day::VARCHAR AS file FROM l), p AS (SELECT file, row_number() OVER (ORDER BY file) - 1 AS i, count(*) OVER () AS n FROM f)
    SELECT 'spread' AS mode, file AS name FROM p WHERE i % greatest(1, n // 5) = 0 AND i // greatest(1, n // 5) < 5 UNION ALL SELECT 'first', file FROM p WHERE i < 3
    UNION ALL SELECT 'hands', hand_id FROM (SELECT hand_id FROM l ORDER BY day, hand_id LIMIT 100)""",
)
def _(spark, d):
    """Sampling operators: the days of every step-th file, five of them, and of the first three, each as read from those files alone; the first hundred hands."""

    def make(h):
        # A file for each day: all its hands go to one task.
        return logs.sections(h).repartition("day").select("day", "value")

    path = _text(spark, d, "days", make, "day")
    named = lambda mode, df, c: df.select(F.lit(mode).alias("mode"), F.col(c).alias("name"))
    day = F.regexp_extract("file", "/day=([^/]+)/", 1)
    read = lambda **how: parse.sampled_blocks(spark, path, **how).select(day.alias("day")).distinct()
    hundred = parse.first_hands(hands(spark, d), 100, "day", "hand_id")
    return named("spread", read(spread=5), "day").union(named("first", read(first=3), "day")).union(named("hands", hundred, "hand_id"))


@query("a17_results_only", f"{H} SELECT hand_id, {flat('list_reverse(players)')} AS players, day::DOUBLE AS r1, -day::DOUBLE AS r2 FROM {TWO}")
def _(spark, d):
    rows = parse.results_only(limit(spark, d))
    return rows.select("hand_id", F.array_join("players", ",").alias("players"), F.col("results")[0].alias("r1"), F.col("results")[1].alias("r2"))


@query("a18_parquet_sink", f"WITH {bindings.N_SQL} SELECT site, count(*) AS n, sum(net_c)::BIGINT AS net_c FROM n GROUP BY ALL")
def _(spark, d):
    rows = kept(spark, d, "sink", lambda: bindings.n(spark, d))
    return rows.groupBy("site").agg(F.count("*").alias("n"), F.sum("net_c").alias("net_c"))


@query("a19_parquet_glob", f"WITH {bindings.V_SQL} SELECT a, count(*) AS n FROM v GROUP BY ALL")
def _(spark, d):
    path = folder(spark, "glob")
    bindings.v(spark, d).write.partitionBy("site").parquet(path)
    return spark.read.parquet(f"{path}/site=*").groupBy("a").agg(F.count("*").alias("n"))


@query("a20_resumable_shards", f"WITH {bindings.V_SQL} SELECT day, count(*) AS n, sum(r_c)::BIGINT AS r_c FROM v GROUP BY ALL")
def _(spark, d):
    """A stream over shards that is stopped and run again: shards done are not taken twice."""
    source, out, state = (folder(spark, x) for x in ("shards", "shards-out", "shards-state"))
    v = bindings.v(spark, d).select("day", "r_c")
    for part in (0, 1):
        v.where(F.col("day") % 2 == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(v.schema).parquet(source).writeStream.option("checkpointLocation", state)
        stream.format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("day").agg(F.count("*").alias("n"), F.sum("r_c").alias("r_c"))


@query("a21_persisted_table", f"WITH {bindings.V_SQL} SELECT s_core, count(*) AS n FROM v GROUP BY ALL")
def _(spark, d):
    """A table that is written as a whole, then replaced partition by partition, and read back."""
    path = folder(spark, "table")
    rows = bindings.v(spark, d)
    layout.partitioned(rows, path, "a")
    layout.partitioned(rows.where("a = 'check'"), path, "a")
    return spark.read.parquet(path).groupBy("s_core").agg(F.count("*").alias("n"))


@query("a21_enriched_by_street", f"{q.ALL} SELECT action_faced, act, count(*) AS n, round(sum(act_to_bb), 3) AS act_to_bb FROM dec WHERE street = 1 GROUP BY ALL")
def _(spark, d):
    """The enriched decisions by street: a query on one street reads no other."""
    path = folder(spark, "by-street")
    layout.partitioned(decisions(spark, d, *DECIDED), path, "street")
    rows = spark.read.parquet(path).where("street = 1")
    return rows.groupBy("action_faced", "act").agg(F.count("*").alias("n"), F.round(F.sum(F.round("act_to_bb", 6)), 3).alias("act_to_bb"))


@query(
    "a18_bucketed_join",
    f"""{q.ALL}, a AS (SELECT site, player, count(*) AS decisions FROM dec GROUP BY ALL), b AS (SELECT site, player, count(*) AS hands, sum(vpip::INT)::BIGINT AS vpip FROM hpl GROUP BY ALL)
    SELECT * FROM a JOIN b USING (site, player)""",
)
def _(spark, d):
    """Decisions and seats in buckets of the same entities: grouped and joined on the entity without a shuffle."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = layout.bucketed(decisions(spark, d, "site", "player", "hand_id", "seq"), "decisions_by_player", n, "site", "player")
    two = layout.bucketed(seats(spark, d).select("site", "player", "hand_id", "vpip"), "seats_by_player", n, "site", "player")
    return layout.joined_counts(one, two)


@query("a22_report_sinks", f"WITH {bindings.N_SQL}, {COUNTS} SELECT site, player, hands, vpip_hands FROM pc")
def _(spark, d):
    """The entity report as CSV and as JSON, read back and joined."""
    rows = profile.entity_counts(bindings.n(spark, d))
    csv, json = folder(spark, "report-csv"), folder(spark, "report-json")
    rows.select("site", "player", "hands").write.option("header", "true").csv(csv)
    rows.select("site", "player", "vpip_hands").write.json(json)
    a = spark.read.option("header", "true").schema("site string, player string, hands long").csv(csv)
    return a.join(spark.read.schema("site string, player string, vpip_hands long").json(json), ["site", "player"])
