"""Reading decision logs: section blocks, one-hand files, transcripts and fixed-limit logs as DataFrames of hands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feltloom.sources.scratch import folder

HANDS = (
    "site string, nl_level int, hand_id string, table string, seat_count int, n_players int, players array<string>, blinds array<double>, "
    "starting_stacks array<double>, finishing_stacks array<double>, winnings array<double>, actions array<string>, year int, month int, day int, time string"
)
HAND_COLUMNS = tuple(x.split()[0] for x in HANDS.split(", "))


# ---------------------------------------------------------------- blocks


def fields(block: Column) -> Column:
    """key -> value of a block's lines with ' = ', split at the first; the last of repeated keys wins.

    map_from_entries refuses repeated keys, so of equal keys only the last line is passed on.
    """
    lines = F.filter(F.split(F.regexp_replace(block, "\r", ""), "\n"), lambda x: F.contains(x, F.lit(" = ")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, " = ", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, " = ") + 3, F.length(x))).alias("v")))
    last = F.transform(F.array(pairs), lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.greatest(F.size(p) - i - 1, F.lit(0))), lambda y: y.k == x.k)))[0]
    return F.map_from_entries(last)


def blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each section of the files under path, or of these files: its file and its fields. Splits of a file are read by many tasks; sections without a field are left out."""
    reader = spark.read.option("lineSep", "\n[").option("recursiveFileLookup", "true")
    raw = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    out = raw.select("file", fields(F.col("value")).alias("kv"))
    return out.where(F.size("kv") > 0)


def value(key: str) -> Column:
    return F.try_element_at("kv", F.lit(key))


def strings(x: Column) -> Column:
    """The quoted tokens between the first [ and the last ]."""
    inner = F.regexp_extract(x, r"(?s)\[(.*)\]", 1)
    found = F.regexp_extract_all(inner, F.lit(r"('[^']*'|\"[^\"]*\")"), F.lit(1))
    return F.transform(found, lambda t: F.substring(t, 2, F.length(t) - 2))


def numbers(x: Column) -> Column:
    """The comma-separated numbers between the first [ and the last ]; blanks are skipped, what is no number is 0."""
    inner = F.regexp_extract(x, r"(?s)\[(.*)\]", 1)
    return F.transform(F.filter(F.split(inner, ","), lambda t: F.trim(t) != ""), lambda t: F.coalesce(F.trim(t).try_cast("double"), F.lit(0.0)))


def whole(x: Column) -> Column:
    """int(float(x)), or 0."""
    return F.coalesce(x.try_cast("double").cast("int"), F.lit(0))


def unquoted(x: Column) -> Column:
    return F.coalesce(F.regexp_replace(x, "^['\"]|['\"]$", ""), F.lit(""))


def level_of(path: Column) -> Column:
    found = F.regexp_extract(path, r"_(\d+)NLH_OBFU", 1)
    return F.when(found == "", -1).otherwise(found.try_cast("int"))


def site_of(path: Column) -> Column:
    """The part before the first dash of the folder above the file's own."""
    return F.substring_index(F.element_at(F.split(path, "/"), -3), "-", 1)


def cash_hands(found: DataFrame) -> DataFrame:
    """No-limit sections as hands."""
    players = strings(value("players"))
    return found.where(unquoted(value("variant")) == "NT").select(
        site_of(F.col("file")).alias("site"),
        level_of(F.col("file")).alias("nl_level"),
        unquoted(value("hand")).alias("hand_id"),
        unquoted(value("table")).alias("table"),
        whole(value("seat_count")).alias("seat_count"),
        F.size(players).alias("n_players"),
        players.alias("players"),
        *[numbers(value(k)).alias(n) for k, n in (("blinds_or_straddles", "blinds"), ("starting_stacks", "starting_stacks"), ("finishing_stacks", "finishing_stacks"), ("winnings", "winnings"))],
        strings(value("actions")).alias("actions"),
        *[whole(value(k)).alias(k) for k in ("year", "month", "day")],
        unquoted(value("time")).alias("time"),
    )


def one_hand_files(spark: SparkSession, path: str, site: str = "POOL") -> DataFrame:
    """One hand for each file, from its first section; the level follows from the largest blind, else the least bet, else 100."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    kv = raw.select(F.col("_metadata.file_path").alias("file"), fields(F.split(F.regexp_replace("value", "^\\[", ""), "\n\\[")[0]).alias("kv"))
    blinds, players = numbers(value("blinds_or_straddles")), strings(value("players"))
    bb = F.coalesce(F.when(F.array_max(blinds) > 0, F.array_max(blinds)), F.when(value("min_bet").try_cast("double") > 0, value("min_bet").try_cast("double")), F.lit(100.0))
    return kv.where(F.size("kv") > 0).select(
        F.lit(site).alias("site"),
        F.floor(bb * 100).cast("int").alias("nl_level"),
        F.concat_ws("/", F.element_at(F.split("file", "/"), -2), unquoted(value("hand"))).alias("hand_id"),
        F.lit("").alias("table"),
        F.size(players).alias("seat_count"),
        F.size(players).alias("n_players"),
        players.alias("players"),
        *[numbers(value(k)).alias(n) for k, n in (("blinds_or_straddles", "blinds"), ("starting_stacks", "starting_stacks"), ("finishing_stacks", "finishing_stacks"), ("winnings", "winnings"))],
        strings(value("actions")).alias("actions"),
        F.lit(2019).alias("year"),
        F.lit(7).alias("month"),
        F.lit(11).alias("day"),
        F.lit("").alias("time"),
    )


def natural_halves(files: DataFrame, directory: Column, stem: Column) -> DataFrame:
    """day 1 for the first half of the files in order of (directory, first number in the stem, or -1), else day 2."""
    number = F.coalesce(F.regexp_extract(stem, r"(\d+)", 1).try_cast("bigint"), F.lit(-1))
    placed = files.withColumns({"_d": directory, "_n": number, "_s": stem})
    # Ranges are in order; they are written, as a range partitioning made twice need not fall alike, and each adds to its own places the rows before it.
    path = folder(files.sparkSession, "natural-order")
    placed.repartitionByRange("_d", "_n", "_s").withColumn("_p", F.spark_partition_id()).write.parquet(path)
    ranged = files.sparkSession.read.parquet(path)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_before"), F.sum("_c").over(W.partitionBy()).alias("_total"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_p").orderBy("_d", "_n", "_s")) - 1
    return ranged.join(offsets, "_p").withColumn("day", F.when(place < F.floor(F.col("_total") / 2), 1).otherwise(2)).drop("_d", "_n", "_s", "_p", "_before", "_total")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """file and size of every file under path; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"))


def sampled_files(files: DataFrame, file: str, first: int | None = None, spread: int | None = None) -> DataFrame:
    """A sampling operator on the list of files: the first of them by name, or every step-th with step = max(1, count // spread).

    Every step-th needs all names in order, a row a file in one task; the first ones need no more than their own number from each task.
    """
    names = files.select(file).distinct()
    if not spread:
        return names.orderBy(file).limit(first) if first else names
    placed = names.withColumns({"_i": F.row_number().over(W.orderBy(file)) - 1, "_n": F.count("*").over(W.partitionBy())})
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / spread).cast("int"))
    placed = placed.where(F.col("_i") % step == 0).where(F.floor(F.col("_i") / step) < spread)
    return (placed.where(F.col("_i") < first) if first else placed).select(file)


def sampled_blocks(spark: SparkSession, path: str, *, first: int | None = None, spread: int | None = None, largest: int | None = None) -> DataFrame:
    """The sections of a sample of the files under path. The sample is taken from names and sizes, and only its files are read.

    ``first`` and ``spread`` as in sampled_files; ``largest`` leaves out files of more bytes before that. The chosen paths, as many as the sample has, reach the driver.
    """
    files = listed(spark, path)
    if largest is not None:
        files = files.where(F.col("size") <= largest)
    chosen = sorted(r.file for r in sampled_files(files, "file", first, spread).collect())
    if not chosen:
        return spark.createDataFrame([], "file string, kv map<string,string>")
    return blocks(spark, chosen)


def first_hands(hands: DataFrame, most: int, *order: str) -> DataFrame:
    """A sampling operator on hands: the first of them in that order. Every task keeps no more than that many before they meet."""
    return hands.orderBy(*order).limit(most)


# ---------------------------------------------------------------- transcripts

HAND = "PokerStars Hand #"


def transcript_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each hand of the transcripts: the text from its number on, and the ordinal of its file as day.

    A hand starts at its number line where the file starts or a blank line stands before it; the same words in a chat line start none. Files with
    carriage returns hold no such separator for the reader, and are split in the row.
    """
    raw = spark.read.option("lineSep", f"\n\n{HAND}").option("recursiveFileLookup", "true").text(path)
    each = raw.select(F.col("_metadata.file_path").alias("file"), F.explode(F.split("value", rf"\r?\n[ \t]*\r?\n(?={HAND})")).alias("value"))
    out = each.select("file", F.regexp_replace(F.regexp_replace("value", "\r", ""), rf"^\s*{HAND}", "").alias("block")).where(F.col("block").rlike(r"^\d+"))
    ordinal = out.select("file").distinct().withColumn("day", F.dense_rank().over(W.orderBy("file")))
    return out.join(ordinal, "file")


def transcript_hands(found: DataFrame, site: str = "ACPC") -> DataFrame:
    """Heads-up transcripts as hands; the button's seat comes first. Blocks without two seats and a button are refused."""
    b = F.col("block")
    money = r"([0-9]+(?:\.[0-9]+)?)"
    seats = F.regexp_extract_all(b, F.lit(rf"(?m)^Seat (\d+): (.+?) \(\$?{money} in chips\)"), F.lit(0))
    part = lambda s, i: F.regexp_extract(s, rf"^Seat (\d+): (.+?) \(\$?{money} in chips\)", i)
    out = found.select(
        "day",
        F.regexp_extract(b, r"^(\d+)", 1).alias("hand_id"),
        F.regexp_extract(b, rf"\(\${money}/\${money}", 1).try_cast("double").alias("sb"),
        F.regexp_extract(b, rf"\(\${money}/\${money}", 2).try_cast("double").alias("bb"),
        F.regexp_extract(b, r"Seat #(\d+) is the button", 1).alias("button"),
        F.transform(seats, lambda s: F.struct(part(s, 1).alias("seat"), part(s, 2).alias("name"), part(s, 3).try_cast("double").alias("stack"))).alias("seats"),
        F.split(b, "\n").alias("lines"),
    )
    out = out.where((F.size("seats") == 2) & (F.col("button") != ""))
    first = F.filter("seats", lambda s: s.seat == F.col("button"))
    rest = F.filter("seats", lambda s: s.seat != F.col("button"))
    out = out.withColumn("order", F.concat(first, rest)).where(F.size("order") == 2)
    shown = F.filter("lines", lambda x: x.rlike(r": shows \["))

    def hole(name: Column) -> Column:
        cards = F.transform(shown, lambda x: F.when(F.substring_index(x, ": shows", 1) == name, F.regexp_replace(F.regexp_extract(x, r"shows \[([^\]]*)\]", 1), " ", "")))
        return F.coalesce(F.get(F.filter(cards, lambda x: x.isNotNull()), F.lit(0)), F.lit("????"))

    def player(line: Column) -> Column:
        return F.when(F.substring_index(line, ": ", 1) == F.col("order")[0]["name"], "p1").when(F.substring_index(line, ": ", 1) == F.col("order")[1]["name"], "p2")

    def token(line: Column) -> Column:
        """The action token of a line; NULL for what is no action."""
        act = F.substring(line, F.instr(line, ": ") + 2, F.length(line))
        return (
            F.when(line.rlike(r"^\*\*\* (FLOP|TURN|RIVER) \*\*\*"), F.concat(F.lit("d db "), F.regexp_replace(F.regexp_extract(line, r"\[([^\[\]]*)\]\s*$", 1), " ", "")))
            .when(act.startswith("folds"), F.concat(player(line), F.lit(" f")))
            .when(act.startswith("checks") | act.startswith("calls"), F.concat(player(line), F.lit(" cc")))
            .when(act.startswith("raises"), F.concat(player(line), F.lit(" cbr "), F.regexp_extract(act, rf"to \${money}", 1)))
            .when(act.startswith("bets"), F.concat(player(line), F.lit(" cbr "), F.regexp_extract(act, rf"bets \${money}", 1)))
        )

    def place(head: str) -> Column:
        return F.array_position(F.transform("lines", lambda x: x.startswith(head)), True)

    begin, end = place("*** HOLE CARDS"), place("*** SUMMARY")
    inside = F.filter("lines", lambda x, i: (i + 1 > begin) & ((end == 0) | (i + 1 < end)))
    acts = F.filter(F.transform(inside, token), lambda x: x.isNotNull())
    deal = F.array(*[F.concat(F.lit(f"d dh p{i + 1} "), hole(F.col("order")[i]["name"])) for i in (0, 1)])
    no_numbers = F.array().cast("array<double>")
    return out.select(
        F.lit(site).alias("site"),
        F.floor(F.col("bb") * 100).cast("int").alias("nl_level"),
        "hand_id",
        F.lit("").alias("table"),
        F.lit(2).alias("seat_count"),
        F.lit(2).alias("n_players"),
        F.transform("order", lambda s: s["name"]).alias("players"),
        F.array("sb", "bb").alias("blinds"),
        F.transform("order", lambda s: s.stack).alias("starting_stacks"),
        no_numbers.alias("finishing_stacks"),
        no_numbers.alias("winnings"),
        F.concat(deal, acts).alias("actions"),
        F.lit(2014).alias("year"),
        F.lit(1).alias("month"),
        "day",
        F.lit("").alias("time"),
    )


# ---------------------------------------------------------------- fixed limit


def limit_hands(found: DataFrame, site: str = "ACPC") -> DataFrame:
    """Fixed-limit sections of two players with results, seats exchanged so that the small blind comes first."""
    players, results, stacks = strings(value("players")), numbers(value("_results")), numbers(value("starting_stacks"))
    out = found.where(unquoted(value("variant")) == "FT").withColumns({"p": players, "r": results, "st": stacks, "bl": numbers(value("blinds_or_straddles")), "ac": strings(value("actions"))})
    out = out.where((F.size("p") == 2) & (F.size("r") == 2))
    start = F.when(F.size("st") == 2, F.col("st")).otherwise(F.array(F.lit(2000.0), F.lit(2000.0)))
    bb = F.coalesce(F.when(F.array_max("bl") > 0, F.array_max("bl")), F.lit(10.0))
    swapped = F.transform("ac", lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\bp1\b", "p#"), r"\bp2\b", "p1"), "p#", "p2"))
    return out.select(
        F.lit(site).alias("site"),
        F.floor(bb * 100).cast("int").alias("nl_level"),
        unquoted(value("hand")).alias("hand_id"),
        F.reverse("p").alias("players"),
        F.array(bb / 2, bb).alias("blinds"),
        F.reverse(start).alias("starting_stacks"),
        F.reverse(F.zip_with(start, "r", lambda a, b: a + b)).alias("finishing_stacks"),
        swapped.alias("actions"),
    )


def results_only(found: DataFrame) -> DataFrame:
    """hand, players and results of two-player sections, and nothing else."""
    out = found.select(unquoted(value("hand")).alias("hand_id"), strings(value("players")).alias("players"), numbers(value("_results")).alias("results"))
    return out.where((F.size("players") == 2) & (F.size("results") == 2))
