"""Quality rules: a threshold table compiled into one projection, without user functions.

Every figure is a built-in expression over the whole text, so a document is judged in the task that reads it:
no shuffle, no join, no Python. A text that is null, empty or has no word gets zero counts and fails the base rule.
Repeated rows are judged one by one; other columns pass through ``annotate`` untouched, whatever their names,
unless they bear the name of a figure, which is then replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

#: Frequent function words of the languages that the corpus is written in.
STOP_WORDS = (
    "a an and are as at be but by for from have he her his i in is it not of on or that the they this to was we were with you "
    "au aux avec ce dans de des du elle en est et il je la le les mais ne nous on ou par pas pour qui que se sur un une vous "
    "als am auf aus bei das dem den der des die durch ein eine einer er es für ich ist mit nach nicht sich sie sind um und von wie zu zum zur "
    "al como con del el en es las lo los más me mi no para pero por se si sin su sus un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A figure of a document and the bounds, both included, within which it is kept; None: unbounded."""

    name: str
    low: float | None
    high: float | None


#: Production thresholds. They bound gross defects only: junk symbols, lists without prose, and repetition.
RULES = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)

MIN_WORDS = 50
#: Percent of the words that may stand in repeated 3-word windows.
MAX_REPEAT_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the text.

    A window is a hash of its three words with its place in the low 20 bits, so that sorting plain longs brings equal
    windows side by side; neighbours count once their words are equal too. Texts of over 2**20 words sort
    (64-bit hash, place) pairs instead, which give the same count.
    """
    bits = 20

    def hashes(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def covered(at: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

    def packed(keys: Column, w: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda h, i: F.shiftleft(h, bits).bitwiseOR(i.cast("long"))))

        def place(x: Column) -> Column:
            return x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

        def twin(x: Column, y: Column) -> Column:
            same = [F.get(w, place(x) + k) == F.get(w, place(y) + k) for k in range(3)]
            return F.coalesce((F.shiftright(x, bits) == F.shiftright(y, bits)) & same[0] & same[1] & same[2], F.lit(False))

        return let(ordered, lambda p: covered(F.transform(F.filter(p, lambda x, i: twin(x, F.get(p, i - 1)) | twin(x, F.get(p, i + 1))), place)))

    def paired(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda x, y: F.coalesce(x.h == y.h, F.lit(False))
        return let(ordered, lambda p: covered(F.transform(F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1))), lambda x: x.i)))

    def counted(keys: Column) -> Column:
        few = F.size(keys) < (1 << bits)
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).when(few, packed(keys, words)).otherwise(paired(keys))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes(words), counted))


def spelled(words: tuple[str, ...] | list[str]) -> list[str]:
    """The words in lower, title and upper case, alone and before a stop; a set for one lookup a word."""
    return [w + stop for word in sorted(set(words)) for w in (word, word.capitalize(), word.upper()) for stop in ("", ".", ",", ";", ":", "!", "?")]


def counts(text: Column) -> Column:
    """A struct of whole numbers from which all ratios follow."""
    text = F.coalesce(text, F.lit(""))
    stop = spelled(STOP_WORDS)

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stop))).cast("long").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    n_symbols = F.when(text.rlike(SYMBOL), F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).otherwise(F.lit(0))
    return F.struct(let(words_of(text), of_words).alias("w"), let(lines, of_lines).alias("l"), n_symbols.cast("long").alias("n_symbols"))


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of every figure, base_failed, failed_rules and kept. The counts are bound once, also where a filter on kept is pushed down."""

    def of(q: Column) -> Column:
        ratio = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
        n = q.w.n_words
        ratios = {
            "mean_word_chars": ratio(q.w.word_chars, n),
            "symbol_ratio": ratio(q.n_symbols, n),
            "stop_word_ratio": ratio(q.w.n_stop_words, n),
            "dup_line_ratio": ratio(q.l.n_dup_lines, q.l.n_lines),
            "bullet_line_ratio": ratio(q.l.n_bullet_lines, q.l.n_lines),
            "ellipsis_line_ratio": ratio(q.l.n_ellipsis_lines, q.l.n_lines),
        }
        base = (n < MIN_WORDS) | (F.lit(100) * q.w.n_repeat_words > F.lit(MAX_REPEAT_PERCENT) * n)
        broken = []
        for r in rules:
            low = ratios[r.name] < r.low if r.low is not None else F.lit(False)
            high = ratios[r.name] > r.high if r.high is not None else F.lit(False)
            broken.append(F.when(low | high, F.lit(r.name)))
        failed = F.array_compact(F.array(*broken))
        whole = (n, q.w.word_chars, q.n_symbols, q.l.n_dup_lines, q.w.n_repeat_words)
        return F.struct(
            *[c.alias(k) for k, c in zip(FIGURES, whole, strict=True)],
            *[c.alias(k) for k, c in ratios.items()],
            base.alias("base_failed"),
            failed.alias("failed_rules"),
            (~base & (F.size(failed) == 0)).alias("kept"),
        )

    return let(counts(text), of)


def annotate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with every figure, base_failed, kept, and the names of the rules that failed."""
    names = (*FIGURES, *[r.name for r in RULES], "base_failed", "failed_rules", "kept")
    held = "_verdict"
    while held in map(str.lower, docs.columns):
        held = f"_{held}"
    return docs.withColumn(held, verdict(F.col(text), rules)).withColumns({n: F.col(f"{held}.{n}") for n in names}).drop(held)


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    return docs.where(verdict(docs["text"], rules)["kept"])


OUT = (*FIGURES, "base_failed", "kept")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return annotate(docs).select("doc_id", *OUT)


def oracle() -> str:
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in spelled(STOP_WORDS))
    tests = {r.name: " OR ".join(([f"{r.name} < {r.low}"] if r.low is not None else []) + ([f"{r.name} > {r.high}"] if r.high is not None else [])) for r in RULES}
    return f"""
    WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
    p AS (SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) > 2),
    g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM p),
    r AS (SELECT rid, count(DISTINCT k) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY rid),
    c AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
                 len(list_filter(words, lambda x: x IN ({stop}))) AS n_stop, len(lines) AS n_lines,
                 len(list_filter(lines, lambda x: ltrim(x)[1:1] IN ('-', '*', '•'))) AS n_bullet,
                 len(list_filter(lines, lambda x: rtrim(x).ends_with('...') OR rtrim(x).ends_with('…'))) AS n_ellipsis
          FROM w LEFT JOIN r USING (rid)),
    f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
                 coalesce(word_chars::DOUBLE / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbol_ratio,
                 coalesce(n_stop::DOUBLE / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_ratio,
                 coalesce(n_bullet::DOUBLE / nullif(n_lines, 0), 0) AS bullet_line_ratio, coalesce(n_ellipsis::DOUBLE / nullif(n_lines, 0), 0) AS ellipsis_line_ratio
          FROM c)
    SELECT doc_id, {", ".join(OUT[:-1])}, NOT base_failed AND NOT ({" OR ".join(f"({x})" for x in tests.values())}) AS kept FROM f
    """
