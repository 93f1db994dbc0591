"""Spelling variants by PartEnum signatures over letter multisets.

A word's letters with their counts are a binary vector with a place for each (letter, occurrence). One inserted or deleted letter changes one place, one
replaced letter two: words one edit apart are at most two apart in Hamming distance. The places fall into parts, by letter, so two words at distance d
agree in all but d parts at most. A signature is a word's projection on a choice of parts: all of ``parts`` but two for words of one length, all of ``parts_apart`` but
one for words whose lengths differ by one. Letters are dealt to parts by falling frequency, back and forth, so that the parts tell words apart alike well.
An edit also leaves the front half or the back half of the shorter word as it was: each signature is made once with either half, so that anagrams don't meet in one bucket.
Every pair one edit apart shares a signature with a half, so an equi-join on them finds all pairs, and the edit distance verifies them.

Words are counted for each batch in its task and then by Spark, and only distinct words are joined. Words are lower-cased in A-Z alone. Null and empty
texts have no words; a null doc_id is written as empty where it is hashed. Repeated rows count each time. An empty table gives no words. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, slices, table, written

#: What stands between words.
OTHERS = r"[^A-Za-z\x{c0}-\x{ff}]+"

@dataclass(frozen=True)
class Params:
    least_length: int = 7
    least_n: int = 2
    #: A word's form is at least this many times as frequent.
    ratio: int = 10
    parts: int = 4
    parts_apart: int = 2
    #: One in so many runs of a document loses a letter before words are counted; None for texts as they are.
    spoiled: int | None = 31


#: Longest words, in bytes, whose checksums are put together from those of doc_id and word; longer ones are summed as a whole.
LONGEST = 64


@cache
def shifts() -> np.ndarray:
    """[n, k, v]: what byte k of a CRC-32, if it is v, becomes after n more bytes; those of all k together, and the checksum of the n bytes, make the new one by exclusive or."""
    step = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)
    at = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [at]
    for _ in range(LONGEST):
        out.append((out[-1] >> np.uint32(8)) ^ step[out[-1] & np.uint32(255)])
    return np.array(out)


def checksums(heads: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of pairs of strings from the checksums of both and the bytes of the second."""
    table, out = shifts(), words.copy()
    for k in range(4):
        out ^= table[sizes, k, (heads >> np.uint32(8 * k)) & np.uint32(255)]
    return out


COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def words(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """word, n of every word of enough letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.replace_substring_regex(b.column(1).fill_null(""), OTHERS, " ")))
            coded = lists.flatten().dictionary_encode()
            size = pc.utf8_length(coded.dictionary).to_numpy()
            code = coded.indices.to_numpy()
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[size[code] >= params.least_length]
            code = code[size[code] >= params.least_length]
            found, lost = coded.dictionary, Counter()
            if params.spoiled is not None:
                raw = [x.encode() for x in found.to_pylist()]
                ids = [f"{'' if x is None else x}:".encode() for x in b.column(0).to_pylist()]
                bytes_ = np.fromiter(map(len, raw), np.int64, len(raw))
                head, tail = (np.fromiter(map(zlib.crc32, x), np.uint32, len(x)) for x in (ids, raw))
                h = checksums(head[doc], tail[code], np.minimum(bytes_, LONGEST)[code])
                for i in np.flatnonzero(bytes_[code] > LONGEST):
                    h[i] = zlib.crc32(ids[doc[i]] + raw[code[i]])
                hit = h % np.uint32(params.spoiled) == 0
                for c, at in zip(code[hit].tolist(), (h[hit] % size[code[hit]]).tolist(), strict=True):
                    word = raw[c].decode()
                    lost[word[:at] + word[at + 1 :]] += 1
                code = code[~hit]
            n = np.bincount(code, minlength=len(found))
            yield batch(COUNTED, found.take(pa.array(np.flatnonzero(n))), n[n > 0])
            yield batch(COUNTED, list(lost), list(lost.values()))

    counted = map_batches(docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")), run, "word string, n long")
    return counted.where(F.length("word") >= params.least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= params.least_n)


def letters(found: DataFrame) -> list[str]:
    """The letters of the words by falling frequency: 90 rows at most reach the driver."""
    counts = found.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").agg(F.count("*").alias("n"))
    return [r.letter for r in counts.orderBy(F.desc("n"), "letter").collect()]


def dealt(order: list[str], parts: int) -> list[set[str]]:
    """The letters of each part, dealt back and forth."""
    out: list[set[str]] = [set() for _ in range(parts)]
    for k, letter in enumerate(order):
        lap, place = divmod(k, parts)
        out[place if lap % 2 == 0 else parts - 1 - place].add(letter)
    return out


SIGNED = pa.schema([("word", pa.string()), ("role", pa.int32()), ("key", pa.int64())])


def keys(word: str, shares: list[list[set[str]]]) -> Iterator[tuple[int, bytes]]:
    """(role, signature with a half) on which the word meets others of its length (role 0), longer ones (1) and shorter ones (2)."""
    ordered, n = sorted(word), len(word)
    same, apart = (["".join([c for c in ordered if c in share]) for share in x] for x in shares)
    for left_out, roles, parts in ((2, (0,), same), (1, (1, 2), apart)):
        for kept in combinations(range(len(parts)), len(parts) - left_out):
            projected = ",".join([parts[i] for i in kept])
            for role in roles:
                shorter = n - (role == 2)
                half = shorter // 2
                head = f"{left_out}:{kept}:{shorter}:{projected}"
                yield role, f"{head}<{word[:half]}".encode()
                yield role, f"{head}>{word[n - shorter + half:]}".encode()


def signatures(found: DataFrame, params: Params = Params()) -> DataFrame:
    """word, role, key: a hash of every signature with a half. Hashes that agree by chance are told apart as the pairs are verified."""
    order = letters(found)
    shares = [dealt(order, params.parts), dealt(order, params.parts_apart)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            made = [[(role, xxhash.xxh64_intdigest(k)) for role, k in keys(w, shares)] for w in b.column(0).to_pylist()]
            flat = np.array([x for m in made for x in m], np.uint64).reshape(-1, 2)
            word = b.column(0).take(pa.array(np.repeat(np.arange(len(made)), list(map(len, made)))))
            yield batch(SIGNED, word, pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1].view(np.int64)))

    # The words are few and their signatures many: they are made in as many tasks as a shuffle has.
    dealt_out = found.select("word").repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    return map_batches(dealt_out, run, "word string, role int, key long")


def links(found: DataFrame, params: Params = Params()) -> DataFrame:
    """a, b: every two words one edit apart, once."""
    # Spark sizes signatures by the bytes of their words, which are few: it would send a table of many times that size to every executor.
    signed = signatures(found, params).hint("merge")
    roles = "(a.role = 0 AND b.role = 0 AND a.word < b.word OR a.role = 1 AND b.role = 2)"
    met = signed.alias("a").join(signed.alias("b"), F.expr(f"a.key = b.key AND {roles} AND levenshtein(a.word, b.word, 1) = 1"))
    return met.select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).distinct()


def forms(found: DataFrame, params: Params = Params()) -> DataFrame:
    """word, form, root, n, n_near, form_n: for every word its most frequent near word, if that is ``ratio`` times as frequent, and the last of the forms from there on."""
    found = written(found, "variant-words")
    pairs = written(links(found, params), "variant-links")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    # Tables of words grow with the corpus and are sized by packed files: no join broadcasts one.
    both = both.join(found.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near")
    # The largest n, then the smallest word: the least of (-n, word).
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    keep = -F.col("best.m") >= F.lit(params.ratio) * F.col("n")
    out = found.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(keep, F.col("best.near")).alias("form"), F.when(keep, -F.col("best.m")).alias("form_n"))
    out = written(out, "variant-forms")
    # A form is ratio times as frequent as its word, so a chain of forms has few steps, and each round doubles what it follows.
    most = out.agg(F.max("n")).first()[0] or 1
    steps = out.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    for _ in range(math.ceil(math.log2(1 + math.log(max(most, 2), max(params.ratio, 2))))):
        further = steps.select(F.col("word").alias("to"), F.col("to").alias("further"))
        steps = written(steps.join(further.hint("merge"), "to", "left").select("word", F.coalesce("further", "to").alias("to")), "variant-steps")
    return out.join(steps.hint("merge"), "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    params = Params()
    return forms(words(table(spark, sf_dir, "documents"), params), params)
