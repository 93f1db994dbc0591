"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a table of masks, as many 64-bit words for each slot as the languages need, in which
bit l of a slot says that an n-gram of language l was hashed there. The AND of an n-gram's ``hashes`` slots is the set of all languages that contain it, in one lookup.
The popcounts of a text, one for each language, are corrected for false positives: if the slots of language l are set with density f,
a foreign n-gram hits with probability f**hashes, so of n n-grams with c hits (c - n q) / (1 - q) belong to it, q = f**hashes.
The language with the most wins, ties to the one that sorts first.

N-grams are the runs of 2 to 4 letters of a padded word in lower case. A language's filter holds its most frequent ones
(``grams``), counted by Spark over at most ``max_docs`` documents of each language, the first by a hash of doc_id; this bound does not grow with the corpus.
Every language is learned: the table takes 4 MB for each 63 of them. Every document is judged over its whole text. A text that is null or has no letter is ``und`` with
score 0, as is any text if nothing was learned. Rows with a null doc_id or lang are not learned from; repeated rows are judged alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, bounded_sample, map_batches, slices, table

WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 400_000
WORD_BITS = 63


@dataclass(frozen=True)
class Params:
    max_docs: int = 1000
    grams: int = 1500
    sizes: tuple[int, ...] = (2, 3, 4)
    slot_bits: int = 19
    hashes: int = 3
    seed: int = 11


def grams(word: str, sizes: tuple[int, ...]) -> list[str]:
    """N-grams of the word's runs of letters; other numerals than digits (such as 2 as an exponent) match WORD but are none."""
    runs = [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()
    padded = [f" {x} " for x in runs]
    return [w[i : i + n] for w in padded for n in sizes for i in range(len(w) - n + 1) if w[i : i + n] != " "]


def slots(gram: str, p: Params) -> list[int]:
    import xxhash

    h = xxhash.xxh3_64_intdigest(gram, p.seed)
    a, b = h & 0xFFFFFFFF, (h >> 32) | 1
    return [(a + i * b) & ((1 << p.slot_bits) - 1) for i in range(p.hashes)]


@dataclass(frozen=True)
class Filter:
    langs: list[str]
    masks: np.ndarray
    false_rate: np.ndarray
    params: Params
    known: dict[str, int] = field(default_factory=dict)
    words: dict[str, np.ndarray] = field(default_factory=dict)  # counts of words seen, for as long as a worker lives

    def languages(self, gram: str) -> int:
        """The mask of all languages that contain the n-gram."""
        out = self.known.get(gram)
        if out is None:
            both = np.bitwise_and.reduce(self.masks[slots(gram, self.params)], axis=0)
            out = sum(int(m) << WORD_BITS * k for k, m in enumerate(both))
            if len(self.known) < CACHE_WORDS:
                self.known[gram] = out
        return out

    def word(self, word: str) -> np.ndarray:
        """For each language, how many n-grams of the word it contains, and last how many there are."""
        found = Counter(map(self.languages, grams(word, self.params.sizes)))
        out = [0] * len(self.langs) + [found.total()]
        for m, n in found.items():
            while m:
                low = m & -m
                out[low.bit_length() - 1] += n
                m ^= low
        return np.array(out, np.int64)

    def most_words(self) -> int:
        """How many words to remember: their counts take no more memory for more languages than for 63."""
        return CACHE_WORDS * 64 // max(64, len(self.langs) + 1)

    def decide(self, counts: np.ndarray) -> tuple[str, float]:
        n = counts[-1]
        if not n or not self.langs:
            return "und", 0.0
        true = np.clip((counts[:-1] - n * self.false_rate) / (1 - self.false_rate), 0, None) / n
        best = int(true.argmax())
        total = float((true**8).sum())
        return self.langs[best], float(true[best] ** 8 / total) if total else 0.0


def build(found: dict[str, list[str]], p: Params) -> Filter:
    """The filter of each language's n-grams."""
    langs = sorted(found)
    masks = np.zeros((1 << p.slot_bits, max(1, -(-len(langs) // WORD_BITS))), np.int64)
    for i, lang in enumerate(langs):
        for g in found[lang]:
            masks[slots(g, p), i // WORD_BITS] |= 1 << i % WORD_BITS
    density = np.array([(masks[:, i // WORD_BITS] >> i % WORD_BITS & 1).mean() for i in range(len(langs))])
    return Filter(langs, masks, density**p.hashes, p)


def train(docs: DataFrame, p: Params = Params()) -> Filter:
    learned = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    # The hash threshold of each language leaves a bounded number of rows in the scan itself, so no other text is shuffled.
    chosen = bounded_sample(learned.select("lang", "doc_id", "text"), "lang", "doc_id", p.max_docs, p.seed, tie="text").select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORD.findall((text or "").lower()))
            for lang, c in words.items():
                total: Counter = Counter()
                for w, n in c.items():
                    for g in grams(w, p.sizes):
                        total[g] += n
                yield batch(schema, [lang] * len(total), list(total), list(total.values()))

    counted = map_batches(chosen, count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= p.grams)
    found: dict[str, list[str]] = {}
    for r in top.select("lang", "gram").collect():
        found.setdefault(r.lang, []).append(r.gram)
    return build(found, p)


OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identified(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        none = np.zeros(len(f.langs) + 1, np.int64)
        for b in slices(batches):
            out = []
            for text in b.column(1).to_pylist():
                words = WORD.findall(text.lower()) if text else []
                for w in set(words).difference(f.words) if len(f.words) < f.most_words() else ():
                    f.words[w] = f.word(w)
                seen = Counter(words)
                at = [f.words[w] if w in f.words else f.word(w) for w in seen]
                out.append(f.decide(np.fromiter(seen.values(), np.int64, len(seen)) @ np.array(at) if at else none))
            yield batch(OUT, b.column(0), *(list(c) for c in zip(*out, strict=True)))

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return identified(docs, train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
