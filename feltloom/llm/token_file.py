"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A block holds consecutive documents of a shard. Every id is replaced by its rank in the corpus (0: the most frequent,
ties to the smaller id) and written in 1 to 4 bytes, little-endian, without leading zero bytes. The lengths, two bits each
for four ids a byte, stand apart in ``control``, where each document starts a byte of its own; the bytes stand in ``data``. So a reader finds every id's
place by table lookup on whole control bytes and a running sum, without a branch for each id. Documents are packed before they are put in order, so
the packed bytes travel and not the ids.

The blocks are rows of Parquet files (shard, block, doc ids, lengths, control, data): Spark commits them atomically, on any
file system, and a reader skips what it does not need. ``ranks`` is the table of ids by rank.
Null texts count as empty; each document ends with ``end_id``. Documents stand in ascending doc_id order, null first,
repeated ones by their ids' checksum.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, map_batches, shared_dir, slices, table, written

IDS = np.dtype("<u4")
#: Words, and parts of words, of a generation that a worker remembers; when it is full, it becomes the older one, and the one before is forgotten.
CACHE_WORDS = 300_000
BLOCK_IDS = 1 << 16
BATCH_ROWS = 2048

#: Letters beyond ASCII that no normaliser composes anew and that have one letter for each case.
CASED = "".join(filter(str.isalpha, map(chr, (*range(0xC0, 0x130), *range(0x132, 0x149), *range(0x14A, 0x17F)))))
LOWER = "a-z" + "".join(c for c in CASED if c == c.lower())
PLAIN_WORD = re.compile(f"[!-~{CASED}]*")
PLAIN_TEXT = rf"^[\t-\r -~{CASED}]*$"
#: What the vocabulary's splitter makes of plain words in lower case: fixed values of its file, with the classes cut down to them.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LOWER}]+|[0-9]|[^\t-\r 0-9{LOWER}]+")
#: The same for texts in which no apostrophe stands before a letter, as blanks around all but letters.
MARKS, DIGIT, ENDING = rf"([^\t-\r 0-9{LOWER}]+)", "([0-9])", rf"'[{LOWER}]"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(x if x in plain else next(others)) for x in range(0x100)]


LETTERS = byte_letters()
#: A character that stands alone between the words of one call, to tell their ids apart.
APART = "\x01"


class Memory:
    """Ids of strings, learned together where they are missing; two generations of bounded size."""

    def __init__(self, learn):
        self.learn, self.known, self.older = learn, {"": b""}, {}

    def get(self, strings: list[str]) -> list[bytes]:
        known = self.known
        missing = [x for x in strings if x not in known]
        if missing and len(known) > CACHE_WORDS:
            self.older, self.known, missing = known, {"": b""}, strings
        if missing:
            old, known = self.older, self.known
            known |= {x: old[x] for x in missing if x in old}
            if missing := [x for x in missing if x not in known]:
                known |= self.learn(missing)
        return list(map(self.known.__getitem__, strings))


class WordEncoder:
    """Ids of a text as bytes, put together from those of its distinct words or parts of words.

    The vocabulary's normaliser and splitter never join what stands on two sides of a blank or a newline. Of plain texts, of Latin letters without endings after an apostrophe,
    Arrow makes the splitter's parts in one go; of others it makes words, of which plain ones are split here. It finds the distinct ones of a batch, and numpy
    gathers their ids. Parts go to the library's model without the normaliser, which has nothing left to do; words that are not plain go to
    the library as they are. A text that holds the start of a special token is encoded whole. Ids take two bytes here if the vocabulary allows it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.parts = Memory(self.learn), Memory(self.modelled)
        self.apart = self.tokenizer.encode(APART, add_special_tokens=False).ids
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        # Every part ends with a token that has the suffix: there the ids of many parts are cut.
        self.ends = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
        if suffix:
            self.ends[[i for w, i in spec["model"]["vocab"].items() if w.endswith(suffix)]] = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(spec))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def spelled(self, words: list[str]) -> dict[str, bytes]:
        """The ids of these distinct words from one call, cut where the ids of APART stand."""
        if len(self.apart) != 1 or any(APART in w for w in words):
            return {w: self.whole(w) for w in words}
        ids = np.array(self.tokenizer.encode(f" {APART} ".join(words), add_special_tokens=False).ids, self.dtype)
        return cut(words, ids, np.flatnonzero(ids == self.apart[0]), 1)

    def modelled(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of these distinct parts of plain words in lower case, straight from the model."""
        text = " ".join([x if x.isascii() else "".join(map(LETTERS.__getitem__, x.encode())) for x in parts])
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        at = np.flatnonzero(self.ends[ids]) + 1
        return cut(parts, ids, at[:-1], 0) if len(at) == len(parts) else self.spelled(parts)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        split = {w: SPLIT.findall(w.lower()) for w in words if PLAIN_WORD.fullmatch(w)}
        parts = list(set().union(*split.values()))
        get = dict(zip(parts, self.parts.get(parts), strict=True)).__getitem__
        out = {w: b"".join(map(get, x)) for w, x in split.items()}
        if others := [w for w in words if w not in out]:
            out |= self.spelled(others)
        return out

    def gathered(self, lists: pa.ListArray, memory: Memory) -> list[bytes]:
        """The ids of each list of strings."""
        coded = lists.flatten().dictionary_encode()
        code, found = coded.indices.to_numpy(), memory.get(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        flat, n = np.frombuffer(b"".join(found), self.dtype), size[code]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - (ends - n), n) + np.arange(n.sum())].tobytes()
        offsets = lists.offsets.to_numpy()
        at = (np.concatenate([[0], ends])[offsets - offsets[0]] * self.dtype.itemsize).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def texts(self, texts: pa.Array) -> list[bytes]:
        texts = texts.fill_null("")
        low = pc.utf8_lower(texts)
        plain = pc.and_(pc.match_substring_regex(texts, PLAIN_TEXT), pc.invert(pc.match_substring_regex(low, ENDING)))
        parts = pc.replace_substring_regex(pc.replace_substring_regex(low.filter(plain), MARKS, r" \1 "), DIGIT, r" \1 ")
        words = pc.replace_substring(texts.filter(pc.invert(plain)), "\n", " ")
        of_parts, of_words = iter(self.gathered(pc.ascii_split_whitespace(parts), self.parts)), iter(self.gathered(pc.split_pattern(words, " "), self.words))
        out = [next(of_parts if x else of_words) for x in plain.to_pylist()]
        for i in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)):
            out[i] = self.whole(texts[i].as_py())
        return out


def cut(words: list[str], ids: np.ndarray, at: np.ndarray, gap: int) -> dict[str, bytes]:
    """The ids between the places ``at``, a word each; ``gap`` ids stand between two."""
    raw = ids.tobytes()
    starts = (np.concatenate([[0], at + gap]) * ids.itemsize).tolist()
    ends = (np.concatenate([at, [len(ids)]]) * ids.itemsize).tolist()
    return {w: raw[a:b] for w, a, b in zip(words, starts, ends, strict=True)}


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary, with the words it remembers."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())])


def encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens, crc, wide, ids of every text; ids are little-endian integers of four bytes if wide, else of two, and end with end_id. crc is that of four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end, size, wide = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize, encoder.dtype.itemsize == 4
        for b in slices(batches, BATCH_ROWS):
            ids = [x + end for x in encoder.texts(b.column(1))]
            crc = [zlib.crc32(np.frombuffer(x, encoder.dtype).astype(IDS)) for x in ids]
            yield batch(ENCODED, b.column(0), [len(x) // size for x in ids], crc, [wide] * len(ids), ids)

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, crc long, wide boolean, ids binary")


def numbers(ids: pa.Array, wide: pa.Array) -> np.ndarray:
    """The ids of a batch, one document after the other."""
    return np.frombuffer(b"".join(ids.to_pylist()), IDS if len(wide) and wide[0].as_py() else "<u2")


def ranks(ids: DataFrame) -> np.ndarray:
    """The ids by falling frequency in all documents; as many as the vocabulary has at most, so they fit the driver and a broadcast."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in slices(batches):
            got = np.bincount(numbers(*b.columns), minlength=len(total))
            got[: len(total)] += total
            total = got
        at = np.flatnonzero(total)
        yield batch(schema, at, total[at])

    found = map_batches(ids.select("ids", "wide"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id")
    return np.array([r.id for r in found.select("id").collect()], IDS)


def pack(values: np.ndarray, lengths: list[int]) -> tuple[list[bytes], list[bytes]]:
    """(control, data) of each of the documents that these unsigned 32-bit values belong to, in their order."""
    n = np.array(lengths, np.int64)
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    four, place = padded(n)
    codes = np.zeros(4 * int(four.sum()), np.uint8)
    codes[place] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()
    ends, data_ends = np.cumsum(four).tolist(), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.cumsum(n)].tolist()
    return [control[a:b] for a, b in zip([0, *ends], ends)], [data[a:b] for a, b in zip([0, *data_ends], data_ends)]


def padded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes of each document, the place of every value among the codes of whole control bytes)."""
    four = -(-n // 4)
    return four, np.arange(int(n.sum())) + np.repeat(4 * (np.cumsum(four) - four) - (np.cumsum(n) - n), n)


#: For each control byte the lengths of its four values.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, data: bytes, lengths: list[int]) -> np.ndarray:
    """The values of documents whose control bytes and data stand one after the other."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[padded(np.array(lengths, np.int64))[1]]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = raw[start]
    for k in (1, 2, 3):
        out |= raw[start + k] << np.uint32(8 * k)
    return out & MASKS[size]


PACKED = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("n_tokens", pa.int64()), ("control", pa.binary()), ("data", pa.binary())])
BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])


@dataclass(frozen=True)
class TokenFile:
    path: str
    ids_by_rank: np.ndarray


def write(docs: DataFrame, tokenizer_path: str, end_id: int, name: str = "tokens") -> TokenFile:
    """Encode docs and write their blocks, a file for each shard of consecutive documents."""
    spark = docs.sparkSession
    ids = written(encoded(docs, tokenizer_path, end_id), f"{name}-ids")
    by_rank = ranks(ids)
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank_of)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = b.column(2).to_pylist()
            shards = [bisect.bisect_right(starts, (d is not None, d or 0, c)) for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield batch(PACKED, shards, b.column(0), b.column(1), n, *pack(sent.value[numbers(b.column(3), b.column(4))], n))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, held, n = 0, [], 0

        def block() -> pa.RecordBatch:
            shards, docs, lengths, control, data = zip(*held, strict=True)
            return batch(BLOCK, [shards[0]], [k], [docs], [lengths], [b"".join(control)], [b"".join(data)])

        for b in slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (n >= BLOCK_IDS or held[0][0] != row[0]):
                    yield block()
                    k, held, n = k + 1 if held[0][0] == row[0] else 0, [], 0
                held.append(row)
                n += row[2]
        if held:
            yield block()

    # Where shards of like numbers of documents start, from the ids alone: one row for each shard.
    n_shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ids.select("doc_id", "crc").repartitionByRange(n_shards, "doc_id", "crc")
    starts = keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), "crc")).alias("s"))
    starts = sorted(tuple(r.s) for r in starts.collect())[1:]
    small = map_batches(ids.select("doc_id", "crc", "n_tokens", "ids", "wide"), packed, "shard int, doc_id long, crc long, n_tokens long, control binary, data binary")
    ordered = small.repartition(n_shards, "shard").sortWithinPartitions("shard", "doc_id", "crc").select("shard", "doc_id", "n_tokens", "control", "data")
    from uuid import uuid4

    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    out = map_batches(ordered, blocks, "shard int, block int, doc_ids array<long>, lengths array<long>, control binary, data binary")
    out.write.option("compression", "zstd").parquet(path)
    return TokenFile(path, by_rank)


DIGEST = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("before", pa.int64())])


def digests(spark, file: TokenFile) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    sent = spark.sparkContext.broadcast(file.ids_by_rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            out = []
            for shard, block, docs, lengths, control, data in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                ids = sent.value[unpack(control, data, lengths)].astype(IDS).tobytes()
                at = 0
                for i, (d, n) in enumerate(zip(docs, lengths, strict=True)):
                    out.append((shard, block, i, d, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), at))
                    at += n
            yield batch(DIGEST, *(list(c) for c in zip(*out, strict=True))) if out else batch(DIGEST, *[[]] * 7)

    blocks = spark.read.parquet(file.path)
    each = map_batches(blocks, run, "shard int, block int, place int, doc_id long, n_tokens long, ids_crc32 long, before long")
    # Where a block starts: the ids of earlier shards, a row each, and of earlier blocks of its own shard.
    sums = blocks.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))
    in_shard = W.partitionBy("shard").orderBy("block")
    starts = sums.select("shard", "block", (F.sum("n").over(in_shard) - F.col("n")).alias("block_start")).join(F.broadcast(shards), "shard")
    return each.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark, write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2))
