"""Best-fit packing of documents into sequences of bounded length, with a bounded number of open bins.

Documents come in the order of their table, some 2,000 at a time with the longest first, and each goes into the fullest open bin that has room for it. The open bins hang on their free
space, and a bitset of ``size + 1`` bits tells which amounts of free space there are: the lowest set bit from a piece's length on is the best fit, the lowest
of all is the fullest bin. A piece that fits nowhere opens a bin; if ``open_bins`` are open then, the fullest closes first. Full bins close at once.

Every task packs the rows of its own split as it encodes them, without a shuffle: any number of rows may share a source, a doc_id or a text.
Only the bins still open at the end of a task, ``open_bins`` at most, are dealt out once more and packed together as wholes, the
longest first, some thousands a task. The sequences are rows of a table (sequence_id, the pieces, their ids), so a lost executor costs a task of one of the two rounds.

Documents longer than a sequence are cut into pieces of full size; only the first piece may be shorter, and only it shares a sequence.
Null texts count as empty; a document without a token is its end id alone. Null and repeated doc_ids are documents like others.
An empty table gives no sequence. Other columns are ignored. The numbers of sequences are unique; they follow the splits of the table.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, slices, table, written
from .token_file import BATCH_ROWS, IDS, LETTERS, Memory, WordEncoder, cut

#: White space of plain texts but the blank, as Arrow's patterns and as regex write it.
WHITE, SPACE = r"\t-\r\x{85}\x{a0}", r"\t-\r\x85\xa0"
#: Texts of these characters, whose classes are the same in every version of Unicode that matters, are split by Arrow.
PLAIN = r"^[\t-\r -~\x{a0}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}]*$"
#: What no pattern without a look ahead can split: white space beside a blank or at an end, and endings after an apostrophe.
TIED = f" [ {WHITE}]|[{WHITE}] |^[ {WHITE}]|[ {WHITE}]$|'(?:s|t|re|ve|m|ll|d)"
#: What a byte-level vocabulary's splitter takes as one: fixed values. Here for plain texts with ties; below for those without, where every blank starts a part.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^ {SPACE}\p{{L}}\p{{N}}]+|[ {SPACE}]+(?![^ {SPACE}])|[ {SPACE}]+")
MARKS, BREAKS = rf"( ?(?:[^ {WHITE}\pL\pN\x00]+|\pN+))", f"([{WHITE}]*)([{WHITE}])"
#: Units of the second round that a task gets, about.
UNITS = 4096


@dataclass(frozen=True)
class Params:
    size: int = 2048
    open_bins: int = 2048
    end_id: int = 0


class ByteEncoder:
    """Ids of a text as bytes, put together from those of its distinct parts.

    Arrow splits plain texts as the vocabulary's splitter does and finds the distinct parts of a batch; numpy gathers their ids. Parts that were not met before
    go to the library's model in one call, whose ids are cut by the bytes that they stand for. Other texts, or with a special token's text, go to the library as they are.
    """

    gathered = WordEncoder.gathered

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # The bytes of a part are letters already, and blanks part the parts.
        spec = json.loads(self.tokenizer.to_str())
        self.model = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
        self.size = np.zeros(1 + max(spec["model"]["vocab"].values()), np.int64)
        self.size[list(spec["model"]["vocab"].values())] = list(map(len, spec["model"]["vocab"]))
        self.letters = dict(enumerate(LETTERS)) | {0: " "}
        self.parts = Memory(self.by_model)

    def by_model(self, parts: list[str]) -> dict[str, bytes]:
        raw = "\0".join(parts).encode()
        ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0)
        ids = np.array(self.model.encode_batch_fast([raw.decode("latin-1").translate(self.letters)], add_special_tokens=False)[0].ids, self.dtype)
        return cut(parts, ids, np.searchsorted(np.cumsum(self.size[ids]), ends - np.arange(len(ends))) + 1, 0)

    def texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null is empty."""
        texts = texts.fill_null("")
        whole = pc.invert(pc.match_substring_regex(texts, PLAIN))
        for x in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        tied = pc.and_not(pc.match_substring_regex(texts, TIED), whole)
        parts = pc.replace_substring(texts.filter(pc.invert(pc.or_(whole, tied))), " ", "\0 ")
        parts = pc.replace_substring_regex(pc.replace_substring_regex(parts, MARKS, "\0\\1\0"), BREAKS, "\0\\1\0\\2\0")
        of_parts, of_tied = iter(self.gathered(pc.split_pattern(parts, "\0"), self.parts)), texts.filter(tied).to_pylist()
        of_tied = iter(self.gathered(pa.array(map(SPLIT.findall, of_tied), pa.list_(pa.string())), self.parts))
        of_whole = (np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, self.dtype).tobytes() for x in texts.filter(whole).to_pylist())
        return [next(of_whole if w else of_tied if t else of_parts) for w, t in zip(whole.to_pylist(), tied.to_pylist(), strict=True)]


_encoders: dict[str, ByteEncoder] = {}


def encoder_of(path: str) -> ByteEncoder:
    """One encoder for each worker process and vocabulary, with what it remembers."""
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


class Bins:
    """At most ``most`` open bins of ``size`` places, found by their free space. ``closed`` gathers the lists of items of closed bins."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.n, self.bits = size, most, 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(size + 1)]
        self.closed: list[list] = []

    def take(self, least: int) -> tuple[list, int] | None:
        """The fullest open bin with that much room, no longer open, and its free space."""
        fit = self.bits >> least
        if not fit:
            return None
        free = least + (fit & -fit).bit_length() - 1
        found = self.by_free[free].pop()
        self.n -= 1
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return found, free

    def put(self, item, length: int) -> None:
        found = self.take(length)
        if found is None:
            if self.n == self.most:
                self.closed.append(self.take(0)[0])
            found = [], self.size
        items, free = found
        items.append(item)
        if free == length:
            self.closed.append(items)
        else:
            self.by_free[free - length].append(items)
            self.bits |= 1 << (free - length)
            self.n += 1

    def rest(self) -> list[list]:
        """All bins that are still open, the fullest first."""
        return [x for row in self.by_free for x in row]


SEQUENCE = pa.schema(
    [("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("open", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary())]
)
SEQUENCE_DDL = "sequence_id long, n_tokens int, open boolean, doc_ids array<long>, pieces array<int>, starts array<long>, lengths array<int>, ids binary"


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole if it fits, else full pieces after a first one of what is left over."""
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def packed(docs: DataFrame, path: str, params: Params = Params()) -> DataFrame:
    """The sequences of docs: sequence_id, n_tokens, doc_ids, pieces, starts, lengths and ids; the pieces stand in the ids one after the other.

    Ids are little-endian integers of two bytes, or of four where the vocabulary needs them.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = encoder_of(path), Bins(params.size, params.open_bins)
        end, width, number = np.array([params.end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize, TaskContext.get().partitionId() << 40

        def sequences(found: list[list], still: bool) -> pa.RecordBatch:
            nonlocal number
            columns = [list(zip(*x, strict=True)) for x in found]
            rows = [(number + i, sum(c[3]), still, *map(list, c[:4]), b"".join(c[4])) for i, c in enumerate(columns)]
            number += len(rows)
            return batch(SEQUENCE, *(map(list, zip(*rows, strict=True)) if rows else [[]] * 8))

        for b in slices(batches, BATCH_ROWS):
            found = [
                (doc, k, at, n, ids[at * width : (at + n) * width])
                for doc, ids in zip(b.column(0).to_pylist(), (x + end for x in encoder.texts(b.column(1))), strict=True)
                for k, (at, n) in enumerate(cuts(len(ids) // width, params.size))
            ]
            for x in sorted(found, key=lambda x: -x[3]):
                bins.put(x, x[3])
                if len(bins.closed) >= 1024:
                    yield sequences(bins.closed, False)
                    bins.closed.clear()
        yield sequences(bins.closed, False)
        yield sequences(bins.rest(), True)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(params.size, 2 * UNITS)
        for b in slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bins.put(row, row[1])
        found = bins.closed + bins.rest()
        for at in range(0, len(found), 1024):
            rows = [(x[0][0], sum(u[1] for u in x), False, *(sum((u[k] for u in x), []) for k in (3, 4, 5, 6)), b"".join(u[7] for u in x)) for x in found[at : at + 1024]]
            yield batch(SEQUENCE, *map(list, zip(*rows, strict=True)))

    once = written(map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), first, SEQUENCE_DDL), "packed-once")
    left = once.where("open")
    tasks = -(-left.count() // UNITS) or 1
    units = left.repartition(tasks, F.xxhash64("sequence_id")).sortWithinPartitions(F.desc("n_tokens"), "sequence_id")
    return once.where("NOT open").unionByName(map_batches(units, second, SEQUENCE_DDL)).drop("open")


PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pieces(sequences: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (as unsigned integers of four bytes), sequence_id and offset of every piece, from the sequences alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for number, n, docs, ks, starts, lengths, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, at = np.frombuffer(raw, IDS if len(raw) == 4 * n else "<u2").astype(IDS).tobytes(), 0
                for doc, k, start, length in zip(docs, ks, starts, lengths, strict=True):
                    out.append((doc, k, start, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), number, at))
                    at += length
            yield batch(PIECE, *(map(list, zip(*out, strict=True)) if out else [[]] * 7))

    columns = ("sequence_id", "n_tokens", "doc_ids", "pieces", "starts", "lengths", "ids")
    return map_batches(sequences.select(*columns), run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op12_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces(packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
