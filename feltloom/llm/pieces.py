"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The machine is compiled once from a model file; a text is composed with it, and the shortest path in the tropical semiring
(weights are added along a path, the least total wins) spells the ids.

* Normaliser: an arc from a blank to the mark U+2581, arcs from every other character to itself, and one mark before the text; the
  model's own flags say so. It is composed with the pieces when the machine is compiled: the trie reads a text as it stands.
* Pieces: a trie of all pieces, each an arc from the place where it starts to the place where it ends.
* Byte fallback: the root's default arc. A character that no piece contains takes it, and it writes the ids of the UTF-8 bytes.
* Weights: the model merges pairs by rank, so a path's weight is not a sum of scores. It is known that the ids of a
  merge-based model are the one sequence in which every two neighbours are what merging makes of the two together. The machine
  therefore remembers the piece before, and an arc weighs 0 if merging keeps that pair apart and infinity if not; the single
  finite path is the encoding. A piece that merging would not make of its own characters has no arc. Pairs are judged once and remembered.
* Search: no path weighs less than 0, so the first that reaches the end with 0 is the shortest. States are opened depth first, the arc of the longest
  piece first; a state from which no finite path leads on is dead and never opened again.

No piece holds a mark after another character, so all paths meet before each mark that follows another character. There the problem
falls apart into words, and the path of a word is found once for as long as a worker remembers it: two generations of
``CACHE_WORDS`` words, of which the older one goes when the younger is full, so that the frequent words stay.

Models whose pieces are merged by rank (BPE) with an identity normaliser are covered; others are refused.
Null and empty texts have no ids. Decoding joins the pieces, bytes between them as UTF-8 (broken runs give U+FFFD for each byte), turns marks into blanks and takes
away the first one; it gives back every text without U+2581.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, slices, table

MARK = "▁"
WORD = re.compile(f"[ {MARK}]+[^ {MARK}]*|[^ {MARK}]+")
CACHE_WORDS = 400_000
IDS = np.dtype("<u4")
INFINITY = float("inf")


class Memory(dict):
    """Paths of words, found where they are missing; two generations of bounded size."""

    def __init__(self, find):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, word: str) -> bytes:
        got = self.older.get(word)
        if got is None:
            got = self.find(word)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = got
        return got


class Transducer:
    """Normaliser, pieces and byte fallback of one model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only BPE models with an identity normaliser are covered")
        self.prefix = " " if n.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.shown = ["" if p.type == 3 else p.piece.replace(MARK, " ") for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.bytes = np.array([k == 6 for k in self.kinds])
        self.unknown = self.kinds.index(2)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.score = {p: model.pieces[i].score for p, i in normal.items()}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece holds a mark after another character")
        # Trie: a dict for each node, by character; the id of the piece that ends there at key "". A blank leads where the mark does.
        self.trie: dict = {}
        for p, i in normal.items():
            node = self.trie
            for c in p:
                if c not in node:
                    node[c] = {}
                    if c == MARK:
                        node[" "] = node[c]
                node = node[c]
            node[""] = i
        self.weight_of: dict[tuple[int, int], float] = {}
        self.merges_of: dict[int, list[tuple[str, str, float]] | None] = {}
        self.known = Memory(self.path)

    def merges(self, piece: int) -> list[tuple[str, str, float]] | None:
        """What merging by rank makes of a piece's characters, step by step: first part, last part and the score of the next merge. None if not the piece.

        The best-scored neighbours join, leftmost first, until none can.
        """
        if piece not in self.merges_of:
            parts, steps = list(self.pieces[piece]), []
            while True:
                best, at = -INFINITY, -1
                for i in range(len(parts) - 1):
                    s = self.score.get(parts[i] + parts[i + 1])
                    if s is not None and s > best:
                        best, at = s, i
                steps.append((parts[0], parts[-1], best))
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.merges_of[piece] = steps if len(parts) == 1 else None
        return self.merges_of[piece]

    def apart(self, a: int, b: int) -> bool:
        """Whether merging keeps two pieces apart: until parts join over their seam, each piece merges as it does alone, the better score first."""
        left, right = self.merges(a), self.merges(b)
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            (_, last, s), (first, _, t) = left[i], right[j]
            over = self.score.get(last + first, -INFINITY)
            if over > s and over >= t and over > -INFINITY:
                return False
            if s == t == -INFINITY:
                return True
            if s >= t:
                i += 1
            else:
                j += 1

    def weight(self, before: int, piece: int) -> float:
        """0 or infinity: whether merging keeps the two pieces as they are; -1 stands for a start or a fallback."""
        if before < 0:
            return INFINITY if self.merges(piece) is None else 0.0
        got = self.weight_of.get((before, piece))
        if got is None:
            got = self.weight_of[before, piece] = 0.0 if self.apart(before, piece) else INFINITY
        return got

    def arcs(self, word: str, at: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs that leave a place, the shortest first; without a piece of one character, the fallback: numbered below -1, so that arcs after it start afresh."""
        node, end, out = self.trie, at, []
        while end < len(word) and (node := node.get(word[end])) is not None:
            end += 1
            if (piece := node.get("")) is not None:
                out.append((end, piece))
        if not out or out[0][0] > at + 1:
            out.insert(0, (at + 1, -2 - ord(word[at])))
        return out

    def path(self, word: str) -> bytes:
        """The ids on the shortest path through the word's lattice, little-endian 32-bit. A state is (place, piece before)."""
        n, dead = len(word), set()
        open_ = [(0, -1, self.arcs(word, 0) if n else [])]
        while open_[-1][0] < n:
            at, before, arcs = open_[-1]
            if not arcs:
                dead.add((at, before))
                open_.pop()
                continue
            end, piece = arcs.pop()
            if piece >= 0 and ((end, piece) in dead or self.weight(max(before, -1), piece) == INFINITY):
                continue
            open_.append((end, piece, self.arcs(word, end) if end < n else []))
        out: list[int] = []
        for _, piece, _ in open_[1:]:
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte.get(x, self.unknown) for x in chr(-2 - piece).encode()]
        return np.array(out, IDS).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, WORD.findall(self.prefix + text)))

    def decode(self, ids: np.ndarray) -> str:
        if not self.bytes[ids].any():
            return "".join(map(self.shown.__getitem__, ids.tolist())).removeprefix(self.prefix)
        out, raw = [], bytearray()

        def flush() -> None:
            if raw:
                at = 0
                while at < len(raw):
                    for size in (1, 2, 3, 4):
                        try:
                            out.append(bytes(raw[at : at + size]).decode())
                            at += size
                            break
                        except UnicodeDecodeError:
                            continue
                    else:
                        out.append("�")
                        at += 1
                raw.clear()

        for i in ids.tolist():
            if self.kinds[i] == 6:
                raw.append(int(self.pieces[i][3:5], 16))
            else:
                flush()
                out.append(self.shown[i])
        flush()
        return "".join(out).replace(MARK, " ").removeprefix(self.prefix)


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    """One machine for each worker process and model, with what it remembers."""
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = machine(path)
        for b in slices(batches):
            ids = [t.encode(x) for x in b.column(1).to_pylist()]
            flat = pa.array(np.frombuffer(b"".join(ids), IDS).astype(np.int32))
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
            yield batch(OUT, b.column(0), [len(x) // 4 for x in ids], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = machine(path)
        for b in slices(batches):
            yield batch(schema, b.column(0), [t.decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()])

    return map_batches(rows.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, the unsigned crc32 of the ids as little-endian 32-bit integers, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = machine(path)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            ids = [t.encode(x) for x in texts]
            same = [t.decode(np.frombuffer(x, IDS)) == (text or "") for x, text in zip(ids, texts, strict=True)]
            yield batch(DIGEST, b.column(0), [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], same)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
