"""Phrase collocations from weighted acyclic automata over n-grams.

A task reads its rows in segments, sorts each segment's word windows (as many words as a phrase may have, cut short at a piece's end) and builds from them, level by level,
a count transducer: an arc's weight is how often the phrase up to it occurs, so every prefix of a window has its count. States with equal arcs onward are
one, from the last level back. Transducers are cut at the same bounds, prefixes of the order of words, in every task, and each range's parts travel as one row each; a range's task unites them by
summing weights. What lies below the least count stays there: only frequent phrases leave a range, and the few prefixes that reach over its bounds, whose weights are added up afterwards.

Every part of a frequent phrase is frequent itself. So the counts of all first parts of a phrase are the arc weights on its own path through the transducer of the frequent phrases of its range,
and those of all last parts the same with phrases read backwards: each range composes its phrases with its transducer, forwards and backwards, and no lookup of a very frequent word meets in one task.

The bounds come from a sample of at most ``sample_docs`` documents and only balance the ranges; they change no result. A phrase, word or language that holds a third of all rows
is one path, counted in every segment first. Everything is counted for each language; null languages are ``und``. Words are lower-cased in A-Z. Null and empty texts have no words, repeated rows count
each time, doc_id and other columns are ignored, an empty table has no phrases. Counts are exact; scores are computed in decimals.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, map_batches, slices, table, written

#: What ends a piece, and the mark put there, which no word holds.
PIECE_ENDS, END = r"[.,;:!?\n-\r]+", "."
#: Words of the longest phrases.
DEPTH = 4
#: Words that a task holds before it makes a transducer of them, about.
SEGMENT = 1_000_000
#: Windows of a range, about, and the most ranges.
RANGE_WINDOWS, MOST_RANGES = 1_000_000, 20_000
#: Windows of a range that its task holds before it unites them, at least.
HELD_WINDOWS = 250_000


@dataclass(frozen=True)
class Params:
    least: int = 30
    top: int = 2000
    #: A phrase goes if a longer one occurs at least so many percent as often.
    covered: int = 80
    sample_docs: int = 4000


def keyed(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Each row of four numbers up to ``most`` as one number, or as two where they don't fit into one, in the order of the rows."""
    bits = max(int(most).bit_length(), 1)
    one = bits * DEPTH <= 64
    out = []
    for at in range(0, DEPTH, DEPTH if one else 2):
        key = rows[:, at].astype(np.uint64)
        for i in range(at + 1, at + (DEPTH if one else 2)):
            key <<= np.uint64(bits)
            key |= rows[:, i].astype(np.uint64)
        out.append(key)
    return out


def of_keys(keys: list[np.ndarray], most: int) -> np.ndarray:
    """The rows that ``keyed`` made these of."""
    bits = max(int(most).bit_length(), 1)
    rows, step = np.empty((len(keys[0]), DEPTH), np.int32), DEPTH // len(keys)
    for d in range(DEPTH):
        rows[:, d] = (keys[d // step] >> np.uint64(bits * (step - 1 - d % step))) & np.uint64((1 << bits) - 1)
    return rows


def added_up(keys: list[np.ndarray], n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of these keys in order, and the sums of their n. The list of keys is used up."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    n, fresh = n[order], np.zeros(len(order), bool)
    fresh[:1] = True
    for i, key in enumerate(keys):
        keys[i] = key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    del order, key
    first = np.flatnonzero(fresh)
    keys[:] = [x[first] for x in keys]
    return of_keys(keys, most), np.add.reduceat(n, first, dtype=np.int64) if len(first) else n.astype(np.int64)


def summed(rows: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and the sums of their n."""
    return added_up(keyed(rows, most), n, most)


def merged(starts: np.ndarray, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the state that each state becomes, starts, arcs) after states with equal arcs are made one; states keep the order of their first ones."""
    size, own = np.diff(starts), np.arange(len(starts) - 1)
    mix = arcs.astype(np.uint64) * np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    mix = mix[:, 0] ^ (mix[:, 1] >> np.uint64(7)) ^ (mix[:, 2] << np.uint64(9)) ^ mix[:, 2]
    ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))])[starts]
    _, first, group = np.unique(ends[1:] - ends[:-1], return_index=True, return_inverse=True)
    like = first[group]
    # A hash brings likely equals together, the arcs themselves decide.
    like = np.where(size[like] == size, like, own)
    n = np.where(like < own, size, 0)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    apart = (arcs[np.repeat(starts[:-1], n) + at] != arcs[np.repeat(starts[like], n) + at]).any(1)
    like[np.repeat(own, n)[apart]] = np.repeat(own, n)[apart]
    kept = np.flatnonzero(like == own)
    n = size[kept]
    new = np.zeros(len(size), np.int64)
    new[kept] = np.arange(len(kept))
    return new[like], np.concatenate([[0], np.cumsum(n)]), arcs[np.repeat(starts[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def planes(x: np.ndarray) -> bytes:
    """Width and length, and the numbers in the least width that holds them, all first bytes, then all second ones and so on."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return np.array([kind.itemsize, len(x)], "<i8").tobytes() + x.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def of_planes(raw: memoryview, at: int) -> tuple[np.ndarray, int]:
    """(the numbers that lie there, where they end)."""
    width, n = np.frombuffer(raw, "<i8", 2, at).tolist()
    found = np.frombuffer(raw, np.uint8, width * n, at + 16).reshape(width, n)
    return np.ascontiguousarray(found.T).view(f"<u{width}").ravel(), at + 16 + width * n


def sizes_and_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    _, ends, text = words.buffers()
    ends = np.frombuffer(ends, "<i4", len(words) + 1, 4 * words.offset)
    return np.diff(ends), np.frombuffer(text or b"", np.uint8)[ends[0] : ends[-1]]


@dataclass
class Transducer:
    """Words in order, and for each level the first arc of every state and the arcs (label, weight, target); label i is words[i - 1], and 0 is none."""

    words: pa.Array
    starts: list[np.ndarray]
    arcs: list[np.ndarray]

    @classmethod
    def of(cls, words: pa.Array, rows: np.ndarray, n: np.ndarray, *, totals: bool = True, shared: bool = True) -> Transducer:
        """From distinct rows in order, 0 after their end. An arc weighs the sum of n of the rows along it, or without ``totals`` the n of the row that ends there. States with equal arcs become one if ``shared``."""
        fresh, parents = np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        fresh[:1] = True
        starts, arcs, n_states = [], [], 1
        for d in range(DEPTH):
            fresh = fresh | np.concatenate([[True], rows[1:, d] != rows[:-1, d]])[: len(rows)]
            at = np.flatnonzero(fresh)
            weight = np.add.reduceat(n, at) if totals and len(at) else n[at]
            real = rows[at, d] > 0
            label, weight, parent = rows[at, d][real], weight[real], parents[at][real]
            starts.append(np.searchsorted(parent, np.arange(n_states + 1)))
            arcs.append(np.stack([label, weight, np.arange(len(label))], 1).astype(np.int64))
            group = np.cumsum(np.where(fresh & (rows[:, d] > 0), 1, 0)) - 1
            parents, n_states = group, len(label)
        arcs[-1][:, 2] = 0
        for d in range(DEPTH - 1, 0, -1) if shared else ():
            new, starts[d], arcs[d] = merged(starts[d], arcs[d])
            arcs[d - 1][:, 2] = new[arcs[d - 1][:, 2]]
        return cls(words, starts, arcs)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct rows that it was made of and their n, in no order."""
        state, path, left = np.zeros(1, np.int64), np.zeros((1, DEPTH), np.int32), None
        out = []
        for d in range(DEPTH):
            n = np.diff(self.starts[d])[state]
            ends = np.cumsum(n)
            at = np.repeat(self.starts[d][state] - (ends - n), n) + np.arange(n.sum())
            arcs = self.arcs[d][at]
            if left is not None:
                rest = left - np.diff(np.concatenate([[0], np.cumsum(arcs[:, 1])])[np.concatenate([[0], ends])])
                out.append((path[rest > 0], rest[rest > 0]))
            path = np.repeat(path, n, 0)
            path[:, d] = arcs[:, 0]
            state, left = arcs[:, 2], arcs[:, 1]
        out.append((path, left))
        return np.concatenate([p for p, _ in out]), np.concatenate([n for _, n in out])

    def frequent(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length the paths that weigh ``least`` at least, and the first and the last path that go on, with their weights."""
        state, path = np.zeros(1, np.int64), np.zeros((1, DEPTH), np.int64)
        edge = np.ones((2, 1), bool)
        for d in range(DEPTH):
            n = np.diff(self.starts[d])[state]
            arcs = self.arcs[d][np.repeat(self.starts[d][state] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            path = np.repeat(path, n, 0)
            path[:, d] = arcs[:, 0]
            # The first path of all has no arc where its row ends; then none that goes on is at that edge.
            edge = np.repeat(edge, n, 1)
            edge[0, 1:] = edge[1, :-1] = False
            keep = (arcs[:, 1] >= least) | edge.any(0)
            yield path[keep, : d + 1], arcs[keep, 1]
            state, path, edge = arcs[keep, 2], path[keep], edge[:, keep]

    def composed(self, rows: np.ndarray) -> np.ndarray:
        """The weights along each row's path, 0 where it has ended or leaves the transducer."""
        out, state, on = np.zeros((len(rows), DEPTH), np.int64), np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        span = len(self.words) + 1
        for d in range(DEPTH):
            arcs = self.arcs[d]
            have = np.repeat(np.arange(len(self.starts[d]) - 1), np.diff(self.starts[d])) * span + arcs[:, 0]
            at = np.searchsorted(have, state * span + rows[:, d])
            on &= (at < len(have)) & (rows[:, d] > 0)
            at = np.where(on, at, 0)
            on &= have[at] == state * span + rows[:, d] if len(have) else False
            out[on, d] = arcs[at[on], 1]
            state = arcs[at, 2] if len(have) else state
        return out

    def to_bytes(self) -> bytes:
        """Words, the sizes of states and arcs, compressed. The target of an arc is 0 where a state comes for the first time, as states are in the order in which arcs lead to them."""
        out = [planes(x) for x in sizes_and_bytes(self.words)]
        for starts, arcs in zip(self.starts, self.arcs, strict=True):
            target = arcs[:, 2]
            old = target <= np.concatenate([[-1], np.maximum.accumulate(target)])[:-1]
            out += [planes(np.diff(starts)), planes(arcs[:, 0]), planes(arcs[:, 1]), planes(np.where(old, target + 1, 0))]
        raw = b"".join(out)
        return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, "zstd", asbytes=True)

    @classmethod
    def from_bytes(cls, packed: bytes) -> Transducer:
        raw = memoryview(pa.decompress(memoryview(packed)[8:], int(np.frombuffer(packed, "<i8", 1)[0]), "zstd"))
        found, at = [], 0
        for _ in range(2 + 4 * DEPTH):
            x, at = of_planes(raw, at)
            found.append(x)
        size, text, *found = found
        ends = np.concatenate([[0], np.cumsum(size)]).astype("<i4")
        words = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(text)])
        starts, arcs = [], []
        for size, label, weight, code in zip(*(found[i::4] for i in range(4)), strict=True):
            starts.append(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]))
            target = code.astype(np.int64) - 1
            target[code == 0] = np.arange(np.count_nonzero(code == 0))
            arcs.append(np.stack([label, weight, target], 1, dtype=np.int64, casting="unsafe"))
        return cls(words, starts, arcs)


def renumbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the distinct words in order, for each word its label)."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    label = np.empty(len(order), np.int32)
    label[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), label[coded.indices.to_numpy()]


def part(words: pa.Array, rows: np.ndarray, n: np.ndarray) -> Transducer:
    """A transducer of some rows, with the words that they have."""
    seen = np.zeros(len(words) + 1, bool)
    seen[rows] = True
    seen[0] = False
    used = np.flatnonzero(seen)
    label = np.zeros(len(words) + 1, np.int32)
    label[used] = np.arange(1, len(used) + 1)
    return Transducer.of(words.take(pa.array(used - 1)), label[rows], n)


#: Words in order, distinct rows of their labels in order, and how often each row occurs.
Counted = tuple[pa.Array, np.ndarray, np.ndarray]


def counted(parts: Iterable[Counted]) -> Counted:
    """All rows of several, with the sums of their n."""
    words, rows, n = [], [], []
    for w, r, k in parts:
        words.append(w)
        rows.append(r.astype(np.min_scalar_type(len(w))))
        n.append(k.astype(np.min_scalar_type(int(k.max(initial=0)))))
    sizes = np.cumsum([0, *map(len, words)])
    words, label = renumbered(pa.concat_arrays(words))
    keys = []
    for i, r in enumerate(rows):
        own = np.concatenate([np.zeros(1, np.int32), label[sizes[i] : sizes[i + 1]]])
        keys.append(keyed(own[r], len(words)))
        rows[i] = None
    keys = [np.concatenate(x) for x in zip(*keys, strict=True)]
    return words, *added_up(keys, np.concatenate(n), len(words))


def united(parts: list[Transducer]) -> Transducer:
    """The transducer whose weights are the sums of theirs."""
    return Transducer.of(*counted((t.words, *t.rows()) for t in parts))


def trimmed(rows: np.ndarray, n: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows, each ended after its longest part from the start that weighs ``least`` at least or leads to the first or the last row. The weights of such parts stay."""
    fresh, on, rows = np.zeros(len(rows), bool), np.ones(len(rows), bool), rows.copy()
    fresh[:1] = True
    for d in range(DEPTH):
        # Rows are as they were from here on.
        fresh[1:] |= rows[1:, d] != rows[:-1, d]
        at = np.flatnonzero(fresh)
        keep = np.add.reduceat(n, at) >= least if len(at) else np.zeros(0, bool)
        keep[:1] = keep[-1:] = True
        on &= np.repeat(keep, np.diff(at, append=len(rows)))
        rows[~on, d] = 0
    return summed(rows, n, most)


def give_back() -> None:
    """Arrow's free memory goes back to the system; the executor's other processes need it."""
    pa.default_memory_pool().release_unused()


def flat_words(texts: pa.Array) -> pa.Array:
    """The words of these texts, one after the other, with END after every piece."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts.fill_null("")), PIECE_ENDS, f" {END} ")
    words = pc.ascii_split_whitespace(pc.binary_join_element_wise(marked, END, " ")).flatten()
    return words.filter(pc.not_equal(words, ""))


def windows(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the distinct words in order, a row of labels for every word and those after it in its piece)."""
    names, label = renumbered(words)
    if (ends := pc.index(names, END).as_py() + 1) > 0:
        names = names.filter(pc.not_equal(names, END))
        label = np.where(label == ends, 0, label - (label > ends).astype(np.int32))
    at, wide = np.flatnonzero(label), np.concatenate([label, np.zeros(DEPTH, np.int32)])
    rows = np.empty((len(at), DEPTH), np.int32)
    rows[:, 0] = wide[at]
    for i in range(1, DEPTH):
        rows[:, i] = wide[at + i] * (rows[:, i - 1] > 0)
    return names, rows


PARTS = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("n", pa.int64()), ("part", pa.binary())])
Bound = tuple[bytes, ...]


def by_lang(b: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = b.column(0)
    for lang in pc.unique(langs).to_pylist():
        yield lang, b.column(1).filter(pc.equal(langs, lang))


def parts(docs: DataFrame, bounds: list[Bound]) -> DataFrame:
    """lang, range, n (words), part: the parts of every segment's transducer. A range starts at its bound (language, then words)."""

    def made(lang: str, held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        words = pa.concat_arrays(held)
        held.clear()
        names, rows = windows(words)
        del words
        rows, n = summed(rows, np.ones(len(rows), np.int32), len(names))
        raw, own = names.cast(pa.binary()), lang.encode()
        key = lambda i: (own, *(raw[c - 1].as_py() for c in rows[i].tolist() if c))
        # Bounds of other languages lie before or after all rows.
        first, last = bisect.bisect_left(bounds, (own,)), bisect.bisect_left(bounds, (own + b"\0",))
        cuts = [bisect.bisect_left(range(len(rows)), x, key=key) for x in bounds[first:last]]
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True), first):
            if a < b:
                t = part(names, rows[a:b], n[a:b])
                yield batch(PARTS, [lang], [k], [int(n[a:b].sum())], [t.to_bytes()])

    def ended(held: dict[str, list[pa.Array]]) -> Iterator[pa.RecordBatch]:
        while held:
            yield from made(*held.popitem())
            give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size = 0
        for b in slices(batches):
            for lang, texts in by_lang(b):
                words = flat_words(texts)
                held.setdefault(lang, []).append(words)
                size += len(words)
            if size >= SEGMENT:
                yield from ended(held)
                size = 0
        yield from ended(held)

    return map_batches(docs, run, "lang string, range int, n long, part binary")


SAMPLED = pa.schema([("key", pa.list_(pa.binary()))])


def bounds_of(docs: DataFrame, params: Params) -> list[Bound]:
    """Where the ranges start. A sample of documents, and of their windows, reaches the driver: 80,000 windows at most."""
    step, spark = 29, docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for lang, texts in by_lang(b):
                names, rows = windows(flat_words(texts))
                raw = names.cast(pa.binary()).to_pylist()
                yield batch(SAMPLED, [[lang.encode(), *(raw[c - 1] for c in r if c)] for r in rows[::step].tolist()])

    total = docs.count()
    share = min(1.0, params.sample_docs / max(total, 1))
    some = docs.where(F.rand(7) < share)
    found = sorted(tuple(map(bytes, r.key)) for r in map_batches(some, run, "key array<binary>").orderBy(F.xxhash64("key")).limit(80_000).collect())
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = min(max(least, int(step * len(found) / share / RANGE_WINDOWS)), MOST_RANGES, max(len(found), 1))
    return sorted({found[len(found) * i // n] for i in range(1, n)})


COUNTS = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64())])


def frequent(made: DataFrame, n_ranges: int, least: int) -> DataFrame:
    """lang, words, f of every phrase of up to four words that occurs ``least`` times."""

    def kept(lang: str, words: pa.Array, rows: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        # Those at the edges of the range may go on in the ranges beside.
        t, out = Transducer.of(words, *trimmed(rows, n, least, len(words)), shared=False), []
        names = [None, *words.to_pylist()]
        for paths, f in t.frequent(least):
            out += [(lang, [names[c] for c in r], k) for r, k in zip(paths.tolist(), f.tolist(), strict=True)]
        return batch(COUNTS, *map(list, zip(*out, strict=True)))

    def opened(packed: list[bytes]) -> Iterator[Counted]:
        # One at a time: as arcs they are many times as large.
        for x in packed:
            t = Transducer.from_bytes(x)
            yield t.words, *t.rows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, size, at = [], [], 0, None
        for b in slices(batches, 16):
            for lang, k, n, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at and at != (k, lang):
                    yield kept(at[1], *counted([*done, *opened(held)]))
                    done, held, size = [], [], 0
                    give_back()
                at = k, lang
                held.append(packed)
                size += n
                # What is united already is gone through again only for as many new windows.
                if size >= max([HELD_WINDOWS, *(len(x) for _, _, x in done)]):
                    done, held, size = [counted([*done, *opened(held)])], [], 0
                    give_back()
        if at:
            yield kept(at[1], *counted([*done, *opened(held)]))

    dealt = made.repartition(n_ranges, "range").sortWithinPartitions("range", "lang")
    found = map_batches(dealt, run, "lang string, words array<string>, f long")
    return found.groupBy("lang", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


PLACED = pa.schema([("range", pa.int32()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("f", pa.int64()), ("own", pa.bool_())])
LOOKED_UP = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("weights", pa.list_(pa.int64()))])


def looked_up(found: DataFrame, bounds: list[Bound], name: str) -> DataFrame:
    """lang, words, name: for every phrase of two words and more, how often its first one, two, ... words occur."""
    over: dict[Bound, list[int]] = {}
    for k, x in enumerate(bounds, 1):
        for d in range(2, len(x) + 1):
            over.setdefault(x[:d], []).append(k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            out = []
            for lang, words, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = (lang.encode(), *(w.encode() for w in words))
                own = bisect.bisect_right(bounds, key)
                out += [(k, lang, words, f, k == own) for k in {own, *over.get(key, ())}]
            yield batch(PLACED, *(map(list, zip(*out, strict=True)) if out else [[]] * 5))

    def compose(lang: str, words: list[list[str]], f: list[int], own: list[bool]) -> pa.RecordBatch:
        names, label = renumbered(pa.array([w for x in words for w in x], pa.string()))
        size = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.zeros((len(words), DEPTH), np.int64)
        rows[np.repeat(np.arange(len(words)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = label
        order = np.lexsort(keyed(rows, len(names))[::-1])
        t = Transducer.of(names, rows[order], np.array(f, np.int64)[order], totals=False)
        wanted = np.flatnonzero(np.array(own) & (size > 1)).tolist()
        weights = t.composed(rows[wanted]).tolist()
        return batch(LOOKED_UP, [lang] * len(wanted), [words[i] for i in wanted], [w[: len(words[i])] for i, w in zip(wanted, weights, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for b in slices(batches, 2048):
            for k, lang, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and at != (k, lang):
                    yield compose(at[1], *map(list, zip(*held, strict=True)))
                    held = []
                at = k, lang
                held.append(rest)
        if held:
            yield compose(at[1], *map(list, zip(*held, strict=True)))

    placed = map_batches(found.select("lang", "words", "f"), place, "range int, lang string, words array<string>, f long, own boolean")
    dealt = placed.repartition(len(bounds) + 1, "range").sortWithinPartitions("range", "lang")
    return map_batches(dealt, run, f"lang string, words array<string>, {name} array<long>")


def collocations(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    bounds = bounds_of(docs, params)
    made = written(parts(docs, bounds), "collocation-parts")
    found = written(frequent(made, len(bounds) + 1, params.least), "collocation-counts")
    totals = made.groupBy("lang").agg(F.sum("n").alias("n"))
    back = found.select("lang", F.reverse("words").alias("words"), "f")
    first = looked_up(found, bounds, "firsts")
    last = looked_up(back, bounds, "lasts").select("lang", F.reverse("words").alias("words"), "lasts")
    size, k = F.size("words"), "k -> named_struct('score', (a2 div (CAST(firsts[k - 1] AS DECIMAL(20)) + lasts[size(words) - k - 1])), 'k', k, 'l', firsts[k - 1], 'r', lasts[size(words) - k - 1])"
    cut = first.join(last, ["lang", "words"]).withColumn("a", F.element_at("firsts", size)).withColumn("a2", F.expr("CAST(a AS DECIMAL(20)) * 2000000"))
    cut = cut.select("lang", "words", "a", F.expr(f"array_min(transform(sequence(1, size(words) - 1), {k}))").alias("c"))
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")
    longer = found.where(size > 2).select("lang", F.explode(inner).alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("longer"))
    left = cut.join(longer, ["lang", "words"], "left").where(F.expr(f"longer IS NULL OR CAST(100 AS DECIMAL(20)) * longer < CAST({params.covered} AS DECIMAL(20)) * a"))
    rows = left.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of op13's rows, by plain counting."""
    p, cap = Params(), "".join(map(chr, range(65, 91)))
    part = lambda a, b: f"array_to_string(string_split(c.phrase, ' ')[{a}:{b}], ' ')"
    return f"""
    WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{cap}', '{cap.lower()}'), '[.,;:!?\\n-\\r]')) AS x FROM documents),
    words AS (SELECT lang, list_filter(regexp_split_to_array(x, '[ \\t]+'), lambda w: w <> '') AS ws FROM piece),
    total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang),
    placed AS (SELECT lang, unnest(list_transform(generate_series(1, len(ws)), lambda i: ws[i : i + 3])) AS ws FROM words),
    f AS MATERIALIZED (SELECT lang, m, array_to_string(ws[1 : m], ' ') AS phrase, count(*)::HUGEINT AS f FROM placed, generate_series(1, {DEPTH}) g(m) WHERE m <= len(ws) GROUP BY ALL),
    c AS MATERIALIZED (SELECT * FROM f WHERE m > 1 AND f >= {p.least}),
    cut AS (SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, 2000000 * c.f // (l.f + r.f) AS score FROM c, generate_series(1, {DEPTH - 1}) g(k)
            JOIN f l ON l.lang = c.lang AND l.phrase = {part('1', 'k')} JOIN f r ON r.lang = c.lang AND r.phrase = {part('k + 1', 'c.m')} WHERE k < c.m),
    lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (SELECT c.lang, {part('i', 'i + s - 1')} AS phrase, max(c.f) AS f FROM c, generate_series(2, {DEPTH - 1}) g(s), generate_series(1, {DEPTH - 1}) h(i) WHERE s < c.m AND i + s - 1 <= c.m GROUP BY ALL),
    kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE longer.f IS NULL OR 100 * longer.f < {p.covered} * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
    FROM kept JOIN total USING (lang) QUALIFY rank <= {p.top}"""
