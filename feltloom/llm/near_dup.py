"""Near-duplicate classes: fast similarity sketches, banding, exact verification, connected components.

A document's set holds its distinct runs of ``words`` consecutive words, A-Z in lower case. Documents with
100 * intersection >= percent * union are linked; the class of a document is the least doc_id that links reach.

* Sketch: in round r every element falls into one of t bins with a value that grows with r; a bin keeps its least
  value. Rounds go on until all bins of a set are full, and after t random rounds the r-th round fills bin r - t,
  so every coordinate is filled after 2t rounds at most, in expected time O(set + t log t). The share of equal
  coordinates estimates the similarity with Chernoff-type concentration, also for sets smaller than t.
* Banding: ``bands`` hashes of ``rows`` coordinates. A pair at similarity 0.8 is missed with probability
  (1 - 0.8**5)**32 = 3e-6 at the production parameters.
* Exact copies of a set become one representative before banding, so that groups of copies cost nothing.
* Verification goes in two steps, both on full sets. First every member of a bucket against the bucket's centre
  (the least node of each thousand members, and these against the bucket's least). What is still apart is settled in tiles: the members
  outside of a bucket's largest class meet all members of other classes, in parts of bounded size, and the task that holds both full sets
  intersects them there and then. What it finds linked is one class from there on, so fewer links than members leave a tile, however many pairs are
  looked at; a pair is looked at in the first band that it shares, and not at all if sizes or sketches rule it out
  (a linked pair agrees in fewer than ``agree`` coordinates once in a million). No pair within a class is made.

A node is a distinct set. A doc_id that occurs with several texts has several nodes, which are linked.

Null and empty texts, and texts without words, have an empty set and are linked with nothing; shorter texts are one
shingle. A set of fewer than ``percent / (100 - percent)`` shingles is similar enough to itself only and goes into no bucket. Rows with a null doc_id are classes of their own (component_id null, kept). Repeated rows of a doc_id share a class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, map_batches, slices, table, written
from .graph import components


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    centre_of: int = 1000
    tile: int = 1_000_000  # shingles of a tile's members, and again of those that they meet
    tile_docs: int = 10_000  # and how many they are at most, about

    @property
    def agree(self) -> int:
        """Five standard deviations below the mean of the coordinates that agree at the least similarity."""
        t, s = self.bands * self.rows, self.percent / 100
        return int(t * s - 5 * (t * s * (1 - s)) ** 0.5)


U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
        x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
        return x ^ (x >> U64(33))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of that many words; bytes.split() splits at \\x20 and \\x09-\\x0D."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), U64, len(found))
    k = min(words, len(h))
    run = np.full(len(h) - k + 1, k, U64)
    for i in range(k):
        run = mix(run ^ h[i : len(h) - k + 1 + i])
    return np.unique(run)


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A (sets, t) array of coordinates; a row of an empty set means nothing."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values = np.concatenate(sets) if len(sets) else np.empty(0, U64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    out = np.full(len(sets) * t, np.iinfo(U64).max, U64)
    for r in range(2 * t):
        if not len(values):
            break
        h = mix(values + U64((r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        bins = (h % U64(t)).astype(np.int64) if r < t else np.full(len(h), r - t)
        np.minimum.at(out, owner * t + bins, (U64(r) << U64(52)) | (h >> U64(12)))
        full = (out.reshape(-1, t) != np.iinfo(U64).max).all(1)
        left = ~full[owner]
        values, owner = values[left], owner[left]
    return out.reshape(-1, t)


def banded(sets: list[np.ndarray], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the bands, a byte of every coordinate) of each set."""
    every = sketch(sets, p.bands * p.rows)
    rows = every.reshape(len(sets), p.bands, p.rows)
    keys = np.broadcast_to(np.arange(p.bands, dtype=U64), (len(sets), p.bands))
    for i in range(p.rows):
        keys = mix(keys ^ rows[:, :, i])
    return keys.astype(np.int64), (mix(every) & U64(0xFF)).astype(np.uint8)


FEATURES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])


def features(docs: DataFrame, p: Params) -> DataFrame:
    """Per row: doc_id, a hash of the text, n_shingles, a 128-bit fingerprint of the set, and its band keys (none if the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(x, p.words) for x in b.column(2).to_pylist()]
            keys, _ = banded(sets, p)
            with np.errstate(over="ignore"):
                a = [int(mix(s).sum(dtype=U64).astype(np.int64)) for s in sets]
                c = [int(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64).astype(np.int64)) for s in sets]
            bands = [k if len(s) else [] for k, s in zip(keys, sets, strict=True)]
            yield batch(FEATURES, b.column(0), b.column(1), [len(s) for s in sets], a, c, bands)

    schema = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>"
    return map_batches(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text"), run, schema)


#: How many sets are intersected at once with one.
LOOK = 64
WHOLE = pa.schema([("id", pa.int64()), ("keys", pa.binary()), ("marks", pa.binary()), ("shingles", pa.binary())])


def whole(texts: DataFrame, p: Params) -> DataFrame:
    """id, and as bytes: its band keys, a byte of every coordinate, its full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            sets = [shingles(x, p.words) for x in b.column(1).to_pylist()]
            keys, marks = banded(sets, p)
            yield batch(WHOLE, b.column(0), [k.tobytes() for k in keys], [m.tobytes() for m in marks], [s.tobytes() for s in sets])

    return map_batches(texts.select("doc_id", "text"), run, "id long, keys binary, marks binary, shingles binary")


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verified(pairs: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets.

    The text of every b goes to its a, right after the text of a itself; a task holds one set at a time. An a with many b
    is sent once for each ``centre_of`` of them, so that no task gets them all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for b in slices(batches):
            out_a, out_b = [], []
            for a, x, text in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                s = shingles(text, p.words)
                if x == a:
                    at, own = a, s
                elif at == a:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if both and 100 * both >= p.percent * (len(own) + len(s) - both):
                        out_a.append(a)
                        out_b.append(x)
            yield batch(LINKS, out_a, out_b)

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / p.centre_of).cast("int").alias("parts"))
    parted = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"))
    ends = parted.withColumnRenamed("b", "doc_id").union(own)
    sent = ends.join(docs, "doc_id").select("a", "part", "doc_id", "text")
    sent = sent.repartition("a", "part").sortWithinPartitions("a", "part", F.col("doc_id") != F.col("a"), "doc_id")
    return map_batches(sent, run, "a long, b long")


def meet(band: int, ids: list[int], component: np.ndarray, asked: np.ndarray, keys: np.ndarray, marks: np.ndarray, sets: list[np.ndarray], p: Params) -> Iterator[tuple[int, int]]:
    """Links that join all classes of a tile that the asked members are linked with."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    component, place = component.copy(), np.arange(len(sets))
    for x in np.flatnonzero(asked):
        # Two asked members meet once. Sizes too far apart leave no union small enough.
        at = np.flatnonzero((component != component[x]) & (~asked | (place > x)) & (100 * np.minimum(n, n[x]) >= p.percent * np.maximum(n, n[x])))
        at = at[~(keys[at, :band] == keys[x, :band]).any(1)]
        alike = (marks[at] == marks[x]).sum(1)
        at = at[np.argsort(-alike, kind="stable")[: (alike >= p.agree).sum()]]
        # The most alike first: a link spares the rest of its class.
        while len(at):
            some, at = at[:LOOK], at[LOOK:]
            values = np.concatenate([sets[i] for i in some])
            hit = sets[x][np.minimum(np.searchsorted(sets[x], values), n[x] - 1)] == values
            both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[some]) - n[some])
            for y in some[100 * both >= p.percent * (n[some] + n[x] - both)]:
                if component[y] != component[x]:
                    yield ids[x], ids[y]
                    component[component == component[y]] = component[x]
            at = at[component[at] != component[x]]


def across(inside: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """(a, b): links between members of different classes of a bucket, as many as it takes to join the classes that are linked there.

    inside: band, key, id, n_shingles, component, major. Both sides of a bucket are cut into parts of ``tile`` shingles by a hash of the id;
    a tile is a part of the members and a part of those outside of the largest class.
    """
    minor = F.col("component") != F.col("major")
    some = lambda of: F.ceil(F.greatest(F.sum(F.when(of, F.col("n_shingles"))) / p.tile, F.count_if(of) / p.tile_docs)).cast("int")
    parts = inside.groupBy("band", "key").agg(some(F.lit(True)).alias("rows"), F.greatest(some(minor), F.lit(1)).alias("cols"))
    ids = inside.select(F.col("id").alias("doc_id")).distinct()
    full = written(whole(texts.join(ids, "doc_id", "left_semi"), p), "full-sets")
    dealt = inside.join(parts, ["band", "key"]).withColumns({"row": F.pmod(F.xxhash64("id"), F.col("rows")), "col": F.when(minor, F.pmod(F.xxhash64("id", F.lit(1)), F.col("cols")))})
    # Every member goes to its row of tiles; one that is asked also to its column, where it isn't already.
    to_row = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda c: F.struct(F.col("row").cast("int").alias("row"), c.alias("col"), F.coalesce(c == F.col("col"), F.lit(False)).alias("asked")))
    to_col = F.transform(F.filter(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: r != F.col("row")), lambda r: F.struct(r.alias("row"), F.col("col").cast("int").alias("col"), F.lit(True).alias("asked")))
    tiles = dealt.withColumn("t", F.explode(F.when(minor, F.concat(to_row, to_col)).otherwise(to_row))).select("band", "key", "t.row", "t.col", "t.asked", "id", "component")
    tiles = tiles.join(full, "id").select("band", "key", "row", "col", "asked", "id", "component", "keys", "marks", "shingles")
    tiles = tiles.repartition("band", "key", "row", "col").sortWithinPartitions("band", "key", "row", "col", "id")

    def settle(held: list[tuple]) -> pa.RecordBatch:
        asked, ids, component, keys, marks, sets = zip(*(r[4:] for r in held), strict=True)
        found = meet(
            held[0][0], ids, np.array(component), np.array(asked), np.frombuffer(b"".join(keys), np.int64).reshape(len(ids), -1),
            np.frombuffer(b"".join(marks), np.uint8).reshape(len(ids), -1), [np.frombuffer(s, U64) for s in sets], p,
        )
        a, b = zip(*found, strict=True) if (found := list(found)) else ([], [])
        return batch(LINKS, list(a), list(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in slices(batches):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and r[:4] != held[0][:4]:
                    yield settle(held)
                    held = []
                held.append(r)
        if held:
            yield settle(held)

    return map_batches(tiles, run, "a long, b long")


def classes(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id for every row of docs."""
    found = written(features(docs, p), "features")
    nonempty = found.where("n_shingles > 0 AND doc_id IS NOT NULL")
    fingerprint = ["set_a", "set_b", "n_shingles"]
    least_row = F.min(F.struct("doc_id", "text_key", "bands")).alias("m")
    nodes = nonempty.groupBy(*fingerprint).agg(least_row).select(*fingerprint, "m.*").withColumn("id", F.monotonically_increasing_id())
    nodes = written(nodes, "nodes")  # ids are fixed here
    # Another set is similar enough only if it has an element more or less at best; so the smallest sets are linked with no other.
    large = nodes.where(F.col("n_shingles") * (100 - p.percent) >= p.percent)
    members = large.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(members.join(shared, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / p.centre_of))), "members")
    # Only nodes that share a bucket are compared: theirs are the texts that later rounds send about.
    needed = nodes.select("doc_id", "text_key", "id").join(members.select("id").distinct(), "id", "left_semi")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").join(needed, ["doc_id", "text_key"])
    texts = written(texts.groupBy(F.col("id").alias("doc_id")).agg(F.first("text").alias("text")), "texts")  # repeated rows have equal texts

    least = members.groupBy("band", "key", "part").agg(F.min("id").alias("centre"))
    top = least.groupBy("band", "key").agg(F.min("centre").alias("top"))
    to_centre = members.join(least, ["band", "key", "part"]).select(F.col("centre").alias("a"), F.col("id").alias("b"))
    to_top = least.join(top, ["band", "key"]).select(F.col("top").alias("a"), F.col("centre").alias("b"))
    tried = written(to_centre.union(to_top).where("a <> b").distinct(), "pairs")
    # The nodes of a doc_id that occurs with several sets are one document.
    several = nonempty.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = nonempty.join(several, "doc_id").join(nodes.select(*fingerprint, "id"), fingerprint).select("doc_id", "id")
    same = several.join(several.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b").distinct()
    links = written(verified(tried, texts, p).union(same), "links")
    label = written(components(links), "components")

    # Members of buckets that hold several classes, with their class and the bucket's largest one.
    known = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    known = written(known.select("band", "key", "id", "n_shingles", "component"), "known")
    per = known.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    mixed = per.groupBy("band", "key").agg(F.count("*").alias("k"), F.max_by("component", F.struct("n", "component")).alias("major")).where("k > 1")
    inside = written(known.join(mixed.select("band", "key", "major"), ["band", "key"]), "mixed")
    new = written(across(inside, texts, p), "links-of-tiles")
    if not new.isEmpty():
        label = written(components(links.union(new)), "classes")

    # A class is named by the least doc_id of its nodes.
    names = label.join(nodes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = nodes.join(label, "id", "left").join(names, "component", "left").select(*fingerprint, F.coalesce("component_id", "doc_id").alias("component_id"))
    out = found.drop("bands").join(named, fingerprint, "left")
    return out.select("doc_id", "text_key", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One document of each class, the one with the least doc_id, and once only (of several texts, the one whose hash is least); rows without doc_id all stay."""
    decided = classes(docs, p).where("doc_id = component_id").groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    cols = docs.columns
    own = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    key, text = f"c{cols.index('doc_id')}", f"c{cols.index('text')}"
    chosen = decided.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text"))
    kept = own.join(chosen, (F.col(key).cast("long") == F.col("k_id")) & (F.xxhash64(text) == F.col("k_text")), "left_semi").dropDuplicates([key])
    return kept.union(own.where(F.col(key).isNull()).select(kept.columns)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"), Params(words=2)).drop("text_key")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
