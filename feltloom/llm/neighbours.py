"""Approximate nearest neighbours: a hierarchical k-means tree, searched best-bin-first.

Nearness is the inner product. Vectors get one more component, sqrt(M^2 - |x|^2) with M the greatest norm, and queries a zero
there, which turns the largest inner product into the least distance; the tree is built in that space.

* The tree is fitted on the driver from at most ``sample`` distinct vectors, chosen by hash: its size is bounded. Every
  vector is then sent down the tree on the executors; leaves are stored in blocks of bounded size.
* A query walks the tree with a priority queue of branches, nearest centre first, and so gets its leaves in best-bin-first order.
* How many leaves to visit is calibrated, not guessed: for ``calibrate`` query vectors the exact answer is found by a scan of
  all vectors in blocks, and visits are widened until their recall, the query's own vector not counted, reaches ``recall``.
* Visits widen in rounds, each up to ``widen`` times the leaves of the ones before. What a query has found so far gives it a floor, the score
  of its (k + 1)-th best; a leaf of a later round returns only what reaches it. So the rows that a query gets back grow with the number of
  rounds, the logarithm of its visits, and not with the vectors it is held against. No answer is lost by it.
* Leaves are searched in blocks: a leaf's vectors and the queries that visit it are cut into parts of bounded size, cogrouped, and scored in
  double precision on the original vectors. The queries of a batch travel to a leaf in one row.

Equal vectors are one: each distinct vector carries its k + 1 least ids, which is all that any answer can hold, and equal queries are searched once,
so a vector that a third of all rows share costs no more than another. Rows with a null id or vector, a null or
non-finite component, or only zeros take no part, nor do those of another length than most vectors have, as no inner product
with the others is defined. With fewer than k candidates, all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, map_batches, slices, table, written


@dataclass(frozen=True)
class Params:
    k: int = 20
    leaf: int = 50
    max_leaves: int = 4096
    branch: int = 8
    sample: int = 40_000
    calibrate: int = 64
    recall: float = 0.93
    first: int = 4  # leaves of the first round
    widen: int = 4
    block: int = 4000
    every: int = 20
    seed: int = 3


# ---------------------------------------------------------------- the tree


@dataclass
class Tree:
    """Nodes in arrays: centres[i], and children[i] as node numbers (none: a leaf)."""

    centres: np.ndarray
    children: list[list[int]]
    leaf_of: dict[int, int]

    def send(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest centre at every level."""
        at = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            moved = []
            for node in np.unique(at[open_]):
                rows = open_[at[open_] == node]
                kids = self.children[node]
                if not kids:
                    continue
                at[rows] = np.array(kids)[nearest(x[rows], self.centres[kids])]
                moved.append(rows)
            open_ = np.concatenate(moved) if moved else np.empty(0, np.int64)
        return np.fromiter((self.leaf_of[i] for i in at), np.int64, len(at))

    def orders(self, q: np.ndarray, most: int) -> list[list[int]]:
        """For each query up to ``most`` leaves, best bin first: the branch with the nearest centre is always opened next."""
        out = []
        for d in ((self.centres**2).sum(1) - 2 * q @ self.centres.T).tolist():
            heap, found = [(0.0, 0)], []
            while heap and len(found) < most:
                _, node = heapq.heappop(heap)
                if kids := self.children[node]:
                    for k in kids:
                        heapq.heappush(heap, (d[k], k))
                else:
                    found.append(self.leaf_of[node])
            out.append(found)
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def grow(x: np.ndarray, leaves: int, p: Params) -> Tree:
    """Split the largest leaf into ``branch`` parts until there are about that many leaves."""
    rng = np.random.default_rng(p.seed)
    centres, children = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]]
    heap = [(-len(x), 0, np.arange(len(x)))]
    n = 1
    while heap and n < leaves and -heap[0][0] > 2 * p.branch:
        _, node, rows = heapq.heappop(heap)
        found = k_means(x[rows], min(p.branch, leaves - n + 1), rng)
        at = nearest(x[rows], found)
        parts = [rows[at == i] for i in range(len(found))]
        parts = [(c, r) for c, r in zip(found, parts, strict=True) if len(r)]
        if len(parts) < 2:
            continue
        for c, r in parts:
            centres.append(c)
            children.append([])
            children[node].append(len(centres) - 1)
            heapq.heappush(heap, (-len(r), len(centres) - 1, r))
        n += len(parts) - 1
    ends = [i for i, c in enumerate(children) if not c]
    return Tree(np.array(centres), children, {node: i for i, node in enumerate(ends)})


# ---------------------------------------------------------------- vectors


def valid(rows: DataFrame) -> DataFrame:
    """id, v of the rows that take part; v is the original vector in double precision."""
    found = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return found.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(values, float).reshape(-1, width)


def best(scores: np.ndarray, ids: list[list[int]], k: int, least: float) -> tuple[list[int], list[float]]:
    """The first k + 1 ids by score, ties to the smaller id, among those that reach ``least``; a vector stands for all its ids."""
    m = min(len(scores), k + 1)
    floor = max(least, np.partition(scores, len(scores) - m)[len(scores) - m])
    found = sorted((-scores[i], x) for i in np.flatnonzero(scores >= floor) for x in ids[i])[: k + 1]
    return [x for _, x in found], [-s for s, _ in found]


FOUND = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def search(spark, rows: DataFrame, queries: DataFrame, p: Params) -> tuple[DataFrame, dict]:
    """(query_id, rank, vec_id, score) for every query row (a subset of rows by id), and what calibration found."""
    every = valid(rows)
    widths = every.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], schema), {"visits": 0, "leaves": 0, "recall": 1.0}
    width = widths.w
    every = every.where(F.size("v") == width)
    # One row for each distinct vector, with its k + 1 least ids; the limit is applied in every task before the shuffle.
    least = every.withColumn("r", F.dense_rank().over(W.partitionBy("v").orderBy("id"))).where(F.col("r") <= p.k + 1)
    vectors = least.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("key", F.monotonically_increasing_id())
    vectors = written(vectors, "vectors")
    asked = valid(queries).where(F.size("v") == width).select("id", "v").join(vectors.select("v", "key"), "v").select("id", "key").distinct()
    asked = written(asked, "asked")

    n, top = vectors.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    norm = float(np.sqrt(top))

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))[:, None]])

    share = min(1.0, 1.2 * p.sample / max(n, 1))
    sample = vectors.select("key", "v").where(F.pmod(F.xxhash64("v", F.lit(p.seed)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    sample = sample.orderBy(F.xxhash64("v", F.lit(p.seed)), "v").limit(p.sample).toArrow()
    tree = grow(lifted(matrix(sample.column("v").combine_chunks(), width)), int(np.clip(n // p.leaf, 1, p.max_leaves)), p)
    sent = spark.sparkContext.broadcast((tree, width))

    placed_schema = pa.schema([("key", pa.int64()), ("leaf", pa.int64()), ("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, width = sent.value
        for b in slices(batches, 4096):
            yield batch(placed_schema, b.column(0), tree.send(lifted(matrix(b.column(1), width))), b.column(1), b.column(2))

    placed = written(map_batches(vectors.select("key", "v", "ids"), place, "key long, leaf long, v array<double>, ids array<long>"), "placed")
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / p.block).cast("int")).select("leaf", "blocks")

    distinct = asked.select("key").distinct().join(vectors.select("key", "v"), "key")
    visits, recall = calibrated(spark, distinct, placed, tree, width, p)

    order_schema = pa.schema([("q", pa.int64()), ("qv", pa.list_(pa.float64())), ("leaves", pa.list_(pa.int32()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, width = sent.value
        for b in slices(batches, 512):
            q = matrix(b.column(1), width)
            yield batch(order_schema, b.column(0), b.column(1), tree.orders(np.hstack([q, np.zeros((len(q), 1))]), visits))

    orders = written(map_batches(distinct.select("key", "v"), walk, "q long, qv array<double>, leaves array<int>"), "orders")

    route_schema = pa.schema([("leaf", pa.int64()), ("n", pa.int64()), ("q", pa.list_(pa.int64())), ("least", pa.list_(pa.float64())), ("qv", pa.list_(pa.float64()))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each leaf that queries of the batch visit, with these queries."""
        for b in slices(batches, 512):
            q, least, qv = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), width)
            visitors: dict[int, list[int]] = {}
            for i, leaves in enumerate(b.column(3).to_pylist()):
                for leaf in leaves:
                    visitors.setdefault(leaf, []).append(i)
            for some in visitors.items():  # a row at a time, so that the copies of vectors stay few
                leaf, at = some
                yield batch(route_schema, [leaf], [len(at)], [q[at]], [least[at]], [qv[at].ravel()])

    def compare(key, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        if not theirs.num_rows or not ours.num_rows:
            return FOUND.empty_table()
        x = matrix(theirs.column("v").combine_chunks(), width)
        ids = theirs.column("ids").to_pylist()
        out = ([], [], [])
        for q, least, qv in zip(ours.column("q").to_pylist(), ours.column("least").to_pylist(), ours.column("qv"), strict=True):
            scores = qv.values.to_numpy().reshape(-1, width) @ x.T
            for name, floor, s in zip(q, least, scores, strict=True):
                i, s = best(s, ids, p.k, floor)
                out[0].extend([name] * len(i))
                out[1].extend(i)
                out[2].extend(s)
        return pa.Table.from_batches([batch(FOUND, *out)])

    def searched(start: int, end: int, least: DataFrame | None) -> DataFrame:
        """(q, id, score) of the leaves from place start to end of each query's order: the best k + 1 of every block that reach the query's floor."""
        turn = orders.select("q", "qv", F.slice("leaves", start + 1, end - start).alias("leaves"))
        turn = turn.join(least, "q", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))) if least is not None else turn.withColumn("least", F.lit(float("-inf")))
        routes = written(map_batches(turn.select("q", "least", "qv", "leaves"), route, "leaf long, n long, q array<long>, least array<double>, qv array<double>"), "routes")
        crowd = F.broadcast(routes.groupBy("leaf").agg(F.ceil(F.sum("n") / p.block).cast("int").alias("crowds")).join(sizes, "leaf"))  # a row for each leaf: max_leaves at most
        aimed = routes.join(crowd, "leaf").withColumn("crowd", F.pmod(F.xxhash64(F.col("q")[0]), F.col("crowds")).cast("int"))
        aimed = aimed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("leaf", "block", "crowd", "q", "least", "qv")
        blocks = placed.join(crowd, "leaf").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        blocks = blocks.withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).select("leaf", "block", "crowd", "v", "ids")
        return aimed.groupBy("leaf", "block", "crowd").cogroup(blocks.groupBy("leaf", "block", "crowd")).applyInArrow(compare, "q long, id long, score double")

    per_key, start, end = None, 0, min(p.first, visits)
    while start < visits:
        least = None if per_key is None else per_key.where(F.col("r") == p.k + 1).select("q", F.col("score").alias("least"))
        new = searched(start, end, least)
        new = new if per_key is None else new.union(per_key.select("q", "id", "score"))
        new = new.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= p.k + 1)
        per_key = written(new, "found")
        start, end = end, min(visits, end * p.widen)
    own = asked.withColumnRenamed("id", "query_id").join(per_key.select("q", "id", "score"), F.col("key") == F.col("q")).where("id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = own.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    return out, {"visits": visits, "leaves": len(tree.leaf_of), "recall": recall}


def calibrated(spark, distinct: DataFrame, placed: DataFrame, tree: Tree, width: int, p: Params) -> tuple[int, float]:
    """(leaves to visit, their recall on the calibration queries): widened by a tenth until recall is reached.

    The exact neighbours come with their leaf, so one scan tells every query's recall at any number of visits.
    """
    some = distinct.orderBy(F.xxhash64("v", F.lit(p.seed + 1)), "v").limit(p.calibrate).toArrow()
    leaves = len(tree.leaf_of)
    if not some.num_rows:
        return leaves, 1.0
    names, q = some.column("key").to_pylist(), matrix(some.column("v").combine_chunks(), width)
    sent = spark.sparkContext.broadcast((names, q))
    schema = pa.schema([("q", pa.int64()), ("leaf", pa.int64()), ("score", pa.float64()), ("key", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        for b in slices(batches, 4096):
            scores = matrix(b.column(1), width) @ q.T
            key, leaf = b.column(2).to_numpy(), b.column(0).to_numpy()
            for j, name in enumerate(names):
                top = np.argsort(-scores[:, j], kind="stable")[: p.k + 1]
                yield batch(schema, [name] * len(top), leaf[top], scores[top, j], key[top])

    exact = map_batches(placed.select("leaf", "v", "key"), scan, "q long, leaf long, score double, key long").where("q <> key")
    exact = exact.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "key"))).where(F.col("r") <= p.k)
    truth: dict[int, list[int]] = {}
    for r in exact.orderBy("q", "r").collect():  # k * calibrate rows at most
        truth.setdefault(r.q, []).append(r.leaf)
    orders = tree.orders(np.hstack([q, np.zeros((len(q), 1))]), leaves)
    turn = {name: {leaf: t for t, leaf in enumerate(order)} for name, order in zip(names, orders, strict=True)}
    needed = sorted(turn[name][leaf] + 1 for name, found in truth.items() for leaf in found)
    visits = min(p.first, leaves)
    if not needed:
        return leaves, 1.0
    while (recall := float(np.searchsorted(needed, visits, "right")) / len(needed)) < p.recall and visits < leaves:
        visits = min(leaves, max(visits + 1, int(visits * 1.1)))
    return visits, recall


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = Params()
    return search(spark, rows, rows.where(F.col("vec_id") % p.every == 0), p)[0]
