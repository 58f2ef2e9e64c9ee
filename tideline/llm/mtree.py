"""Exact top-k by inner product with M-trees and best-first search.

Inner products are made a metric: with M the largest norm of a shard, each vector x gets one more coordinate
sqrt(M^2 - |x|^2) and a query a zero there, so that d(q, x)^2 = |q|^2 + M^2 - 2 q.x, and the nearest vectors have
the largest products. A shard's tree has paged nodes whose entries carry covering radius and distance to the
parent; the search takes nodes by their least possible distance and leaves an entry's distance uncomputed where
the stored distances and the triangle inequality already rule it out. Scores are exact integers; distances only prune.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import small_batches, stage, stored_bytes

PAGE = 256  # entries of a node
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
BROADCAST_BYTES = 32 << 20
LARGEST = 1 << 63


@dataclass
class Node:
    rows: np.ndarray  # the routing object of each entry (inner) or the object itself (leaf)
    to_parent: np.ndarray
    radius: np.ndarray | None = None
    children: list[Node] | None = None


class MTree:
    """Bulk-loaded over the rows of an integer matrix."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        self.ids, self.page = ids, page
        self.largest = float(np.abs(vectors).max(initial=0))
        self.exact = vectors.shape[1] * self.largest**2 < 2**53  # float products are whole numbers then
        self.data = vectors.astype(np.float64) if self.exact else vectors.astype(np.int64)
        norms = np.einsum("ij,ij->i", self.data.astype(np.float64), self.data.astype(np.float64))
        self.top = float(norms.max(initial=0.0))
        self.points = np.column_stack([self.data.astype(np.float64), np.sqrt(np.maximum(self.top - norms, 0))])
        self.slack = 1e-7 * (np.sqrt(self.top) + 1)
        self.root = self._load(np.arange(len(ids)), None) if len(ids) else None
        self.computed = 0

    def _distances(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        diff = self.points[rows] - point
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))

    def _load(self, rows: np.ndarray, parent: int | None) -> Node:
        to_parent = self._distances(rows, self.points[parent]) if parent is not None else np.zeros(len(rows))
        if len(rows) <= self.page:
            return Node(rows, to_parent)
        seeds = [int(rows[0])]
        near = self._distances(rows, self.points[seeds[0]])
        owner = np.zeros(len(rows), dtype=np.int64)
        while len(seeds) < self.page // 4 and near.max() > 0:  # farthest first
            seeds.append(int(rows[near.argmax()]))
            d = self._distances(rows, self.points[seeds[-1]])
            owner[d < near] = len(seeds) - 1
            near = np.minimum(near, d)
        if len(seeds) == 1:  # all the same: pages of equal objects
            owner = np.arange(len(rows)) * (self.page // 2) // len(rows)
            seeds = [int(rows[np.flatnonzero(owner == k)[0]]) for k in range(owner.max() + 1)]
        groups = [(s, rows[owner == k], near[owner == k].max()) for k, s in enumerate(seeds)]
        routing = np.array([s for s, _, _ in groups])
        upward = self._distances(routing, self.points[parent]) if parent is not None else np.zeros(len(routing))
        return Node(routing, upward, np.array([r for *_, r in groups]), [self._load(members, s) for s, members, _ in groups])

    def search(self, query: np.ndarray, k: int, own: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k (score, id) of largest inner product, ties to the smaller id, without rows whose id is `own`.

        With a floor, a score that k others are known to reach, those below it may be left out: what other shards gave
        bounds the search of this one from its start.
        """
        if self.root is None:
            return []
        q = query.astype(np.float64)
        constant = float(q @ q) + self.top
        slack = max(self.slack, 1e-6 * (np.sqrt(constant) + 1))  # a long query's distances are less exact
        bound = len(q) * float(np.abs(q).max(initial=0)) * self.largest
        kind = np.float64 if self.exact and bound < 2**53 else np.int64 if bound < 2**62 else object  # Python's integers don't overflow
        factor = q if kind is np.float64 else query.astype(np.int64).astype(kind)
        best: list[tuple[int, int]] = []  # (score, -id), the worst first
        limit = np.inf if floor is None else float(np.sqrt(max(constant - 2 * floor, 0)))  # distance of the k-th best so far
        queue: list[tuple[float, int, Node, float]] = [(0.0, 0, self.root, -1.0)]
        serial = 1
        while queue:
            least, _, node, at_parent = heapq.heappop(queue)
            if least > limit + slack:
                break
            rows, to_parent, radius = node.rows, node.to_parent, node.radius
            if at_parent >= 0 and limit < np.inf:  # |d(q, parent) - d(entry, parent)| - radius bounds from below
                apart = np.abs(at_parent - to_parent) - (radius if radius is not None else 0)
                chosen = np.flatnonzero(apart <= limit + slack)
            else:
                chosen = np.arange(len(rows))
            if not len(chosen):
                continue
            self.computed += len(chosen)
            scores = self.data[rows[chosen]]
            scores = (scores if kind is np.float64 else scores.astype(np.int64).astype(kind)) @ factor
            distance = np.sqrt(np.maximum(constant - 2 * scores.astype(np.float64), 0))
            if node.children is not None:
                low = np.maximum(distance - radius[chosen], 0)
                for i in np.flatnonzero(low <= limit + slack):
                    heapq.heappush(queue, (float(low[i]), serial, node.children[chosen[i]], float(distance[i])))
                    serial += 1
                continue
            if len(best) == k:
                chosen, scores = chosen[scores >= best[0][0]], scores[scores >= best[0][0]]
            if floor is not None:
                chosen, scores = chosen[scores >= floor], scores[scores >= floor]
            for i, score in zip(chosen, scores):
                vec_id = int(self.ids[rows[i]])
                if vec_id == own:
                    continue
                entry = (int(score), -vec_id)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                limit = min(limit, float(np.sqrt(max(constant - 2 * best[0][0], 0))))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


# --- over tables --------------------------------------------------------------------------------------------

PACK = "dim int, n int, ids binary, data binary"


def _pack(rows: int):
    """Blocks of at most `rows` vectors of one length, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list[int]]]] = {}

        def packed(dim: int) -> pa.RecordBatch:
            block = held.pop(dim)
            ids = np.array([i for i, _ in block], dtype="<i8").tobytes()
            data = np.array([v for _, v in block], dtype="<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(block)], pa.int32()), pa.array([ids], pa.binary()), pa.array([data], pa.binary())], ["dim", "n", "ids", "data"])

        for batch in batches:
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(len(vector), []).append((vec_id, vector))
                if len(held[len(vector)]) >= rows:
                    yield packed(len(vector))
        for dim in list(held):
            yield packed(dim)

    return run


def _unpack(dim: int, n: int, ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((n, max(width, 1)), dtype=np.int64)
    out[:, :dim] = np.frombuffer(data, dtype="<i8").reshape(n, dim)
    return np.frombuffer(ids, dtype="<i8"), out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, None
        tops: dict[bytes, list[list[int]]] = {}  # by query block the k best scores of each query so far, over all shards of the task
        for batch in batches:
            for row in batch.to_pylist():
                width = max(row["dim"], row["q_dim"])
                if key != (row["ids"], row["data"], width):
                    key, tree = (row["ids"], row["data"], width), MTree(*_unpack(row["dim"], row["n"], row["ids"], row["data"], width))
                q_ids, queries = _unpack(row["q_dim"], row["q_n"], row["q_ids"], row["q_data"], width)
                held = tops.setdefault(hashlib.blake2b(row["q_ids"], digest_size=16).digest(), [[] for _ in q_ids])
                found = []
                for n, (q, v) in enumerate(zip(q_ids.tolist(), queries)):
                    got = tree.search(v, k, q, held[n][0] if len(held[n]) == k else None)
                    found += [(q, s, i) for s, i in got]
                    held[n] = sorted([*held[n], *(s for s, _ in got)])[-k:]
                if over := next((f for f in found if not -(1 << 63) <= f[1] < 1 << 63), None):
                    raise OverflowError(f"the score {over[1]} of query {over[0]} and vector {over[2]} does not fit a long")
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1, 2)], ["query_id", "score", "vec_id"])

    return run


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of every usable vector: not null, and without null or non-finite components.

    Rows without vec_id take no part either, nor vectors with components of 2^63 and more after scaling, which no long
    holds. Scores that a long does not hold end the search with an error.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float(LARGEST) / scale)))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<long>").alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k rows of largest integer inner product, ties to the smaller id.

    Both tables have vec_id and vector (array of long). A query's own rows, those with its id, are no candidates;
    of query rows with one id the least vector counts; repeated candidates each take a rank; vectors of unlike
    length meet as if padded with zeros. Vectors are packed where they are read into shards of bounded size, each
    with its own tree, and every query block visits every shard, with the bound that the task's shards before gave. Query blocks are broadcast only up to a size that
    is looked up; beyond it shards and blocks meet in a shuffled join spread over salts.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    one = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    staged = stage(one.mapInArrow(_pack(BLOCK_ROWS), PACK), "mtree-queries")
    blocks = staged.select(F.col("dim").alias("q_dim"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    shards = vectors.mapInArrow(_pack(SHARD_ROWS), PACK)
    if stored_bytes(spark, staged._tideline_path) <= BROADCAST_BYTES:
        met = shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).crossJoin(F.broadcast(blocks))
    else:
        salts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        met = shards.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).join(blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), "salt").drop("salt").sortWithinPartitions(F.xxhash64("ids"), "n")  # the rows of a shard follow each other: its tree is built once
    found = met.mapInArrow(_search(k), "query_id long, score long, vec_id long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
