"""Operator 9: exact top-k by inner product with a KD-tree per shard.

Vectors are dealt into shards by hash; a task builds the KD-tree of its shard
by median splits along principal axes, every node with its tight bounding box and
ball. A query visits nodes best first by the largest inner product any point of
the node can have and stops
at the kth score found so far. A first wave searches one shard per query; its
kth score is propagated as the floor of the search in all other shards.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

K, SCALE = 10, 1024
#: Most vectors of a shard, vectors of a leaf, and most queries that search a shard together. What is moved is
#: vectors * blocks of queries + queries * shards, so both are as large as a task's memory allows; small tables
#: are cut into two shards for each core instead.
SHARD, LEAF, QUERIES_AT_ONCE = 32_768, 64, 16_384


class Tree:
    """A KD-tree over integer vectors, cut along their principal axes; nodes in arrays, points in leaf order.

    Boxes and balls only bound scores, in floating point with room for its error; scores are exact integers.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        order, nodes, stack = np.arange(len(ids)), [], [(0, len(ids), -1)]
        real = points.astype(np.float64)
        middle = real.mean(axis=0)
        self.axes = np.linalg.eigh(np.cov(real - middle, rowvar=False).reshape(points.shape[1], -1))[1] if len(ids) > points.shape[1] else np.eye(points.shape[1])
        turned = real @ self.axes
        low, high, centers, radii = [], [], [], []
        while stack:
            a, b, parent = stack.pop()
            part = turned[order[a:b]]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            centers.append(part.mean(axis=0))
            radii.append(np.sqrt(((part - centers[-1]) ** 2).sum(axis=1).max()))
            nodes.append([a, b, -1, -1])
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = len(nodes) - 1
            if b - a > leaf:
                axis = int((high[-1] - low[-1]).argmax())
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], half)]
                stack += [(a, a + half, len(nodes) - 1), (a + half, b, len(nodes) - 1)]
        self.nodes, self.ids, self.points, self.turned = nodes, ids[order], points[order], turned[order]
        self.low, self.high, self.centers, self.radii = np.array(low), np.array(high), np.array(centers), np.array(radii)
        self.real, self.longest = real[order], float(np.sqrt((real**2).sum(axis=1).max()))
        self.leaves = sum(left < 0 for _, _, left, _ in nodes)

    def scores(self, a: int, b: int, query: np.ndarray, most: float) -> np.ndarray:
        """Exact inner products of the query and these points; ``most`` bounds what any partial sum can be."""
        if most < 2.0**52:
            return (self.real[a:b] @ query.astype(np.float64)).astype(np.int64)
        if most < 2.0**62:
            return self.points[a:b] @ query
        exact = [sum(x * y for x, y in zip(p, query.tolist(), strict=True)) for p in self.points[a:b].tolist()]
        if any(not -(2**63) <= s < 2**63 for s in exact):
            raise OverflowError("a score does not fit in a long")
        return np.array(exact, np.int64)

    def search(self, query: np.ndarray, own: int | None, k: int, floor: int | None) -> tuple[list[tuple[int, int]], int]:
        """Up to k best (score, -id) not below the floor, own id left out, ties to smaller ids; and the number of leaves visited."""
        q = query.astype(np.float64) @ self.axes
        norm = float(np.sqrt(q @ q))
        # by Cauchy-Schwarz no sum of some of a product's terms is larger in size
        most = norm * self.longest * (1 + 1e-9)
        box = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        bound = (np.minimum(box, self.centers @ q + norm * self.radii) + 1e-9 * most + 1e-9).tolist()
        best: list[tuple[int, int]] = []
        queue, visited = [(-bound[0], 0)], 0
        while queue:
            limit, node = heapq.heappop(queue)
            if floor is not None and -limit < floor:
                break
            a, b, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if floor is None or bound[child] >= floor:
                        heapq.heappush(queue, (-bound[child], child))
                continue
            visited += 1
            scores = self.scores(a, b, query, most)
            good = np.flatnonzero(scores >= floor) if floor is not None else np.arange(b - a)
            for score, i in zip(scores[good].tolist(), self.ids[a:b][good].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            if len(best) == k:
                floor = best[0][0] if floor is None else max(floor, best[0][0])
        return best, visited


def whole(embedding: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for vectors that are null or hold nulls or non-finite numbers."""
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int | None = None) -> DataFrame:
    """The k vectors with the largest inner product for each query.

    vectors and queries: (vec_id long, v array<long>); other columns take no part, whatever
    their names. Rows with a null id or vector take no part, nor do pairs of
    different dimension. A query's own id is left out. Returns query_id, rank
    (from 1), vec_id, score, an exact integer; fewer ranks where there are fewer
    vectors; ties go to smaller ids. Rows with equal ids are searched each. A
    score that does not fit in a long is an error.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = _search(vectors, queries, k, shard).where("vec_id is not null")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def leaf_visits(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int | None = None) -> DataFrame:
    """query_id, visited and leaves: how many leaves of all trees each query opened, and how many there are."""
    found = _search(vectors, queries, k, shard).where("vec_id is null")
    return found.groupBy("query_id").agg(F.sum("visited").alias("visited"), F.sum("leaves").alias("leaves"))


def _search(vectors: DataFrame, queries: DataFrame, k: int, shard: int | None) -> DataFrame:
    """(query_id, vec_id, score) of all that may be among the best, and for each search of a tree a row without vec_id: visited, leaves."""
    spark = vectors.sparkSession
    vectors = vectors.where("vec_id is not null and v is not null").select("vec_id", "v")
    queries = queries.where("vec_id is not null and v is not null").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    n = vectors.count()
    shard = shard or min(SHARD, max(1024, math.ceil(n / (2 * spark.sparkContext.defaultParallelism))))
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(queries.count() / QUERIES_AT_ONCE))
    dealt = vectors.select((F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int") if shards > 1 else F.lit(0)).alias("shard"), "vec_id", "v")

    def wave(asked: DataFrame) -> DataFrame:
        """asked: (shard, query_id, q, floor). One task for each shard and block of queries."""
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
        trees = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v")
        rows = asked.select("shard", block.alias("block"), F.col("query_id").alias("vec_id"), F.col("q").alias("v"), "floor", F.lit(True).alias("asks"))
        rows = rows.unionByName(trees.withColumns({"floor": F.lit(None).cast("long"), "asks": F.lit(False)}))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(list(batches))  # at most a shard's vectors and a block's queries
            asks = group.filter(group["asks"])
            points = group.filter(pc.invert(group["asks"]))
            sizes, out = pc.list_value_length(points["v"]), []
            for size in pc.unique(sizes).to_pylist():
                own = points.filter(pc.equal(sizes, size))
                tree = Tree(own["vec_id"].to_numpy(), own["v"].combine_chunks().flatten().to_numpy().reshape(len(own), size))
                for i, q, floor in zip(asks["vec_id"].to_pylist(), asks["v"].to_pylist(), asks["floor"].to_pylist(), strict=True):
                    if len(q) == size:
                        best, visited = tree.search(np.array(q, np.int64), i, k, floor)
                        out += [(i, -neg, s, None, None) for s, neg in best] + [(i, None, None, visited, tree.leaves)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], names=["query_id", "vec_id", "score", "visited", "leaves"])

        return rows.groupBy("shard", "block").applyInArrow(search, "query_id long, vec_id long, score long, visited long, leaves long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    home = F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")
    none = F.lit(None).cast("long")
    first = shared.keep(wave(queries.select(home.alias("shard"), "query_id", "q", none.alias("floor"))), "nearest-at-home")
    kth = first.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    others = queries.join(kth, "query_id", "left").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", "q", "floor").where(F.col("shard") != home)
    return first.unionByName(wave(others)) if shards > 1 else first
