"""Operator 11: ranked lexical search of many items at once, with common subexpressions.

A document's score for an item is a sum over the item's terms, so items that share
terms share parts of the sum. From the items of a block a plan is made: pairs of
summands that several items have are mined, the pair that saves most becomes a node of
its own, and again, until no pair is shared. Nodes are made of terms and of earlier
nodes: a DAG, at whose sinks the items stand. Documents are tokenised once and their
occurrences of asked terms written; counts over them give the terms' weights. Then
each batch of documents gets its partial accumulators: every node once, whichever
items it serves, and items by adding up what is left. A task keeps the best of every
item; those meet by item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

K = 20
#: Items, and their different terms, that one plan is made for, on average over the blocks of a large table of items.
ITEMS_AT_ONCE, TERMS_AT_ONCE = 1024, 100_000
#: Of an item, the summands that pairs are mined from: those that most documents hold. Bounds the plan's cost; the others are added one by one.
MINED_SUMMANDS = 64
#: Cells (nodes by documents) of the accumulators that a task holds at once.
CELLS = 8_000_000
#: Parts of an item's candidates that are ranked apart before they meet.
SLICES = 64

#: Bytes of UTF-8 that are part of a term: digits, Latin letters, and all of other characters. The table lowers A-Z and blanks the rest.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_TABLE).split() if text else []


@dataclass(frozen=True)
class Plan:
    """What is added up for the items of a block.

    Symbols are numbered: 0 to terms - 1 are terms (in the order of ``vocabulary``), then come the nodes.
    nodes: (first, second) symbols of each, both below its own number. items: of each item its (symbols, how often each).
    """

    vocabulary: dict[bytes, int]
    nodes: list[tuple[int, int]]
    items: list[tuple[list[int], list[int]]]

    def additions(self) -> int:
        """Sums of two numbers for a document that holds all terms."""
        return len(self.nodes) + sum(max(0, len(s) - 1) for s, _ in self.items)


def mine(items: list[dict[bytes, int]], holders: dict[bytes, int] | None = None) -> Plan:
    """The plan of items (term -> how often).

    A summand is a term with its number of repeats, or a node; the pair of summands whose node saves most additions
    (the items that have it, but one, times the documents that hold either) is replaced in all these items, until no
    pair is in two items. holders: how many documents hold a term (1 where unknown).
    """
    vocabulary = {t: i for i, t in enumerate(sorted({t for item in items for t in item}))}
    cost = [(holders or {}).get(t, 1) for t in vocabulary]
    left = [{(vocabulary[t], n) for t, n in item.items()} for item in items]
    common = Counter(s for item in left for s in item)
    mined = [set(heapq.nsmallest(MINED_SUMMANDS, (s for s in item if common[s] > 1), key=lambda s: (-cost[s[0]], s))) for item in left]
    having: dict[tuple, set[int]] = defaultdict(set)  # pair -> items

    def pair(a: tuple[int, int], b: tuple[int, int]) -> tuple:
        return (a, b) if a < b else (b, a)

    for i, item in enumerate(mined):
        ordered = sorted(item)
        for x, a in enumerate(ordered):
            for b in ordered[x + 1 :]:
                having[a, b].add(i)
    saves = lambda p: (len(having[p]) - 1) * (cost[p[0][0]] + cost[p[1][0]])
    waiting = [(-saves(p), p) for p in having if len(having[p]) > 1]
    heapq.heapify(waiting)
    nodes: list[tuple[int, int]] = []
    made: dict[tuple[int, int], int] = {}  # repeated terms are nodes of their own: (symbol, repeats) -> symbol
    made_of: list[tuple[tuple[int, int], tuple[int, int]]] = []
    while waiting:
        gain, p = heapq.heappop(waiting)
        now = saves(p)
        if now <= 0:
            continue
        if now != -gain:
            heapq.heappush(waiting, (-now, p))
            continue
        new = (len(vocabulary) + len(made_of), 1)
        made_of.append(p)
        cost.append(cost[p[0][0]] + cost[p[1][0]])
        touched = set()
        for i in sorted(having.pop(p)):
            for item in (mined[i], left[i]):
                item.difference_update(p)
            for other in mined[i]:
                for old in p:
                    having[pair(old, other)].discard(i)
                having[pair(other, new)].add(i)
                touched.add(pair(other, new))
            mined[i].add(new)
            left[i].add(new)
        for q in touched:
            if len(having[q]) > 1:
                heapq.heappush(waiting, (-saves(q), q))
    # nodes of two symbols each: a repeated term inside a node is doubled and added up first
    number = {}

    def symbol(s: tuple[int, int]) -> int:
        """The symbol that stands for a summand."""
        i, n = s
        if i >= len(vocabulary):
            return number[i]
        if n == 1:
            return i
        if s not in made:
            half = symbol((i, n // 2))
            nodes.append((half, half))
            made[s] = len(vocabulary) + len(nodes) - 1
            if n % 2:
                nodes.append((made[s], i))
                made[s] += 1
        return made[s]

    for i, (a, b) in enumerate(made_of):
        both = symbol(a), symbol(b)
        nodes.append(both)
        number[len(vocabulary) + i] = len(vocabulary) + len(nodes) - 1
    ends = []
    for item in left:
        summands = sorted((i if i < len(vocabulary) else number[i], n) for i, n in item)
        ends.append(([i for i, _ in summands], [n for _, n in summands]))
    return Plan(vocabulary, nodes, ends)


def accumulate(plan: Plan, parts: np.ndarray) -> Iterator[np.ndarray]:
    """Scores of each item in order, from parts: (terms, documents). Every node is added up once."""
    sums = np.empty((len(plan.vocabulary) + len(plan.nodes), parts.shape[1]), np.int64)
    sums[: len(plan.vocabulary)] = parts
    for i, (a, b) in enumerate(plan.nodes, len(plan.vocabulary)):
        np.add(sums[a], sums[b], out=sums[i])
    for symbols, many in plan.items:
        if max(many) == 1:
            yield sums[symbols].sum(axis=0)
        else:
            yield np.array(many, np.int64) @ sums[symbols]


def part(tf: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A term's part of a score, in whole numbers."""
    return weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Best:
    """The k best documents of each item so far: higher scores, then smaller ids, null ids first."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item, self.doc, self.null, self.score = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, ...]:
        at = np.flatnonzero(score >= self.floor[item])
        return np.full(len(at), item), doc[at], null[at], score[at]

    def merge(self, found: list[tuple[np.ndarray, ...]]) -> None:
        own = (self.item, self.doc, self.null, self.score)
        item, doc, null, score = (np.concatenate([o, *(f[i] for f in found)]) for i, o in enumerate(own))
        order = np.lexsort((doc, ~null, -score, item))
        item, doc, null, score = item[order], doc[order], null[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < self.k
        self.item, self.doc, self.null, self.score = item[kept], doc[kept], null[kept], score[kept]
        last = rank[kept] == self.k - 1
        self.floor[self.item[last]] = self.score[last]


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), found (numbers of asked terms, each once), tf of every document with a term."""
    asked = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = asked.value.get
        size = len(asked.value)
        for batch in batches:
            texts = [terms(t) for t in batch["text"].to_pylist()]
            n = np.fromiter(map(len, texts), np.int64, len(texts))
            ids = np.fromiter((number(t, -1) for text in texts for t in text), np.int64, n.sum())
            row = np.repeat(np.arange(len(texts)), n)[ids >= 0]
            key, tf = np.unique(row * size + ids[ids >= 0], return_counts=True)
            some = np.flatnonzero(n)
            edges = np.append(np.searchsorted(key, some * size), len(key))
            out = [batch["doc_id"].take(pa.array(some)), pa.array(n[some])]
            out += [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v.astype(np.int32))) for v in (key % max(size, 1), tf)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n", "found", "tf"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.where("text is not null").mapInArrow(work, "doc_id long, n long, found array<int>, tf array<int>")


def _ranked(found: DataFrame, plan: Plan, weight: np.ndarray, n: int, length: int, k: int) -> DataFrame:
    """item (its number in the plan), doc_id, score: the best k of each task."""
    sent = found.sparkSession.sparkContext.broadcast((plan, weight))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = sent.value
        best = Best(len(plan.items), k)
        size = len(plan.vocabulary)
        at_once = max(1, CELLS // (size + len(plan.nodes)))
        for batch in batches:
            for at in range(0, len(batch), at_once):
                some = batch.slice(at, at_once)
                many = some["found"].value_lengths().to_numpy()
                m = 75 + (25 * some["n"].to_numpy() * n) // length
                ids, tf = (some[c].flatten().to_numpy().astype(np.int64) for c in ("found", "tf"))
                parts = np.zeros((size, len(some)), np.int64)
                parts[ids, np.repeat(np.arange(len(some)), many)] = part(tf, np.repeat(m, many), weight[ids])
                doc, null = some["doc_id"].fill_null(0).to_numpy(), some["doc_id"].is_null().to_numpy(zero_copy_only=False)
                best.merge([best.add(i, score, doc, null) for i, score in enumerate(accumulate(plan, parts))])
        yield pa.RecordBatch.from_arrays([pa.array(best.item), pa.array(best.doc, mask=best.null), pa.array(best.score)], names=["item", "doc_id", "score"])

    return found.select("doc_id", "n", "found", "tf").mapInArrow(work, "item long, doc_id long, score long")


def _item_terms(items: DataFrame) -> list[dict[bytes, int]]:
    """Terms of the items of one block (bounded), in the order of their rows."""
    return [Counter(terms(bytes(r.text) if r.text is not None else None)) for r in items]


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each item; ties go to smaller ids.

    docs: doc_id long, text string; items: item_id long, text string. Every row of docs is a document, also where
    ids or rows repeat; rows without id take part, and rank first among equals. Items with equal id and text are one; an id with
    several texts is answered for each, with ranks of its own; items may be without id. Null and empty texts, and items whose terms no document
    holds, have no rows. Texts are read whole, whatever their length. Other columns take no part, whatever
    their names; empty tables give an empty one.

    Items are answered in blocks of a bounded size, each by one plan, which tasks get by broadcast; each block reads
    the documents again.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null").distinct()
    size = items.agg(F.count("*"), F.sum(F.octet_length("text") / 4)).first()
    blocks = max(1, math.ceil(size[0] / ITEMS_AT_ONCE), math.ceil((size[1] or 0) / TERMS_AT_ONCE))
    out = None
    for block in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == block)
        rows = sorted(own.collect(), key=lambda r: (r.item_id is not None, r.item_id or 0, bytes(r.text)))
        found = _block(docs, rows, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    asked = [(r.item_id, t) for r, t in zip(rows, _item_terms(rows), strict=True) if t]
    if not asked:
        return None
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, item in asked for t in item}))}
    found = shared.keep(occurrences(docs, vocabulary), "occurrences")
    n, length = found.agg(F.count("*"), F.sum("n")).first()
    if not n:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in found.select(F.explode("found").alias("i")).groupBy("i").count().collect():  # at most one row for each asked term
        df[r.i] = r["count"]
    plan = mine([item for _, item in asked], dict(zip(vocabulary, df.tolist(), strict=True)))
    best = _ranked(found, plan, weights(n, df), n, length, k).withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES)))
    for keys in (["item", "slice"], ["item"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(asked)], "item long, item_id long")
    return best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
