"""Operator 10: similarity join on word n-grams with Bayesian candidate pruning.

1. Documents with equal n-gram sets form a class; one of them stands for it.
2. Classes that share a band of MinHash values are candidates. Their pairs are
   compared by MinHash values, a few at a time: a pair is dropped when the
   posterior probability that its similarity reaches the threshold falls below
   the tolerance. Pairs never leave the task: it returns a spanning forest of
   those that stay. So classes that only share a template are not tied.
3. Connected components of these ties are where links can be; only their texts
   are read again. A component is cut into blocks by set size and hash; for every
   two blocks that can hold a link, pairs are pruned in the same way and the rest
   is verified exactly. A task returns each class's number of links and a
   spanning forest of them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components

WORDS, THRESHOLD = 5, 0.8
#: 28 bands of 5 MinHash values: a pair at the threshold shares none with probability 2e-5.
BANDS, ROWS = 28, 5
#: MinHash values per step of the comparison, and the posterior below which a pair is dropped.
STEP, TOLERANCE = 20, 1e-6
#: Classes of a block of one band bucket; buckets are cut into pairs of blocks.
BUCKET_BLOCK = 2048
#: Classes and n-grams of a block of a component, about.
BLOCK, BLOCK_NGRAMS = 768, 600_000
_MEMO_WORDS = 400_000


class _Words(dict):
    def __missing__(self, word: str) -> int:
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(word) <= 48:
            if len(self) >= _MEMO_WORDS:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def ngram_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted hashes (64 bits) of the different n-grams of white-space separated words; a shorter text is one n-gram, an empty one has none."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache
def _functions(values: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(10)
    return random.integers(1, 2**32, values, np.uint32) | np.uint32(1), random.integers(0, 2**32, values, np.uint32)


def minhash(sets: list[np.ndarray], values: int) -> np.ndarray:
    """(sets, values) MinHash values of non-empty sets."""
    a, b = _functions(values)
    sizes = np.array([len(s) for s in sets])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    out, p, q = np.empty((values, len(sets)), np.uint32), np.empty_like(x), np.empty_like(x)
    for j in range(values):
        np.bitwise_xor(x, b[j], out=p)
        np.multiply(p, a[j], out=p)
        np.right_shift(p, np.uint32(15), out=q)
        np.bitwise_xor(p, q, out=p)
        np.multiply(p, np.uint32(0x2C1B3C6D), out=p)
        out[j] = np.minimum.reduceat(p, first)
    return np.ascontiguousarray(out.T)


def signatures(docs: DataFrame, n: int, values: int, text_key: bool = False) -> DataFrame:
    """(id, digest of the n-gram set, size, sig: MinHash values; null for an empty set), and with text_key the text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [ngram_set(t, n) for t in batch.column(1).to_pylist()]
            sigs: list[bytes | None] = [None] * len(sets)
            chunk, size = [], 0
            for i, s in enumerate(sets):
                if len(s):
                    chunk.append(i)
                    size += len(s)
                if chunk and (size > 30_000 or i + 1 == len(sets)):
                    for k, sig in zip(chunk, minhash([sets[k] for k in chunk], values), strict=True):
                        sigs[k] = sig.astype("<u4").tobytes()
                    chunk, size = [], 0
            digests = [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in sets]
            arrays = [batch.column(0), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[2:]], names=["id", "digest", "size", "sig", *keys])

    keys = ["text_key"] if text_key else []
    schema = "id long, digest binary, size long, sig binary" + ", text_key string" * text_key
    return docs.select(shared.id_key().alias("id"), F.col("text").cast("string"), *(_text_key().alias(k) for k in keys)).mapInArrow(run, schema)


def _text_key():
    """Tells texts apart, the null one too."""
    return F.coalesce(F.sha2(F.col("text").cast("string").cast("binary"), 256), F.lit(""))


@lru_cache
def fewest(compared: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of so many with which a pair goes on. With a
    uniform prior the posterior is Beta(m + 1, n - m + 1), and it reaches the
    threshold with the probability that of n + 1 draws at most m succeed."""
    total = 0.0
    for m in range(compared + 1):
        total += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if total >= tolerance:
            return m
    return compared


def candidate_pairs(one: np.ndarray, two: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signature rows that survive the incremental comparison."""
    values = one.shape[1]
    left, right = [], []
    for at in range(0, len(one), 128):
        part = one[at : at + 128]
        equal = np.zeros((len(part), len(two)), np.uint8)
        for v in range(min(STEP, values)):
            equal += part[:, v, None] == two[None, :, v]
        i, j = np.nonzero(equal >= fewest(min(STEP, values), threshold, tolerance))
        if same:
            keep = i + at < j
            i, j = i[keep], j[keep]
        for s in range(0, len(i), 200_000):
            a, b = i[s : s + 200_000], j[s : s + 200_000]
            m = equal[a, b].astype(np.int64)
            for v in range(STEP, values, STEP):
                m += (part[a, v : v + STEP] == two[b, v : v + STEP]).sum(axis=1)
                go = m >= fewest(min(v + STEP, values), threshold, tolerance)
                a, b, m = a[go], b[go], m[go]
            left.append(a + at)
            right.append(b)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def intersections(one: list[np.ndarray], two: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of these pairs of sets."""
    used_i, used_j = np.unique(i), np.unique(j)
    if len(i) < 64 or len(i) * 40 < len(used_i) * len(used_j):
        return np.array([len(np.intersect1d(one[a], two[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    a, b = np.concatenate([one[k] for k in used_i]), np.concatenate([two[k] for k in used_j])
    common = np.intersect1d(a, b)  # n-grams of one side only add nothing
    rows_a, rows_b = np.repeat(np.arange(len(used_i)), [len(one[k]) for k in used_i]), np.repeat(np.arange(len(used_j)), [len(two[k]) for k in used_j])
    total = np.zeros((len(used_i), len(used_j)), np.float32)
    for s in range(0, len(common), 8192):
        part = common[s : s + 8192]
        dense = []
        for h, rows, n in ((a, rows_a, len(used_i)), (b, rows_b, len(used_j))):
            at = np.searchsorted(part, h)
            ok = (at < len(part)) & (part[np.minimum(at, len(part) - 1)] == h)
            m = np.zeros((n, len(part)), np.float32)
            m[rows[ok], at[ok]] = 1
            dense.append(m)
        total += dense[0] @ dense[1].T
    return total[np.searchsorted(used_i, i), np.searchsorted(used_j, j)].astype(np.int64)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of these links."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
            if len(out) == n - 1:
                break
    return out


def ties_within(sigs: np.ndarray, block: np.ndarray, threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that stay, of one block or of two (then between them). What is tied already is not compared again."""
    sides = np.unique(block)
    open_, edges = np.ones(len(sigs), bool), []
    for start in range(len(sigs)):
        if not open_[start]:
            continue
        open_[start], front = False, np.array([start])
        while len(front) and open_.any():
            found = []
            for side in sides:
                mine = front if len(sides) == 1 else front[block[front] == side]
                others = np.flatnonzero(open_ if len(sides) == 1 else open_ & (block != side))
                if not len(mine) or not len(others):
                    continue
                i, j = candidate_pairs(sigs[mine], sigs[others], False, threshold, tolerance)
                new, first = np.unique(j, return_index=True)
                open_[others[new]] = False
                edges += zip(mine[i[first]].tolist(), others[new].tolist(), strict=True)
                found.append(others[new])
            front = np.concatenate(found) if found else front[:0]
    return edges


def candidate_ties(classes: DataFrame, bands: int, rows: int, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): a spanning forest of the pairs of classes that share a band and that the posterior does not exclude. classes: (node, sig), a written table. The result is written too."""
    width = 4 * rows
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * width + 1, F.lit(width))))
    banded = shared.keep(classes.where(F.col("sig").isNotNull()).select("node", F.explode(band).alias("bucket")), "bands")
    # buckets with the same members (known by their number and two sums of hashes) tell the same: one of them is enough
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in (0, 1)]
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), *marks).where("n > 1")
    buckets = shared.keep(buckets.groupBy("n", "m0", "m1").agg(F.min("bucket").alias("bucket")).select("bucket", "n", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("blocks")), "buckets")
    total = banded.count()
    members = shared.join_spread(banded, buckets, "bucket", F.col("n") >= max(2.0, total * shared.HOT_SHARE))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("block"), k).alias("i"), F.greatest(F.col("block"), k).alias("j")))
    tasks = members.withColumn("block", block).select("bucket", "node", "block", F.explode(pairs).alias("task"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lowest byte of each value: equal ones stay equal, so no pair is dropped by it."""
        for batch in batches:
            short = [np.frombuffer(x, "<u4").astype(np.uint8).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["node", "sig"])

    signed = classes.where(F.col("sig").isNotNull()).select("node", "sig").mapInArrow(shorten, "node long, sig binary")
    dealt = tasks.join(signed, "node").repartition("bucket", "task").sortWithinPartitions("bucket", "task", "node")

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_end(batches):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not len(held):
                continue
            bucket, i, j = (held[c].to_numpy() for c in ("bucket", "i", "j"))
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = [0, *cuts.tolist(), *([] if batch is not None else [len(held)])]  # the last group may go on
            node, block = held["node"].to_numpy(), held["block"].to_numpy()
            raw, out = held["sig"].to_pylist(), []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a < 2 or i[a] != j[a] and len(np.unique(block[a:b])) < 2:
                    continue
                sigs = np.frombuffer(b"".join(raw[a:b]), np.uint8).reshape(b - a, -1)
                out += [(node[a + x], node[a + y]) for x, y in ties_within(sigs, block[a:b], threshold, tolerance)]
            held = held.slice(edges[-1])
            yield pa.RecordBatch.from_arrays([pa.array([int(e[k]) for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    ties = shared.keep(dealt.select("bucket", "task.i", "task.j", "block", "node", "sig").mapInArrow(tie, "a long, b long"), "ties")
    shared.drop(banded)
    shared.drop(buckets)
    return ties


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def join(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE) -> DataFrame:
    """Links all rows whose n-gram sets have a Jaccard similarity of at least ``threshold``.

    Returns for each row of docs: doc_id, class_id (the smallest doc_id it is
    connected to by links), copies (other rows with the same n-gram set),
    n_links (other rows linked to it, copies included). N-grams are of
    white-space separated words, case and punctuation kept; a text with fewer
    words is one n-gram. Null and empty texts are copies of each other and of
    nothing else. Repeated rows are copies. A null doc_id is below all others
    and is returned as null.
    """
    sigs, known = _link(docs, n, threshold, bands, rows, tolerance)
    null = lambda c: F.when(F.col(c) != shared.NO_ID, F.col(c)).alias(c)
    known = shared.keep(known.drop("component"), "known")
    hot = F.col("rows") >= max(2.0, sigs.count() * shared.HOT_SHARE)
    return shared.join_spread(sigs.select(F.col("id").alias("doc_id"), "digest"), known, "digest", hot).select(
        null("doc_id"), null("class_id"), (F.col("rows") - 1).alias("copies"), (F.col("links") + F.col("rows") - 1).alias("n_links")
    )


def _link(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tolerance: float = TOLERANCE, text_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """The signatures of the rows; and of each different n-gram set: digest, component, rows, class_id, links."""
    spark = docs.sparkSession
    shared.prepare(spark)
    values = bands * rows
    sigs = shared.keep(signatures(docs, n, values, text_key), "signatures")
    groups = sigs.groupBy("digest").agg(F.count("*").alias("rows"), F.min("id").alias("rep"), F.max("size").alias("size"), F.max("sig").alias("sig"))
    classes = shared.keep(groups.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")

    places = shared.keep(components(candidate_ties(classes, bands, rows, threshold, tolerance)), "places")

    # texts of the classes that may have links, read once more
    members = shared.keep(classes.join(places, "node"), "members")
    wanted = members.select("rep").distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_set(t, n) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["digest", "grams"])

    texts = docs.select(shared.id_key().alias("rep"), F.col("text").cast("string").alias("text")).join(wanted.hint("shuffle_hash"), "rep", "left_semi").select("text")
    grams = texts.mapInArrow(sets, "digest binary, grams binary")

    # blocks: sets whose sizes differ by more than the threshold allows cannot be similar
    ratio = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(1 / threshold)) + 1e-9).cast("int")
    bucketed = members.withColumn("step", ratio)
    cuts = bucketed.groupBy("component", "step").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_NGRAMS)).cast("int").alias("blocks"))
    near = cuts.select("component", (F.col("step") - 1).alias("step"), F.col("blocks").alias("above"))
    cuts = cuts.join(near, ["component", "step"], "left").select("component", "step", "blocks", F.coalesce("above", F.lit(0)).alias("above"))
    below = cuts.select("component", (F.col("step") + 1).alias("step"), F.col("blocks").alias("below"))
    cuts = cuts.join(below, ["component", "step"], "left").select("component", "step", "blocks", "above", F.coalesce("below", F.lit(0)).alias("below"))
    # Written first: the join below then stands alone on its keys, and Spark can split a component that holds many of the rows.
    cuts = shared.keep(cuts, "blocks")
    cut = bucketed.join(cuts, ["component", "step"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    me = F.col("block")

    def task(step, i, other, j):
        return F.struct(step.alias("step"), i.cast("int").alias("i"), other.alias("other"), j.cast("int").alias("j"))

    step = F.col("step")
    # a component in one block has one task of its own; else one for every two blocks of this and the neighbouring steps
    upto = lambda count: F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    within = F.transform(upto(F.col("blocks")), lambda k: task(step, F.least(me, k), step, F.greatest(me, k)))
    upward = F.transform(upto(F.col("above")), lambda k: task(step, me, step + 1, k))
    downward = F.transform(upto(F.col("below")), lambda k: task(step - 1, k, step, me))
    dealt = (
        cut.select("component", "step", "block", "node", "rows", "size", "digest", "sig", F.explode(F.concat(within, upward, downward)).alias("task"))
        .join(grams.groupBy("digest").agg(F.first("grams").alias("grams")), "digest")
    )

    def link(group: pd.DataFrame) -> pd.DataFrame:
        t = group["task"].iloc[0]
        group = group.sort_values("node")
        left = ((group["step"] == t["step"]) & (group["block"] == t["i"])).to_numpy()
        same = t["step"] == t["other"] and t["i"] == t["j"]
        if not same and (left.all() or not left.any()):
            return pd.DataFrame({"a": [], "b": [], "links": [], "copies": []})
        one, two = (group[left], group[~left]) if not same else (group, group)
        sig = [np.frombuffer(b"".join(x["sig"]), "<u4").reshape(len(x), -1) for x in (one, two)]
        set_ = [[np.frombuffer(g, np.uint64) for g in x["grams"]] for x in (one, two)]
        i, j = candidate_pairs(*sig, same, threshold, tolerance)
        size = [x["size"].to_numpy() for x in (one, two)]
        both = intersections(*set_, i, j) if len(i) else np.zeros(0, np.int64)
        ok = both >= threshold * (size[0][i] + size[1][j] - both) - 1e-9
        i, j = i[ok], j[ok]
        node, weight = [x["node"].to_numpy() for x in (one, two)], [x["rows"].to_numpy() for x in (one, two)]
        count = [np.bincount(i, weight[1][j], len(one)), np.bincount(j, weight[0][i], len(two))]
        number = [np.bincount(i, minlength=len(one)), np.bincount(j, minlength=len(two))]
        edges = forest(i, j + (0 if same else len(one)), len(group))
        nodes = node[0] if same else np.concatenate(node)
        out = [pd.DataFrame({"a": node[k], "b": node[k], "links": count[k].astype(np.int64), "copies": number[k].astype(np.int64)})[number[k] > 0] for k in (0, 1)]
        out.append(pd.DataFrame({"a": [nodes[a] for a, _ in edges], "b": [nodes[b] for _, b in edges], "links": 0, "copies": 0}))
        return pd.concat(out)

    linked = dealt.groupBy("component", "task").applyInPandas(link, "a long, b long, links long, copies long")
    linked = shared.keep(linked, "links")
    for done in (places, members, cuts):
        shared.drop(done)
    counts = linked.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    final = components(linked.where("a <> b").select("a", "b"))
    labelled = classes.select("node", "digest", "rows", "rep").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = labelled.groupBy("component").agg(F.min("rep").alias("class_id"))
    return sigs, labelled.join(firsts, "component").join(counts, "node", "left").select("digest", "component", "rows", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each class stays. All columns stay as they are.

    It is the one with the smallest doc_id (null first); of several rows with
    that id the smallest n-gram digest, then the smallest digest of the text,
    then of the whole row. Rows of other classes stay whatever id they share.
    """
    columns = docs.columns
    sigs, known = _link(docs, text_key=True, **options)
    ones = sigs.groupBy("digest").agg(F.min(F.struct("id", "text_key")).alias("one")).join(known.select("digest", "component"), "digest")
    stay = ones.groupBy("component").agg(F.min(F.struct("one.id", "digest", "one.text_key")).alias("one")).select(F.col("one.id").alias("__id"), F.col("one.text_key").alias("__key"))
    rows = docs.withColumns({"__id": shared.id_key(), "__key": _text_key()}).join(stay.hint("shuffle_hash"), ["__id", "__key"], "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in columns))
    order = F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}).cast("binary"), 256)
    return rows.groupBy("__id", "__key").agg(F.min_by(whole, order).alias("__row")).select("__row.*")
