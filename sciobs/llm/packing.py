"""Operator 2: packing documents into sequences by linear grouping.

Documents become pieces of at most ``capacity`` tokens. There are at most
``capacity`` different lengths, so their histogram is small whatever the corpus;
Spark counts it, the plan is made on counts, and Spark deals the actual pieces
into the plan by their rank among pieces of equal length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, tokens

CAPACITY = 2048
#: Lengths above this share of the capacity are grouped; the rest is fitted in afterwards.
LARGE = 0.25
#: Groups of equal cardinality that the large lengths are rounded up in.
GROUPS = 64
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document's ids are those of its whole text (null or empty: none), then id
    0. Only documents longer than the capacity are cut. Null ids and repeated
    rows stay as they are; other columns are not read.
    """
    path = tokenizer or tokens.default_tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            encoded = tokens.encode(batch.column(1).to_pylist(), path)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += b"\0\0\0\0"
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[float, np.ndarray]]:
    """How often each filling of a sequence is used so that the demand for few
    sizes is met with the fewest sequences: a linear programme over all fillings,
    whose columns a knapsack finds when they pay."""
    n, size = len(sizes), np.asarray(sizes)
    basis = np.diag((capacity // size).astype(float))
    amount = np.asarray(demand, float) / np.diag(basis)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(n))
        best = np.zeros(capacity + 1)
        last = np.full(capacity + 1, -1)
        for k in range(n):
            if worth[k] <= 1e-12:
                continue
            for _copy in range(capacity // size[k]):
                better = best[: -size[k]] + worth[k]
                gain = np.flatnonzero(better > best[size[k] :] + 1e-12)
                if not len(gain):
                    break
                best[gain + size[k]], last[gain + size[k]] = better[gain], k
        # the items on the way to the best filling
        column, left = np.zeros(n), int(best.argmax())
        while left > 0 and last[left] >= 0:
            column[last[left]] += 1
            left -= size[last[left]]
        if column @ worth <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column)
        ratios = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratios.argmin())
        step = ratios[out]
        amount = np.maximum(amount - step * change, 0)
        amount[out] = step
        basis[:, out] = column
    return [(amount[i], basis[:, i].astype(int)) for i in range(n)]


class _Plan:
    """Sequences are kept as ranges of like ones: (first, how many, tokens used)."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.dealt: list[tuple[int, int, int, int, int]] = []  # length, from rank, how many, first sequence, offset
        self.open: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by room left
        self.rooms: list[int] = []

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def offer(self, first: int, n: int, used: int) -> None:
        room = self.capacity - used
        if n and room:
            if room not in self.open:
                bisect.insort(self.rooms, room)
            self.open[room].append((first, n, used))

    def fit(self, length: int, rank: int, n: int) -> None:
        """Best fit of n pieces of one length: each goes where the least room is left."""
        while n:
            i = bisect.bisect_left(self.rooms, length)
            if i < len(self.rooms):
                room = self.rooms[i]
                first, many, used = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room], self.rooms[i]
            else:
                room, used = self.capacity, 0
                many = -(-n // (room // length))
                first = self.new(many)
            each = room // length
            full = min(many, n // each)
            if not full:  # the last few share one sequence
                each, full = n, 1
            for k in range(each):
                self.dealt.append((length, rank + k * full, full, first, used + k * length))
            rank, n = rank + each * full, n - each * full
            self.offer(first, full, used + each * length)
            self.offer(first + full, many - full, used)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> np.ndarray:
    """Rows (length, from rank, how many, first sequence, offset): pieces of that
    length with these ranks go to as many consecutive sequences at that offset.
    The work depends on the capacity, not on the number of pieces."""
    made = _Plan(capacity)
    big = sorted((s for s in histogram if large * capacity < s <= capacity), reverse=True)
    total = sum(histogram[s] for s in big)
    share = max(1, -(-total // groups))
    # linear grouping: runs of equal lengths, cut into groups of equal cardinality, rounded up to the group's longest
    members: dict[int, list[list[int]]] = defaultdict(list)
    room, top = 0, 0
    for s in big:
        rank, left = 0, histogram[s]
        while left:
            if not room:
                room, top = share, s
            take = min(room, left)
            members[top].append([s, rank, take])
            rank, left, room = rank + take, left - take, room - take
    sizes = sorted(members, reverse=True)
    if sizes:
        demand = [sum(m[2] for m in members[s]) for s in sizes]
        for amount, column in configurations(sizes, demand, capacity):
            n = int(amount + 1e-9)
            n = min([n, *(sum(m[2] for m in members[sizes[k]]) // column[k] for k in np.flatnonzero(column))])
            if not n:
                continue
            like = [(made.new(n), n, 0)]
            slots = np.repeat(np.arange(len(column)), column)
            # Substitute actual pieces for the rounded sizes, all but a filling's smallest: what rounding has left
            # free adds up in the room for that one, and best fit chooses an actual piece for the room.
            for k in slots[: max(1, len(slots) - 1)]:
                runs, after = members[sizes[k]], []
                for first, many, used in like:
                    while many:
                        s, rank, left = runs[0]
                        take = min(many, left)
                        made.dealt.append((s, rank, take, first, used))
                        after.append((first, take, used + s))
                        first, many = first + take, many - take
                        runs[0][1:] = rank + take, left - take
                        if take == left:
                            runs.pop(0)
                like = after
            for x in like:
                made.offer(*x)
    rest = [tuple(m) for runs in members.values() for m in runs] + [(s, 0, n) for s, n in histogram.items() if s <= large * capacity]
    for s, rank, n in sorted(rest, key=lambda x: (-x[0], x[1])):
        made.fit(s, rank, n)
    out = np.array(sorted(made.dealt), dtype=np.int64).reshape(-1, 5)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, groups: int = GROUPS, large: float = LARGE) -> DataFrame:
    """Packs every document into as few sequences of ``capacity`` tokens as it can.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Sequences are gapless from offset 0; ids of sequences
    are any numbers (negative for a piece that fills one alone). Null and empty
    texts are one piece of one token; repeated rows are packed as often as they
    occur; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    cut = shared.keep(pieces(docs, capacity, tokenizer), "pieces")
    part = cut.where(F.col("length") < capacity)
    # at most capacity - 1 rows
    histogram = {r["length"]: r["n"] for r in part.groupBy("length").agg(F.count("*").alias("n")).collect()}
    dealt = spark.sparkContext.broadcast(plan(histogram, capacity, groups, large))
    # A length may be that of a third of all pieces: ranks are counted within salts and carried on from salt to salt.
    salts = max(64, shared.shuffle_partitions(spark))
    salted = part.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    carried = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(carried), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("n", F.row_number().over(within)).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("n") - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = dealt.value
        wide = np.int64(1) << 44  # ranks stay below
        at = np.searchsorted(table[:, 0] * wide + table[:, 1], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": table[at, 3] + rank.to_numpy() - table[at, 1], "offset": table[at, 4]})

    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*keys, place("length", "rank").alias("at")).select(*keys, "at.sequence_id", "at.offset")
    alone = cut.where(F.col("length") >= capacity).select(*keys, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(placed)
