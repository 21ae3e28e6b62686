"""Operator 3: line deduplication with levelled sorted runs of line hashes.

Batches of documents come in descending doc_id. What has been seen lies in
runs: tables of line hashes, bucketed and sorted by hash, so that a batch is
joined to them by merging. The join decides: a hash that no run holds is fresh
(its largest doc_id keeps the line), one that a run holds as repeated is dropped
in the whole batch, and one that too few documents held so far is settled as
soon as a batch brings enough, for the batches that wait as well. Only fresh
hashes, and waiting ones whose state changes, are added as the batch's run; a
level with enough runs is compacted into one run of the next level.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: A line's key loses these at both ends.
SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3
#: A batch holds about as many documents as all before it, since it is merged with all of them: runs are read less than once a
#: document in all, and batches grow with the logarithm of the corpus. The first holds about UNIT, or a 2^(MAX_BATCHES - 1)th of all.
#: A run of the next level is made of FANOUT.
UNIT, MAX_BATCHES, FANOUT = 5000, 12, 3
#: A key with at least this share of all (document, key) rows in one batch is joined by broadcast; there are at most 1 / share of them.
HOT_SHARE = 0.001


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # lowers A-Z only


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def text_key() -> Column:
    """Tells rows of one id (all those without id, too) apart by their text."""
    return F.xxhash64(F.col("text").cast("string"))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, cuts: list[int] = ()) -> DataFrame:
    """(id, key, batch, hash) for each different line key of each row; the hash has 128 bits. Batch k has the ids at or below k of the descending cuts."""
    ascending = np.array(sorted(cuts), np.int64)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, hashes = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                keys = {k for line in (text or b"").split(b"\n") if long_enough(k := line_key(line), min_chars)}
                hashes += [hashlib.md5(k, usedforsecurity=False).digest() for k in keys]
                many.append(len(keys))
            ids = batch.column(0).to_numpy()
            number = (len(ascending) - np.searchsorted(ascending, ids)).astype(np.int32)
            each = [np.repeat(x, many) for x in (ids, batch.column(1).to_numpy(), number)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, each), pa.array(hashes, pa.binary())], names=["id", "key", "batch", "hash"])

    return docs.select(shared.id_key().alias("id"), text_key().alias("key"), F.col("text").cast("string")).mapInArrow(split, "id long, key long, batch int, hash binary")


class Runs:
    """The levels: each a list of tables, oldest first. A row of a run: hash, n (rows that held it, at most ``least``), holder
    (largest id), waiting (batches whose lines are not settled, fewer than ``least``). Beside each run lie its batch's marks."""

    def __init__(self, spark: SparkSession, least: int = MIN_DOCS, fanout: int = FANOUT):
        self.spark, self.least, self.fanout, self.levels = spark, least, fanout, [[]]
        self.buckets = shared.shuffle_partitions(spark)
        self.paths: list[str] = []
        self.written: list[str] = []

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        path = shared.new_path(self.spark, "run")
        self.written.append(path)
        name = path.rpartition("/")[2].replace("-", "_")
        rows.write.partitionBy("part").bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        return name, path

    def newest(self) -> list[tuple[str, str]]:
        """A batch's run is newer than all of the level above it, and runs of a level are in their order."""
        return [run for level in self.levels for run in reversed(level)]

    def known(self, keys: DataFrame) -> DataFrame:
        """keys with ``seen``: what the newest run that holds the hash knows of it, null for fresh ones. One merge join for each run."""
        seen = []
        for i, (name, _) in enumerate(self.newest()):
            run = self.spark.table(name).where("part = 'run'").select("hash", F.struct("n", "holder", "waiting").alias(f"run_{i}"))
            keys, seen = keys.join(run.hint("merge"), "hash", "left"), [*seen, f"run_{i}"]
        none = F.lit(None).cast("struct<n:long,holder:long,waiting:array<int>>")
        return keys.withColumn("seen", F.coalesce(*seen, none)).drop(*seen)

    def add(self, keys: DataFrame, batch: int) -> None:
        """keys: (hash, n, holder) of one batch. Writes its run, and marks (hash, n, holder, batch): in this batch the hash's lines go, but not the holder's."""
        here, before = F.col("n"), F.coalesce("seen.n", F.lit(0).cast("long"))
        total = F.least(before + here, F.lit(self.least).cast("long"))
        holder = F.coalesce("seen.holder", "holder")
        waiting = F.coalesce("seen.waiting", F.array().cast("array<int>"))
        settled, changed = total >= self.least, before < self.least
        none = F.array().cast("array<int>")

        def row(part: str, n: Column, waits: Column, of: Column) -> Column:
            return F.struct(F.lit(part).alias("part"), "hash", n.alias("n"), holder.alias("holder"), waits.alias("waiting"), of.cast("int").alias("batch"))

        run = F.when(changed, row("run", total, F.when(settled, none).otherwise(F.array_append(waiting, F.lit(batch).cast("int"))), F.lit(None)))
        marks = F.when(settled, F.transform(F.array_append(waiting, F.lit(batch).cast("int")), lambda of: row("mark", here, none, of)))
        rows = F.filter(F.concat(F.array(run), F.coalesce(marks, F.array().cast(f"array<{ROW}>"))), lambda x: x.isNotNull())
        found = self._write(self.known(keys).select(F.explode(rows).alias("r")).select("r.*"))
        self.levels[0].append(found)
        self.paths.append(found[1])
        self.compact()

    def compact(self) -> None:
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self.merged(level))
                self.drop(level)
                self.levels[k] = []

    def merged(self, level: list[tuple[str, str]]) -> tuple[str, str]:
        """One run of these, the newest row of each hash; read as plain files, since a union of bucketed tables can lose rows."""
        rows = self.spark.createDataFrame([], f"{ROW_SCHEMA}, age int")
        for age, (_, path) in enumerate(level):
            rows = rows.unionByName(self._read(path, "run").withColumn("age", F.lit(age)))
        newest = rows.groupBy("hash").agg(F.max_by(F.struct("n", "holder", "waiting", "batch"), "age").alias("r"))
        return self._write(newest.select(F.lit("run").alias("part"), "hash", "r.*").repartition(self.buckets, "hash"))

    def marks(self) -> DataFrame:
        """(hash, n, holder, batch) of all batches so far."""
        found = self.spark.createDataFrame([], ROW_SCHEMA)
        for path in self.paths:
            found = found.unionByName(self._read(path, "mark"))
        return found.select("hash", "n", "holder", "batch")

    def _read(self, path: str, part: str) -> DataFrame:
        where = f"{path}/part={part}"
        return self.spark.read.schema(ROW_SCHEMA).parquet(where) if shared.exists(self.spark, where) else self.spark.createDataFrame([], ROW_SCHEMA)

    def drop(self, level: list[tuple[str, str]]) -> None:
        """Drops runs that are not read any more; the marks stay."""
        for name, path in level:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            shared.remove(self.spark, f"{path}/part=run")

    def close(self) -> None:
        """Deletes every run and all marks."""
        for level in self.levels:
            self.drop(level)
        for path in self.written:
            shared.remove(self.spark, path)


ROW_SCHEMA = "hash binary, n long, holder long, waiting array<int>, batch int"
ROW = "struct<part:string,hash:binary,n:bigint,holder:bigint,waiting:array<int>,batch:int>"


def cut(docs: DataFrame, batches: int | None) -> list[int]:
    """Ids, descending, at or below which the next batch begins; each batch holds about as many documents as all before it."""
    many = docs.count()
    batches = batches or min(MAX_BATCHES, max(3, 1 + math.ceil(math.log2(max(many, 1) / UNIT))))
    parts = [1 - 0.5**i for i in range(1, batches)]
    cuts = docs.select(shared.id_key().alias("id")).agg(F.percentile_approx("id", parts, 10 * 2**batches).alias("c")).first()["c"] if parts else []
    return sorted(set(cuts or []), reverse=True)


def repeated_lines(hashes: DataFrame, batches: int, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> DataFrame:
    """(hash, n, holder, batch): where lines go. hashes: (id, batch, hash), a written table; batches are numbered from 0 in descending id."""
    spark = hashes.sparkSession
    # one count of all batches; sorted, so that reading one skips the row groups of the others
    counted = hashes.groupBy("batch", "hash").agg(F.count("*").alias("n"), F.max("id").alias("holder"))
    counted = shared.keep(counted.sortWithinPartitions("batch"), "line-counts")
    runs = Runs(spark, min_docs, fanout)
    try:
        for batch in range(batches):
            runs.add(counted.where(F.col("batch") == batch).drop("batch"), batch)
        return shared.keep(runs.marks(), "line-marks")
    finally:
        runs.close()
        shared.drop(counted)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """Drops repeated lines from every document; the largest doc_id keeps its own.

    Texts are split at newlines; a line's key is the line without white space at
    both ends and with A-Z lowered. Keys of at least ``min_chars`` code points
    that at least ``min_docs`` rows hold lose all their lines except in the rows
    with the largest doc_id that holds them. Returns the columns of docs with
    the new text (never null: null and empty texts are one empty line), n_lines
    (before) and n_dropped, which replace columns of these names. Every row
    counts as a document of its own, also where ids repeat; a null doc_id is
    below all others. Very long texts are split whole, a row at a time.
    """
    shared.prepare(docs.sparkSession)
    cuts = cut(docs, batches)
    hashes = shared.keep(line_hashes(docs, min_chars, cuts), "lines")
    marks = repeated_lines(hashes, len(cuts) + 1, min_docs, fanout)
    hot_rows = max(min_docs, int(hashes.count() * HOT_SHARE))
    place = ["batch", "hash"]
    hot = F.broadcast(marks.where(F.col("n") >= hot_rows).select(*place, "holder"))
    rare = marks.where(F.col("n") < hot_rows).select(*place, "holder")
    lost = hashes.join(hot, place).unionByName(hashes.join(rare, place)).where(F.col("id") < F.col("holder"))
    lists = lost.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_set("hash").alias("__lost"))

    @F.pandas_udf("text string, dropped long")
    def without(texts: pd.Series, lost: pd.Series) -> pd.DataFrame:
        kept, dropped = [], []
        for text, hashes in zip(texts, lost, strict=True):
            if text is None or hashes is None:
                kept.append(None)
                dropped.append(0)
                continue
            gone = {bytes(h) for h in hashes}
            lines = text.encode().split(b"\n")
            stay = [x for x in lines if hashlib.md5(line_key(x), usedforsecurity=False).digest() not in gone]
            kept.append(b"\n".join(stay).decode())
            dropped.append(len(lines) - len(stay))
        return pd.DataFrame({"text": kept, "dropped": dropped})

    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*columns, shared.id_key().alias("__id"), text_key().alias("__key")).join(lists.hint("shuffle_hash"), ["__id", "__key"], "left")
    done = rows.withColumn("__done", without(F.when(F.col("__lost").isNotNull(), F.col("text")), "__lost"))
    text = F.coalesce("text", F.lit(""))
    return done.select(
        *(F.coalesce("__done.text", text).alias("text") if c == "text" else F.col(c) for c in columns),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce("__done.dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
