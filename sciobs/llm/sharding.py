"""Operator 12: shards by jump consistent hashing.

A row's shard is a function of its key and the number of shards alone: a generator
seeded by the key jumps from shard to shard, and the last one below the number of
shards is the row's. There is no table of a ring, and a shard that is appended takes
the necessary fraction of the rows, from all others evenly, and nothing else moves.

The generator is the published one (multiply by JUMP and add 1 modulo 2^64, take the
upper 31 bits). A 64-bit product overflows a long, so numbers travel as two halves of
32 bits. Everything is a column expression.

Places in a shard ("slots") are gapless and follow a mixed order, so that a shard read
in slot order is shuffled. Rows that agree in all that the order looks at are counted,
not sorted, and bounded blocks of the order are ranked apart; block totals shift them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Multiplier of the published generator.
JUMP = 2862933555777941757
SHARDS = 8
#: Distinct rows of one shard that are ranked together, on average; and equal rows that one task numbers at once.
BLOCK_ROWS, AT_ONCE = 4096, 65_536

_LOW = 0xFFFFFFFF


def halves(key: Column) -> tuple[Column, Column]:
    """Upper and lower 32 bits of a long, as longs from 0 to 2^32 - 1."""
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(F.lit(_LOW))


def step(high: Column, low: Column) -> tuple[Column, Column]:
    """(high, low) * JUMP + 1 modulo 2^64; no product exceeds 48 bits."""
    jump_high, jump_low = JUMP >> 32, JUMP & _LOW

    def product(x: Column, y: int) -> Column:
        """x * y modulo 2^32, of 32-bit numbers."""
        upper = (F.shiftright(x, 16) * F.lit(y)).bitwiseAND(F.lit(0xFFFF))
        return (x.bitwiseAND(F.lit(0xFFFF)) * F.lit(y) + F.shiftleft(upper, 16)).bitwiseAND(F.lit(_LOW))

    upper = F.shiftright(low, 16) * F.lit(jump_low)
    lower = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(jump_low) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    carry = F.shiftright(lower, 32) + F.shiftright(upper, 16)
    return (carry + product(low, jump_high) + product(high, jump_low)).bitwiseAND(F.lit(_LOW)), lower.bitwiseAND(F.lit(_LOW))


def jump(key: Column, shards: int) -> Column:
    """Shard of a long key, from 0: jump consistent hashing. Null keys count as the smallest long.

    A row jumps about ln(shards) + 1 times. The first sequence is long enough for nearly
    all rows; the few others go on through a sequence of the length that always suffices.
    """
    high, low = halves(F.coalesce(key.cast("long"), F.lit(shared.NO_ID)))
    start = F.struct(high.alias("high"), low.alias("low"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def leap(state: Column, _: Column) -> Column:
        high, low = step(state["high"], state["low"])
        to = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        return F.when(state["j"] >= shards, state).otherwise(F.struct(high.alias("high"), low.alias("low"), state["j"].alias("b"), to.alias("j")))

    often = min(shards, 4 * math.ceil(math.log(shards + 1)) + 16)
    some = F.aggregate(F.sequence(F.lit(1), F.lit(often)), start, leap)
    if often == shards:
        return some["b"].cast("int")
    on = lambda state: F.when(state["j"] >= shards, state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, leap))
    return F.transform(F.array(some), on)[0]["b"].cast("int")


def key_of(*columns: str) -> Column:
    """A long from any columns, for rows whose key is not a long."""
    return F.xxhash64(*columns)


def moved(rows: DataFrame, key: Column, before: int, after: int) -> DataFrame:
    """The rows whose shard another number of shards changes, with ``shard`` and ``new_shard``: what a resharding copies.

    With more shards, new_shard is one of the appended ones in every row; with fewer, shard is one of those taken away.
    """
    rows = rows.drop("shard", "new_shard").withColumns({"shard": jump(key, before), "new_shard": jump(key, after)})
    return rows.where(F.col("shard") != F.col("new_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (``key``), shard, slot, grown_shard of every row of docs (doc_id long, text string).

    size is the text's UTF-8 bytes plus 1, a null text has none (so 1, and CRC-32 of nothing, 0).
    The key is doc_id; rows with equal ids share a shard, null ids share that of the smallest long.
    slot numbers a shard's rows from 0 without gaps, by a mix of id and text, then id, CRC-32 and size;
    repeated rows get slots in any order. grown_shard is the shard with one shard more.
    Other columns take no part, whatever their names; an empty table gives an empty one.
    """
    blocks = max(1, math.ceil(docs.count() / (shards * BLOCK_ROWS)))
    id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(id.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    mixed = step(*halves(F.coalesce(id, F.lit(shared.NO_ID))))[0].bitwiseXOR(F.col("text_crc32"))
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("many"))
    counted = counted.withColumns({"shard": jump(F.col("doc_id"), shards), "grown_shard": jump(F.col("doc_id"), shards + 1), "mixed": mixed})
    counted = shared.keep(counted.withColumn("block", F.floor(F.col("mixed") * blocks / F.lit(float(1 << 32))).cast("int")), "shard-rows")

    totals = counted.groupBy("shard", "block").agg(F.sum("many").alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "block").orderBy("mixed", F.asc_nulls_first("doc_id"), "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("slot", F.coalesce(F.sum("many").over(within), F.lit(0))).join(starts, ["shard", "block"])
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "many", (F.col("slot") + F.col("start")).alias("slot"))
    return _numbered(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _numbered(placed: DataFrame) -> DataFrame:
    """One row for each of the ``many`` equal rows, with following slots. Very large groups are cut into parts that are dealt anew."""
    large = placed.where(F.col("many") > AT_ONCE).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(many - 1) div {AT_ONCE}"))))
    large = large.withColumns({"slot": F.col("slot") + F.col("part") * AT_ONCE, "many": F.least(F.lit(AT_ONCE).cast("long"), F.col("many") - F.col("part") * AT_ONCE)})
    large = large.drop("part").repartition("shard", "slot")
    every = placed.where(F.col("many") <= AT_ONCE).unionByName(large)
    return every.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).withColumn("slot", F.col("slot") + F.col("i")).drop("i", "many")
