"""Interval joins: values within closed intervals, for long and short intervals together.

An interval of whole ticks is covered by few aligned blocks: blocks of level l are
BASE^l ticks long, and what a level leaves over at both ends goes to the level below. A value
lies in one block of each level, so it meets an interval in exactly one block and no pair
is found twice. Only levels that a cover uses are made for values. Blocks that hold many
values are dealt over several tasks by a salt.

Where only aggregates of an interval's values are asked for, blocks are added up once and
intervals are put together from them: the work grows with the rows of both tables, not with
their pairs. The ticks are then the places of values and bounds in their common order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.spec import Aggregate, SpecError
from ..sources.scratch import kept

#: Blocks of a level that make one of the next, and levels: BASE^LEVELS ticks are the longest block.
BASE_BITS, LEVELS = 2, 24
BASE = 1 << BASE_BITS
#: A block with more than this share of all values is salted: at most 1 / share of them are listed.
HOT_SHARE = 0.002
#: Values up to which a block is not salted, whatever its share.
BLOCK_ROWS = 20_000
#: Aggregates that can be put together from those of parts, and by which function.
MERGES = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
#: Bits of a number of ``monotonically_increasing_id`` that count within a partition.
ROW_BITS = 33


def cover(first: Column, last: Column) -> Column:
    """array of (level, block): the ticks from first to last, each in one block; at most 2 * (BASE - 1) blocks a level. Null or empty where last < first."""
    blocks = lambda a, b, level: F.when(a <= b, F.transform(F.sequence(a, b), lambda k: F.struct(level.alias("level"), k.alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))
    start = F.struct(first.cast("long").alias("a"), last.cast("long").alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("found"))

    def climb(state: Column, level: Column) -> Column:
        a, b, found = state["a"], state["b"], state["found"]
        up_a, up_b = -_floor_div(-a), _floor_div(b + 1) - 1
        wider = (up_a <= up_b) & (level < LEVELS - 1)
        none = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(found, blocks(a, b, level)).alias("found"))
        some = F.struct(up_a.alias("a"), up_b.alias("b"), F.concat(found, blocks(a, up_a * BASE - 1, level), blocks((up_b + 1) * BASE, b, level)).alias("found"))
        return F.when(a > b, state).when(wider, some).otherwise(none)

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, climb, lambda s: s["found"])


def _floor_div(c: Column) -> Column:
    """c / BASE rounded down, for negative numbers too."""
    return F.shiftright(c, BASE_BITS)


def blocks_of(tick: Column, levels: list[int]) -> Column:
    """array of (level, block): the blocks of these levels that hold a tick."""
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(tick, BASE_BITS * k).alias("block")) for k in levels))


def interval_join(intervals: DataFrame, values: DataFrame, start: str, end: str, value: str, tick: float = 1.0) -> DataFrame:
    """Every row of ``intervals`` with every row of ``values`` whose value lies from start to end, both inclusive.

    The columns are numbers, dates or times; names of the two tables must differ. A block of level 0 is ``tick`` (in seconds for
    times and days for dates) long; it decides the cost, not the result. Rows with a null bound or value, and intervals that end
    before they start, meet nothing. Repeated rows meet as often as they are there.
    """
    if set(intervals.columns) & set(values.columns):
        raise SpecError(f"both tables have {sorted(set(intervals.columns) & set(values.columns))}")
    if not (math.isfinite(tick) and tick > 0):
        raise SpecError("the tick must be positive")
    intervals = intervals.where(F.col(start) <= F.col(end))
    ends = intervals.agg(F.min(start).alias("a"), F.max(end).alias("b")).first()
    if ends["a"] is None:
        return intervals.join(values, F.lit(False))
    values = values.where(F.col(value).between(F.lit(ends["a"]), F.lit(ends["b"])))  # reaches the scan
    at = lambda df, c: F.floor(_number(df, c) / F.lit(float(tick))).cast("long")
    covered = intervals.withColumn("__c", F.explode(cover(at(intervals, start), at(intervals, end))))
    covered = covered.select(*intervals.columns, F.col("__c.level").alias("__level"), F.col("__c.block").alias("__block"))
    levels = sorted(r[0] for r in covered.select("__level").distinct().collect())  # at most LEVELS
    placed = values.withColumn("__b", F.explode(blocks_of(at(values, value), levels))).select(*values.columns, F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block"))
    joined = spread_join(covered, placed, ["__level", "__block"])
    return joined.where(F.col(value).between(F.col(start), F.col(end))).select(*intervals.columns, *values.columns)


def interval_summaries(intervals: DataFrame, values: DataFrame, start: str, end: str, value: str, aggregates: list[Aggregate]) -> DataFrame:
    """Every row of ``intervals`` that meets a value, with aggregates (count, sum, min, max) of all rows of ``values`` from start to end, both inclusive.

    What ``interval_join`` and a grouping by interval would give, without their pairs. Equal values are added up first; then they and the
    bounds are numbered in order, so that no block is crowded, however unevenly values lie. Sums of doubles depend on the order of rows.
    """
    names = [a.name for a in aggregates]
    if unknown := sorted({a.function for a in aggregates} - MERGES.keys()):
        raise SpecError(f"no aggregates that can be put together: {unknown}")
    if not names or len({*names, *intervals.columns}) < len(names) + len(intervals.columns):
        raise SpecError(f"aggregates need names of their own: {names}")
    first = [getattr(F, a.function)(a.field or F.lit(1)).alias(a.name) for a in aggregates]
    intervals = kept(intervals.where(F.col(start) <= F.col(end)).withColumn("__id", F.monotonically_increasing_id()), "intervals")
    ends = intervals.agg(F.min(start).alias("a"), F.max(end).alias("b")).first()
    values = values.where(F.col(value).between(F.lit(ends["a"]), F.lit(ends["b"])))  # reaches the scan
    summed = values.groupBy(F.col(value).alias("__at")).agg(*first)
    kinds = dict(summed.dtypes)
    merged = [MERGES[a.function](a.name).cast(kinds[a.name]).alias(a.name) for a in aggregates]
    # of what is equal, starts come before values and ends after them
    bounds = [intervals.select(F.col(c).alias("__at"), F.lit(side).alias("__side"), "__id") for c, side in ((start, 0), (end, 2))]
    points = summed.withColumn("__side", F.lit(1)).unionByName(bounds[0].unionByName(bounds[1]), allowMissingColumns=True)
    order = ["__at", "__side", "__id"]
    row, part, seen = F.col("__number").bitwiseAND(F.lit((1 << ROW_BITS) - 1)), F.shiftright("__number", ROW_BITS), Observation()
    points = points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__number", F.monotonically_increasing_id())
    points = kept(points.drop("__at").observe(seen, F.max(row).alias("row"), F.max(part).alias("part")), "points")
    # places without the wide gaps between the partitions' numbers
    bits = (seen.get.get("row") or 0).bit_length()
    points = points.withColumn("__place", F.shiftleft(part, bits) + row)
    levels = list(range(min(LEVELS, (bits + (seen.get.get("part") or 0).bit_length()) // BASE_BITS + 1)))
    keys = ["__level", "__block"]
    blocks = points.where("__side = 1").select(F.explode(blocks_of(F.col("__place"), levels)).alias("__b"), *names).groupBy(F.col("__b.level").alias("__level"), F.col("__b.block").alias("__block")).agg(*merged)
    places = points.where("__side <> 1").groupBy("__id").agg(F.min("__place").alias("a"), F.max("__place").alias("b"))
    covered = places.select("__id", F.explode(cover(F.col("a"), F.col("b"))).alias("__c")).select("__id", F.col("__c.level").alias("__level"), F.col("__c.block").alias("__block"))
    found = spread_join(blocks, covered, keys).groupBy("__id").agg(*merged)
    return intervals.join(found, "__id").select(*[c for c in intervals.columns if c != "__id"], *names)


def spread_join(few: DataFrame, many: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys. Where ``many`` has more than a share of its rows at one key, they are dealt over salts, to each of which that key's rows of ``few`` go."""
    # one count of the keys: those with many rows are written while all are added up
    seen = Observation()
    crowded = kept(many.groupBy(*keys).agg(F.count("*").alias("__n")).observe(seen, F.sum("__n").alias("total")).where(F.col("__n") > BLOCK_ROWS), "crowded")
    limit = max(BLOCK_ROWS, math.ceil((seen.get.get("total") or 0) * HOT_SHARE))
    crowded = crowded.where(F.col("__n") > limit)
    if crowded.isEmpty():
        return few.join(many, keys)
    # at most 1 / HOT_SHARE keys
    hot = F.broadcast(crowded.select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias("__salts")))
    salted = many.join(hot, keys, "left").withColumn("__salt", F.floor(F.rand(7) * F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    copied = few.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return copied.join(salted, [*keys, "__salt"]).drop("__salt")


def _number(df: DataFrame, name: str) -> Column:
    """A column as a number: seconds of a time, days of a date."""
    kind = dict(df.dtypes)[name]
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(name).cast("timestamp")) / F.lit(1e6)
    if kind == "date":
        return F.unix_date(name).cast("double")
    return F.col(name).cast("double")
