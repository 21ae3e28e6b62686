"""Ordered lines of any length: vertices of a key in order, cut into numbered segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import SpecError
from ..sources.scratch import kept

#: Edges of a segment: the most vertices that one row holds are one more.
SEGMENT_EDGES = 50_000


def line_segments(rows: DataFrame, keys: Sequence[str], order: str, vertex: Sequence[str], edges: int = SEGMENT_EDGES) -> DataFrame:
    """keys, segment (from 0), points, line: the vertices (order, vertex columns) of every key in order, at most ``edges`` edges a segment.

    A segment begins with the vertex at which the one before it ends, so segments drawn one by one are the whole line. Keys with one
    vertex have no line. Equal places in the order go by the vertex's columns; repeated vertices stay. Null keys are keys like others.

    A key with at most ``edges`` vertices is one group. Vertices of the others are dealt by ranges of key and order, so that a line of any
    length is numbered and cut in many tasks; counts of the ranges shift the numbers.
    """
    if edges < 1:
        raise SpecError("a segment has at least one edge")
    if set(keys) & {order, *vertex} or {"segment", "points", "line"} & {*keys, order, *vertex}:
        raise SpecError("names of keys, vertices and results differ")
    columns = list(dict.fromkeys([order, *vertex]))
    rows = kept(rows.select(*keys, *columns), "vertices")
    long = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > edges)
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    if long.isEmpty():
        return _segments(rows.withColumn("segment", F.lit(0)), keys, columns)
    long = kept(long.drop("__n"), "long-lines")
    short = rows.join(long, same(rows, long), "left_anti").withColumn("segment", F.lit(0))
    laid = rows.join(long, same(rows, long), "left_semi").repartitionByRange(*keys, *columns).sortWithinPartitions(*keys, *columns)
    laid = kept(laid.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}), "ordered-vertices")
    parts = laid.groupBy(*keys, "__part").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).select(F.struct(*keys).alias("__of_key"), F.col("__part").alias("__of"), "__shift")
    at = F.col("__id") + F.col("__shift")
    placed = laid.withColumn("__key", F.struct(*keys)).join(shifts, (F.col("__part") == F.col("__of")) & F.col("__key").eqNullSafe(F.col("__of_key"))).withColumn("__at", at)
    whole = F.floor(F.col("__at") / edges).cast("int")
    # the first vertex of a segment also ends the one before
    border = (F.col("__at") % edges == 0) & (F.col("__at") > 0)
    placed = placed.withColumn("segment", F.explode(F.when(border, F.array(whole - 1, whole)).otherwise(F.array(whole))))
    return _segments(short.unionByName(placed.select(*short.columns)), keys, columns)


def _segments(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    lines = rows.groupBy(*keys, "segment").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("line"))
    return lines.select(*keys, "segment", F.size("line").alias("points"), "line").where("points >= 2")
