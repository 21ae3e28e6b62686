"""Stored features in the order of a space-filling curve, with a table of boxes beside them.

Features are written in Hilbert order of the centres of their boxes, cut into nodes of about
NODE_ROWS features. The node table holds each node's box; a region looks up the nodes whose
box it touches and reads those only. Nodes are neighbours on the curve, so their rows lie in
few row groups, which their smallest and largest node numbers prune.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import MAX_RESULT_ROWS, Box, SpecError
from ..sources.files import read_small, write_small
from .geometry import geometry_box, vector_region
from .quadtree import BOX

#: Bits of a coordinate on the curve; two of them fill the key, below 2^32.
CURVE_BITS = 16
#: Features of a node, about; nodes asked for one by one, and beyond that by ranges that also span nodes between them.
NODE_ROWS, MAX_SPANS = 1024, 200
_FILE = "_packed.json"


@dataclass(frozen=True)
class Packed:
    """Facts of a layout."""

    features: int
    nodes: int
    node_rows: int


def _curve_table(bits: int) -> list[int]:
    """For each turn of the curve and whole coordinates of so many bits: (place on the curve) * 4 + turn within.

    Turns are 0 none, 1 along the diagonal, 2 across it, 3 both: bits of lower quarters lie on their side, the left one along the diagonal, the right one across it."""
    out = []
    for turn in range(4):
        for xy in range(4**bits):
            x, y, now, place = xy >> bits, xy & ((1 << bits) - 1), turn, 0
            for k in reversed(range(bits)):
                right, upper = x >> k & 1, y >> k & 1
                right, upper = ((right, upper), (upper, right), (1 - upper, 1 - right), (1 - right, 1 - upper))[now]
                place = place * 4 + ((0, 1), (3, 2))[right][upper]
                now ^= 0 if upper else 2 if right else 1
            out.append(place * 4 + now)
    return out


def hilbert(x: Column, y: Column, bits: int = CURVE_BITS) -> Column:
    """Place on the Hilbert curve of whole coordinates from 0 to 2^bits - 1.

    From the highest bits down, a few are looked up at once: their place within a square of the curve, and how the curve is turned in it."""
    step = next(n for n in (4, 2, 1) if bits % n == 0)
    table = F.array(*(F.lit(v).cast("long") for v in _curve_table(step)))
    turn, place = F.lit(0).cast("long"), F.lit(0).cast("long")
    for at in range(bits - step, -1, -step):
        part = lambda c, at=at: F.shiftright(c.cast("long"), at).bitwiseAND(F.lit((1 << step) - 1).cast("long"))
        found = F.get(table, ((turn * (1 << step) + part(x)) * (1 << step) + part(y)).cast("int"))
        place = place + F.shiftleft(F.shiftright(found, 2), 2 * at)
        turn = found.bitwiseAND(F.lit(3).cast("long"))
    return place


def build_packed_features(features: DataFrame, path: str, node_rows: int = NODE_ROWS) -> Packed:
    """Writes features (feature_index, min_x, min_y, max_x, max_y, ...) under ``path``: ``features`` in curve order with their node, and ``nodes``.

    Features without a box lie in nodes of their own at the end, which no region asks for. Ranges of the curve make the tasks and files; many features
    at one place are told apart by feature_index. Nodes are numbered along the curve from each range's first place, with gaps between ranges."""
    if node_rows < 1:
        raise SpecError("a node has at least one feature")
    if taken := {"node", "curve"} & set(features.columns):
        raise SpecError(f"{sorted(taken)} are columns of the layout")
    spark, root = features.sparkSession, path.rstrip("/")
    # a small file is one task, though each of its features has to be placed
    features = features.repartition(spark.sparkContext.defaultParallelism)
    boxed = F.lit(True)
    for c in BOX:
        boxed = boxed & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    cx, cy = (F.when(boxed, F.col(a) / 2 + F.col(b) / 2) for a, b in (("min_x", "max_x"), ("min_y", "max_y")))
    ends = features.agg(F.min(cx), F.max(cx), F.min(cy), F.max(cy)).first()
    top = 2**CURVE_BITS - 1

    def place(c: Column, low: float | None, high: float | None) -> Column:
        width = (high or 0.0) - (low or 0.0)
        return F.floor((c - F.lit(low or 0.0)) / F.lit(width) * top).cast("long") if width > 0 else F.lit(0).cast("long")

    curve = F.when(boxed, hilbert(place(cx, *ends[:2]), place(cy, *ends[2:]))).otherwise(F.lit(4**CURVE_BITS))
    placed = features.withColumn("curve", curve).repartitionByRange("curve", "feature_index").sortWithinPartitions("curve", "feature_index")
    # rows of a task in their order: the high bits are the range's, the low ones the row's, so that nodes are blocks of neighbours
    number = F.monotonically_increasing_id()
    row = number.bitwiseAND(F.lit((1 << 33) - 1))
    node = F.shiftleft(F.shiftright(number, 33), 33).bitwiseOR(F.floor(row / node_rows).cast("long"))
    placed.withColumn("node", node).write.option("parquet.block.row.count.limit", str(8 * node_rows)).parquet(f"{root}/features")
    laid = spark.read.schema(_with_layout(features)).parquet(f"{root}/features")
    sound = F.col("curve") < 4**CURVE_BITS
    edges = [(F.min if c.startswith("min") else F.max)(F.when(sound, F.col(c))).alias(c) for c in BOX]
    laid.groupBy("node").agg(F.count("*").alias("features"), *edges).repartitionByRange("node").sortWithinPartitions("node").write.parquet(f"{root}/nodes")
    total = spark.read.parquet(f"{root}/nodes").agg(F.coalesce(F.sum("features"), F.lit(0)), F.count("*")).first()
    facts = Packed(int(total[0]), int(total[1]), node_rows)
    write_small(spark, f"{root}/{_FILE}", json.dumps({**asdict(facts), "schema": laid.schema.jsonValue()}))
    return facts


def _with_layout(features: DataFrame) -> T.StructType:
    return T.StructType([*features.schema.fields, T.StructField("curve", T.LongType()), T.StructField("node", T.LongType())])


def open_packed_features(spark: SparkSession, path: str) -> tuple[Packed, DataFrame, DataFrame]:
    """(facts, features, nodes) of a layout."""
    root = path.rstrip("/")
    facts = json.loads(read_small(spark, f"{root}/{_FILE}"))
    schema = T.StructType.fromJson(facts.pop("schema"))
    return Packed(**facts), spark.read.schema(schema).parquet(f"{root}/features"), spark.read.parquet(f"{root}/nodes")


def node_spans(nodes: DataFrame, box: Box, most: int = MAX_SPANS) -> list[tuple[int, int]]:
    """Ranges of node numbers that hold all nodes whose box touches this one: at most ``most``, by leaving the widest gaps out.

    Gaps between neighbouring nodes are found and ranked by the tasks; the driver gets the nodes behind the widest ones only."""
    near = (F.col("max_x") >= box.min_x) & (F.col("min_x") <= box.max_x) & (F.col("max_y") >= box.min_y) & (F.col("min_y") <= box.max_y)
    hit = nodes.where(near).select("node")
    # the range of a partition of the build is the node's high part: within it, gaps come from the node before
    before = F.lag("node").over(Window.partitionBy(F.shiftright("node", 33)).orderBy("node"))
    gaps = hit.select("node", before.alias("before")).where("before is null or node > before + 1")
    ends = hit.agg(F.min("node").alias("a"), F.max("node").alias("b")).first()
    if ends["a"] is None:
        return []
    # a range's start; a partition's first one has its last predecessor in an earlier partition
    starts = gaps.select("node", F.coalesce(F.col("node") - F.col("before"), F.lit(2**62)).alias("gap"))
    widest = sorted(r["node"] for r in starts.orderBy(F.desc("gap"), "node").limit(most).collect())
    widest = widest if widest and widest[0] == ends["a"] else [ends["a"], *widest[: most - 1]]
    # the end of each range: the last hit node before the next start
    bounds = F.array(*(F.lit(int(w)) for w in widest))
    which = F.size(F.filter(bounds, lambda w: w <= F.col("node")))
    last = hit.groupBy(which.alias("k")).agg(F.min("node").alias("a"), F.max("node").alias("b")).collect()
    return sorted((int(r["a"]), int(r["b"])) for r in last)


def packed_candidates(spark: SparkSession, path: str, box: Box, most: int = MAX_SPANS) -> DataFrame:
    """Features of the nodes that a box touches, as stored: a superset of those whose own box does."""
    _, features, nodes = open_packed_features(spark, path)
    wanted = F.lit(False)
    for a, b in node_spans(nodes, box, most):
        wanted = wanted | F.col("node").between(a, b)
    return features.where(wanted).drop("curve", "node")


def packed_region(spark: SparkSession, path: str, geometry: dict, limit: int | None = MAX_RESULT_ROWS) -> tuple[DataFrame, DataFrame]:
    """vector_region() of stored features: (up to ``limit`` features that intersect, or all with None; number of all that do), reading few row groups."""
    return vector_region(packed_candidates(spark, path, geometry_box(geometry)), geometry, limit)
