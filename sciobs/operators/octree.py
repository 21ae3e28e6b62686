"""Stored levels of a point cloud: every point in exactly one node of an octree.

Level l has a spacing of ``spacing`` / 2^l. The first point in source order of a
cube of that edge stands for the cube; a point belongs to the coarsest level at
which it stands for a cube, and to the last level if at none. As the first point of a cube
is also the first of the smaller cube around it, levels 0 to l together hold one point
of every cube of level l: what ``thin_points`` makes of all points by a scan,
a read of the first folders gives here.

A node is a cube of NODE_CELLS cubes an edge. Folders are levels and tiles (the node's
ancestor TILE_LEVELS above); within, rows are in Morton order of nodes, so row groups are boxes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import MAX_RESULT_ROWS, Box, SpecError
from ..sources.files import read_small, remove_path, write_small
from .points import point_region

#: Cubes along a node's edge (a power of 2), and how many levels above a node its folder's tile is.
NODE_BITS, TILE_LEVELS = 5, 3
#: Bits of a node's coordinate; three of them fill a long.
KEY_BITS = 20
#: Tiles up to which folders are asked for by name; a larger box is left to the rows' own statistics.
MAX_TILES = 4096
_FILE = "_octree.json"


@dataclass(frozen=True)
class Octree:
    """Facts of a layout; ``root``: the node coordinates' origin, in cubes of the finest level."""

    spacing: float
    levels: int
    root: tuple[int, int, int]

    def edge(self, level: int) -> float:
        return self.spacing / 2**level

    def level_for(self, resolution: float) -> int:
        """The coarsest level whose spacing is at most the resolution; the last one where none is."""
        if not (math.isfinite(resolution) and resolution > 0):
            raise SpecError("the resolution must be positive and finite")
        return min(self.levels, max(0, math.ceil(math.log2(self.spacing / resolution) - 1e-12)))


#: Bits of a coordinate that one look into the table of spread numbers takes.
TABLE_BITS = 10


def interleave(*axes: Column) -> Column:
    """Morton key of coordinates from 0 to 2^KEY_BITS - 1: bit i of axis k becomes bit 3 i + k.

    Numbers of TABLE_BITS bits are looked up with their bits three apart, so an axis is named KEY_BITS / TABLE_BITS times only."""
    table = F.array(*(F.lit(sum((v >> i & 1) << 3 * i for i in range(TABLE_BITS))).cast("long") for v in range(1 << TABLE_BITS)))
    low = F.lit((1 << TABLE_BITS) - 1).cast("long")
    out = None
    for k, axis in enumerate(axes):
        for at in range(0, KEY_BITS, TABLE_BITS):
            part = F.shiftleft(F.get(table, F.shiftright(axis, at).bitwiseAND(low).cast("int")), 3 * at + k)
            out = part if out is None else out.bitwiseOR(part)
    return out


def _standing(cubes: DataFrame, levels: int, scratch: str) -> DataFrame:
    """(source_index, level): the coarsest level at which a point stands for a cube. cubes: (source_index, vx, vy, vz) at the finest spacing.

    Each level is made of the one below, which is written once; a crowded cube is reduced before the shuffle."""
    spark, found = cubes.sparkSession, cubes
    for level in reversed(range(levels)):
        one = found.groupBy("vx", "vy", "vz").agg(F.min("source_index").alias("source_index"))
        one.write.parquet(f"{scratch}/level={level}")
        found = spark.read.parquet(f"{scratch}/level={level}").select("source_index", *(F.shiftright(v, 1).alias(v) for v in ("vx", "vy", "vz")))
    return spark.read.parquet(scratch).groupBy("source_index").agg(F.min("level").cast("int").alias("level"))


def build_point_octree(points: DataFrame, path: str, spacing: float, levels: int) -> Octree:
    """Writes points (source_index long, x, y, z, ...) as an octree of levels 0 to ``levels``; the last holds what no coarser one does.

    source_index tells points apart. Points without a coordinate stand for no cube and lie in the last level; an empty cloud gives an empty layout."""
    if not (math.isfinite(spacing) and spacing > 0) or levels < 1:
        raise SpecError("the spacing must be positive and there must be a level")
    if any(c in points.columns for c in ("level", "tile", "node")):
        raise SpecError("level, tile and node are columns of the layout")
    spark = points.sparkSession
    finest = spacing / 2 ** (levels - 1)
    cube = {f"v{c}": F.floor(F.col(c) / finest).cast("long") for c in "xyz"}
    placed = points.select("source_index", *(v.alias(n) for n, v in cube.items())).where("vx is not null and vy is not null and vz is not null")
    low, high = (placed.agg(*(f(v).alias(v) for v in cube)).first() for f in (F.min, F.max))
    whole = NODE_BITS + TILE_LEVELS + levels - 1  # a tile of level 0, in bits of the finest cubes
    root = tuple(((low[v] or 0) >> whole) << whole for v in cube)
    tree = Octree(float(spacing), levels, root)
    if any(((high[v] or 0) - r) >> (NODE_BITS + KEY_BITS) for v, r in zip(cube, root, strict=True)):
        raise SpecError("the cloud is too wide for this spacing and number of levels")
    scratch = f"{path.rstrip('/')}-levels"
    standing = _standing(placed, levels, scratch)
    rows = points.join(standing, "source_index", "left").withColumn("level", F.coalesce("level", F.lit(levels)))
    up = F.lit(levels - 1) - F.least("level", F.lit(levels - 1)) + NODE_BITS
    nodes = [_shifted(F.coalesce(v - r, F.lit(0).cast("long")), up) for v, r in zip(cube.values(), root, strict=True)]
    # a node's coordinates are made once and looked up many times; a tile's key is the node's without its last bits
    rows = rows.withColumns({f"__n{k}": n for k, n in enumerate(nodes)})
    rows = rows.withColumn("node", interleave(*(F.col(f"__n{k}") for k in range(3)))).drop("__n0", "__n1", "__n2")
    rows = rows.withColumn("tile", F.shiftright("node", 3 * TILE_LEVELS))
    laid = rows.repartitionByRange("level", "tile", "node", "source_index").sortWithinPartitions("level", "tile", "node", "source_index")
    laid.write.partitionBy("level", "tile").parquet(path)
    # the schema, too: a layout without points has no file to tell it
    write_small(spark, f"{path.rstrip('/')}/{_FILE}", json.dumps({**asdict(tree), "schema": rows.schema.jsonValue()}))
    remove_path(spark, scratch)
    return tree


def _shifted(value: Column, bits: Column) -> Column:
    """value >> bits, where bits is a column."""
    return F.call_function("shiftright", value, bits.cast("int"))


def open_point_octree(spark: SparkSession, path: str) -> Octree:
    facts = json.loads(read_small(spark, f"{path.rstrip('/')}/{_FILE}"))
    return Octree(facts["spacing"], facts["levels"], tuple(facts["root"]))


def octree_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a layout with their level, tile and node."""
    facts = json.loads(read_small(spark, f"{path.rstrip('/')}/{_FILE}"))
    return spark.read.schema(T.StructType.fromJson(facts["schema"])).parquet(path)


def octree_nodes(spark: SparkSession, path: str) -> DataFrame:
    """level, node, points and the z range of every node that is not empty."""
    return octree_rows(spark, path).groupBy("level", "node").agg(F.count("*").alias("points"), F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def _tiles(tree: Octree, level: int, box: Box) -> list[int] | None:
    """Keys of a level's tiles that touch the box in x and y, over all z; None if they are too many to name."""
    coarse = min(level, tree.levels - 1)
    edge = tree.edge(coarse) * 2 ** (NODE_BITS + TILE_LEVELS)
    first = [r >> (tree.levels - 1 - coarse + NODE_BITS + TILE_LEVELS) for r in tree.root]
    sides = [[math.floor(v / edge) - f for v in ends] for ends, f in zip(((box.min_x, box.max_x), (box.min_y, box.max_y)), first, strict=False)]
    top = 2 ** max(0, KEY_BITS - TILE_LEVELS)
    (x0, x1), (y0, y1) = ((max(0, a), min(top - 1, b)) for a, b in sides)
    if x1 < x0 or y1 < y0:
        return []
    return None if (x1 - x0 + 1) * (y1 - y0 + 1) > MAX_TILES else [_key(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)]


def _key(x: int, y: int) -> int:
    """Bits of a tile's key that x and y set."""
    return sum((x >> i & 1) << 3 * i | (y >> i & 1) << 3 * i + 1 for i in range(KEY_BITS))


#: Bits of a key that belong to x and y.
_XY = sum(3 << 3 * i for i in range(KEY_BITS))


def leveled_points(spark: SparkSession, path: str, box: Box, resolution: float | None = None, level: int | None = None) -> DataFrame:
    """Points in the box of all levels up to the asked one, or up to the one that a resolution needs; of all levels without either.

    Only the folders of these levels, and of tiles that touch the box, are read."""
    if resolution is not None and level is not None:
        raise SpecError("give a resolution or a level, not both")
    if level is not None and level < 0:
        raise SpecError("a level is not negative")
    tree = open_point_octree(spark, path)
    last = tree.level_for(resolution) if resolution is not None else tree.levels if level is None else min(level, tree.levels)
    wanted = F.lit(False)
    for k in range(last + 1):
        tiles = _tiles(tree, k, box)
        own = F.lit(True) if tiles is None else F.col("tile").bitwiseAND(F.lit(_XY)).isin(tiles) if tiles else F.lit(False)
        # points without a coordinate lie in tile 0 of the last level, outside of every box
        wanted = wanted | ((F.col("level") == k) & own)
    inside = F.col("x").between(box.min_x, box.max_x) & F.col("y").between(box.min_y, box.max_y)
    return octree_rows(spark, path).where((F.col("level") <= last) & wanted & inside).drop("tile", "node")


def leveled_point_region(spark: SparkSession, path: str, box: Box, resolution: float | None = None, level: int | None = None, classes: Sequence[int] = (), z_min: float | None = None, z_max: float | None = None, limit: int = MAX_RESULT_ROWS) -> tuple[DataFrame, DataFrame]:
    """point_region() of the stored levels: (up to ``limit`` points in source order, statistics of all that match)."""
    return point_region(leveled_points(spark, path, box, resolution, level), box, classes, z_min, z_max, limit)
