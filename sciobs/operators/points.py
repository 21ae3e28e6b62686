"""Point clouds as tables (source_index, x, y, z, classification, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import MAX_RESULT_ROWS, Box, SpecError
from .table import class_elevation_filter, source_rows


def bbox_filter(df: DataFrame, box: Box, x: str = "x", y: str = "y") -> DataFrame:
    """Points in an inclusive box: four range predicates that reach the scan."""
    return df.where((F.col(x) >= box.min_x) & (F.col(x) <= box.max_x) & (F.col(y) >= box.min_y) & (F.col(y) <= box.max_y))


def point_statistics(points: DataFrame) -> DataFrame:
    """One row: count, z minimum, maximum and mean, and the number of points of each class as a map."""
    by_class = points.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("lo"), F.max("z").alias("hi"), F.sum("z").alias("s"), F.count("z").alias("k"))
    classes = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("classification").isNotNull(), F.struct("classification", "n")))))
    return by_class.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.min("lo").alias("z_min"), F.max("hi").alias("z_max"), (F.sum("s") / F.sum("k")).alias("z_mean"), classes.alias("classes"))


def matched_points(points: DataFrame, box: Box, classes: Sequence[int] = (), z_min: float | None = None, z_max: float | None = None) -> DataFrame:
    return class_elevation_filter(bbox_filter(points, box), classes, z_min, z_max)


def point_region(points: DataFrame, box: Box, classes: Sequence[int] = (), z_min: float | None = None, z_max: float | None = None, limit: int = MAX_RESULT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(up to ``limit`` points in source order, statistics of all that match)."""
    found = matched_points(points, box, classes, z_min, z_max)
    return found.orderBy("source_index").limit(max(1, min(limit, MAX_RESULT_ROWS))), point_statistics(found)


def points_by_index(points: DataFrame, indices: Sequence[int], classes: Sequence[int] = (), z_min: float | None = None, z_max: float | None = None) -> DataFrame:
    """Points at these source positions, in the order asked for, filtered further."""
    return class_elevation_filter(source_rows(points, indices), classes, z_min, z_max).orderBy("position")


def with_cells(points: DataFrame, cell: float) -> DataFrame:
    if cell <= 0:
        raise SpecError("the cell size must be positive")
    return points.withColumns({"cell_x": F.floor(F.col("x") / cell).cast("long"), "cell_y": F.floor(F.col("y") / cell).cast("long")})


def build_point_index(points: DataFrame, cell: float, path: str, parts: int | None = None) -> None:
    """A spatial layout of the points: one folder for each column of cells, sorted within by cell, so that a box reads few folders and row groups.

    Ranges of cells and points make the tasks, so a dense column, or one dense cell, is split into several files."""
    laid, by = with_cells(points, cell), ("cell_x", "cell_y", "source_index")
    laid = laid.repartitionByRange(parts, *by) if parts else laid.repartitionByRange(*by)
    laid.sortWithinPartitions("cell_x", "cell_y", "source_index").write.mode("overwrite").partitionBy("cell_x").parquet(path)


def point_digest(points: DataFrame, cell: float) -> str:
    """Tells a cloud and its cell size apart: count and two sums of row hashes (the rows' order does not count; null and empty clouds are fine), hashed."""
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(k), *sorted(points.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string") for k in (0, 1)]
    parts = [F.lit(repr(float(cell))), F.lit(",".join(f"{n}:{t}" for n, t in sorted(points.dtypes))), F.count(F.lit(1)).cast("string"), *sums]
    return points.agg(F.sha2(F.concat_ws("|", *parts), 256).alias("digest")).first()["digest"]


def ensure_point_index(points: DataFrame, cell: float, root: str) -> tuple[str, bool]:
    """(path, reused): the index of these points under ``root``, built only if none of the same digest is finished there."""
    spark = points.sparkSession
    path = f"{root.rstrip('/')}/{point_digest(points, cell)}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return path, True
    build_point_index(points, cell, path)
    return path, False


def indexed_point_region(index: DataFrame, cell: float, box: Box, classes: Sequence[int] = (), z_min: float | None = None, z_max: float | None = None, limit: int = MAX_RESULT_ROWS) -> tuple[DataFrame, DataFrame]:
    """point_region() through the index: cell predicates prune folders and row groups first."""
    import math

    at = lambda v: math.floor(v / cell)
    near = index.where(F.col("cell_x").between(at(box.min_x), at(box.max_x)) & F.col("cell_y").between(at(box.min_y), at(box.max_y)))
    return point_region(near.drop("cell_x", "cell_y"), box, classes, z_min, z_max, limit)


def thin_points(points: DataFrame, resolution: float | None = None, level: int | None = None, extent: float | None = None) -> DataFrame:
    """One point, the first in source order, of every cube of an edge ``resolution``, or of extent / 2^level.

    The two are exclusive. Unlike a stored octree the levels are made when asked for."""
    if (resolution is None) == (level is None):
        raise SpecError("give a resolution or a level")
    edge = resolution if resolution is not None else (extent or 1.0) / 2**level
    if edge <= 0:
        raise SpecError("the resolution must be positive")
    voxel = [F.floor(F.col(c) / edge).cast("long").alias(f"v{c}") for c in "xyz"]
    columns = points.columns
    first = points.groupBy(*voxel).agg(F.min_by(F.struct(*columns), "source_index").alias("p"))
    return first.select(*(F.col("p")[c].alias(c) for c in columns))


def rebase_origin(points: DataFrame) -> DataFrame:
    """Coordinates from the layer's minimum, as float."""
    low = points.agg(*(F.min(c).alias(f"min_{c}") for c in "xyz"))  # one row
    moved = points.crossJoin(F.broadcast(low))
    return moved.withColumns({c: (F.col(c) - F.col(f"min_{c}")).cast("float") for c in "xyz"}).drop("min_x", "min_y", "min_z")
