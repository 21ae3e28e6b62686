"""Statistics of many windows over one raster: a window costs its border, not its area.

A pyramid holds sums of the valid values of every tile, and of every square of 2^k by 2^k
tiles. A window is covered by the largest squares that lie in it; what is left
along its border is added up from pixels. Sums are of differences from the band's mean, so
that a large common offset takes no digits from the deviation. All parts are sums, minima and
maxima: windows, squares and pixels are added up before they are exchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import SpecError
from .rasters import valid_value

#: An edge of a tile is 2^TILE_BITS pixels.
TILE_BITS = 6
#: Windows, tiles or squares of windows, and pixels of one task.
TASK_WINDOWS, TASK_TILES, TASK_PIXELS = 20_000, 50_000, 500_000
_PARTS = ("n", "s1", "s2", "low", "high", "pixels")


def pyramid_levels(rows: int, cols: int, tile_bits: int = TILE_BITS) -> int:
    """Levels of a raster's pyramid: the last one has a square as large as the raster."""
    return max(0, (max(rows, cols, 1) - 1).bit_length() - tile_bits) + 1


def band_shifts(pixels: DataFrame, no_data: float | None = None) -> DataFrame:
    """(band, shift): the mean of a band's valid values, 0 without any. One row a band."""
    return pixels.groupBy("band").agg(F.coalesce(F.avg(valid_value(F.col("value"), no_data)), F.lit(0.0)).alias("shift"))


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    """Parts of pixels with ``v`` (null where not valid) and ``shift``."""
    d = F.col("v") - F.col("shift")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return df.groupBy(*keys).agg(F.count("v").alias("n"), zero(d).alias("s1"), zero(d * d).alias("s2"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("pixels"))


def _added(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*((F.min if c == "low" else F.max if c == "high" else F.sum)(c).alias(c) for c in _PARTS))


def raster_pyramid(pixels: DataFrame, rows: int, cols: int, no_data: float | None = None, tile_bits: int = TILE_BITS) -> DataFrame:
    """(level, band, tile_row, tile_col, shift, n, s1, s2, low, high, pixels): sums of every tile (level 0) and square of tiles with pixels.

    pixels: (row, col, band, value); those outside of the raster are left out. Pixels are added up to tiles once; all other levels are
    made of the tiles. Write the result to use it for more than one table of windows."""
    inside = pixels.where((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols))
    shifts = band_shifts(inside, no_data)  # one row a band
    tile = lambda c: F.shiftright(F.col(c).cast("long"), tile_bits)
    valued = inside.withColumns({"v": valid_value(F.col("value"), no_data), "tile_row": tile("row"), "tile_col": tile("col")})
    tiles = _summed(valued.join(F.broadcast(shifts), "band"), "band", "tile_row", "tile_col", "shift")
    squares = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("tile_row", k).alias("tile_row"), F.shiftright("tile_col", k).alias("tile_col")) for k in range(1, pyramid_levels(rows, cols, tile_bits))))
    ground = tiles.select(F.lit(0).alias("level"), "band", "tile_row", "tile_col", "shift", *_PARTS)
    if pyramid_levels(rows, cols, tile_bits) == 1:
        return ground
    above = tiles.select("band", "shift", *_PARTS, F.explode(squares).alias("s")).select("s.*", "band", "shift", *_PARTS)
    return ground.unionByName(_added(above, "level", "band", "tile_row", "tile_col", "shift"))


Range = tuple[Column, Column, Column, Column]


def _rect(level: int, a: Column, b: Column, c: Column, d: Column) -> Column:
    """array of (level, tile_row, tile_col): rows from a to before b, columns from c to before d."""
    none = F.array().cast("array<struct<level:int,tile_row:bigint,tile_col:bigint>>")
    one = lambda r: F.transform(F.sequence(c, d - 1), lambda k: F.struct(F.lit(level).alias("level"), r.alias("tile_row"), k.alias("tile_col")))
    return F.when((a < b) & (c < d), F.flatten(F.transform(F.sequence(a, b - 1), one))).otherwise(none)


def _ring(level: int, outer: Range, inner: Range) -> Column:
    """Tiles of a rectangle without those of another one within it, which may be empty."""
    (a, b, c, d), (ia, ib, ic, id_) = outer, inner
    around = F.concat(_rect(level, a, ia, c, d), _rect(level, ib, b, c, d), _rect(level, ia, ib, c, ic), _rect(level, ia, ib, id_, d))
    return F.when((ia < ib) & (ic < id_), around).otherwise(_rect(level, a, b, c, d))


def window_cover(rows: int, cols: int, tile_bits: int = TILE_BITS) -> tuple[Column, Column]:
    """Of a window with r0, r1, c0, c1 (half-open, within the raster, not empty): (tiles along its border, squares that cover the rest).

    Both are arrays of (level, tile_row, tile_col). Their number grows with the window's edges. A tile or square that the
    raster's own edge cuts counts as within the window where the window ends there."""

    def within(level: int) -> Range:
        bits = tile_bits + level
        up = lambda x: F.shiftright(F.col(x) + ((1 << bits) - 1), bits)
        down = lambda x, edge: F.when(F.col(x) == edge, up(x)).otherwise(F.shiftright(x, bits))
        return up("r0"), down("r1", rows), up("c0"), down("c1", cols)

    levels = pyramid_levels(rows, cols, tile_bits)
    ground = within(0)
    touched = (F.shiftright("r0", tile_bits), F.shiftright(F.col("r1") - 1, tile_bits) + 1, F.shiftright("c0", tile_bits), F.shiftright(F.col("c1") - 1, tile_bits) + 1)
    squares = []
    for k in range(levels):
        mine = within(k)
        if k + 1 == levels:
            squares.append(_rect(k, *mine))
            continue
        a, b, c, d = within(k + 1)
        # a square at the raster's edge may have fewer tiles below it
        squares.append(_ring(k, mine, (a * 2, F.least(b * 2, mine[1]), c * 2, F.least(d * 2, mine[3]))))
    return _ring(0, touched, ground), F.concat(*squares)


def window_statistics(windows: DataFrame, pixels: DataFrame, rows: int, cols: int, no_data: float | None = None, pyramid: DataFrame | None = None, tile_bits: int = TILE_BITS) -> DataFrame:
    """(selection_id, band, count, min, max, mean, stddev of the population) of the valid values in each window.

    windows: (selection_id, r0, r1, c0, c1), half-open and clipped to the raster; an empty one gives no row. A band without a pixel in
    a window gives no row, one without a valid value has the count 0 and nulls. Rows of one selection_id are added up. ``pyramid``: what
    raster_pyramid() gave for this raster, no_data and tile_bits."""
    if rows < 1 or cols < 1:
        raise SpecError("the raster is empty")
    pyramid = raster_pyramid(pixels, rows, cols, no_data, tile_bits) if pyramid is None else pyramid
    border, squares = window_cover(rows, cols, tile_bits)
    some = windows.select("selection_id", *(F.col(c).cast("long").alias(c) for c in ("r0", "r1", "c0", "c1"))).where("r0 < r1 and c0 < c1")
    key = ["level", "tile_row", "tile_col"]
    # a task adds up the windows that it meets, so their number sets the number of tasks, however few files hold them
    high, wide = (F.shiftright(F.col(b) - 1, tile_bits) - F.shiftright(F.col(a), tile_bits) + 1 for a, b in (("r0", "r1"), ("c0", "c1")))
    asked, touched = some.agg(F.count("*"), F.sum(F.least(high * wide, (high + wide) * 4))).first()
    least = pixels.sparkSession.sparkContext.defaultParallelism
    tasks = lambda n, most: max(least, math.ceil((n or 0) / most))
    some = some.repartition(tasks(asked, TASK_WINDOWS), "selection_id", "r0", "c0")
    held = pyramid.where(F.col("level") == pyramid_levels(rows, cols, tile_bits) - 1).agg(F.sum("pixels")).first()[0]
    parts = max(tasks(touched, TASK_TILES), tasks(held, TASK_PIXELS))
    whole = some.select("selection_id", F.explode(squares).alias("t")).select("selection_id", "t.*")
    whole = whole.repartition(parts, *key).join(pyramid.repartition(parts, *key), key)
    # pixels of the border, each window's added up by band; the shifts are the pyramid's own
    shifts = pyramid.where(F.col("level") == pyramid_levels(rows, cols, tile_bits) - 1).select("band", "shift").distinct()
    tile = lambda c: F.shiftright(F.col(c).cast("long"), tile_bits)
    laid = pixels.select("row", "col", "band", valid_value(F.col("value"), no_data).alias("v"), tile("row").alias("tile_row"), tile("col").alias("tile_col"))
    edges = some.select("*", F.explode(border).alias("t")).select("selection_id", "r0", "r1", "c0", "c1", "t.tile_row", "t.tile_col")
    inside = (F.col("row") >= F.col("r0")) & (F.col("row") < F.col("r1")) & (F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c1"))
    place = ["tile_row", "tile_col"]
    # pixels grow when they are read, so a small file does not make them fit for a broadcast
    cut = edges.repartition(parts, *place).join(laid.repartition(parts, *place).hint("shuffle_hash"), place).where(inside).join(F.broadcast(shifts), "band")
    found = whole.select("selection_id", "band", "shift", *_PARTS).unionByName(_summed(cut, "selection_id", "band", "shift"))
    n = F.nullif(F.col("n"), F.lit(0))
    mean = F.col("s1") / n
    one = F.col("low") == F.col("high")  # exact where all values are equal, however far from the band's mean
    spread = F.when(one, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / n - mean * mean)))
    return _added(found, "selection_id", "band", "shift").select(
        "selection_id", "band", F.col("n").alias("count"), F.col("low").alias("min"), F.col("high").alias("max"),
        F.when(one, F.col("low")).otherwise(mean + F.col("shift")).alias("mean"), F.when(n.isNotNull(), spread).alias("stddev"),
    )
