"""Rasters as pixel tables (row, col, band, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.science import finite, pixel_to_world, stretch_u8
from ..plans.spec import MAX_RASTER_PIXELS, Affine, Box, SpecError
from ..sources.scratch import kept

_STATISTICS = {"count": lambda v: F.count(v), "min": F.min, "max": F.max, "mean": F.avg, "stddev": F.stddev_pop}


def valid_value(value: Column, no_data: float | None) -> Column:
    v = finite(value.cast("double"))
    return v if no_data is None else F.when(v != F.lit(float(no_data)), v)


def pixel_window(box: Box, t: Affine, rows: int, cols: int) -> tuple[int, int, int, int]:
    """(first row, end row, first column, end column) of the pixels that a box touches; an empty window is an error."""
    import math

    if not t.north_up:
        raise SpecError("the transform is rotated or not north-up")
    c0, c1 = math.floor((box.min_x - t.a) / t.b), math.ceil((box.max_x - t.a) / t.b)
    r0, r1 = math.floor((box.max_y - t.d) / t.f), math.ceil((box.min_y - t.d) / t.f)
    c0, c1, r0, r1 = max(0, c0), min(cols, c1), max(0, r0), min(rows, r1)
    if c0 >= c1 or r0 >= r1:
        raise SpecError("the window is empty")
    if (c1 - c0) * (r1 - r0) > MAX_RASTER_PIXELS:
        raise SpecError(f"the window has more than {MAX_RASTER_PIXELS} pixels")
    return r0, r1, c0, c1


def in_window(pixels: DataFrame, window: tuple[int, int, int, int]) -> DataFrame:
    r0, r1, c0, c1 = window
    return pixels.where((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))


def zonal_statistics(pixels: DataFrame, keys: Sequence[str], no_data: float | None = None, statistics: Sequence[str] = ("count", "min", "max", "mean", "stddev")) -> DataFrame:
    """Statistics of valid values for each zone and band (population deviation), and the number of others."""
    if unknown := set(statistics) - set(_STATISTICS):
        raise SpecError(f"unknown statistics: {', '.join(sorted(unknown))}")
    v = valid_value(F.col("value"), no_data)
    return pixels.groupBy(*keys).agg(*(_STATISTICS[s](v).alias(s) for s in statistics), F.count_if(v.isNull()).alias("nodata_count"))


def raster_region(pixels: DataFrame, box: Box, t: Affine, rows: int, cols: int, bands: Sequence[int] = (), crs: str | None = None, box_crs: str | None = None, no_data: float | None = None, statistics: Sequence[str] = ("count", "min", "max", "mean", "stddev")) -> DataFrame:
    """Statistics of each band in the window of a box; there is no reprojection, so another CRS is an error."""
    if box_crs is not None and box_crs != crs:
        raise SpecError(f"the region is in {box_crs}, the raster in {crs}")
    found = in_window(pixels, pixel_window(box, t, rows, cols))
    return zonal_statistics(found.where(F.col("band").isin(*bands)) if bands else found, ["band"], no_data, statistics)


def raster_pixel(pixels: DataFrame, row: int, col: int, t: Affine, bands: Sequence[int] = ()) -> DataFrame:
    """The value of every band at one pixel, with the coordinates of its centre."""
    one = pixels.where((F.col("row") == row) & (F.col("col") == col))
    x, y = pixel_to_world(F.col("col"), F.col("row"), t)
    one = one.where(F.col("band").isin(*bands)) if bands else one
    return one.select("band", "value", x.alias("world_x"), y.alias("world_y")).orderBy("band")


def raster_export_window(pixels: DataFrame, window: tuple[int, int, int, int], t: Affine) -> tuple[DataFrame, Affine]:
    """The pixels of a window counted from its corner, and the shifted transform."""
    r0, _, c0, _ = window
    moved = in_window(pixels, window).withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})
    return moved, Affine(t.a + t.b * c0 + t.c * r0, t.b, t.c, t.d + t.e * c0 + t.f * r0, t.e, t.f)


def raster_tiles(pixels: DataFrame, size: int) -> DataFrame:
    """(band, tile_row, tile_col, values) with values in row-major order."""
    tile = lambda c: F.floor(F.col(c) / size).cast("long")
    cells = F.array_sort(F.collect_list(F.struct("row", "col", "value")))
    return pixels.groupBy("band", tile("row").alias("tile_row"), tile("col").alias("tile_col")).agg(F.transform(cells, lambda c: c["value"]).alias("values"))


def raster_overviews(pixels: DataFrame, rows: int, cols: int, no_data: float | None = None, least: int = 1) -> DataFrame:
    """Averages of 2^level by 2^level pixels for all levels until an edge would fall below ``least``: (level, band, row, col, value)."""
    levels, level = [], 1
    while min(rows, cols) >> level >= least:
        levels.append(level)
        level += 1
    v = valid_value(F.col("value"), no_data)
    cells = pixels.select("band", "row", "col", v.alias("sum"), F.when(v.isNotNull(), 1).otherwise(0).cast("long").alias("n"))
    out, done = None, 0
    # each tier is made of the sums and counts of the level before it, so pixels are aggregated once and not once a level
    for tier in ([x for x in levels if x == 1], [x for x in levels if 1 < x <= 4], [x for x in levels if x > 4]):
        if tier or out is None:
            rows_ = cells.withColumn("level", F.explode(F.array(*map(F.lit, tier)) if tier else F.array().cast("array<int>")))
            down = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), F.col("level") - done)).cast("long")  # noqa: E731, B023
            made = rows_.groupBy("level", "band", down("row").alias("row"), down("col").alias("col")).agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
            out = made if out is None else out.unionByName(made)
            if tier:
                done = tier[-1]
                cells = made.where(F.col("level") == done).drop("level")
    return out.select("level", "band", "row", "col", (F.col("sum") / F.nullif(F.col("n"), F.lit(0))).alias("value"))


def band_image(pixels: DataFrame, band: int, rows: int, cols: int, max_edge: int = 1024) -> DataFrame:
    """One band, every stride-th row and column so that no edge exceeds ``max_edge``."""
    sy, sx = -(-rows // max_edge), -(-cols // max_edge)
    plane = pixels.where((F.col("band") == band) & (F.col("row") % sy == 0) & (F.col("col") % sx == 0))
    return plane.select((F.col("row") / sy).cast("long").alias("y"), (F.col("col") / sx).cast("long").alias("x"), "value")


#: Bits of a key that a pass of the selection decides.
RADIX_BITS = 16


def order_key(value: Column) -> Column:
    """A long in the order of doubles, which are not null: the bits of a number, those of negative ones turned over. 0 and -0 are equal."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def key_value(key: int) -> float:
    """The double that has this key."""
    return float(np.array(key ^ (2**63 - 1) if key < 0 else key, np.int64).view(np.float64))


def select_ranks(values: DataFrame, value: str, ranks: Callable[[int], Sequence[int]]) -> list[float]:
    """The values at ranks (from 0) of all values that are not null; ``ranks`` makes them of the number of values. Nothing without values.

    Radix selection: each pass counts at most 2^RADIX_BITS buckets of the keys that begin as the wanted ones do, and goes on in the
    bucket that holds a rank. Values are read again for each pass, but neither sorted nor exchanged: tasks send counts.
    """
    keys, wanted = values.where(F.col(value).isNotNull()).select(order_key(F.col(value)).alias("key")), None
    for shift in range(64 - RADIX_BITS, -1, -RADIX_BITS):
        rows = keys if wanted is None else keys.where(F.shiftright("key", shift + RADIX_BITS).isin(sorted({w[0] for w in wanted})))
        counts = rows.groupBy(F.shiftright("key", shift).alias("bucket")).agg(F.count("*").alias("n")).collect()
        buckets = sorted((r["bucket"], r["n"]) for r in counts)
        if wanted is None:
            total = sum(n for _, n in buckets)
            if not total:
                return []
            asked = list(ranks(total))
            wanted = [(None, r) for r in asked]
        followed = []
        for prefix, rank in wanted:
            for bucket, n in buckets:
                if prefix is not None and bucket >> RADIX_BITS != prefix:
                    continue
                if rank < n:
                    followed.append((bucket, rank))
                    break
                rank -= n
        wanted = followed
    return [key_value(k) for k, _ in wanted]


def rank_percentiles(df: DataFrame, value: str = "value", low: int = 2, high: int = 98, no_data: float | None = None) -> DataFrame:
    """(low, high): values at the whole ranks (n - 1) * percent / 100 of valid values; equal ones give low + 1, no values give nulls. See select_ranks()."""
    v = df.select(valid_value(F.col(value), no_data).alias("v"))
    ends = select_ranks(v, "v", lambda n: [(n - 1) * p // 100 for p in (low, high)])
    a, b = ends if ends else (None, None)
    if ends and b <= a:
        b = a + 1
    return df.sparkSession.range(1).select(F.lit(a).cast("double").alias("low"), F.lit(b).cast("double").alias("high"))


def rgb_composite(pixels: DataFrame, bands: tuple[int, int, int], rows: int, cols: int, no_data: float | None = None, max_edge: int = 1024) -> DataFrame:
    """(y, x, r, g, b) with one stretch for the three bands together."""
    sy, sx = -(-rows // max_edge), -(-cols // max_edge)
    channels = F.array_compact(F.array(*(F.when(F.col("band") == b, c) for b, c in zip(bands, "rgb", strict=True))))  # a band may serve several
    seen = pixels.where(F.col("band").isin(*bands) & (F.col("row") % sy == 0) & (F.col("col") % sx == 0))
    together = seen.select((F.col("row") / sy).cast("long").alias("y"), (F.col("col") / sx).cast("long").alias("x"), "value", F.explode(channels).alias("channel"))
    together = kept(together, "composite")  # at most three times max_edge squared: the raster is scanned once
    stretch = rank_percentiles(together, no_data=no_data)
    levels = together.crossJoin(F.broadcast(stretch)).withColumn("level", stretch_u8(valid_value(F.col("value"), no_data), F.col("low"), F.col("high")))
    return levels.groupBy("y", "x").pivot("channel", list("rgb")).agg(F.first("level"))
