"""N-dimensional arrays as chunk tables and cell tables.

A chunk table has (array_path, origin array<bigint>, shape array<bigint>, values array<double>) with values in C order;
a cell table has (indices array<bigint>, value). Ranges prune chunks by their origin and shape before anything is exploded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.science import decode_sample, finite, wavelength_factor
from ..plans.spec import MAX_CUBE_CELLS, AxisRange, SpecError


def explode_array_chunks(chunks: DataFrame, rank: int) -> DataFrame:
    """Chunk table -> (array_path, indices, value), the position within a chunk unravelled along its shape."""
    cells = chunks.select("array_path", "origin", "shape", F.posexplode("values").alias("at", "value"))
    position, indices = F.col("at").cast("long"), []
    for axis in reversed(range(rank)):
        n = F.col("shape")[axis]
        indices.append((position % n + F.col("origin")[axis]).cast("long"))
        position = ((position - position % n) / n).cast("long")
    return cells.select("array_path", F.array(*indices[::-1]).alias("indices"), "value")


def chunk_cells(cells: DataFrame, shape: Sequence[int], chunk: Sequence[int]) -> DataFrame:
    """Cell table (array_path, indices, value) -> chunk table on the grid of ``chunk``; edge chunks are cut to the array.

    Cells that are missing or null are NaN, chunks without any cell give no row, cells out of the array are an error, and of
    repeated cells the smallest value counts. A task holds one chunk at a time."""
    if len(shape) != len(chunk) or any(c < 1 for c in chunk):
        raise SpecError("one positive chunk length for each axis")
    cell = lambda k: F.col("indices")[k]
    outside = F.size("indices") != len(shape)
    for k, n in enumerate(shape):
        outside = outside | (cell(k) < 0) | (cell(k) >= n)
    origin = F.array(*((cell(k) - cell(k) % c).cast("long") for k, c in enumerate(chunk)))
    size = F.array(*(F.least(F.lit(c), F.lit(n) - F.col("origin")[k]).cast("long") for k, (c, n) in enumerate(zip(chunk, shape, strict=True))))
    at = F.lit(0).cast("long")
    for k in range(len(chunk)):
        at = at * F.col("shape")[k] + (cell(k) - F.col("origin")[k])
    placed = cells.where(F.when(outside, F.raise_error(F.lit("a cell lies out of the array"))).otherwise(F.lit(True)))
    placed = placed.withColumn("origin", origin).withColumn("shape", size).withColumn("__at", at)
    one = placed.groupBy("array_path", "origin", "shape", "__at").agg(F.min("value").cast("double").alias("value"))
    held = one.groupBy("array_path", "origin", "shape").agg(F.sort_array(F.collect_list(F.struct("__at", F.coalesce("value", F.lit(float("nan"))).alias("value")))).alias("held"))
    length = F.aggregate("shape", F.lit(1).cast("long"), lambda a, b: a * b)
    gap = lambda n: F.array_repeat(F.lit(float("nan")), n.cast("int"))
    # cells in their order; only where some are missing, each is led by the gap before it
    before = lambda i: F.when(i == 0, F.lit(-1).cast("long")).otherwise(F.get("held", i - 1)["__at"])
    led = F.flatten(F.transform("held", lambda c, i: F.concat(gap(c["__at"] - before(i) - 1), F.array(c["value"]))))
    filled = F.concat(led, gap(length - 1 - F.element_at("held", -1)["__at"]))
    values = F.when(F.size("held") == length, F.transform("held", lambda c: c["value"])).otherwise(filled)
    return held.select("array_path", "origin", "shape", values.alias("values"))


def slice_size(ranges: Sequence[AxisRange]) -> int:
    total = 1
    for r in ranges:
        total *= max(0, -(-(r.end - r.start) // r.step))
    return total


def check_ranges(ranges: Sequence[AxisRange], shape: Sequence[int] | None, cell_limit: int) -> None:
    if shape is not None and len(shape) != len(ranges):
        raise SpecError("one range for each axis")
    for k, r in enumerate(ranges):
        if r.step < 1 or r.start < 0 or r.end <= r.start or shape is not None and r.end > shape[k]:
            raise SpecError(f"range {k} is empty or out of bounds")
    if slice_size(ranges) > cell_limit:
        raise SpecError(f"the slice has {slice_size(ranges)} cells, the limit is {cell_limit}")


def cube_slice(chunks: DataFrame, ranges: Sequence[AxisRange], shape: Sequence[int] | None = None, cell_limit: int = MAX_CUBE_CELLS) -> DataFrame:
    """(array_path, indices, value) of the cells in half-open ranges with steps; a slice over the limit is an error.

    Only chunks that overlap the ranges are read further. Row-major order is that of ``indices``.
    """
    check_ranges(ranges, shape, cell_limit)
    for k, r in enumerate(ranges):
        chunks = chunks.where((F.col("origin")[k] < r.end) & (F.col("origin")[k] + F.col("shape")[k] > r.start))
    cells = explode_array_chunks(chunks, len(ranges))
    for k, r in enumerate(ranges):
        i = F.col("indices")[k]
        cells = cells.where((i >= r.start) & (i < r.end) & ((i - r.start) % r.step == 0))
    return cells


def grid_subset(chunks: DataFrame, slices: Sequence[tuple[int, int, int]], shape: Sequence[int] | None = None, cell_limit: int = MAX_CUBE_CELLS) -> DataFrame:
    """Slices (start, stride, stop) with an inclusive stop."""
    return cube_slice(chunks, [AxisRange(a, b + 1, s) for a, s, b in slices], shape, cell_limit)


def grid_subset_by_value(chunks: DataFrame, axis: int, coordinates: DataFrame, low: float, high: float, rank: int) -> DataFrame:
    """Cells whose coordinate on one axis lies in an inclusive range. coordinates: (index, coordinate), as long as the axis."""
    wanted = coordinates.where(F.col("coordinate").between(low, high)).select(F.col("index").cast("long").alias("__i"), "coordinate")
    cells = explode_array_chunks(chunks, rank)
    return cells.join(wanted, F.col("indices")[axis] == F.col("__i")).drop("__i")


def spectral_filter(df: DataFrame, value: str = "value", band: str = "band", wavelength: str = "wavelength", bad_bands: Sequence[int] = (), no_data: float | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Drops bad bands, raw no-data and wavelengths outside an inclusive range."""
    out = df.where(~F.col(band).isin(*bad_bands)) if bad_bands else df
    out = out.where(F.col(value).isNull() | (F.col(value) != F.lit(no_data))) if no_data is not None else out
    out = out.where(F.col(wavelength) >= low) if low is not None else out
    return out.where(F.col(wavelength) <= high) if high is not None else out


def spectra_batch(cells: DataFrame, pixels: DataFrame, wavelengths: DataFrame, scale: float = 1.0, offset: float = 0.0, no_data: float | None = None, bad_bands: Sequence[int] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """Spectra of many pixels at once.

    cells (y, x, band, value), pixels (y, x and any ids), wavelengths (band,
    wavelength). No-data is compared to the raw value; the rest is decoded.
    """
    found = cells.join(pixels, ["y", "x"]).join(wavelengths, "band")
    kept = spectral_filter(found, bad_bands=bad_bands, no_data=no_data, low=low, high=high)
    return kept.withColumn("value", decode_sample(F.col("value"), scale, offset))


def spectrum(cells: DataFrame, y: int, x: int, wavelengths: DataFrame, **options) -> DataFrame:
    """The spectrum of one pixel, by band."""
    one = cells.where((F.col("y") == y) & (F.col("x") == x))
    kept = spectral_filter(one.join(wavelengths, "band"), **{k: v for k, v in options.items() if k in ("bad_bands", "no_data", "low", "high")})
    return kept.select("band", "wavelength", decode_sample(F.col("value"), options.get("scale", 1.0), options.get("offset", 0.0)).alias("value")).orderBy("band")


def spectrum_series(spectra: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Finite (wavelength, value) pairs in band order."""
    ok = finite(F.col("wavelength").cast("double")).isNotNull() & finite(F.col("value")).isNotNull()
    return spectra.where(ok).select(*keys, "band", "wavelength", "value").orderBy(*keys, "band")


def nearest_band(coordinates: DataFrame, targets: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(target, band): the first band whose wavelength is nearest; coordinates (band, wavelength, unit)."""
    nm = F.col("wavelength") * wavelength_factor(F.col("unit"))
    wanted = F.explode(F.array(*(F.lit(float(t)) for t in targets))).alias("target")
    rows = coordinates.where(nm.isNotNull()).select(*keys, "band", nm.alias("nm"), wanted)
    return rows.groupBy(*keys, "target").agg(F.min_by("band", F.struct(F.abs(F.col("nm") - F.col("target")), "band")).alias("band"))


def match_wavelength_axis(arrays: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(array_path, axis, coordinate_path) where exactly one axis and one coordinate agree in length.

    arrays (array_path, shape), coordinates (coordinate_path, length)."""
    axes = arrays.select("array_path", F.posexplode("shape").alias("axis", "length"))
    pairs = axes.join(coordinates, "length")
    alone = F.count(F.lit(1)).over(Window.partitionBy("array_path"))
    return pairs.withColumn("__n", alone).where("__n = 1").select("array_path", "axis", "coordinate_path", "length")


def default_array(arrays: DataFrame) -> DataFrame:
    """(dataset_id, array_path, wavelength_path, error): the only rank-3 array, and the only rank-1 ``*wavelength*`` as long as one of its axes.

    arrays (dataset_id, array_path, shape). Ambiguity is an error, not a guess; a missing wavelength is not."""
    cubes = arrays.where(F.size("shape") == 3).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("cubes"), F.min("array_path").alias("array_path"), F.min("shape").alias("shape"))
    lines = arrays.where((F.size("shape") == 1) & F.lower("array_path").contains("wavelength")).select("dataset_id", F.col("array_path").alias("path"), F.col("shape")[0].alias("length"))
    fitting = cubes.join(lines, "dataset_id").where(F.array_contains("shape", F.col("length"))).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("lines"), F.min("path").alias("path"))
    rows = arrays.select("dataset_id").distinct().join(cubes, "dataset_id", "left").join(fitting, "dataset_id", "left")
    error = F.when(F.coalesce("cubes", F.lit(0)) == 0, "no_cube").when(F.col("cubes") > 1, "ambiguous_cube").when(F.coalesce("lines", F.lit(0)) > 1, "ambiguous_wavelength")
    return rows.select("dataset_id", F.when(error.isNull() | (error == "ambiguous_wavelength"), F.col("array_path")).alias("array_path"), F.when(error.isNull(), F.col("path")).alias("wavelength_path"), error.alias("error"))


def cube_descriptors(arrays: DataFrame, role: Column | None = None) -> DataFrame:
    """Arrays of rank two and more with their axes' roles, chunk shape and decoding. arrays (array_path, shape, axis_names, chunk_shape, attrs map)."""
    from ..functions.science import axis_role, try_double

    def attr(*names: str) -> Column:
        return F.coalesce(*(try_double(F.try_element_at("attrs", F.lit(n))) for n in names))

    axes = F.transform(F.arrays_zip("axis_names", "shape"), lambda z: F.struct(z["axis_names"].alias("name"), axis_role(z["axis_names"]).alias("role"), z["shape"].alias("length")))
    return arrays.where(F.size("shape") >= 2).select(
        "array_path", axes.alias("axes"), "chunk_shape",
        attr("scale_factor", "Scale_Factor").alias("scale"), attr("add_offset", "offset").alias("offset"), attr("_FillValue", "missing_value", "Data_Ignore_Value").alias("no_data"),
    )


def largest_array(arrays: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Shape of the array with the most cells; of equal ones the last path."""
    cells = F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n)
    return arrays.groupBy(*keys).agg(F.max_by("shape", F.struct(cells, "array_path")).alias("shape"))
