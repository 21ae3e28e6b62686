"""Array and raster operators on embeddings: vectors as rows of a cube or raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.science import decode_sample, ravel, stretch_u8, unravel, world_to_pixel
from ..operators import arrays as a
from ..operators import rasters as r
from ..plans.spec import Affine, AxisRange, Box
from ..sources.files import read_zarr_chunks, read_zarr_slice, write_zarr_chunks
from .common import Registry, read, rnd, rounded, scratch

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
WIDTH = 64
AFFINE = Affine(100.0, 2.0, 0.0, 5000.0, 0.0, -2.0)
_CELLS = "WITH cells AS (SELECT vec_id, label, unnest(embedding) AS value, unnest(range(0, len(embedding))) AS band FROM embeddings)"
_PIXELS = "WITH px AS (SELECT vec_id // 4 AS row, i AS col, vec_id % 4 AS band, CAST(v AS DOUBLE) AS value, label FROM (SELECT vec_id, label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings))"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.lit("embeddings").alias("array_path"), F.array("vec_id", F.lit(0).cast("long")).alias("origin"), F.array(F.lit(1).cast("long"), F.size("embedding").cast("long")).alias("shape"), F.col("embedding").cast("array<double>").alias("values"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("y"), F.col("label").cast("long").alias("x"), F.posexplode(F.col("embedding").cast("array<double>")).alias("band", "value"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 4).alias("row"), (F.col("vec_id") % 4).alias("band"), "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("col", "value")).select("row", F.col("col").cast("long").alias("col"), "band", "value", "label")


def wavelengths(spark: SparkSession) -> DataFrame:
    return spark.range(WIDTH).select(F.col("id").cast("int").alias("band"), (F.lit(400.0) + F.col("id") * 10).alias("wavelength"), F.lit("nm").alias("unit"))


def _rows(spark: SparkSession, sf_dir: str) -> int:
    return read(spark, sf_dir, "embeddings").agg((F.floor(F.max("vec_id") / 4) + 1).alias("n")).first()["n"]


@query("explode_array_chunks", _CELLS + " SELECT vec_id AS y, band, CAST(value AS DOUBLE) AS value FROM cells")
def explode_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.explode_array_chunks(chunks(spark, sf_dir), 2)
    return out.select(F.col("indices")[0].alias("y"), F.col("indices")[1].alias("band"), "value")


@query("cube_slice", _CELLS + " SELECT vec_id AS y, band, CAST(value AS DOUBLE) AS value FROM cells WHERE vec_id >= 10 AND vec_id < 400 AND (vec_id - 10) % 3 = 0 AND band >= 5 AND band < 60 AND (band - 5) % 7 = 0")
def cube_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.cube_slice(chunks(spark, sf_dir), [AxisRange(10, 400, 3), AxisRange(5, 60, 7)])
    return out.select(F.col("indices")[0].alias("y"), F.col("indices")[1].alias("band"), "value")


def _zarr(spark: SparkSession, sf_dir: str) -> str:
    """The vectors as a Zarr array of chunks of 50 by 16, written to the shared folder by the tasks."""
    e = read(spark, sf_dir, "embeddings")
    rows = e.agg((F.max("vec_id") + 1).alias("n")).first()["n"]
    cells = a.explode_array_chunks(chunks(spark, sf_dir), 2)
    path = scratch(spark, "zarr")
    write_zarr_chunks(a.chunk_cells(cells, [rows, WIDTH], [50, 16]), path, "vectors", [rows, WIDTH], [50, 16])
    return path


@query("read_zarr_chunks", _CELLS + " SELECT vec_id - vec_id % 50 AS row, band - band % 16 AS band, count(*) AS cells, round(sum(CAST(value AS DOUBLE)), 4) AS total FROM cells GROUP BY 1, 2")
def zarr_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a chunk of the written array."""
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    found = read_zarr_chunks(spark, _zarr(spark, sf_dir), "vectors")
    return found.select(F.col("origin")[0].alias("row"), F.col("origin")[1].alias("band"), F.size("values").cast("long").alias("cells"), rnd(total).alias("total"))


@query("read_zarr_slice", _CELLS + " SELECT vec_id AS y, band, CAST(value AS DOUBLE) AS value FROM cells WHERE vec_id >= 120 AND vec_id < 300 AND (vec_id - 120) % 3 = 0 AND band >= 20 AND band < 31")
def zarr_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the chunks of rows 100 to 300 and bands 16 to 32 are opened."""
    out = read_zarr_slice(spark, _zarr(spark, sf_dir), "vectors", [AxisRange(120, 300, 3), AxisRange(20, 31, 1)])
    return out.select(F.col("indices")[0].alias("y"), F.col("indices")[1].alias("band"), "value")


@query("grid_subset", _CELLS + " SELECT vec_id AS y, band, CAST(value AS DOUBLE) AS value FROM cells WHERE vec_id >= 0 AND vec_id <= 90 AND vec_id % 10 = 0 AND band >= 10 AND band <= 30 AND (band - 10) % 2 = 0")
def grid_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = a.grid_subset(chunks(spark, sf_dir), [(0, 10, 90), (10, 2, 30)])
    return out.select(F.col("indices")[0].alias("y"), F.col("indices")[1].alias("band"), "value")


@query("grid_subset_by_value", _CELLS + " SELECT vec_id AS y, band, 400.0 + 10 * band AS coordinate, CAST(value AS DOUBLE) AS value FROM cells WHERE 400 + 10 * band BETWEEN 555 AND 602")
def grid_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = wavelengths(spark).select(F.col("band").alias("index"), F.col("wavelength").alias("coordinate"))
    out = a.grid_subset_by_value(chunks(spark, sf_dir), 1, axis, 555, 602, 2)
    return out.select(F.col("indices")[0].alias("y"), F.col("indices")[1].alias("band"), "coordinate", "value")


@query("spectrum", _CELLS + " SELECT band, 400.0 + 10 * band AS wavelength, round(CAST(value AS DOUBLE) * 0.5 + 1, 6) AS value FROM cells, (SELECT label AS l FROM embeddings WHERE vec_id = 7) WHERE vec_id = 7 AND label = l AND band NOT IN (3, 4) AND 400 + 10 * band BETWEEN 420 AND 700")
def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "embeddings").where("vec_id = 7").first()["label"]
    return rounded(a.spectrum(cells(spark, sf_dir), 7, x, wavelengths(spark), bad_bands=[3, 4], low=420, high=700, scale=0.5, offset=1.0), "value", digits=6)


@query("spectra_batch", _CELLS + " SELECT vec_id AS y, band, round(CAST(value AS DOUBLE) * 2, 6) AS value FROM cells WHERE label = 3 AND band <> 9 AND 400 + 10 * band <= 600")
def spectra_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = read(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("y"), F.col("label").cast("long").alias("x"))
    return a.spectra_batch(cells(spark, sf_dir), picks, wavelengths(spark), scale=2.0, bad_bands=[9], high=600).select("y", "band", rnd("value", 6).alias("value"))


@query("spectral_filter", _CELLS + " SELECT vec_id AS y, band FROM cells WHERE band NOT IN (0, 1) AND 400 + 10 * band BETWEEN 450 AND 500 AND value <> 0")
def spectral_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = cells(spark, sf_dir).join(F.broadcast(wavelengths(spark)), "band")
    return a.spectral_filter(joined, bad_bands=[0, 1], no_data=0.0, low=450, high=500).select("y", "band")


@query("spectrum_series", _CELLS + " SELECT vec_id AS y, band, 400.0 + 10 * band AS wavelength, CAST(value AS DOUBLE) AS value FROM cells WHERE isfinite(value)")
def spectrum_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.spectrum_series(cells(spark, sf_dir).join(F.broadcast(wavelengths(spark)), "band"), ["y"])


@query("nearest_band", """SELECT vec_id AS y, target, CAST(arg_min(i, abs(v - target) * 1000 + i * 1e-9) AS INTEGER) AS band FROM
    (SELECT vec_id, unnest(embedding)::DOUBLE * 1000 AS v, unnest(range(0, 64)) AS i FROM embeddings), (SELECT unnest([-50.0, 0.0, 120.0])::DOUBLE AS target) GROUP BY 1, 2""")
def nearest_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = cells(spark, sf_dir).select("y", "band", (F.col("value") * 1000).alias("wavelength"), F.lit("nm").alias("unit"))
    return a.nearest_band(axis, [-50.0, 0.0, 120.0], ["y"])


@query("match_wavelength_axis", "SELECT 'label ' || label AS array_path, 1 AS axis, 'wavelength' AS coordinate_path, 64 AS length FROM embeddings GROUP BY label HAVING count(*) <> 64")
def match_wavelength(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.array(F.count(F.lit(1)), F.max(F.size("embedding")).cast("long")).alias("shape"))
    coordinates = wavelengths(spark).agg(F.lit("wavelength").alias("coordinate_path"), F.count(F.lit(1)).alias("length"))
    return a.match_wavelength_axis(groups.select(F.concat(F.lit("label "), "label").alias("array_path"), "shape"), coordinates)


@query("largest_array", "SELECT n, 64 AS width FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ORDER BY n DESC, 'label ' || label DESC LIMIT 1")
def largest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.array(F.count(F.lit(1)), F.max(F.size("embedding")).cast("long")).alias("shape"))
    return a.largest_array(groups.select(F.concat(F.lit("label "), "label").alias("array_path"), "shape")).select(F.col("shape")[0].alias("n"), F.col("shape")[1].alias("width"))


@query("ravel_unravel", "SELECT vec_id, (vec_id // 35) % 9 AS i, (vec_id // 7) % 5 AS j, vec_id % 7 AS k, vec_id % 315 AS flat FROM embeddings")
def ravel_unravel(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j, k = unravel(F.col("vec_id"), [9, 5, 7])
    return read(spark, sf_dir, "embeddings").select("vec_id", i.alias("i"), j.alias("j"), k.alias("k"), ravel([i, j, k], [9, 5, 7]).alias("flat"))


@query("decode_sample", _CELLS + " SELECT vec_id AS y, band, CASE WHEN label = 4 THEN NULL ELSE round(label / 8.0 + 0.5, 6) END AS value FROM cells WHERE band = 0")
def decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).where("band = 0").select("y", "band", rnd(decode_sample(F.col("x"), 8.0, 0.5, 4.0, divisor=True), 6).alias("value"))


@query("zonal_statistics", _PIXELS + " SELECT label AS zone, band, count(value) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, count(*) - count(value) AS nodata_count FROM px GROUP BY 1, 2")
def zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.zonal_statistics(pixels(spark, sf_dir).withColumnRenamed("label", "zone"), ["zone", "band"]), "mean", "stddev", digits=6)


@query("raster_region", _PIXELS + " SELECT band, count(value) AS count, round(avg(value), 6) AS mean, 0 AS nodata_count FROM px WHERE row >= 5 AND row < 26 AND col >= 10 AND col < 31 AND band IN (0, 2) GROUP BY band")
def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = r.raster_region(pixels(spark, sf_dir), Box(121.0, 4949.0, 161.0, 4989.0), AFFINE, _rows(spark, sf_dir), WIDTH, bands=[0, 2], statistics=("count", "mean"))
    return rounded(out, "mean", digits=6)


@query("raster_pixel", _PIXELS + " SELECT band, value, 100.0 + 2 * (col + 0.5) AS world_x, 5000.0 - 2 * (row + 0.5) AS world_y FROM px WHERE row = 9 AND col = 17")
def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.raster_pixel(pixels(spark, sf_dir), 9, 17, AFFINE)


@query("raster_export_window", _PIXELS + " SELECT row - 3 AS row, col - 8 AS col, band, value FROM px WHERE row >= 3 AND row < 20 AND col >= 8 AND col < 40")
def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.raster_export_window(pixels(spark, sf_dir), (3, 20, 8, 40), AFFINE)[0].select("row", "col", "band", "value")


@query("raster_tiles", _PIXELS + " SELECT band, row // 16 AS tile_row, col // 16 AS tile_col, count(*) AS n, first(value ORDER BY row, col) AS first_value, last(value ORDER BY row, col) AS last_value FROM px GROUP BY 1, 2, 3")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.raster_tiles(pixels(spark, sf_dir), 16).select("band", "tile_row", "tile_col", F.size("values").cast("long").alias("n"), F.col("values")[0].alias("first_value"), F.element_at("values", -1).alias("last_value"))


@query("raster_overviews", _PIXELS + """, s AS (SELECT least(max(row) + 1, 64) AS edge FROM px)
    SELECT level, band, row // (1 << level) AS row, col // (1 << level) AS col, round(avg(value), 6) AS value FROM px, (SELECT unnest(range(1, 20)) AS level FROM s) l, s WHERE edge >> level >= 1 GROUP BY 1, 2, 3, 4""")
def overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.raster_overviews(pixels(spark, sf_dir), _rows(spark, sf_dir), WIDTH), "value", digits=6)


@query("band_image", _PIXELS + ", s AS (SELECT CAST(ceil((max(row) + 1) / 32.0) AS BIGINT) AS sy FROM px) SELECT row // sy AS y, col // 2 AS x, value FROM px, s WHERE band = 1 AND row % sy = 0 AND col % 2 = 0")
def band_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.band_image(pixels(spark, sf_dir), 1, _rows(spark, sf_dir), WIDTH, 32)


_STRETCH = "st AS (SELECT v[((len(v) - 1) * 2) // 100 + 1] AS low, v[((len(v) - 1) * 98) // 100 + 1] AS high FROM (SELECT list(value ORDER BY value) AS v FROM {}))"


@query("rank_percentile", _PIXELS + ", " + _STRETCH.format("px") + " SELECT low, high FROM st")
def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.rank_percentiles(pixels(spark, sf_dir))


@query("rgb_composite", _PIXELS + ", im AS (SELECT row AS y, col AS x, band, value FROM px WHERE band IN (0, 1, 2)), " + _STRETCH.format("im") + """,
    lv AS (SELECT y, x, band, CAST(round((least(greatest(value, low), high) - low) / (high - low) * 255) AS INTEGER) AS l FROM im, st)
    SELECT y, x, max(l) FILTER (band = 2) AS r, max(l) FILTER (band = 1) AS g, max(l) FILTER (band = 0) AS b FROM lv GROUP BY 1, 2""")
def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.rgb_composite(pixels(spark, sf_dir), (2, 1, 0), _rows(spark, sf_dir), WIDTH, max_edge=1 << 20)


@query("stretch_u8", _PIXELS + " SELECT row, col, band, CAST(round((least(greatest(value, -0.25), 0.25) + 0.25) / 0.5 * 255) AS INTEGER) AS level FROM px")
def stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("row", "col", "band", stretch_u8(F.col("value"), F.lit(-0.25), F.lit(0.25)).alias("level"))


@query("world_to_pixel", "SELECT l_orderkey, l_linenumber, CAST(floor((l_extendedprice - 100) / 2) AS BIGINT) AS col, CAST(floor((l_quantity - 5000) / -2) AS BIGINT) AS row FROM lineitem")
def to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    col, row = world_to_pixel(F.col("l_extendedprice"), F.col("l_quantity"), AFFINE)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", col.alias("col"), row.alias("row"))
