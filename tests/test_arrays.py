from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from sciobs.operators import arrays as a
from sciobs.operators import rasters as r
from sciobs.plans.spec import Affine, AxisRange, Box, SpecError

CHUNK = "array_path string, origin array<bigint>, shape array<bigint>, values array<double>"


def cube(spark, shape, chunk, values=None):
    """A chunk table of 0, 1, 2, ... in C order."""
    import numpy as np

    full = np.arange(np.prod(shape), dtype=float).reshape(shape)
    rows = []
    for at in np.ndindex(*(-(-n // c) for n, c in zip(shape, chunk, strict=True))):
        origin = [i * c for i, c in zip(at, chunk, strict=True)]
        part = full[tuple(slice(o, o + c) for o, c in zip(origin, chunk, strict=True))]
        rows.append(("x", origin, list(part.shape), part.ravel().tolist()))
    return spark.createDataFrame(rows, CHUNK)


@pytest.mark.parametrize("shape,chunk,ranges,n,first,last", [
    ([2, 3, 4], [2, 3, 4], [(1, 2, 1), (0, 3, 2), (1, 4, 2)], 4, 13, 23), ([2, 3, 4], [1, 2, 2], [(0, 2, 1), (1, 3, 1), (0, 4, 2)], 8, 4, 22), ([2, 3], [2, 2], [(0, 2, 1), (1, 3, 1)], 4, 1, 5),
])
def test_slices(spark, shape, chunk, ranges, n, first, last):
    got = a.cube_slice(cube(spark, shape, chunk), [AxisRange(*x) for x in ranges], shape).orderBy("indices").collect()
    assert len(got) == n and got[0]["value"] == first and got[-1]["value"] == last


def test_slice_errors(spark):
    c = cube(spark, [2, 3], [2, 3])
    for ranges in ([AxisRange(0, 3), AxisRange(0, 1)], [AxisRange(1, 1), AxisRange(0, 1)], [AxisRange(0, 1)], [AxisRange(0, 1, 0), AxisRange(0, 1)]):
        with pytest.raises(SpecError):
            a.cube_slice(c, ranges, [2, 3])
    with pytest.raises(SpecError):
        a.cube_slice(c, [AxisRange(0, 2), AxisRange(0, 3)], [2, 3], cell_limit=5)


def test_inclusive_stop(spark):
    assert [x["value"] for x in a.grid_subset(cube(spark, [30], [7]), [(10, 2, 30 - 1)]).orderBy("indices").collect()] == [float(v) for v in range(10, 30, 2)]


def cells(spark):
    return a.explode_array_chunks(cube(spark, [2, 3, 4], [1, 3, 2]), 3).selectExpr("indices[0] y", "indices[1] x", "int(indices[2]) band", "value")


def test_spectrum(spark):
    w = spark.createDataFrame([(i, 400.0 + 100 * i) for i in range(4)], "band int, wavelength double")
    one = a.spectrum(cells(spark), 1, 1, w, low=500, high=650, scale=0.01).collect()
    assert [(x["wavelength"], round(x["value"], 9)) for x in one] == [(500.0, 0.17), (600.0, 0.18)]
    picks = spark.createDataFrame([("s", 1, 1), ("t", 0, 2)], "selection string, y long, x long")
    batch = a.spectra_batch(cells(spark), picks, w, scale=0.01, low=500, high=650, no_data=10.0)
    assert sorted((x["selection"], x["band"]) for x in batch.collect()) == [("s", 1), ("s", 2), ("t", 1)]


def test_bands_and_arrays(spark):
    axis = spark.createDataFrame([(i, w, "nm") for i, w in enumerate([400.0, 450.0, 550.0, 650.0, 800.0])] + [(9, 0.55, "um"), (10, 550.0, "furlong")], "band int, wavelength double, unit string")
    assert {x["target"]: x["band"] for x in a.nearest_band(axis, [650.0, 550.0, 450.0]).collect()} == {650.0: 3, 550.0: 2, 450.0: 1}
    arrays = spark.createDataFrame([("d", "refl", [2, 3, 4]), ("d", "wavelength", [4]), ("e", "one", [2, 2, 2]), ("e", "two", [2, 2, 2]), ("f", "flat", [3]), ("g", "c", [5, 6, 7]), ("g", "wavelength_a", [7]), ("g", "wavelength_b", [7])], "dataset_id string, array_path string, shape array<bigint>")
    got = {x["dataset_id"]: (x["array_path"], x["wavelength_path"], x["error"]) for x in a.default_array(arrays).collect()}
    assert got == {"d": ("refl", "wavelength", None), "e": (None, None, "ambiguous_cube"), "f": (None, None, "no_cube"), "g": ("c", None, "ambiguous_wavelength")}
    assert a.largest_array(arrays.where("dataset_id = 'e'"), ["dataset_id"]).first()["shape"] == [2, 2, 2]


def test_descriptors(spark):
    rows = [("refl", [2, 3, 4], ["y", "Longitude", "wavelength"], [1, 3, 4], {"Scale_Factor": "10000", "Data_Ignore_Value": "-9999"}), ("line", [4], ["band"], [4], {})]
    (d,) = a.cube_descriptors(spark.createDataFrame(rows, "array_path string, shape array<bigint>, axis_names array<string>, chunk_shape array<bigint>, attrs map<string,string>")).collect()
    assert [x["role"] for x in d["axes"]] == ["y", "x", "spectral"] and d["scale"] == 10000.0 and d["no_data"] == -9999.0


T4 = Affine(0.0, 1.0, 0.0, 4.0, 0.0, -1.0)


@pytest.fixture(scope="module")
def raster(spark):
    return spark.createDataFrame([(y, x, 1, float(4 * y + x)) for y in range(4) for x in range(4)], "row long, col long, band int, value double")


def test_raster_pixel_and_region(raster):
    (p,) = r.raster_pixel(raster, 1, 2, T4).collect()
    assert (p["value"], p["world_x"], p["world_y"]) == (6.0, 2.5, 2.5)
    (s,) = r.raster_region(raster, Box(1, 1, 3, 3), T4, 4, 4, no_data=65535).collect()
    assert (s["count"], s["mean"], s["nodata_count"]) == (4, 7.5, 0)
    cut, t = r.raster_export_window(raster, r.pixel_window(Box(1, 1, 3, 3), T4, 4, 4), T4)
    assert cut.count() == 4 and (t.a, t.d) == (1.0, 3.0)
    for bad in (Box(9, 9, 10, 10), Box(-5, 0, -1, 3)):
        with pytest.raises(SpecError):
            r.raster_region(raster, bad, T4, 4, 4)
    with pytest.raises(SpecError):
        r.raster_region(raster, Box(1, 1, 3, 3), T4, 4, 4, crs="EPSG:4326", box_crs="EPSG:3857")
    with pytest.raises(SpecError):
        r.zonal_statistics(raster, ["band"], statistics=["mode"])


def test_no_data_and_overviews(spark, raster):
    (s,) = r.zonal_statistics(raster, ["band"], no_data=5.0).collect()
    assert (s["count"], s["nodata_count"], s["min"], s["max"]) == (15, 1, 0.0, 15.0)
    levels = {(x["level"], x["row"], x["col"]): x["value"] for x in r.raster_overviews(raster, 4, 4).collect()}
    assert levels[1, 0, 0] == 2.5 and levels[2, 0, 0] == 7.5 and len(levels) == 5


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_percentiles_by_rank(spark, parts):
    import random

    values = [random.Random(3).choice([0.0, 1.0, 2.5, 7.0, 9.0]) for _ in range(3)] + [random.Random(k).gauss(0, 1) for k in range(331)]
    s = sorted(values)
    got = r.rank_percentiles(spark.createDataFrame([(v,) for v in values + [float("nan"), -9999.0]] + [(None,)], "value double").repartition(parts), no_data=-9999.0).first()
    assert (got["low"], got["high"]) == (s[(len(s) - 1) * 2 // 100], s[(len(s) - 1) * 98 // 100])
    flat = r.rank_percentiles(spark.createDataFrame([(4.0,)] * 5, "value double")).first()
    assert (flat["low"], flat["high"]) == (4.0, 5.0)


def test_ranks_by_radix_selection(spark):
    """Against a sort: negative numbers, both zeros, ties, extremes, nulls; and without an exchange of values."""
    import random

    from sciobs.operators import rasters

    r = random.Random(6)
    rows = [r.choice([r.uniform(-5, 5), float(r.randrange(-3, 3)), -0.0, 10 ** r.uniform(-300, 300), -(10 ** r.uniform(-300, 300)), 5e-324, -1.7e308]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in rows] + [(None,)] * 9, "v double").repartition(5)
    ranks = [0, 1, 60, 1500, 1500, 2940, 2999]
    assert rasters.select_ranks(df, "v", lambda n: ranks) == [sorted(rows)[i] for i in ranks]
    assert rasters.select_ranks(df.where("v is null"), "v", lambda n: ranks) == []
    values = [(v,) for v in (0.0, -0.0, 1.0, -1.0, 2.5, -1e-300)]
    keys = spark.createDataFrame(values, "v double").select("v", rasters.order_key(F.col("v")).alias("k")).collect()
    assert all(rasters.key_value(x.k) == x.v for x in keys) and len({x.k for x in keys}) == 5
    assert rasters.rank_percentiles(df.where("v is null"), "v").first() == (None, None)
