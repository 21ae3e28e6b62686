"""Windows over a raster by a pyramid of sums: against numpy, and by what a window reads."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sciobs.operators import pyramid as p

ROWS, COLS = 45, 70


def raster(offset=0.0):
    r = np.random.default_rng(5)
    values = r.normal(offset, 3.0, (2, ROWS, COLS))
    values[0, 3:9, 10:30] = -9999.0
    values[1, 20, 20] = np.nan
    values[1, 30:34, 40:44] = 7.25
    return values


def table(spark, values, bands=(1, 4)):
    rows = [(y, x, bands[b], float(values[b, y, x])) for b in range(values.shape[0]) for y in range(values.shape[1]) for x in range(values.shape[2])]
    return spark.createDataFrame(rows, "row long, col long, band int, value double")


def windows(n=120):
    r = random.Random(8)
    out = [("whole", 0, ROWS, 0, COLS), ("pixel", 7, 8, 9, 10), ("last", ROWS - 1, ROWS, COLS - 1, COLS), ("invalid", 4, 8, 12, 20), ("same", 30, 34, 40, 44), ("empty", 5, 5, 1, 9), ("edge", 16, ROWS, 32, COLS)]
    for k in range(n):
        a, b, c, d = *sorted(r.sample(range(ROWS + 1), 2)), *sorted(r.sample(range(COLS + 1), 2))
        out.append((f"w{k}", a, b, c, d))
    return out


def want(values, asked, bands=(1, 4)):
    out = {}
    for name, a, b, c, d in asked:
        for k, band in enumerate(bands):
            part = values[k, a:b, c:d].ravel()
            if not len(part):
                continue
            good = part[np.isfinite(part) & (part != -9999.0)]
            out[name, band] = (len(good), good.min(), good.max(), good.mean(), good.std()) if len(good) else (0, None, None, None, None)
    return out


@pytest.mark.parametrize("offset, bits", [(0.0, 2), (1e6, 3), (0.0, 7)])
def test_windows_against_numpy(spark, offset, bits):
    values, asked = raster(offset), windows()
    frame = spark.createDataFrame(asked, "selection_id string, r0 long, r1 long, c0 long, c1 long")
    pixels = table(spark, values).unionByName(spark.createDataFrame([(-1, 3, 1, 5.0), (ROWS, 3, 1, 5.0), (3, COLS, 4, 5.0)], "row long, col long, band int, value double"))
    got = {(r["selection_id"], r["band"]): tuple(r)[2:] for r in p.window_statistics(frame, pixels, ROWS, COLS, -9999.0, tile_bits=bits).collect()}
    expected = want(values, asked)
    assert set(got) == set(expected)
    for key, row in expected.items():
        assert got[key][:3] == row[:3], key
        assert got[key][3:] == (pytest.approx(row[3], rel=1e-12), pytest.approx(row[4], rel=1e-7, abs=1e-12)) if row[0] else got[key][3:] == (None, None), key
    assert got["same", 4][4] == 0.0


def test_cover_is_exact_and_grows_with_the_edges(spark):
    """Every tile of a window lies in one square or on the border; a large window has few of both."""
    rows = cols = 1 << 10
    r = random.Random(4)
    asked = [(k, *sorted(r.sample(range(rows + 1), 2)), *sorted(r.sample(range(cols + 1), 2))) for k in range(40)] + [(99, 0, rows, 0, cols), (98, 1, rows - 1, 1, cols - 1)]
    border, squares = p.window_cover(rows, cols, 3)
    frame = spark.createDataFrame(asked, "id long, r0 long, r1 long, c0 long, c1 long")
    for id_, a, b, c, d, edge, inner in frame.select("*", border.alias("edge"), squares.alias("inner")).collect():
        hit = np.zeros((rows // 8, cols // 8), int)
        for k, y, x in inner:
            hit[y << k : (y + 1) << k, x << k : (x + 1) << k] += 1
            assert a <= (y << k) * 8 and ((y + 1) << k) * 8 <= b and c <= (x << k) * 8 and ((x + 1) << k) * 8 <= d
        for _, y, x in edge:
            hit[y, x] += 1
        touched = np.zeros_like(hit)
        touched[a // 8 : (b - 1) // 8 + 1, c // 8 : (d - 1) // 8 + 1] = 1
        assert (hit == touched).all(), id_
        assert len(edge) + len(inner) <= 6 * ((b - a) + (d - c)) / 8 + 16
    (whole,) = frame.where("id = 99").select(border.alias("edge"), squares.alias("inner")).collect()
    assert not whole["edge"] and len(whole["inner"]) == 1


def test_a_pyramid_is_written_once_for_many_tables(spark, tmp_path):
    values, asked = raster(), windows(10)
    pixels = table(spark, values)
    made = p.raster_pyramid(pixels, ROWS, COLS, -9999.0, 3)
    made.write.parquet(str(tmp_path / "pyramid"))
    stored = spark.read.parquet(str(tmp_path / "pyramid"))
    assert stored.agg(F.max("level")).first()[0] == p.pyramid_levels(ROWS, COLS, 3) - 1
    assert {r[0] for r in stored.groupBy("level").agg(F.sum("pixels").alias("n")).select("n").collect()} == {2 * ROWS * COLS}
    frame = spark.createDataFrame(asked, "selection_id string, r0 long, r1 long, c0 long, c1 long")
    one, two = (sorted(map(tuple, p.window_statistics(frame, pixels, ROWS, COLS, -9999.0, x, 3).select("selection_id", "band", "count", "min", "max").collect())) for x in (stored, None))
    assert one == two


def test_no_windows_and_no_pixels(spark):
    schema = "selection_id string, r0 long, r1 long, c0 long, c1 long"
    pixels = table(spark, raster()[:, :4, :4])
    assert p.window_statistics(spark.createDataFrame([], schema), pixels, 4, 4).count() == 0
    assert p.window_statistics(spark.createDataFrame([("a", 0, 4, 0, 4)], schema), pixels.where("false"), 4, 4).count() == 0


def test_tasks_grow_with_the_windows(spark, monkeypatch):
    """However few files hold the windows, and however small the pixels' file is."""
    for name in ("TASK_WINDOWS", "TASK_TILES"):
        monkeypatch.setattr(p, name, 2)
    values, asked = raster(), windows(40)
    frame = spark.createDataFrame(asked, "selection_id string, r0 long, r1 long, c0 long, c1 long").coalesce(1)
    plan = p.window_statistics(frame, table(spark, values), ROWS, COLS, -9999.0, tile_bits=3)._jdf.queryExecution().executedPlan().toString()
    sizes = [int(line.split("), REPARTITION_BY_NUM")[0].rpartition(", ")[2]) for line in plan.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(sizes) == 6 and min(sizes) >= 23 and "BroadcastHashJoin [tile_row" not in plan
