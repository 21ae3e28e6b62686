"""Points, vector features and selections."""

from __future__ import annotations

import json
import random
import struct

import pytest

from sciobs.operators import geometry as g
from sciobs.operators import points as p
from sciobs.operators import selections as s
from sciobs.plans.spec import Affine, Box, SpecError


def polygon(*rings):
    return {"type": "Polygon", "coordinates": [[list(map(float, q)) for q in r] for r in rings]}


SQUARE = polygon([(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)])
RING = polygon([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)])
POINT = lambda x, y: {"type": "Point", "coordinates": [x, y]}
LINE = lambda *q: {"type": "LineString", "coordinates": [list(x) for x in q]}


@pytest.fixture(scope="module")
def cloud(spark):
    return spark.createDataFrame([(i, float(i), float(i), 2.0 * i, i % 3) for i in range(10)], "source_index long, x double, y double, z double, classification int")


def test_point_region(cloud, spark, tmp_path):
    rows, stats = p.point_region(cloud, Box(2, 2, 5, 5))
    assert [r["source_index"] for r in rows.collect()] == [2, 3, 4, 5]
    one = stats.first()
    assert (one["count"], one["z_mean"], one["classes"]) == (4, 7.0, {0: 1, 1: 1, 2: 2})
    assert p.points_by_index(cloud, [7]).first()["x"] == 7.0
    p.build_point_index(cloud, 2.0, f"{tmp_path}/index")
    again, more = p.indexed_point_region(spark.read.parquet(f"{tmp_path}/index"), 2.0, Box(2, 2, 5, 5))
    assert [r["source_index"] for r in again.collect()] == [2, 3, 4, 5] and more.first()["count"] == 4
    assert "PartitionFilters: [isnotnull(cell_x" in again._jdf.queryExecution().toString()
    assert p.point_region(cloud, Box(90, 90, 99, 99))[1].first()["count"] == 0


def test_point_index_is_reused_by_digest(cloud, spark, tmp_path):
    first, reused = p.ensure_point_index(cloud, 2.0, str(tmp_path))
    assert not reused and p.ensure_point_index(cloud.repartition(3), 2.0, str(tmp_path)) == (first, True)
    assert p.ensure_point_index(cloud, 3.0, str(tmp_path))[0] != first != p.ensure_point_index(cloud.where("source_index <> 2"), 2.0, str(tmp_path))[0]
    again, _ = p.indexed_point_region(spark.read.parquet(first), 2.0, Box(2, 2, 5, 5))
    assert [r["source_index"] for r in again.collect()] == [2, 3, 4, 5]
    empty = p.ensure_point_index(cloud.where("false"), 2.0, str(tmp_path))[0]
    assert p.ensure_point_index(cloud.where("false"), 2.0, str(tmp_path)) == (empty, True)


def test_thinning(cloud):
    assert sorted(r["source_index"] for r in p.thin_points(cloud, 4.0).collect()) == [0, 2, 4, 6, 8]
    assert p.thin_points(cloud, level=0, extent=100.0).count() == 1
    for bad in ({}, {"resolution": 1.0, "level": 1}, {"resolution": 0.0}):
        with pytest.raises(SpecError):
            p.thin_points(cloud, **bad)
    assert p.rebase_origin(cloud.where("source_index > 3")).agg({"x": "min"}).first()[0] == 0.0


@pytest.mark.parametrize("a,b,want", [
    (SQUARE, POINT(1, 1), True), (SQUARE, POINT(2, 1), True), (SQUARE, POINT(2.1, 1), False), (RING, POINT(4, 4), False), (RING, POINT(3, 4), True), (RING, LINE((4, 4), (5, 5)), False), (RING, LINE((4, 4), (8, 8)), True),
    (SQUARE, LINE((-1, 1), (3, 1)), True), (SQUARE, LINE((2, 2), (3, 3)), True), (SQUARE, LINE((3, 0), (3, 3)), False), (SQUARE, polygon([(-1, -1), (5, -1), (5, 5), (-1, 5), (-1, -1)]), True), (RING, polygon([(4, 4), (5, 4), (5, 5), (4, 4)]), False),
    (SQUARE, {"type": "GeometryCollection", "geometries": [POINT(9, 9), POINT(0, 0)]}, True), (POINT(1, 1), POINT(1, 1), True), (LINE((0, 0), (2, 2)), POINT(1, 1), True), ({"type": "MultiPoint", "coordinates": [[7, 7], [1, 1]]}, SQUARE, True),
])
def test_intersects(a, b, want):
    for x, y in ((a, b), (b, a)):
        assert g.intersects(g.parse_wkb(g.to_wkb(x)), g.geojson_parts(y)) == want


def test_wkb_forms():
    big = struct.pack(">BI2d", 0, 1, 3.0, 4.0)
    z = struct.pack("<BI3d", 1, 1001, 3.0, 4.0, 5.0)
    ewkb = struct.pack("<BII2d", 1, 1 | 0x20000000, 4326, 3.0, 4.0)
    for data in (big, z, ewkb):
        assert g.parse_wkb(data)[0][0].tolist() == [3.0, 4.0]
    assert g.geometry_box({"type": "Point", "coordinates": [1, 2], "bbox": [0, 0, 5, 6]}) == Box(0, 0, 5, 6)


def test_expression_equals_function(spark):
    r = random.Random(1)
    pts = [(float(r.randrange(-1, 11)), float(r.randrange(-1, 11))) for _ in range(200)]
    df = spark.createDataFrame(pts, "x double, y double")
    got = [row[0] for row in df.select(g.points_in_polygon(df.x, df.y, RING)).collect()]
    assert got == [g.intersects(g.geojson_parts(POINT(*q)), g.geojson_parts(RING)) for q in pts]


def test_spatial_join_equals_all_pairs(spark):
    r = random.Random(2)
    shapes = {f"r{k}": polygon([(x, y), (x + w, y), (x + w, y + h), (x, y)]) for k in range(12) for x, y, w, h in [(r.uniform(0, 20), r.uniform(0, 20), r.uniform(1, 9), r.uniform(1, 9))]}
    pts = [(i, POINT(r.uniform(0, 25), r.uniform(0, 25))) for i in range(150)]
    feats = g.with_boxes(spark.createDataFrame([(i, bytearray(g.to_wkb(q))) for i, q in pts], "feature_index long, geometry binary"))
    want = {(k, i) for k, a in shapes.items() for i, q in pts if g.intersects(g.geojson_parts(a), g.geojson_parts(q))}
    got = [tuple(x) for x in g.spatial_join(g.region_table(spark, shapes), feats).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_features(spark):
    feats = g.with_boxes(spark.createDataFrame([(0, {"plot": "inside"}, bytearray(g.to_wkb(POINT(1, 1)))), (1, {"plot": "outside", "n": "1"}, bytearray(g.to_wkb(POINT(10, 10)))), (2, None, None)], "feature_index long, properties map<string,string>, geometry binary"))
    rows, n = g.vector_region(feats, SQUARE)
    assert [x["properties"]["plot"] for x in rows.collect()] == ["inside"] and n.first()[0] == 1
    one = g.inspect_features(feats).first()
    assert one["features"] == 3 and one["property_keys"] == ["n", "plot"] and one["max_x"] == 10.0
    lines = g.geometry_primitives(spark.createDataFrame([(0, bytearray(g.to_wkb(RING)))], "feature_index long, geometry binary")).collect()
    assert [(x["kind"], len(x["coordinates"])) for x in lines] == [("line", 5), ("line", 5)]


def test_a_region_query_gives_all_that_match(spark, tmp_path):
    from pyspark.sql import functions as F

    from sciobs.queries.points import QUERIES

    n = 100_500  # more than MAX_RESULT_ROWS, which the query's SQL does not have
    rows = spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(7).alias("c_nationkey"), (F.col("id") % 5000).cast("double").alias("c_acctbal"), F.lit("A").alias("c_mktsegment"))
    rows.write.parquet(str(tmp_path / "customer.parquet"))
    assert QUERIES["vector_region"](spark, str(tmp_path)).distinct().count() == n


PICK = "selection_id string, dataset_id string, entity_path string, instance_id long, mapping_kind string, version string"


def test_forged_row_picks(spark):
    layers = spark.createDataFrame([("l", "d", "/world/table", ["/rows"], "row", "2", 1), ("m", "d", "/world/big", ["/rows"], "row", "2", 1 << 40)], "layer_id string, dataset_id string, entity_prefix string, suffixes array<string>, mapping_kind string, version string, stride long")
    data = spark.createDataFrame([("d", i, str(i)) for i in range(8)], "dataset_id string, source_index long, pressure string")
    good = ("d", "/world/table/rows", 7, "row", "2")
    picks = [
        ("ok", *good), ("dataset", "x", *good[1:]), ("entity", "d", "/other/rows", 7, "row", "2"), ("part", "d", "/world/table/lines", 7, "row", "2"), ("kind", "d", good[1], 7, "point", "2"), ("version", "d", good[1], 7, "row", "1"),
        ("negative", "d", good[1], -1, "row", "2"), ("overflow", "d", "/world/big/rows", 1 << 40, "row", "2"), ("range", "d", good[1], 8, "row", "2"),
    ]
    got = {r["selection_id"]: (r["source_index"], r["error"], r["pressure"]) for r in s.resolve_row_picks(spark.createDataFrame(picks, PICK), layers, data).collect()}
    assert got["ok"] == (7, None, "7")
    errors = {k: e for k, (_, e, _) in got.items() if k != "ok"}
    assert errors == {"dataset": "no_layer", "entity": "unknown_entity", "part": "unknown_part", "kind": "wrong_mapping_kind", "version": "wrong_version", "negative": "negative_instance", "overflow": "index_overflow", "range": "row_out_of_range"}


def test_point_to_pixel_to_spectrum(spark):
    cells = spark.createDataFrame([("c", y, x, b, float(16 * y + 4 * x + b - 4)) for y in range(4) for x in range(4) for b in range(4)], "array_path string, y long, x long, band int, value double")
    waves = spark.createDataFrame([(b, 450.0 + 100 * b) for b in range(4)], "band int, wavelength double")
    asked = spark.createDataFrame([("in", "c", 1.2, 2.2), ("out", "c", 9.0, 9.0)], "selection_id string, array_path string, world_x double, world_y double")
    got = s.resolve_world_points(asked, Affine(0, 1, 0, 4, 0, -1), 4, 4, cells, waves).orderBy("selection_id", "band").collect()
    assert [(r["y"], r["x"], r["wavelength"], r["value"]) for r in got if r["selection_id"] == "in"] == [(1, 1, 450.0 + 100 * b, 16.0 + b) for b in range(4)]
    assert [r["status"] for r in got if r["selection_id"] == "out"] == ["unavailable"]


def test_raster_selections_without_geometry(spark):
    pixels = spark.createDataFrame([(y, x, 1, float(4 * y + x)) for y in range(4) for x in range(4)], "row long, col long, band int, value double")
    asked = spark.createDataFrame([("a", 1.0, 1.0, 3.0, 3.0), ("b", None, None, None, None), ("c", 50.0, 50.0, 60.0, 60.0)], "selection_id string, min_x double, min_y double, max_x double, max_y double")
    got = {r["selection_id"]: (r["count"], r["mean"], r["error"]) for r in s.resolve_raster_selections(asked, pixels, Affine(0, 1, 0, 4, 0, -1), 4, 4).collect()}
    assert got == {"a": (4, 7.5, None), "b": (None, None, "no_world_geometry"), "c": (None, None, "empty_window")}


def test_geojson_text():
    assert json.loads(g.geojson_text(SQUARE)) == SQUARE


def test_points_at_once_are_points_one_by_one(monkeypatch):
    r = random.Random(12)
    places = [(float(r.randrange(-1, 11)), float(r.randrange(-1, 11))) for _ in range(150)] + [(r.uniform(-1, 11), r.uniform(-1, 11)) for _ in range(150)]
    regions = [RING, SQUARE, POINT(*places[0]), LINE((0, 0), (9, 9), (9, 3)), {"type": "GeometryCollection", "geometries": [RING, LINE((-1, 10), (10, 10)), POINT(*places[1])]}]
    shapes = [g.to_wkb(POINT(*q)) for q in places] + [None, g.to_wkb(POINT(float("nan"), 1.0))]
    for region in map(g.geojson_parts, regions):
        want = [data is not None and g.intersects(g.parse_wkb(data), region) for data in shapes]
        with monkeypatch.context() as m:
            m.setattr(g, "MAX_COMPARED", 700)
            m.setattr(g, "intersects", None)  # plain points do not need it
            assert list(g.shapes_intersect(shapes, region)) == want
    assert list(g.shapes_intersect([g.to_wkb(SQUARE), g.to_wkb(POINT(5, 5))], g.geojson_parts(RING))) == [True, False]
