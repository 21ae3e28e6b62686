from __future__ import annotations

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sciobs.functions import science as h
from sciobs.operators import catalog as c
from sciobs.plans.spec import SpecError


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_roles(spark):
    names = {"time": "time", "Latitude": "latitude", "lon": "longitude", "depth": "vertical", "temp_qc": "quality_control", "temp": "value", "sigma_std": "uncertainty", "platform_number": "identifier", "_time_": "time", "uncertainty": "uncertainty"}
    df = spark.createDataFrame([(n,) for n in names], "field string")
    assert {r["field"]: r["r"]["role"] for r in df.select("field", h.field_role(F.col("field")).alias("r")).collect()} == names
    attrs = [("TEMP", {"standard_name": "sea_water_temperature"}, ["value"]), ("TIME", {"axis": "T"}, ["time"]), ("PRES", {"standard_name": "sea_water_pressure", "axis": "Z"}, ["vertical"]), ("TEMP_QC", {}, ["quality_control"]), ("id", {"cf_role": "trajectory_id"}, ["identifier"]), ("lat", {}, ["latitude"])]
    df = spark.createDataFrame(attrs, "field string, attrs map<string,string>, want array<string>")
    assert all(r["got"] == r["want"] for r in df.select("want", h.cf_roles(F.col("field"), F.col("attrs")).alias("got")).collect())


def test_text_functions(spark):
    m = value(spark, h.parse_map_info(F.lit("UTM, 1.000, 1.000, 256000.0, 4112000.0, 1.0, 1.0, 11, North, WGS-84, units=Meters, rotation=0")))
    assert m.asDict() == {"a": 256000.0, "b": 1.0, "c": 0.0, "d": 4112000.0, "e": 0.0, "f": -1.0}
    for bad in ("UTM,1,1,2,3,1,1,11,North,WGS,rotation=5", "Geographic,1,1,2,3,1,1", "UTM,1,1,2,3,0,1", "UTM,1"):
        assert value(spark, h.parse_map_info(F.lit(bad))) is None
    assert value(spark, h.epsg_from_wkt(F.lit('PROJCS[...AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","32611"]]'))) == 32611
    assert value(spark, h.wavelength_factor(F.lit(" Micrometers "))) == 1000.0 and value(spark, h.wavelength_factor(F.lit("m"))) is None
    assert value(spark, h.parse_range(F.lit("0.5, x 7 nan 9.5"))).asDict() == {"low": 0.5, "high": 9.5}
    assert value(spark, h.parse_crs(F.lit("EPSG:4326"))).asDict() == {"authority": "EPSG", "code": "4326"} and value(spark, h.parse_crs(F.lit("WGS84")))["authority"] is None
    assert value(spark, h.modality_from_text(F.lit("LiDAR sensor"))) == ["point_cloud", "tabular", "time_series"] and value(spark, h.modality_from_text(F.lit("birds"))) == ["tabular"]
    assert value(spark, h.modality_from_extension(F.lit("a/b.LAZ"))) == ["point_cloud"] and value(spark, h.modality_from_cdm(F.lit("TrajectoryProfile"))) == ["vector", "time_series", "tabular"]
    assert value(spark, h.axis_role(F.lit("Water_Depth"))) == "z" and value(spark, h.axis_role(F.lit("band"))) == "spectral"
    assert value(spark, h.stretch_u8(F.lit(float("nan")), F.lit(0.0), F.lit(1.0))) == 0 and value(spark, h.stretch_u8(F.lit(0.5), F.lit(0.0), F.lit(1.0))) == 128
    assert value(spark, h.point_color(F.lit(2), (F.lit(65535), F.lit(10), F.lit(256)))) == [255, 10, 1]
    assert value(spark, h.display_to_source_pixel(F.lit(-3.5), 4)) == 0
    attrs = F.create_map(*map(F.lit, ("license", "https://x.org CC BY 4.0", "institution", "I", "doi", "doi:10.1/x")))
    got = value(spark, h.license_citation(attrs, F.lit("T"), F.lit("d1")))
    assert got["attribution_required"] and got["url"].startswith("https") and got["citation"] == "T (I), ERDDAP dataset d1" and got["doi"] == "10.1/x"


def test_field_links_and_inventory(spark):
    fields = spark.createDataFrame([("d", f) for f in ("time", "latitude", "longitude", "depth", "temp", "TEMP_QC", "psal", "psalqc", "other")] + [("e", "temp_qc")], "dataset_id string, field string")
    assert sorted((r["field"], r["qc_field"]) for r in c.qc_links(fields).collect()) == [("psal", "psalqc"), ("temp", "TEMP_QC")]
    inventory = c.scientific_inventory(fields)
    assert {r["field"] for r in inventory.where("unresolved").collect()} == {"psalqc", "other"}
    views = c.suggest_views(inventory).collect()
    assert views[0]["kind"] == "profile" and views[0]["confidence"] == "high" and len(views) <= 12
    assert [r["suggestion_id"] for r in views] == [r["suggestion_id"] for r in c.suggest_views(c.scientific_inventory(fields.repartition(5))).collect()]
    assert c.scientific_inventory(fields, cap=4).count() == 4


def test_materialized_and_profile_roles(spark):
    v = spark.createDataFrame([("d", "temp", {"standard_name": "sea_water_temperature"}), ("d", "temp_adjusted", {"standard_name": "sea_water_temperature"}), ("d", "pres", {"axis": "Z"})], "dataset_id string, field string, attrs map<string,string>")
    files = spark.createDataFrame([("d", "time,pres, temp&time>=2020")], "dataset_id string, expression string")
    assert sorted(r["field"] for r in c.materialized_fields(v, files).collect()) == ["pres", "temp"]
    assert {r["role"]: r["field"] for r in c.profile_roles(v).collect()} == {"value": "temp", "vertical": "pres"}


def test_digests(spark):
    assert c.crc32c([b"hello", b"123456789", b""]) == [0x9A71BB4C, 0xE3069283, 0]
    objects = c.with_crc32c(spark.createDataFrame([(p, 5, bytearray(b"hello")) for p in "abcdef"], "path string, size long, content binary")).withColumn("md5", F.md5("content"))
    four = 0x9A71BB4C.to_bytes(4, "big")
    expected = [("a", 5, "md5", "5D41402ABC4B2A76B9719D911017C592"), ("b", 5, "crc32c", "9a71bb4c"), ("c", 5, "CRC32C", str(0x9A71BB4C)), ("d", 5, "crc32c", base64.b64encode(four).decode()), ("e", 6, "md5", "5d41402abc4b2a76b9719d911017c592"), ("f", 5, "sha1", "x"), ("g", 5, "md5", "x")]
    got = c.verify_checksums(objects, spark.createDataFrame(expected, "path string, size long, algorithm string, checksum string"))
    assert {r["path"]: r["status"] for r in got.collect()} == {"a": "ok", "b": "ok", "c": "ok", "d": "ok", "e": "mismatch", "f": "unsupported", "g": "missing"}
    sets = spark.createDataFrame([("x", "1", bytearray(b"a")), ("x", "2", bytearray(b"b"))], "k string, path string, content binary")
    assert c.fingerprint_files(sets, ["k"]).first() == c.fingerprint_files(sets.orderBy(F.desc("path")), ["k"]).first()


def test_provider_documents(spark):
    tree = {"data": {"sites": [{"siteCode": "HARV", "month": "2024-01", "files": [{"name": "a", "size": 3, "md5": "m", "url": "u"}, {"name": "b", "url": "u2", "siteCode": "ABBY"}]}]}}
    rows = c.flatten_plan_files(spark.createDataFrame([(json.dumps(tree),)], "json string")).collect()
    assert [(r["site"], r["month"], r["size"]) for r in rows] == [("HARV", "2024-01", 3), ("ABBY", "2024-01", None)]
    product = {"productCode": "DP1", "productName": "Spectrometer", "siteCodes": [{"siteCode": "HARV", "availableMonths": ["2023-05", "2022-07"]}, {"siteCode": "ABBY", "availableMonths": ["2024-06"]}]}
    (p,) = c.flatten_products(spark.createDataFrame([(json.dumps(product),)], "json string")).collect()
    assert (p["sites"], p["first_month"], p["last_month"], p["modalities"]) == (["ABBY", "HARV"], "2022-07", "2024-06", ["hyperspectral", "raster"])
    good, bad = ({"table": {"columnNames": ["a", "b"], "rows": [r]}} for r in (["1", None], ["1"]))
    assert c.parse_table_envelope(spark.createDataFrame([(json.dumps(good),)], "json string")).first()["values"] == {"a": "1", "b": None}
    with pytest.raises(Exception, match="width"):
        c.parse_table_envelope(spark.createDataFrame([(json.dumps(bad),)], "json string")).collect()
    info = [("attribute", "NC_GLOBAL", k, "String", v) for k, v in {"cdm_data_type": "Grid", "geospatial_lon_min": "0", "geospatial_lon_max": "1", "geospatial_lat_min": "2", "geospatial_lat_max": "3"}.items()] + [("variable", "temp", "", "float", ""), ("attribute", "temp", "units", "String", "degree_C")]
    table = spark.createDataFrame([("d", *r) for r in info], "dataset_id string, row_type string, variable string, attribute string, data_type string, value string")
    pivot = {r["variable"]: r for r in c.attribute_pivot(table, ["dataset_id"]).collect()}
    assert pivot["temp"]["data_type"] == "float" and pivot["temp"]["attrs"] == {"units": "degree_C"}
    (r,) = c.resolve_resource(spark.createDataFrame([("d", "T")], "dataset_id string, title string"), table).collect()
    assert r["modalities"] == ["raster", "tensor"] and json.loads(r["coverage"])["coordinates"][0][2] == [1.0, 3.0] and r["variables"][0]["variable"] == "temp"


def test_plans(spark):
    rows = [("p", "u1", "b", 3, "m"), ("p", "u1", "a", 4, "m"), ("p", "u2", "c", None, "m")]
    files = spark.createDataFrame(rows, "plan_id string, download_url string, name string, size long, md5 string")
    assert sorted(r["name"] for r in c.dedup_plan_files(files).collect()) == ["a", "c"]
    assert tuple(c.plan_totals(files).first()) == (3, 7) and tuple(c.plan_totals(files.limit(0)).first()) == (0, None)
    assert c.plan_hash(files).first() == c.plan_hash(files.orderBy(F.desc("name"))).first()
    assert c.plan_hash(files).first() != c.plan_hash(files.withColumn("size", F.lit(9).cast("long"))).first()


def test_georeference_and_registration(spark):
    cube = spark.createDataFrame([("ok", 10, 20, 0.0, 1.0, 0.0, 10.0, 0.0, -1.0, 0.0, 0.0, 20.0, 10.0), ("off", 10, 20, 0.0, 1.0, 0.0, 10.0, 0.0, -1.0, 500.0, 0.0, 20.0, 10.0)], "array_path string, rows int, cols int, a double, b double, c double, d double, e double, f double, min_x double, min_y double, max_x double, max_y double")
    assert {r["array_path"]: r["linkable"] for r in c.validate_georef(cube).collect()} == {"ok": True, "off": False}
    box = "dataset_id string, authority string, code string, wkt string, min_x double, min_y double, max_x double, max_y double"
    points = spark.createDataFrame([("p", "EPSG", "1", None, 0.0, 0.0, 5.0, 5.0), ("q", None, None, "W", 0.0, 0.0, 1.0, 1.0), ("r", None, None, None, 0.0, 0.0, 1.0, 1.0)], box)
    cubes = spark.createDataFrame([("c", "epsg", "1", None, 5.0, 0.0, 9.0, 5.0), ("d", "EPSG", "1", None, 4.0, 4.0, 9.0, 9.0), ("e", None, None, "W", 0.5, 0.5, 2.0, 2.0)], box)
    got = {(r["point_id"], r["cube_id"]): r["reason"] for r in c.register_point_cube(points, cubes).collect()}
    assert got == {("p", "c"): "no_overlap", ("p", "d"): None, ("q", "e"): None, ("r", None): "no_common_crs"}


def test_merging(spark):
    files = spark.createDataFrame([("d", ["raster"], ["x"], "A", []), ("d", ["unknown", "cube"], ["x", "y"], "B", ["w"]), ("e", [], [], None, [])], "dataset_id string, modalities array<string>, cubes array<string>, crs string, warnings array<string>")
    got = {r["dataset_id"]: r for r in c.merge_file_metadata(files).collect()}
    assert got["d"]["modalities"] == ["cube", "raster"] and got["d"]["crs"] is None and len(got["d"]["warnings"]) == 2 and got["e"]["crs"] is None and got["e"]["warnings"] == []


def test_streams(spark, tmp_path):
    from sciobs.plans.spec import Filter, Recipe, ValueRole
    from sciobs.streaming import stateless as s

    spark.createDataFrame([(i, "p", 1, float(i), float(i), "1" if i % 2 else "4") for i in range(10)], "source_index long, platform string, cycle int, pres double, temp double, qc string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    s.append_parquet(s.stream_filter(stream, [Filter("temp", "gte", 5)], ["source_index"]), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    r = Recipe("platform", "cycle", "pres", (ValueRole("temp", "qc", ("1",)),))
    s.append_parquet(s.stream_flags(stream, r), f"{tmp_path}/flags", f"{tmp_path}/c2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/flags").where("qc_accepted").count() == 5


def test_inventory_and_suggestions_of_many_datasets(spark):
    rows = [(f"g{d % 3}", f"d{d:03}", f"field_{k}") for d in range(60) for k in range(10)] + [("g0", "big", f"field_{k}") for k in range(300)]
    fields = spark.createDataFrame(rows, "asked string, dataset_id string, field string")
    got = {r["dataset_id"]: (r["n"], r["cut"]) for r in c.scientific_inventory(fields.drop("asked")).groupBy("dataset_id").agg(F.count("*").alias("n"), F.max("truncated").alias("cut")).collect()}
    assert got == {**{f"d{d:03}": (10, False) for d in range(60)}, "big": (256, True)}
    groups = fields.select("asked", "dataset_id").distinct()
    views = c.suggest_views(c.scientific_inventory(fields.drop("asked")).join(groups, "dataset_id"), group="asked").groupBy("asked").count().collect()
    assert {r["asked"]: r["count"] for r in views} == {"g0": 12, "g1": 12, "g2": 12}


def test_crc32c_by_lanes_against_the_definition():
    def plain(data):
        r = 0xFFFFFFFF
        for byte in data:
            r ^= byte
            for _ in range(8):
                r = r >> 1 ^ (0x82F63B78 if r & 1 else 0)
        return r ^ 0xFFFFFFFF

    random = np.random.default_rng(1)
    objects = [random.bytes(n) for n in (0, 1, 3, 4, 5, 255, 256, 257, 511, 512, 1000, 5000)] + [bytes(300), b"\xff" * 300]
    assert c.crc32c(objects) == [plain(o) for o in objects]


def test_inventory_and_suggestions_of_all_kinds(spark):
    fields = spark.createDataFrame([("t", "time"), ("t", "temp"), ("c", "/a")], "dataset_id string, field string")
    arrays = spark.createDataFrame(
        [("c", "/a", ["band", "y", "x"], "EPSG:1", 0.0, 0.0, 9.0, 9.0, True), ("c", "/b", ["y", "x"], None, None, None, None, None, None), ("far", "/a", ["wavelength", "lat", "lon"], "EPSG:1", 50.0, 0.0, 59.0, 9.0, True), ("t", "/n", ["n"], None, None, None, None, None, None)],
        "dataset_id string, array_path string, axis_names array<string>, crs string, min_x double, min_y double, max_x double, max_y double, linkable boolean",
    )
    clouds = spark.createDataFrame([("p", "1.las", "EPSG:1", 5.0, 5.0, 20.0, 20.0), ("c", "own.las", None, None, None, None, None)], "dataset_id string, path string, crs string, min_x double, min_y double, max_x double, max_y double")
    layers = spark.createDataFrame([("v", "roads")], "dataset_id string, layer string")
    others = [c.array_components(arrays), c.cloud_components(clouds), c.layer_components(layers)]
    inventory = c.scientific_inventory(fields, others=others)
    rows = {(r["dataset_id"], r["kind"], r["field"]): r["role"] for r in inventory.collect()}
    assert len(rows) == 10 and rows["c", "array", "/a"] == rows["far", "array", "/a"] == "spectral_cube" and rows["c", "array", "/b"] == "raster" and rows["t", "array", "/n"] == "array"
    assert rows["p", "points", "1.las"] == "points" and rows["v", "vector", "roads"] == "geometry"
    want = {
        ("c", None, "composite_and_spectrum", "high", None), ("far", None, "composite_and_spectrum", "high", None), ("c", None, "raster", "high", None), ("c", None, "point_cloud", "high", None), ("p", None, "point_cloud", "high", None),
        ("v", None, "vector_map", "medium", None), ("t", None, "time_series", "medium", None), ("t", None, "table", "low", None), ("c", None, "table", "low", None),
        ("p", "c", "cloud_and_cube", "high", "exact"), ("p", "far", "cloud_and_cube", "high", "unavailable"), ("c", "far", "cloud_and_cube", "high", "unavailable"),
    }
    columns = ("dataset_id", "other_id", "kind", "confidence", "link")
    for asked in (inventory, inventory.withColumn("asked", F.lit("q"))):
        views = c.suggest_views(asked, 50, "asked" if "asked" in asked.columns else None).collect()
        assert {tuple(r[x] for x in columns) for r in views} == want and len(views) == len(want) == len({r["suggestion_id"] for r in views})
    assert [r["kind"] for r in c.suggest_views(inventory, 3).collect()] == ["cloud_and_cube"] * 3
    reasons = {(r["dataset_id"], r["other_id"]): (r["reason"], r["unresolved"]) for r in c.suggest_views(inventory, 50).where("kind = 'cloud_and_cube'").collect()}
    assert reasons == {("p", "c"): (None, False), ("p", "far"): ("no_overlap", True), ("c", "far"): ("no_common_crs", True)}
    none = c.scientific_inventory(fields.where("false"), others=[x.where("false") for x in others])
    assert c.suggest_views(none).count() == 0


PLACED = "dataset_id string, {} string, crs string, min_x double, min_y double, max_x double, max_y double"


def _inventory(spark, clouds, cubes):
    arrays = spark.createDataFrame(cubes, PLACED.format("array_path") + ", linkable boolean").withColumn("axis_names", F.array(*map(F.lit, ("band", "y", "x"))))
    parts = c.union_components(c.cloud_components(spark.createDataFrame(clouds, PLACED.format("path"))), c.array_components(arrays))
    return parts.withColumn("qc_field", F.lit(None).cast("string"))


def test_all_exact_pairs_are_ranked_before_the_cut(spark):
    """14 clouds and 14 cubes, of which the last two of each overlap."""
    at = lambda i, far: (float(100 * i + far), 0.0, float(100 * i + far + 10), 10.0)
    clouds = [(f"p{i:02}", "a", "EPSG:1", *at(i, 0)) for i in range(14)]
    cubes = [(f"q{i:02}", "/a", "EPSG:1", *at(i, 0 if i >= 12 else 50), True) for i in range(14)]
    for group in (None, "asked"):
        inventory = _inventory(spark, clouds, cubes)
        views = c.suggest_views(inventory.withColumn("asked", F.lit(1)) if group else inventory, 12, group).collect()
        assert len(views) == 12 and sorted((r["dataset_id"], r["other_id"]) for r in views if r["link"] == "exact") == [("p12", "q12"), ("p13", "q13")]
        assert {r["reason"] for r in views if r["link"] == "unavailable"} == {"no_overlap"}


def test_each_component_has_its_suggestion(spark):
    clouds = [("p", f"{i}.las", None, None, None, None, None) for i in range(3)]
    views = c.suggest_views(_inventory(spark, clouds, [("q", "/a", "EPSG:1", 0.0, 0.0, 1.0, 1.0, False), ("q", "/b", "EPSG:1", 0.0, 0.0, 1.0, 1.0, None)]), 50).collect()
    kinds = [r["kind"] for r in views]
    assert (kinds.count("point_cloud"), kinds.count("composite_and_spectrum"), kinds.count("cloud_and_cube")) == (3, 2, 6)
    assert len({r["suggestion_id"] for r in views}) == len(views)


def test_boxes_that_touch_are_no_exact_link(spark):
    """As register_point_cube has it, too."""
    cloud, cube = ("p", "a", "EPSG:1", 0.0, 0.0, 5.0, 5.0), ("q", "/a", "EPSG:1", 5.0, 0.0, 9.0, 5.0, True)
    view = c.suggest_views(_inventory(spark, [cloud], [cube]), 12).where("kind = 'cloud_and_cube'").first()
    assert (view["link"], view["reason"]) == ("unavailable", "no_overlap")


def test_pairs_come_from_all_datasets_in_turn(spark):
    """Many cubes of the cloud's own dataset do not hide the one of another."""
    cubes = [("a", f"/{i:03}", "EPSG:1", 0.0, 0.0, 1.0, 1.0, True) for i in range(60)] + [("z", "/a", "EPSG:2", 0.0, 0.0, 1.0, 1.0, True)]
    views = c.suggest_views(_inventory(spark, [("a", "1.las", "EPSG:1", 0.0, 0.0, 1.0, 1.0)], cubes), 12).where("kind = 'cloud_and_cube'").collect()
    assert [(r["other_id"], r["reason"]) for r in views] == [("z", "no_common_crs")]


def test_public_vectors_of_crc32c():
    from sciobs.queries.metadata import VECTORS

    assert {h: c.crc32c([bytes.fromhex(h)])[0] for h in VECTORS} == VECTORS


def test_sums_of_ranges_are_sums_of_wholes(spark):
    """In any order of ranges of any lengths; a missing, repeated or null range gives no sum."""
    import random

    r, rows, want = random.Random(8), [], {}
    for i, n in enumerate([0, 1, 3, 4, 5, 255, 256, 257, 5000, 70_001]):
        raw, at = r.randbytes(n), 0
        want[i] = c.crc32c([raw])[0]
        rows += [(i, n, 0, bytearray())] if n == 0 else []
        while at < n:
            size = min(n - at, r.choice([1, 7, 300, 9000]))
            rows.append((i, n, at, bytearray(raw[at : at + size])))
            at += size
    r.shuffle(rows)
    bad = [(100, 4, 0, bytearray(b"ab")), (101, 4, 0, bytearray(b"ab")), (101, 4, 0, bytearray(b"ab")), (102, 2, 0, bytearray(b"ab")), (102, 2, 2, None), (103, 4, 2, bytearray(b"abc")), (103, 4, 1, bytearray(b"a"))]
    got = c.crc32c_of_ranges(spark.createDataFrame(rows + bad, "path long, size long, offset long, content binary").repartition(5))
    assert {x["path"]: x["crc32c"] for x in got.collect()} == want | {i: None for i in (100, 101, 102, 103)}


def test_files_in_ranges(spark, tmp_path):
    """A file of many ranges, read by several tasks, has the sum of the whole; files without bytes are not listed."""
    import random

    from sciobs.sources.files import read_file_ranges

    raw = random.Random(1).randbytes(100_003)
    (tmp_path / "a.bin").write_bytes(raw)
    (tmp_path / "empty.bin").write_bytes(b"")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        ranges = read_file_ranges(spark, path, 4096)
        assert ranges.count() == 25 and ranges.select(F.spark_partition_id()).distinct().count() > 1
        got = {x["path"].rpartition("/")[2]: (x["size"], x["crc32c"]) for x in c.crc32c_of_ranges(ranges).collect()}
        assert got == {"a.bin": (len(raw), c.crc32c([raw])[0])}
    with pytest.raises(SpecError):
        read_file_ranges(spark, str(tmp_path), 0)


def test_digests_of_sets_tell_sets_apart(spark):
    rows = [(k, f"{i}.txt", bytearray(f"{k if i == 3 else ''}{i}".encode())) for k in ("a", "b") for i in range(400)] + [("c", "0.txt", bytearray(b"0"))]
    files = spark.createDataFrame(rows, "k string, path string, content binary")
    got = {r["k"]: r["digest"] for r in c.fingerprint_files(files, ["k"]).collect()}
    again = {r["k"]: r["digest"] for r in c.fingerprint_files(files.orderBy(F.rand(1)), ["k"]).collect()}
    assert got == again and len(set(got.values())) == 3


def test_point_cube_links_agree_with_all_pairs(spark):
    import random

    r = random.Random(12)
    schema = "dataset_id string, authority string, code string, wkt string, min_x double, min_y double, max_x double, max_y double"

    def some(kind, n):
        rows = []
        for k in range(n):
            x, y, w = r.randrange(100), r.randrange(100), r.choice([0, 1, 5, 60])
            rows.append((f"{kind}{k}", *r.choice([("EPSG", "1", None), ("epsg", "1", "w"), (None, None, "w"), ("EPSG", "2", None)]), float(x), float(y), float(x + w), float(y + w)))
        return rows + [(f"{kind}-null", "EPSG", "1", None, None, 1.0, 2.0, 2.0), (f"{kind}-alone", "EPSG", kind, None, 0.0, 0.0, 9.0, 9.0), (f"{kind}-none", None, None, None, 0.0, 0.0, 9.0, 9.0)]

    points, cubes = (spark.createDataFrame(some(k, n), schema) for k, n in (("p", 40), ("c", 60)))
    every = c.register_point_cube(points, cubes).collect()
    pairs, counts = c.point_cube_links(points, cubes)
    assert sorted(map(tuple, pairs.collect())) == sorted((x.point_id, x.cube_id) for x in every if x.status == "available")
    got = {x.point_id: (x.available, x.unavailable, x.reason) for x in counts.collect()}
    assert set(got) == {x.point_id for x in every}
    for name, (available, unavailable, reason) in got.items():
        mine = [x for x in every if x.point_id == name]
        assert available == sum(x.status == "available" for x in mine) and unavailable == sum(x.reason == "no_overlap" for x in mine)
        assert reason == (None if available else mine[0].reason)


def test_point_cube_links_of_nothing(spark):
    none = spark.createDataFrame([], "dataset_id string, authority string, code string, wkt string, min_x double, min_y double, max_x double, max_y double")
    pairs, counts = c.point_cube_links(none, none)
    assert pairs.count() == counts.count() == 0
