"""Readers and sinks, by round trips and on several splits."""

from __future__ import annotations

import gzip
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sciobs.operators import arrays as a
from sciobs.operators import geometry as g
from sciobs.plans.spec import AxisRange, SpecError
from sciobs.sources import datasources, files, results


def test_source_records_over_many_blocks(spark, tmp_path):
    for name, n in (("a.tsv", 3000), ("b.tsv", 1), ("c.tsv", 1700)):
        (tmp_path / name).write_text("site\tvalue\tnote\n" + "".join(f"S{i}\t0{i}.00\t{'' if i % 3 else '-9999'}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = files.read_source_records(spark, f"{tmp_path}/*.tsv", ["site", "value", "note"], sep="\t").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 4701
    for r in rows:
        i = r["source_index"]
        assert (r["site"], r["value"], r["note"]) == (f"S{i}", f"0{i}.00", "" if i % 3 else "-9999")


def test_source_record_errors(spark, tmp_path):
    (tmp_path / "r.csv").write_text("a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_source_records(spark, f"{tmp_path}/r.csv", ["a", "b"]).collect()
    with pytest.raises(SpecError):
        files.read_source_records(spark, f"{tmp_path}/r.csv", ["a", "A"])
    assert files.separator("x.tsv") == "\t" and files.separator("x.csv") == ","
    (tmp_path / "t.csv").write_text("when,v\n2024-01-01,1.5\n")
    assert files.read_delimited(spark, f"{tmp_path}/t.csv", "when date, v double").first()["v"] == 1.5


def test_parquet_rows(spark, tmp_path):
    spark.createDataFrame([("HARV", 1.0), ("ABBY", 2.5), ("OSBS", 3.75)], "site string, value double").coalesce(1).write.parquet(f"{tmp_path}/p")
    rows = {r["source_index"]: r["site"] for r in files.read_parquet_indexed(spark, f"{tmp_path}/p").collect()}
    assert rows == {0: "HARV", 1: "ABBY", 2: "OSBS"}


@pytest.mark.parametrize("stream", [False, True])
def test_arrow(spark, tmp_path, stream):
    spark.dataSource.register(datasources.ArrowIPC)
    table = pa.table({"site": [f"s{i}" for i in range(1000)], "value": [float(i) for i in range(1000)]})
    with (pa.ipc.new_stream if stream else pa.ipc.new_file)(f"{tmp_path}/t.arrow", table.schema) as w:
        w.write_table(table, max_chunksize=30)
    df = spark.read.format("arrow_ipc").option("path", f"{tmp_path}/t.arrow").load()
    assert df.columns == ["site", "value", "source_index"]
    rows = df.collect()
    assert len(rows) == 1000 and all(r["site"] == f"s{r['source_index']}" and r["value"] == r["source_index"] for r in rows)


def test_arrow_sink(spark, tmp_path):
    df = spark.range(500).select("id", (F.col("id") * 2).alias("twice"))
    results.write_arrow_ipc(df, f"{tmp_path}/out")
    back = spark.read.format("arrow_ipc").option("path", f"{tmp_path}/out").load()
    assert sorted((r["id"], r["twice"]) for r in back.collect()) == [(i, 2 * i) for i in range(500)]


@pytest.mark.parametrize("form,size", [(1, 28), (6, 30)])
def test_las(spark, tmp_path, monkeypatch, form, size):
    head = bytearray(375)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 4 if form == 6 else 2])
    n = 25
    struct.pack_into("<HI", head, 94, 375, 375)
    struct.pack_into("<BHI", head, 104, form, size, 0 if form == 6 else n)
    struct.pack_into("<3d", head, 131, 0.5, 0.5, 0.25)
    struct.pack_into("<3d", head, 155, 100.0, 0.0, 0.0)
    if form == 6:
        struct.pack_into("<Q", head, 247, n)
    body = b""
    for i in range(n):
        p = bytearray(size)
        struct.pack_into("<3iH", p, 0, i, 2 * i, 4 * i, i)
        p[16 if form == 6 else 15] = i % 9
        body += p
    (tmp_path / "c.las").write_bytes(head + body)
    monkeypatch.setattr(datasources, "POINTS", 10)
    spark.dataSource.register(datasources.LAS)
    rows = sorted(spark.read.format("las").option("path", f"{tmp_path}/c.las").load().collect())
    assert [tuple(r) for r in rows] == [(i, 100 + i / 2, float(i), float(i), i, i % 9) for i in range(n)]


def test_geojson(spark, tmp_path):
    feature = lambda i, x: {"type": "Feature", "id": str(i), "properties": {"plot": "p" + str(i)}, "geometry": {"type": "Point", "coordinates": [x, 1.0]}}
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(i, float(i)) for i in range(3)]}))
    (tmp_path / "f.geojson").write_text(json.dumps(feature(7, 7.0)))
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "LineString", "coordinates": [[0, 0], [2, 3]]}))
    rows = files.read_geojson(spark, f"{tmp_path}/*.geojson").collect()
    assert len(rows) == 5
    got = {(r["file_path"].rpartition("/")[2], r["feature_index"]): r for r in rows}
    assert got["c.geojson", 2]["properties"] == {"plot": "p2"} and got["c.geojson", 2]["min_x"] == 2.0 and got["f.geojson", 0]["id"] == "7" and got["g.geojson", 0]["max_y"] == 3.0
    sel = files.read_geojson(spark, f"{tmp_path}/c.geojson").select("id", F.lit('{"type":"Point","coordinates":[0,1]}').alias("geometry"), "properties")
    results.write_geojson(sel, f"{tmp_path}/out")
    lines = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert sorted(x["id"] for x in lines) == ["0", "1", "2"] and lines[0]["geometry"]["type"] == "Point" and lines[0]["type"] == "Feature"
    assert files.read_geojson(spark, f"{tmp_path}/out", lines=True).count() == 3


def test_geoparquet(spark, tmp_path):
    import pyarrow.parquet as pq

    (tmp_path / "gp").mkdir()
    t = pa.table({"plot": ["in", "out"], "shape": [g.to_wkb({"type": "Point", "coordinates": [v, v]}) for v in (1.0, 10.0)]})
    pq.write_table(t.replace_schema_metadata({"geo": json.dumps({"primary_column": "shape"})}), tmp_path / "gp" / "x.parquet")
    df = g.with_boxes(files.read_geoparquet(spark, f"{tmp_path}/gp"))
    square = {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}
    assert [r["plot"] for r in g.vector_region(df, square)[0].collect()] == ["in"]
    with pytest.raises(SpecError):
        files.read_geoparquet(spark, f"{tmp_path}/gp", "nothing")


@pytest.mark.parametrize("codec,sep", [(None, "."), ("zlib", "."), ("gzip", "/")])
def test_zarr(spark, tmp_path, codec, sep):
    full = np.arange(5 * 7, dtype="<i4").reshape(5, 7)
    where = tmp_path / "z" / "refl"
    where.mkdir(parents=True)
    (where / ".zarray").write_text(json.dumps({"shape": [5, 7], "chunks": [2, 3], "dtype": "<i4", "order": "C", "compressor": codec and {"id": codec}, "filters": None, "dimension_separator": sep}))
    for i in range(3):
        for j in range(3):
            block = np.zeros((2, 3), "<i4")
            part = full[2 * i : 2 * i + 2, 3 * j : 3 * j + 3]
            block[: part.shape[0], : part.shape[1]] = part
            path = where / f"{i}{sep}{j}"
            path.parent.mkdir(exist_ok=True)
            path.write_bytes({None: bytes, "zlib": zlib.compress, "gzip": gzip.compress}[codec](block.tobytes()))
    cells = a.explode_array_chunks(files.read_zarr_chunks(spark, f"{tmp_path}/z", "refl"), 2).collect()
    assert {tuple(r["indices"]): r["value"] for r in cells} == {(y, x): float(full[y, x]) for y in range(5) for x in range(7)}


@pytest.mark.parametrize("sep", [".", "/"])
def test_zarr_slices_open_overlapping_chunks_only(spark, tmp_path, monkeypatch, sep):
    """A slice of rows 4 to 8 and columns 3 to 5: damage to all other chunks is not seen."""
    full = np.arange(9 * 7, dtype=float).reshape(9, 7)
    cells = spark.createDataFrame([("v", [y, x], float(full[y, x])) for y in range(9) for x in range(7) if (y, x) != (0, 0)], "array_path string, indices array<bigint>, value double")
    table = a.chunk_cells(cells, [9, 7], [2, 3])
    files.write_zarr_chunks(table, f"file://{tmp_path}/z", "v", [9, 7], [2, 3], sep)
    whole = {tuple(r["indices"]): r["value"] for r in a.explode_array_chunks(files.read_zarr_chunks(spark, f"{tmp_path}/z", "v"), 2).collect()}
    assert whole.pop((0, 0)) != whole.get((0, 1)) and whole == {(y, x): full[y, x] for y in range(9) for x in range(7) if (y, x) != (0, 0)}
    needed = {f"{i}{sep}{j}" for i in (2, 3) for j in (1,)}
    for file in (tmp_path / "z" / "v").rglob("[0-9]*"):
        if file.is_file() and str(file.relative_to(tmp_path / "z" / "v")) not in needed:
            file.write_bytes(b"no chunk")
    ranges = [AxisRange(4, 8, 1), AxisRange(3, 5, 1)]
    for named in (files.MAX_NAMED_CHUNKS, 1):
        monkeypatch.setattr(files, "MAX_NAMED_CHUNKS", named)
        got = files.read_zarr_slice(spark, f"{tmp_path}/z", "v", ranges).collect()
        assert {tuple(r["indices"]): r["value"] for r in got} == {(y, x): full[y, x] for y in range(4, 8) for x in range(3, 5)}
    opened = files.read_zarr_chunks(spark, f"{tmp_path}/z", "v", [(4, 8), (3, 5)])
    assert opened.count() == 2
    assert files.read_zarr_chunks(spark, f"{tmp_path}/z", "v", [(4, 4), (3, 5)]).count() == 0
    with pytest.raises(SpecError):
        files.read_zarr_chunks(spark, f"{tmp_path}/z", "v", [(0, 1)])


def test_zarr_fill_values(spark, tmp_path):
    """Chunks without a file hold the fill value; without one they give no row."""
    one = spark.createDataFrame([("v", [2, 0], [2, 3], [1.0] * 6)], "array_path string, origin array<bigint>, shape array<bigint>, values array<double>")
    files.write_zarr_chunks(one, f"{tmp_path}/z", "v", [5, 4], [2, 3], fill=7.5)
    got = {tuple(r["origin"]): (tuple(r["shape"]), r["values"]) for r in files.read_zarr_chunks(spark, f"{tmp_path}/z", "v").collect()}
    assert len(got) == 6 and got[2, 0] == ((2, 3), [1.0] * 6) and got[4, 3] == ((1, 1), [7.5]) and got[0, 0] == ((2, 3), [7.5] * 6)
    files.write_zarr_chunks(one, f"{tmp_path}/n", "v", [5, 4], [2, 3], fill=None)
    assert files.read_zarr_chunks(spark, f"{tmp_path}/n", "v").count() == 1
    assert files.read_zarr_chunks(spark, f"{tmp_path}/n", "v", [(0, 1), (0, 1)]).count() == 0
    files.write_zarr_chunks(one.limit(0), f"{tmp_path}/e", "v", [2, 2], [2, 2], fill=0.0)
    assert files.read_zarr_chunks(spark, f"{tmp_path}/e", "v").first()["values"] == [0.0] * 4
    with pytest.raises(Exception, match="out of the array"):
        a.chunk_cells(spark.createDataFrame([("v", [5, 0], 1.0)], "array_path string, indices array<bigint>, value double"), [5, 4], [2, 3]).collect()


def test_csv_and_strings(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["x", "y"], 'say "hi", you'), (2, 3.5, None, "")], "id int, v double, tags array<string>, note string").coalesce(1)
    results.write_csv(df, f"{tmp_path}/c")
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert text.splitlines()[0] == "id,v,tags,note" and '"[""x"",""y""]"' in text and text.splitlines()[2] == "2,3.5,,"
    results.write_parquet(df.select("id", "v"), f"{tmp_path}/s", as_strings=True)
    assert dict(spark.read.parquet(f"{tmp_path}/s").dtypes) == {"id": "string", "v": "string"}


def test_persisted_results(spark, tmp_path):
    df = spark.range(1000)
    one, two = (results.persist_result(x, str(tmp_path), "all") for x in (df, df.repartition(7)))
    stats = {r["result_id"]: r for r in spark.read.parquet(f"{tmp_path}/results").collect()}
    assert stats[one]["rows"] == 1000 and stats[one]["checksum"] == stats[two]["checksum"]
    assert spark.read.parquet(f"{tmp_path}/preview/{one}").count() == 200 and spark.read.parquet(f"{tmp_path}/data/{two}").count() == 1000


def test_provenance_and_order_of_the_preview(spark, tmp_path):
    df = spark.range(1000).select(F.lit(1000) - F.col("id").alias("v"), F.create_map(F.lit("k"), F.lit("v")).alias("m")).toDF("v", "m").drop("m").repartition(5)
    found = results.persist_result(df, str(tmp_path), "numbers", sources=["file:/data/x"])
    assert [r["v"] for r in spark.read.parquet(f"{tmp_path}/preview/{found}").collect()] == list(range(1, 201))
    crate = json.loads((tmp_path / "provenance" / found / "ro-crate-metadata.json").read_text())
    parts = {p["@id"]: p for p in crate["@graph"]}
    stats = spark.read.parquet(f"{tmp_path}/results").first()
    data = parts[f"../../data/{found}/"]
    assert parts["ro-crate-metadata.json"]["about"] == {"@id": "./"} and parts["./"]["name"] == "numbers"
    assert data["size"] == stats["rows"] == 1000 and data["identifier"] == f"checksum:{stats['checksum']}"
    assert parts["#query"]["object"] == [{"@id": "file:/data/x"}] and parts["file:/data/x"]["@type"] == "Dataset" and parts["#field-0"]["name"] == "v"
    assert "license" not in parts["./"] and "instrument" not in parts["#query"]
    empty = results.persist_result(df.where("v < 0"), str(tmp_path), "none", citation="Doe et al.", license="CC-BY-4.0", call={"function": "filter_range", "arguments": {"column": "v", "max": 0}})
    crate = json.loads((tmp_path / "provenance" / empty / "ro-crate-metadata.json").read_text())
    parts = {p["@id"]: p for p in crate["@graph"]}
    assert (parts["./"]["citation"], parts["./"]["license"]) == ("Doe et al.", "CC-BY-4.0")
    assert json.loads(parts[parts["#query"]["instrument"]["@id"]]["text"])["arguments"] == {"column": "v", "max": 0}
    assert spark.read.parquet(f"{tmp_path}/results").where(F.col("result_id") == empty).first()["rows"] == 0


def test_inspect_parquet(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    geo = {"version": "1.0.0", "primary_column": "shape", "columns": {"shape": {"encoding": "WKB", "crs": {"id": {"authority": "EPSG", "code": 32613}}}}}
    table = pa.table({"shape": pa.array([b""] * 10, pa.binary()), "start_time": pa.array(range(10), pa.int64())}).replace_schema_metadata({"geo": json.dumps(geo)})
    for k in range(2):
        pq.write_table(table, tmp_path / f"{k}.parquet", row_group_size=4)
    one = files.inspect_parquet(spark, str(tmp_path)).first()
    assert (one["rows"], one["row_groups"], one["geometry_column"], one["crs"], one["time_series"]) == (20, 6, "shape", "EPSG:32613", True)
    assert [f["name"] for f in one["fields"]] == ["shape", "start_time"]
    assert files.geo_crs({}) == "OGC:CRS84" and files.geo_crs({"crs": None}) is None and files.geo_crs({"crs": {"name": "local"}}) == "local"
    spark.range(0).write.parquet(f"{tmp_path}/none")
    none = files.inspect_parquet(spark, f"{tmp_path}/none").first()
    assert (none["rows"], none["row_groups"], none["geometry_column"], none["crs"]) == (0, 0, None, None)


def test_las_written_and_read(spark, tmp_path):
    rows = [(i, 500_000.25 + i, -12.5 - i / 4, i / 100, i % 65536, i % 32) for i in range(2000)] + [(2000, 500_000.0, 0.0, 0.0, None, None)]
    frame = spark.createDataFrame(rows, "id long, x double, y double, z double, intensity int, classification int").repartition(3, "id")
    results.write_las(frame.unionByName(frame.where("false")), str(tmp_path / "las"), (0.01, 0.25, 0.01), (500_000.0, 0.0, 0.0))
    spark.dataSource.register(datasources.LAS)
    got = sorted((round(r.x, 6), r.y, round(r.z, 6), r.intensity, r.classification) for r in spark.read.format("las").option("path", str(tmp_path / "las")).load().collect())
    assert got == sorted((round(x, 6), y, round(z, 6), i or 0, c or 0) for _, x, y, z, i, c in rows)
    names = sorted((tmp_path / "las").iterdir())
    assert len(names) == 3 and all(n.suffix == ".las" for n in names)
    heads = [datasources.las_header(str(n)) for n in names]
    assert sum(h["points"] for h in heads) == 2001 and {h["scale"] for h in heads} == {(0.01, 0.25, 0.01)}
    assert all(n.stat().st_size == 375 + 30 * h["points"] for n, h in zip(names, heads, strict=True))


@pytest.mark.parametrize("row", [(None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (1e9, 1.0, 1.0)])
def test_las_refuses_what_does_not_fit(spark, tmp_path, row):
    frame = spark.createDataFrame([row], "x double, y double, z double")
    with pytest.raises(Exception, match="too large for this scale"):
        results.write_las(frame, str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("*.las"))


def test_large_chunks_with_gaps_and_one_listing(spark, tmp_path):
    """Cells go to their places without a search for each, and a folder of chunks is listed once."""
    want = np.full((300, 250), np.nan)
    want[3:120:2, 7:] = 2.5
    want[299, 249] = 4.0
    cells = spark.createDataFrame([("v", [int(y), int(x)], float(want[y, x])) for y, x in np.argwhere(np.isfinite(want))], "array_path string, indices array<long>, value double")
    chunks = a.chunk_cells(cells, [300, 250], [200, 200])
    assert "map_from_entries" not in chunks._jdf.queryExecution().optimizedPlan().toString()
    files.write_zarr_chunks(chunks, f"{tmp_path}/z", "v", [300, 250], [200, 200])
    read = files.read_zarr_chunks(spark, f"{tmp_path}/z", "v", [(0, 300), (0, 250)])
    assert "InMemoryFileIndex(1 paths)" in read._jdf.queryExecution().executedPlan().toString()
    got = np.zeros((300, 250))
    for r in read.collect():
        (y, x), (h, w) = r["origin"], r["shape"]
        got[y : y + h, x : x + w] = np.reshape(r["values"], (h, w))
    # a chunk without a cell is the fill value
    assert np.array_equal(got[:200, :200], want[:200, :200], equal_nan=True) and np.array_equal(got[200:, 200:], want[200:, 200:], equal_nan=True) and np.array_equal(got[:200, 200:], want[:200, 200:], equal_nan=True)
    assert not got[200:, :200].any()
