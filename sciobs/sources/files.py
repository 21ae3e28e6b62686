"""Readers: delimited text, Parquet with row identity, GeoJSON, GeoParquet, Zarr chunks."""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.catalog import table_fields
from ..operators.geometry import geometry_box, to_wkb
from ..plans.spec import AxisRange, SpecError
from .scratch import kept


def separator(path: str) -> str:
    return "\t" if path.rstrip("/").lower().endswith((".tsv", ".tab")) else ","


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType | None = None, sep: str | None = None) -> DataFrame:
    """Typed rows; comma or tab by the file's ending. Give a schema in production: inference reads the files twice."""
    reader = spark.read.option("header", True).option("sep", sep or separator(path))
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_source_records(spark: SparkSession, path: str, columns: Sequence[str], sep: str | None = None, multiline: bool = False) -> DataFrame:
    """Records as text with ``file_path`` and zero-based ``source_index`` within their file; empty cells are empty text.

    Ragged rows and repeated headers are errors. The index comes from the blocks
    a file is read in: rows are numbered within each block, and blocks are
    offset by the rows of those before. Numbered rows are written once, to the
    shared folder: they are counted and joined as they are there. Quoted newlines need ``multiline``, which
    reads a file as one block.
    """
    if len({c.lower() for c in columns}) != len(columns):
        raise SpecError("a header is repeated")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("sep", sep or separator(path)).option("multiLine", multiline).csv(path)
    rows = rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    rows = kept(rows, "numbered")
    blocks = rows.groupBy("file_path", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("file_path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file_path", "__block", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.join(blocks, ["file_path", "__block"]).select("file_path", (F.col("__before") + F.col("__id") - F.col("__first")).alias("source_index"), *columns)


def read_parquet_indexed(spark: SparkSession, path: str) -> DataFrame:
    """Rows with ``file_path`` and their physical position in it as ``source_index``."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("source_index"))


FEATURE = "type string, id string, properties map<string,string>, geometry string"


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(file_path, feature_index, id, properties map, geometry WKB, boxes) of FeatureCollections, Features or geometries; with ``lines`` one Feature per line.

    A file without ``lines`` is one value of one task; for collections beyond that see ``geojson_ranges.read_large_geojson``."""
    text = spark.read.text(path, wholetext=not lines).select("value", F.col("_metadata.file_path").alias("file_path"))
    if lines:
        text = text.where(F.trim("value") != "")
    parsed = text.select("file_path", "value", F.from_json("value", FEATURE + ", features array<string>").alias("j"))
    each = F.when(F.col("j.type") == "FeatureCollection", F.transform("j.features", lambda f: F.from_json(f, FEATURE)))
    alone = F.when(F.col("j.type") == "Feature", F.struct(F.col("j.type").alias("type"), F.col("j.id").alias("id"), F.col("j.properties").alias("properties"), F.col("j.geometry").alias("geometry")))
    bare = F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("map<string,string>").alias("properties"), F.col("value").alias("geometry"))
    return _shaped(parsed.select("file_path", F.posexplode(F.coalesce(each, F.array(F.coalesce(alone, bare)))).alias("feature_index", "f")))


def feature_rows(texts: DataFrame) -> DataFrame:
    """The rows of read_geojson() from the text of each Feature: (file_path, feature_index, text)."""
    return _shaped(texts.select("file_path", "feature_index", F.from_json("text", FEATURE).alias("f")))


def _shaped(rows: DataFrame) -> DataFrame:
    """Features (file_path, feature_index, f) with geometries as WKB and boxes."""

    @F.pandas_udf("geometry binary, min_x double, min_y double, max_x double, max_y double")
    def shapes(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            g = json.loads(t) if t else None
            out.append((to_wkb(g), *geometry_box(g).__dict__.values()) if g else (None,) * 5)
        return pd.DataFrame(out, columns=["geometry", "min_x", "min_y", "max_x", "max_y"])

    made = rows.select("file_path", F.col("feature_index").cast("long").alias("feature_index"), "f.id", "f.properties", shapes("f.geometry").alias("s"))
    return made.select("file_path", "feature_index", "id", "properties", "s.*")


def footer(spark: SparkSession, file: str):
    """The Parquet footer of one file given as a URI; nothing else of it is read, and by Spark's own file access."""
    import io

    import pyarrow.parquet as pq

    where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(file))
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    size = store.getFileStatus(where).getLen()
    stream = store.open(where)
    try:
        stream.seek(size - 8)
        end = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, 8))
        length = int.from_bytes(end[:4], "little")
        stream.seek(size - 8 - length)
        body = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()
    return pq.read_metadata(io.BytesIO(b"PAR1" + body + end))


def geo_metadata(spark: SparkSession, path: str) -> dict:
    """The ``geo`` entry of the first Parquet footer."""
    found = spark.read.parquet(path).inputFiles()
    return json.loads((footer(spark, found[0]).metadata or {}).get(b"geo", b"{}")) if found else {}


#: Files whose footers one inspection reads, on the driver.
MAX_INSPECTED_FILES = 1000


def geo_crs(column: dict) -> str | None:
    """CRS of a geometry column's metadata: its authority and code, else its name; longitude and latitude where none is given, null where it is unknown."""
    if "crs" not in column:
        return "OGC:CRS84"
    crs = column["crs"] or {}
    found = crs.get("id") or {}
    return f"{found['authority']}:{found['code']}" if "authority" in found and "code" in found else crs.get("name")


def inspect_parquet(spark: SparkSession, path: str) -> DataFrame:
    """inspect_table() of Parquet files from their footers alone, with their number of row groups, the geometry column and its CRS.

    Rows are not scanned. More than MAX_INSPECTED_FILES files are an error; no files give zeros."""
    df = spark.read.parquet(path)
    found = df.inputFiles()
    if len(found) > MAX_INSPECTED_FILES:
        raise SpecError(f"at most {MAX_INSPECTED_FILES} files are inspected at once")
    footers = [footer(spark, f) for f in found]
    geo = json.loads((footers[0].metadata or {}).get(b"geo", b"{}")) if footers else {}
    column = geo.get("primary_column")
    crs = geo_crs(geo.get("columns", {}).get(column, {})) if column else None
    fields, series = table_fields(df)
    sums = [F.lit(sum(getattr(m, n) for m in footers)).cast("long").alias(as_) for n, as_ in (("num_rows", "rows"), ("num_row_groups", "row_groups"))]
    return spark.range(1).select(*sums, fields, series, F.lit(column).cast("string").alias("geometry_column"), F.lit(crs).cast("string").alias("crs"))


def read_geoparquet(spark: SparkSession, path: str, geometry: str | None = None) -> DataFrame:
    """Rows with the primary geometry as ``geometry`` (WKB) and ``feature_index``."""
    column = geometry or geo_metadata(spark, path).get("primary_column", "geometry")
    rows = read_parquet_indexed(spark, path)
    if column not in rows.columns:
        raise SpecError(f"there is no geometry column {column!r}")
    return rows.withColumnRenamed(column, "geometry").withColumnRenamed("source_index", "feature_index")


def read_small(spark: SparkSession, path: str) -> str:
    """Text of one small file, hidden ones too, through Spark's own file access."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small new file through Spark's own file access."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


#: Bytes of a file that one row holds.
RANGE_BYTES = 32 << 20
#: Tasks that read ranges, at most.
MAX_TASKS = 100_000


def read_file_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, size, offset, content: files of any length in ranges of at most ``range_bytes``, read by the tasks. Spark lists no files without bytes.

    Names and sizes come from Spark's listing (a file, a folder or a pattern). Tasks open ranges with Arrow's file systems, so
    the place must be one that both know: a shared folder, HDFS or an object store. A file that has become shorter is an error."""
    if range_bytes < 1:
        raise SpecError("a range has at least one byte")
    listed = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    size, many = listed.agg(F.sum("size"), F.sum(F.greatest(F.ceil(F.col("size") / range_bytes), F.lit(1)))).first()
    tasks = max(1, min(int(many or 1), max(spark.sparkContext.defaultParallelism, -(-int(size or 0) // RANGE_BYTES), 1), MAX_TASKS))
    # a given number: rows of the listing are small, and would be put together by their size
    wanted = listed.withColumn("offset", F.explode(starts)).repartition(tasks, "path", "offset")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                store, name = fs.FileSystem.from_uri(row.path if "://" in row.path else row.path.replace("file:", "file://", 1))
                want = int(min(range_bytes, row.size - row.offset))
                with store.open_input_file(name) as file:
                    file.seek(int(row.offset))
                    content = file.read(want)
                if len(content) != want:
                    raise OSError(f"{row.path} ends before {row.size} bytes")
                yield pd.DataFrame({"path": [row.path], "size": [row.size], "offset": [row.offset], "content": [content]})

    return wanted.mapInPandas(fetch, "path string, size long, offset long, content binary")


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this library's own through Spark's file access."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Chunks along one axis that a slice names one by one; a wider range of chunks is listed whole.
MAX_NAMED_CHUNKS = 2000


def _zarr_array(spark: SparkSession, path: str, array: str) -> tuple[str, dict]:
    """(folder, checked metadata) of a version 2 array."""
    where = f"{path.rstrip('/')}/{array.strip('/')}".rstrip("/")
    meta = json.loads(read_small(spark, f"{where}/.zarray"))
    if (meta.get("compressor") or {}).get("id") not in (None, "zlib", "gzip") or meta.get("filters") or meta.get("order", "C") != "C":
        raise SpecError("only raw, zlib and gzip chunks in C order without filters are read")
    if meta.setdefault("dimension_separator", ".") not in (".", "/"):
        raise SpecError(f"unknown dimension separator {meta['dimension_separator']!r}")
    return where, meta


def zarr_chunk_grid(shape: Sequence[int], chunk: Sequence[int], ranges: Sequence[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Of each axis the chunk numbers [first, end) that half-open index ranges touch; all without ranges."""
    if ranges is None:
        ranges = [(0, n) for n in shape]
    if len(ranges) != len(shape):
        raise SpecError("one range for each axis")
    return [(max(0, a) // c, -(-min(b, n) // c) if min(b, n) > max(0, a) else max(0, a) // c) for (a, b), n, c in zip(ranges, shape, chunk, strict=True)]


def read_zarr_chunks(spark: SparkSession, path: str, array: str, ranges: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """A Zarr (version 2) array -> chunk table. Raw, zlib and gzip chunks in C order; edge chunks are cut to the array.

    With ``ranges`` (half-open, one for each axis) only chunks that overlap them are listed and opened: metadata is read on the
    driver and the names of files follow from it. Tasks read and decode. A chunk without a file holds the fill value;
    without a fill value it gives no row.
    """
    where, meta = _zarr_array(spark, path, array)
    shape, chunk, dtype, dot = meta["shape"], meta["chunks"], np.dtype(meta["dtype"]), meta["dimension_separator"]
    grid = zarr_chunk_grid(shape, chunk, ranges)
    out = "array_path string, origin array<bigint>, shape array<bigint>, values array<double>"
    if any(a >= b for a, b in grid):
        return spark.createDataFrame([], out)
    codec, rank = (meta.get("compressor") or {}).get("id"), len(shape)
    inside = lambda axis: "[0-9]*" if axis[1] - axis[0] > MAX_NAMED_CHUNKS else "{" + ",".join(map(str, range(*axis))) + "}"
    names = f"{where}/{dot.join(map(inside, grid))}"

    # the last parts of a name are the chunk's numbers
    numbers = F.slice(F.split("path", "[./]"), -rank, rank).cast("array<bigint>")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress}[codec]
        for pdf in batches:
            rows = []
            for index, content in zip(pdf["index"], pdf["content"], strict=True):
                origin = [int(i) * c for i, c in zip(index, chunk, strict=True)]
                size = [min(c, n - o) for c, n, o in zip(chunk, shape, origin, strict=True)]
                if content is None:
                    values = np.full(size, float(meta["fill_value"]))
                else:
                    values = np.frombuffer(unpack(bytes(content)), dtype).reshape(chunk)[tuple(slice(0, s) for s in size)]
                rows.append((array, origin, size, values.astype(float).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["array_path", "origin", "shape", "values"])

    matched = spark._jvm.org.apache.hadoop.fs.Path(names)
    any_file = matched.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(matched)
    found = spark.createDataFrame([], "index array<bigint>, content binary")
    if any_file is not None and len(any_file):
        # names within one folder are told apart while it is listed once; as paths, each would be listed for itself
        files = spark.read.format("binaryFile")
        files = files.load(names) if dot == "/" else files.option("pathGlobFilter", names.rpartition("/")[2]).load(where)
        found = files.select(numbers.alias("index"), "content")
        # an axis too wide to be named lists more
        for k, (a, b) in enumerate(grid):
            if b - a > MAX_NAMED_CHUNKS:
                found = found.where(F.col("index")[k].between(a, b - 1))
    if meta.get("fill_value") is not None:
        total, sides = 1, [b - a for a, b in grid]
        for n in sides:
            total *= n
        place, index = F.col("id"), []
        for (a, _), n in zip(reversed(grid), reversed(sides), strict=True):
            index.append((place % n + a).cast("long"))
            place = F.floor(place / n)
        every = spark.range(total).select(F.array(*index[::-1]).alias("index"))
        found = found.unionByName(every.join(found.select("index"), "index", "left_anti").withColumn("content", F.lit(None).cast("binary")))
    return found.mapInPandas(decode, out)


def read_zarr_slice(spark: SparkSession, path: str, array: str, ranges: Sequence[AxisRange]) -> DataFrame:
    """(array_path, indices, value) of half-open ranges with steps of a Zarr array, from the chunks that overlap them."""
    from ..operators.arrays import cube_slice

    shape = _zarr_array(spark, path, array)[1]["shape"]
    return cube_slice(read_zarr_chunks(spark, path, array, [(r.start, r.end) for r in ranges]), ranges, shape)


def write_zarr_chunks(chunks: DataFrame, path: str, array: str, shape: Sequence[int], chunk: Sequence[int], separator: str = ".", fill: float | None = 0.0) -> None:
    """Writes a chunk table (origin on the grid, shape, values) as a Zarr (version 2) array of doubles with zlib chunks.

    Each chunk is one file, written by the task that holds it under a name that only depends on its place, so that a task that
    runs again writes the same file. Chunks that are missing are the fill value's.
    """
    spark = chunks.sparkSession
    where = f"{path.rstrip('/')}/{array.strip('/')}".rstrip("/")
    shape, chunk = list(map(int, shape)), list(map(int, chunk))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(where if "://" in where else f"file://{where}") if "/" in where else (None, None)
        for pdf in batches:
            names = []
            for origin, size, values in zip(pdf["origin"], pdf["shape"], pdf["values"], strict=True):
                if any(o % c or s != min(c, n - o) for o, s, c, n in zip(origin, size, chunk, shape, strict=True)):
                    raise SpecError(f"the chunk at {list(origin)} is not one of the grid")
                full = np.full(chunk, float("nan") if fill is None else fill, "<f8")
                full[tuple(slice(0, int(s)) for s in size)] = np.asarray(values, float).reshape([int(s) for s in size])
                name = separator.join(str(int(o) // c) for o, c in zip(origin, chunk, strict=True))
                store.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                    out.write(zlib.compress(full.tobytes()))
                names.append(name)
            yield pd.DataFrame({"name": names})

    if where.startswith("file:/") and not where.startswith("file://"):
        where = "file://" + where.removeprefix("file:")
    written = chunks.select("origin", "shape", "values").mapInPandas(write, "name string").count()
    if not written and fill is None:
        raise SpecError("an array without chunks needs a fill value")
    meta = {"zarr_format": 2, "shape": shape, "chunks": chunk, "dtype": "<f8", "order": "C", "compressor": {"id": "zlib", "level": 6}, "filters": None, "fill_value": fill, "dimension_separator": separator}
    write_small(spark, f"{where}/.zarray", json.dumps(meta))
