"""Readers and sinks on tables written to the shared folder first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry
from ..sources import datasources, files, results
from ..sources.geojson_ranges import read_large_geojson
from .common import Registry, read, scratch

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("read_source_records", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, count(*) OVER () AS n FROM orders")
def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV, read back as text records; every file numbers its records without gaps."""
    path = scratch(spark, "records")
    results.write_csv(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path)
    rows = files.read_source_records(spark, path, ["o_orderkey", "o_orderstatus"])
    gapless = rows.groupBy("file_path").agg((F.max("source_index") + 1).alias("n"), F.count_distinct("source_index").alias("d")).where("n = d").agg(F.sum("n").alias("n"))
    return rows.crossJoin(F.broadcast(gapless)).select("o_orderkey", "o_orderstatus", "n")  # one row


@query("read_delimited", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "table")
    results.write_csv(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "\t")
    return files.read_delimited(spark, path, "o_orderkey long, o_totalprice double, o_orderstatus string", "\t")


@query("geojson_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS segment, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal AS y FROM customer")
def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "features")
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal")).alias("coordinates")))
    results.write_geojson(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), point.alias("geometry"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("properties")), path)
    back = files.read_geojson(spark, path, lines=True)
    return back.select("id", F.col("properties")["segment"].alias("segment"), F.col("min_x").alias("x"), F.col("min_y").alias("y"))


@query("read_large_geojson", """SELECT c_custkey // 500 AS block, row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) - 1 AS feature_index, CAST(c_custkey AS VARCHAR) AS id, c_mktsegment || '"]}\\ ' || c_name AS segment, c_acctbal AS y FROM customer""")
def large_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 500 customers as collections, with signs of JSON in their texts, read in ranges that cut features."""
    path = scratch(spark, "collections")
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal")).alias("coordinates"))
    segment = F.concat("c_mktsegment", F.lit('"]}\\ '), "c_name")
    feature = F.struct("c_custkey", F.struct(F.lit("Feature").alias("type"), F.col("c_custkey").alias("id"), F.struct(segment.alias("segment")).alias("properties"), point.alias("geometry")).alias("f"))
    found = read(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 500).alias("block")).agg(F.transform(F.array_sort(F.collect_list(feature)), lambda x: x["f"]).alias("features"))
    other = F.array(F.struct(F.lit("no feature").alias("type")))
    found.select("block", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), other.alias("others"), "features", other.alias("more")))).write.partitionBy("block").text(path)
    back = read_large_geojson(spark, f"{path}/*/*", 2000)
    block = F.regexp_extract("file_path", "block=([0-9]+)", 1).cast("long")
    return back.select(block.alias("block"), "feature_index", "id", F.col("properties")["segment"].alias("segment"), F.col("min_y").alias("y"))


@query("write_parquet_strings", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "strings")
    results.write_parquet(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), path, as_strings=True)
    return spark.read.parquet(path)


@query("persist_result", "SELECT count(*) AS rows FROM orders WHERE o_orderstatus = 'O'")
def persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark, "results")
    found = results.persist_result(read(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), root, "orders that are open")
    return spark.read.parquet(f"{root}/results").where(F.col("result_id") == found).select("rows")


@query("arrow_ipc_round_trip", "SELECT o_orderkey, o_orderstatus, o_totalprice, count(*) OVER () AS numbered FROM orders")
def arrow_ipc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as Arrow files, one a partition, and back; each file numbers its rows without gaps."""
    path = scratch(spark, "arrow")
    results.write_arrow_ipc(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    spark.dataSource.register(datasources.ArrowIPC)
    rows = spark.read.format("arrow_ipc").option("path", path).load()
    numbered = rows.agg(F.count("source_index").alias("numbered"))
    return rows.drop("source_index").crossJoin(F.broadcast(numbered))  # one row


@query("las_round_trip", """SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS x, CAST(round(l_quantity * 100) AS BIGINT) AS y, CAST(round(l_discount * 100) AS BIGINT) AS z,
    CAST(l_partkey % 65536 AS BIGINT) AS intensity, CAST(l_linenumber AS BIGINT) AS classification, count(*) OVER () AS numbered FROM lineitem""")
def las(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points in LAS files, one a partition, and back in hundredths."""
    path = scratch(spark, "las")
    items = read(spark, sf_dir, "lineitem")
    results.write_las(items.select(F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("y"), F.col("l_discount").alias("z"), (F.col("l_partkey") % 65536).cast("int").alias("intensity"), F.col("l_linenumber").cast("int").alias("classification")), path)
    spark.dataSource.register(datasources.LAS)
    rows = spark.read.format("las").option("path", path).load()
    numbered = rows.agg(F.count("source_index").alias("numbered"))
    whole = [F.round(F.col(c) * 100).cast("long").alias(c) for c in "xyz"]
    return rows.crossJoin(F.broadcast(numbered)).select(*whole, F.col("intensity").cast("long").alias("intensity"), F.col("classification").cast("long").alias("classification"), "numbered")  # one row


@query("geoparquet_round_trip", "SELECT c_mktsegment AS segment, CAST(c_nationkey AS DOUBLE) AS x, c_acctbal AS y FROM customer")
def geoparquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points in GeoJSON, then in Parquet with well-known binary, and back."""
    path = scratch(spark, "points")
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal")).alias("coordinates")))
    results.write_geojson(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), point.alias("geometry"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("properties")), f"{path}-json")
    files.read_geojson(spark, f"{path}-json", lines=True).select("geometry", F.col("properties")["segment"].alias("segment")).write.parquet(path)
    back = geometry.with_boxes(files.read_geoparquet(spark, path))
    return back.select("segment", F.col("min_x").alias("x"), F.col("min_y").alias("y"))


@query("inspect_parquet", "SELECT count(*) AS rows, true AS grouped, 6 AS n_fields, true AS time_series, CAST(NULL AS VARCHAR) AS geometry_column, CAST(NULL AS VARCHAR) AS crs FROM orders")
def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from their footers alone; any table with rows has a row group."""
    found = files.inspect_parquet(spark, f"{sf_dir}/orders.parquet")
    return found.select("rows", (F.col("row_groups") >= 1).alias("grouped"), F.size("fields").cast("long").alias("n_fields"), "time_series", "geometry_column", "crs")


@query("result_preview", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def previewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored preview of a result in its asked order."""
    root = scratch(spark, "previews")
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("rank"))
    found = results.persist_result(rows, root, "dearest open orders", order=["rank", "o_orderkey"])
    return spark.read.parquet(f"{root}/preview/{found}").drop("rank")
