"""Catalogue operators on part, orders, documents and events seen as catalogues, plans and objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import science as h
from ..operators import catalog as c
from ..sources.results import table_checksum
from .common import Registry, read, rnd

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("register_point_cube", """WITH p AS (SELECT s_nationkey AS k, min(s_suppkey) AS x0, max(s_suppkey) AS x1, min(s_acctbal) AS y0, max(s_acctbal) AS y1 FROM supplier GROUP BY 1), q AS (SELECT c_nationkey AS k, min(c_custkey) AS x0, max(c_custkey) AS x1, min(c_acctbal) AS y0, max(c_acctbal) AS y1 FROM customer GROUP BY 1)
    SELECT p.k AS point_id, q.k AS cube_id, CASE WHEN q.k IS NULL THEN 'no_common_crs' WHEN p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1 THEN NULL ELSE 'no_overlap' END AS reason FROM p LEFT JOIN q ON p.k % 5 = q.k % 5 AND p.k % 5 <> 4""")
def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    def boxes(table: str, k: str, x: str, y: str, crs: int) -> DataFrame:
        rows = read(spark, sf_dir, table).groupBy(F.col(k).alias("dataset_id")).agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))
        code = F.when(F.col("dataset_id") % 5 == 4, F.lit(crs)).otherwise(F.col("dataset_id") % 5)
        return rows.withColumns({"authority": F.lit("EPSG"), "code": code.cast("string"), "wkt": F.lit(None).cast("string")})

    out = c.register_point_cube(boxes("supplier", "s_nationkey", "s_suppkey", "s_acctbal", 90), boxes("customer", "c_nationkey", "c_custkey", "c_acctbal", 91))
    return out.select("point_id", "cube_id", "reason")


_LINKED = """WITH p AS (SELECT s_suppkey AS k, s_nationkey % 7 AS crs, s_acctbal AS x0, s_acctbal + 300 AS x1, s_suppkey * 10 AS y0, s_suppkey * 10 + 150 AS y1 FROM supplier),
    q AS (SELECT c_custkey AS k, c_nationkey % 7 AS crs, c_acctbal AS x0, c_acctbal + 20 + c_custkey % 40 * 50 AS x1, c_custkey AS y0, c_custkey + 1 + c_custkey % 30 AS y1 FROM customer),
    j AS (SELECT p.k AS point_id, q.k AS cube_id, p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1 AS overlap FROM p LEFT JOIN q ON p.crs = q.crs AND p.crs <> 6)"""


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as clouds and customers as cubes, large ones beside small ones; those of one remainder share no CRS."""

    def laid(table: str, key: str, nation: str, other: int, x: Column, x1: Column, y: Column, y1: Column) -> DataFrame:
        code = F.when(F.col(nation) % 7 == 6, F.lit(other)).otherwise(F.col(nation) % 7).cast("string")
        return read(spark, sf_dir, table).select(F.col(key).alias("dataset_id"), F.lit("EPSG").alias("authority"), code.alias("code"), F.lit(None).cast("string").alias("wkt"), x.alias("min_x"), x1.alias("max_x"), y.alias("min_y"), y1.alias("max_y"))

    s, k = F.col("s_suppkey"), F.col("c_custkey")
    clouds = laid("supplier", "s_suppkey", "s_nationkey", 90, F.col("s_acctbal"), F.col("s_acctbal") + 300, s * 10, s * 10 + 150)
    cubes = laid("customer", "c_custkey", "c_nationkey", 91, F.col("c_acctbal"), F.col("c_acctbal") + 20 + k % 40 * 50, k, k + 1 + k % 30)
    return c.point_cube_links(clouds, cubes)


@query("point_cube_links", _LINKED + " SELECT point_id, cube_id FROM j WHERE overlap")
def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[0]


@query("point_cube_counts", _LINKED + """ SELECT point_id, CAST(count(*) FILTER (WHERE overlap) AS BIGINT) AS available, CAST(count(*) FILTER (WHERE NOT overlap) AS BIGINT) AS unavailable,
    CASE WHEN count(cube_id) = 0 THEN 'no_common_crs' WHEN count(*) FILTER (WHERE overlap) = 0 THEN 'no_overlap' END AS reason FROM j GROUP BY 1""")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[1]


@query("verify_checksums", "SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'mismatch' WHEN doc_id % 11 = 0 THEN 'unsupported' ELSE 'ok' END AS status FROM documents")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    objects = docs.select(F.col("doc_id").alias("path"), F.octet_length("text").cast("long").alias("size"), F.md5(F.col("text").cast("binary")).alias("md5"), F.lit(None).cast("long").alias("crc32c"))
    expected = docs.select(F.col("doc_id").alias("path"), (F.octet_length("text") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).cast("long").alias("size"), F.when(F.col("doc_id") % 11 == 0, "blake3").otherwise("MD5").alias("algorithm"), F.upper(F.md5(F.col("text").cast("binary"))).alias("checksum"))
    return c.verify_checksums(objects, expected)


@query("fingerprint_files", "SELECT doc_id AS path, sha256(text) AS digest FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.fingerprint_files(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content")))


@query("fingerprint_sets", """WITH l AS (SELECT source, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, sha256(text) AS digest FROM documents),
    b AS (SELECT source, substr(sha256(path), 1, 4) AS bucket, sha256(string_agg(path || ':' || digest, chr(10) ORDER BY path || ':' || digest)) AS digest, count(*) AS files FROM l GROUP BY 1, 2),
    g AS (SELECT source, substr(bucket, 1, 2) AS part, sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) AS digest, sum(files) AS files FROM b GROUP BY 1, 2)
    SELECT source, sha256(CAST(sum(files) AS BIGINT) || chr(10) || sha256(string_agg(part || ':' || digest, chr(10) ORDER BY part))) AS digest FROM g GROUP BY source""")
def fingerprint_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("text").cast("binary").alias("content"))
    return c.fingerprint_files(files, ["source"]).select("source", "digest")


@query("content_dedup", "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY md5(text)")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = read(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return c.content_dedup(objects, order="doc_id").select("doc_id", "digest")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as planned files: one for each customer and status, with many URLs repeated."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("https://data/"), "o_custkey", F.lit("/"), "o_orderstatus").alias("download_url"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("name"), F.floor("o_totalprice").alias("size"), F.md5(F.col("o_orderkey").cast("string").cast("binary")).alias("md5"), (F.col("o_custkey") % 100).alias("plan_id"))


@query("dedup_plan_files", "SELECT 'https://data/' || o_custkey || '/' || o_orderstatus AS download_url, min(lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS name FROM orders GROUP BY 1")
def dedup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.dedup_plan_files(_files(spark, sf_dir)).select("download_url", "name")


@query("plan_totals", "SELECT o_custkey % 100 AS plan_id, count(*) AS files, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.plan_totals(_files(spark, sf_dir), ["plan_id"])


_PLAN_FILES = """'{"download_url":"https://data/' || o_custkey || '/' || o_orderstatus || '","name":"' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '","size":' || CAST(floor(o_totalprice) AS BIGINT) || ',"md5":"' || md5(CAST(o_orderkey AS VARCHAR)) || '"}'"""


@query("plan_hash", f"""WITH d AS (SELECT o_custkey % 100 AS plan_id, sha256({_PLAN_FILES}) AS d FROM orders), r AS (SELECT plan_id, substr(d, 1, 2) AS r, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM d GROUP BY 1, 2)
    SELECT plan_id, sha256(string_agg(d, chr(10) ORDER BY r)) AS plan_hash FROM r GROUP BY 1""")
def plan_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.plan_hash(_files(spark, sf_dir))


@query("flatten_plan_files", "SELECT 'S' || o_custkey % 50 AS site, strftime(o_orderdate, '%Y-%m') AS month, CAST(o_orderkey AS VARCHAR) AS name, o_custkey AS size FROM orders")
def flatten_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("S"), F.col("o_custkey") % 50).alias("siteCode"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.struct(F.col("o_orderkey").cast("string").alias("name"), F.col("o_custkey").alias("size")).alias("f"))
    sites = o.groupBy("siteCode", "month").agg(F.collect_list("f").alias("files"))
    trees = sites.groupBy("siteCode").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct("siteCode", "month", "files")).alias("sites")).alias("data"))).alias("json"))
    return c.flatten_plan_files(trees).select("site", "month", "name", "size")


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as products; their customers' segments as sites with the months of orders."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    months = o.groupBy("c_nationkey", "c_mktsegment").agg(F.collect_set(F.date_format("o_orderdate", "yyyy-MM")).alias("months"))
    return months.groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_mktsegment").alias("siteCode"), F.col("months").alias("availableMonths"))).alias("sites"))


@query("site_availability", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS sites, min(strftime(o_orderdate, '%Y-%m')) AS first_month, max(strftime(o_orderdate, '%Y-%m')) AS last_month FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.site_availability(_products(spark, sf_dir)).select("c_nationkey", F.array_join("sites", ",").alias("sites"), "first_month", "last_month")


@query("flatten_products", "SELECT CAST(c_nationkey AS VARCHAR) AS product_code, 'Lidar sensor ' || c_nationkey AS name, count(DISTINCT c_mktsegment) AS n_sites, max(strftime(o_orderdate, '%Y-%m')) AS last_month, 'point_cloud,tabular,time_series' AS modalities FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey")
def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.to_json(F.struct(F.col("c_nationkey").cast("string").alias("productCode"), F.concat(F.lit("Lidar sensor "), "c_nationkey").alias("productName"), F.col("sites").alias("siteCodes")))
    return c.flatten_products(_products(spark, sf_dir).select(json.alias("json"))).select("product_code", "name", F.size("sites").cast("long").alias("n_sites"), "last_month", F.array_join("modalities", ",").alias("modalities"))


@query("parse_table_envelope", "SELECT event_id AS row, event_type, CAST(user_id AS VARCHAR) AS user_id FROM events")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.array(F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"))
    per_user = read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(line).alias("rows"))
    json = F.to_json(F.struct(F.struct(F.array(*map(F.lit, ("event_id", "event_type", "user_id"))).alias("columnNames"), "rows").alias("table")))
    out = c.parse_table_envelope(per_user.select(json.alias("json")))
    return out.select(F.col("values")["event_id"].cast("long").alias("row"), F.col("values")["event_type"].alias("event_type"), F.col("values")["user_id"].alias("user_id"))


@query("attribute_pivot", "SELECT CAST(user_id AS VARCHAR) AS variable, min(event_type) AS data_type, count(*) AS n_attributes FROM events GROUP BY user_id")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    attributes = e.select(F.lit("attribute").alias("row_type"), F.col("user_id").cast("string").alias("variable"), F.col("event_id").cast("string").alias("attribute"), F.lit("String").alias("data_type"), F.get_json_object("props", "$.k").alias("value"))
    names = e.groupBy("user_id").agg(F.min("event_type").alias("data_type")).select(F.lit("variable").alias("row_type"), F.col("user_id").cast("string").alias("variable"), F.lit("").alias("attribute"), "data_type", F.lit("").alias("value"))
    return c.attribute_pivot(attributes.unionByName(names)).select("variable", "data_type", F.size("attrs").cast("long").alias("n_attributes"))


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array(F.when(F.col("p_size") % 2 == 0, "tabular").otherwise("raster")).alias("modalities"), F.array("p_brand", F.concat(F.lit("size"), "p_size")).alias("sites"), F.format_string("2020-%02d", F.col("p_size") % 12 + 1).alias("first_month"), F.format_string("2021-%02d", F.col("p_size") % 12 + 1).alias("last_month"))


@query("catalog_search", "SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id FROM part WHERE (contains(lower(p_name), 'widget') OR contains(lower(p_type), 'widget')) AND p_size % 2 = 0 AND printf('2021-%02d', p_size % 12 + 1) >= '2021-03' AND printf('2020-%02d', p_size % 12 + 1) <= '2020-11' ORDER BY id LIMIT 100")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.catalog_search(_resources(spark, sf_dir), "WIDGET", ["tabular"], (), "2021-03", "2020-11").select("id")


@query("search_resources", "SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id FROM part WHERE p_size % 2 = 1 ORDER BY id LIMIT 50")
def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.search_resources(_resources(spark, sf_dir), ["collection"], ["raster"], 50).select("id")


@query("combine_crs", "SELECT source AS dataset_id, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS crs, CASE WHEN count(DISTINCT lang) > 1 THEN 'files differ in CRS: ' || string_agg(DISTINCT lang, ', ' ORDER BY lang) END AS warning FROM documents GROUP BY source")
def crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.combine_crs(read(spark, sf_dir, "documents").select(F.col("source").alias("dataset_id"), F.col("lang").alias("crs")))


@query("merge_file_metadata", "SELECT p_brand AS dataset_id, CASE WHEN bool_or(p_size % 2 = 0) AND bool_or(p_size % 2 = 1) THEN 'raster,tabular' WHEN bool_or(p_size % 2 = 0) THEN 'tabular' ELSE 'raster' END AS modalities, count(DISTINCT p_type) AS n_cubes FROM part GROUP BY 1")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset_id"), F.array(F.when(F.col("p_size") % 2 == 0, "tabular").otherwise("raster"), F.lit("unknown")).alias("modalities"), F.array("p_type").alias("cubes"), F.lit("EPSG:4326").alias("crs"), F.array().cast("array<string>").alias("warnings"))
    return c.merge_file_metadata(p).select("dataset_id", F.array_join("modalities", ",").alias("modalities"), F.size("cubes").cast("long").alias("n_cubes"))


@query("coordinate_summary", "SELECT l_returnflag, count(l_extendedprice) AS count, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY 1")
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.coordinate_summary(read(spark, sf_dir, "lineitem").withColumn("value", F.col("l_extendedprice")), ["l_returnflag"])


@query("inspect_table", "SELECT count(*) AS rows, 6 AS n_fields, true AS time_series FROM orders")
def inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.inspect_table(read(spark, sf_dir, "orders")).select("rows", F.size("fields").cast("long").alias("n_fields"), "time_series")


@query("safe_name", "SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9_-]', '_', 'g') AS name FROM part")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", h.safe_name(F.concat_ws("/", "p_name", "p_brand")).alias("name"))


@query("stable_id", "SELECT c_custkey, 'c-' || substr(sha256(c_name || chr(31) || c_nationkey), 1, 16) AS id FROM customer")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", h.stable_id("c-", [F.col("c_name"), F.col("c_nationkey")]).alias("id"))


@query("modality_from_extension", "SELECT page_id, CASE WHEN regexp_matches(url, '\\.html$') THEN 'unknown' ELSE 'unknown' END AS modality FROM pages")
def extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(h.modality_from_extension(F.col("url")), ",").alias("modality"))


@query("primary_modality", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'point_cloud' WHEN p_size % 2 = 0 THEN 'raster' ELSE 'tabular' END AS modality FROM part")
def primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = h.merge_modalities(F.array(F.lit("tabular"), F.lit("unknown")), F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "raster"), F.when(F.col("p_size") % 3 == 0, "point_cloud"))))
    return read(spark, sf_dir, "part").select("p_partkey", h.primary_modality(found).alias("modality"))


@query("parse_range", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS low, o_totalprice AS high FROM orders")
def parse_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = h.parse_range(F.concat(F.col("o_custkey"), F.lit(", to "), F.col("o_totalprice").cast("decimal(20,2)")))
    return read(spark, sf_dir, "orders").select("o_orderkey", r["low"].alias("low"), r["high"].alias("high"))


@query("parse_crs", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'EPSG' END AS authority, CAST(p_size AS VARCHAR) AS code FROM part")
def parse_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("EPSG:"), "p_size")).otherwise(F.col("p_size").cast("string"))
    out = h.parse_crs(text)
    return read(spark, sf_dir, "part").select("p_partkey", out["authority"].alias("authority"), out["code"].alias("code"))


@query("validate_georef", "SELECT c_custkey, c_custkey % 3 = 0 AS linkable FROM customer")
def georef(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("double")
    shift = F.when(F.col("c_custkey") % 3 == 0, 0.001).otherwise(500.0)
    cubes = read(spark, sf_dir, "customer").select("c_custkey", F.lit(10).alias("rows"), F.lit(20).alias("cols"), k.alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("c"), k.alias("d"), F.lit(0.0).alias("e"), F.lit(-1.0).alias("f"), (k + shift).alias("min_x"), (k + 20).alias("max_x"), (k - 10).alias("min_y"), k.alias("max_y"))
    return c.validate_georef(cubes).select("c_custkey", "linkable")


@query("rgb_band_suggestion", "SELECT label, arg_min(band, abs(w - 650) * 1000 + band * 1e-6) || ',' || arg_min(band, abs(w - 550) * 1000 + band * 1e-6) || ',' || arg_min(band, abs(w - 450) * 1000 + band * 1e-6) AS rgb FROM (SELECT label, vec_id AS band, 400 + (vec_id % 50) * 11.0 AS w FROM embeddings) GROUP BY label")
def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = read(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("band"), (400 + (F.col("vec_id") % 50) * 11.0).alias("wavelength"), F.lit("nm").alias("unit"))
    return c.rgb_band_suggestion(axis, ["label"]).select("label", F.array_join(F.transform("rgb", lambda b: b.cast("string")), ",").alias("rgb"))


@query("rank_suggestions", "SELECT CAST(p_partkey AS VARCHAR) AS suggestion_id FROM part ORDER BY CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END DESC, p_size DESC, suggestion_id LIMIT 12")
def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 3
    return c.rank_suggestions(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("suggestion_id"), F.when(s == 0, "high").when(s == 1, "medium").otherwise("low").alias("confidence"), F.col("p_size").alias("panels"))).select("suggestion_id")


@query("result_checksum")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.agg(F.count(F.lit(1)).alias("rows"), table_checksum(o))


@query("coverage_polygon", "SELECT c_nationkey, round(min(c_acctbal), 2) AS south, round(max(c_acctbal), 2) AS north FROM customer GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_acctbal").alias("s"), F.max("c_acctbal").alias("n"))
    ring = F.from_json(h.coverage_polygon(F.lit(0.0), F.lit(1.0), F.col("s"), F.col("n")), "type string, coordinates array<array<array<double>>>")
    return b.select("c_nationkey", rnd(ring["coordinates"][0][0][1], 2).alias("south"), rnd(ring["coordinates"][0][2][1], 2).alias("north"))
