"""Metadata functions on names, units and attributes that part, supplier and customer rows spell out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import science as h
from ..operators import arrays as a
from ..operators import catalog as c
from .common import Registry, crc_sql, read

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


def choose(n: int, *texts: str) -> Column:
    """One of the texts by the part's size."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.col("p_size") % n + 1).cast("int"))


def _case(n: int, *texts: str) -> str:
    return f"CASE p_size % {n} " + " ".join(f"WHEN {i} THEN {'NULL' if t is None else repr(t)}" for i, t in enumerate(texts)) + " END"


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part")


#: What names of fields, axes and attributes are put together of; words, ends and signs vary independently over the parts.
STEMS = ("time", "Timestamp", "date", "LAT", "longitude", "lng", "Pres", "depth", "altitude", "qc", "temperature", "platform", "station_nr", "uncertain", "wave", "channel", "band", "Easting", "y", "Z", "elevation", "member")
ENDS = ("", "", "_QC", "_error", "_std", "_time", "_id", "_adjusted")
SIGNS = ("", "", "_", "#")


def _pick(texts: tuple[str, ...], over: int = 1, key: str = "p_partkey") -> Column:
    """One of the texts by the key divided by ``over``."""
    return F.element_at(F.array(*map(F.lit, texts)), (F.floor(F.col(key) / over) % len(texts) + 1).cast("int"))


def _picked(texts: tuple[str | None, ...], over: int = 1, key: str = "p_partkey") -> str:
    return f"([{', '.join('NULL' if t is None else repr(t) for t in texts)}])[({key} // {over}) % {len(texts)} + 1]"


def made_name() -> Column:
    """A part's name as a field: every third one begins with the part's own words."""
    own = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"))).otherwise("")
    return F.concat(_pick(SIGNS, 5), own, _pick(STEMS, key="p_size"), _pick(ENDS, 2), _pick(SIGNS, 7))


_NAME = f"{_picked(SIGNS, 5)} || CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_') || '_' ELSE '' END || {_picked(STEMS, key='p_size')} || {_picked(ENDS, 2)} || {_picked(SIGNS, 7)}"
_NAMED = f"n AS (SELECT *, lower(name) AS low, regexp_replace(lower(name), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS bare FROM (SELECT *, {_NAME} AS name FROM part))"
_ROLE_OF_NAME = """CASE WHEN bare IN ('time', 'timestamp', 'datetime', 'date') OR ends_with(low, '_time') THEN 'time'
    WHEN bare IN ('lat', 'latitude') THEN 'latitude' WHEN bare IN ('lon', 'lng', 'longitude') THEN 'longitude'
    WHEN bare IN ('depth', 'pressure', 'pres', 'height', 'elevation', 'altitude') THEN 'vertical'
    WHEN bare = 'qc' OR ends_with(low, '_qc') OR contains(low, 'quality_control') THEN 'quality_control'
    WHEN ends_with(low, '_error') OR ends_with(low, '_std') OR contains(low, 'uncert') THEN 'uncertainty'
    WHEN ends_with(low, '_id') OR regexp_matches(low, 'identifier|site|station|platform|profile|cycle') THEN 'identifier' ELSE 'value' END"""


@query("field_role", f"WITH {_NAMED} SELECT p_partkey, role, CASE WHEN role IN ('uncertainty', 'identifier', 'value') THEN 'low' ELSE 'medium' END AS confidence FROM (SELECT p_partkey, {_ROLE_OF_NAME} AS role FROM n)")
def field_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = h.field_role(made_name())
    return part(spark, sf_dir).select("p_partkey", r["role"].alias("role"), r["confidence"].alias("confidence"))


#: CF attributes, each with its values (null: not given) and what the key is divided by.
ATTRS = {
    "standard_name": (("time", None, "sea_water_pressure", "", "Latitude", "longitude", None, "sea_water_temperature", "depth"), 1), "axis": ((None, "T", None, "z", None, "X", ""), 4),
    "_CoordinateAxisType": ((None, None, "Lat", "Lon", None, "Time", "Height", None), 3), "variable_type": ((None, "environmental", None, "quality_control", None), 6), "cf_role": ((None, None, None, "profile_id"), 11),
}


def _attrs() -> Column:
    given = F.create_map(*(x for k, (texts, over) in ATTRS.items() for x in (F.lit(k), _pick(texts, over))))
    return F.map_filter(given, lambda _, v: v.isNotNull())


_GIVEN = ", ".join(f"{'' if k == 'cf_role' else 'lower('}{_picked(*of)}{'' if k == 'cf_role' else ')'} AS a{i}" for i, (k, of) in enumerate(ATTRS.items()))
_CF = f"""{_NAMED}, g AS (SELECT *, {_GIVEN} FROM n),
    t AS (SELECT *, concat_ws(',', CASE WHEN a0 = 'time' OR a1 = 't' OR a2 = 'time' THEN 'time' END, CASE WHEN a0 = 'latitude' OR a2 = 'lat' THEN 'latitude' END, CASE WHEN a0 = 'longitude' OR a2 = 'lon' THEN 'longitude' END,
        CASE WHEN a0 = 'depth' OR contains(a0, 'pressure') OR a1 = 'z' OR a2 = 'height' THEN 'vertical' END, CASE WHEN a3 = 'quality_control' OR ends_with(low, '_qc') THEN 'quality_control' END, CASE WHEN a4 IS NOT NULL THEN 'identifier' END) AS told FROM g),
    c AS (SELECT p_partkey, p_brand, name, low, coalesce(nullif(concat_ws(',', nullif(told, ''), CASE WHEN a3 = 'environmental' OR a0 <> '' AND told = '' THEN 'value' END), ''), {_ROLE_OF_NAME}) AS roles FROM t)"""


@query("cf_roles", f"WITH {_CF} SELECT p_partkey, roles FROM c")
def cf_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part(spark, sf_dir).select("p_partkey", F.array_join(h.cf_roles(made_name(), _attrs()), ",").alias("roles"))


@query("axis_role", f"""WITH {_NAMED} SELECT p_partkey, CASE WHEN low IN ('x', 'lon', 'longitude', 'easting') THEN 'x' WHEN low IN ('y', 'lat', 'latitude', 'northing') THEN 'y' WHEN low = 'z' OR regexp_matches(low, 'height|elevation|depth') THEN 'z'
    WHEN regexp_matches(low, 'time|date') THEN 'time' WHEN low = 'band' OR regexp_matches(low, 'wave|spectral') THEN 'spectral' WHEN contains(low, 'channel') THEN 'channel' ELSE 'other' END AS role FROM n""")
def axis_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part(spark, sf_dir).select("p_partkey", h.axis_role(made_name()).alias("role"))


@query("modality_from_text", "SELECT p_partkey, " + _case(4, "hyperspectral,raster", "point_cloud", "tabular,time_series", "tabular") + " AS modalities FROM part")
def from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", choose(4, "Imaging Spectrometer", "LIDAR returns", "soil temperature", "beetle counts"))
    return part(spark, sf_dir).select("p_partkey", F.array_join(h.modality_from_text(text), ",").alias("modalities"))


CDM_TYPES = ("Grid", "grid", "Trajectory", "PROFILE", "TrajectoryProfile", "TimeSeriesProfile", "TimeSeries", "Point", "Other", "Swath", "")
UNITS = ("nm", "NM", "nanometer", "Nanometers", "um", "µm", "micrometer", "MICROMETERS", "m", "inch", "nmm", "")


@query("modality_from_cdm", f"""SELECT p_partkey, CASE WHEN t = 'grid' THEN 'raster,tensor' WHEN t IN ('trajectory', 'profile', 'trajectoryprofile', 'timeseriesprofile') THEN 'vector,time_series,tabular' WHEN t = 'timeseries' THEN 'time_series,tabular'
    WHEN t = 'point' THEN 'vector,tabular' ELSE 'tabular' END AS modalities FROM (SELECT p_partkey, lower(CASE WHEN p_partkey % 13 = 0 THEN p_name ELSE {_picked(CDM_TYPES, key="p_size")} END) AS t FROM part)""")
def from_cdm(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("p_partkey") % 13 == 0, F.col("p_name")).otherwise(_pick(CDM_TYPES, key="p_size"))
    return part(spark, sf_dir).select("p_partkey", F.array_join(h.modality_from_cdm(given), ",").alias("modalities"))


@query("wavelength_factor", f"""SELECT p_partkey, CASE WHEN u IN ('nm', 'nanometer', 'nanometers') THEN 1.0 WHEN u IN ('um', 'µm', 'micrometer', 'micrometers') THEN 1000.0 END::DOUBLE AS factor
    FROM (SELECT p_partkey, lower(trim(repeat(' ', (p_partkey % 3)::INT) || {_picked(UNITS, key="p_size")} || repeat(' ', (p_partkey % 4)::INT))) AS u FROM part)""")
def wavelength_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    blanks = lambda n: F.repeat(F.lit(" "), (F.col("p_partkey") % n).cast("int"))
    return part(spark, sf_dir).select("p_partkey", h.wavelength_factor(F.concat(blanks(3), _pick(UNITS, key="p_size"), blanks(4))).alias("factor"))


@query("parse_map_info", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey * 100.0 - 1 END AS a, CASE WHEN s_suppkey % 3 > 0 THEN 2000.0 + s_suppkey + 1 END AS d FROM supplier")
def parse_map_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("UTM, 2, 2, "), F.col("s_nationkey") * 100, F.lit(", "), F.col("s_suppkey") + 2000, F.lit(", 1, 1, 11, North, rotation="), F.when(F.col("s_suppkey") % 3 == 0, "12").otherwise("0"))
    m = h.parse_map_info(text)
    return read(spark, sf_dir, "supplier").select("s_suppkey", m["a"].alias("a"), m["d"].alias("d"))


@query("epsg_from_wkt", "SELECT s_suppkey, 32600 + s_nationkey AS epsg FROM supplier")
def epsg(spark: SparkSession, sf_dir: str) -> DataFrame:
    wkt = F.concat(F.lit('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4326"]],AUTHORITY["EPSG","'), (F.col("s_nationkey") + 32600).cast("string"), F.lit('"]]'))
    return read(spark, sf_dir, "supplier").select("s_suppkey", h.epsg_from_wkt(wkt).cast("long").alias("epsg"))


@query("license_citation", "SELECT c_custkey, c_custkey % 2 = 0 AS attribution_required, c_name || ' (' || c_mktsegment || '), ERDDAP dataset ' || c_custkey AS citation, '10.5/' || c_custkey AS doi FROM customer")
def citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    attrs = F.create_map(F.lit("license"), F.when(F.col("c_custkey") % 2 == 0, "CC BY 4.0").otherwise("none"), F.lit("institution"), F.col("c_mktsegment"), F.lit("doi"), F.concat(F.lit("doi: 10.5/"), key))
    got = h.license_citation(attrs, F.col("c_name"), key)
    return read(spark, sf_dir, "customer").select("c_custkey", got["attribution_required"].alias("attribution_required"), got["citation"].alias("citation"), got["doi"].alias("doi"))


@query("display_to_source_pixel", "SELECT c_custkey, greatest(0, CAST(floor(c_acctbal * 7) AS BIGINT)) AS pixel FROM customer")
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select("c_custkey", h.display_to_source_pixel(F.col("c_acctbal"), 7).alias("pixel"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as the columns of a dataset; some are flags of others."""
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), choose(4, "", "_QC", "qc", ""))
    return part(spark, sf_dir).select(F.col("p_brand").alias("dataset_id"), name.alias("field")).distinct()


_FIELDS = "WITH f AS (SELECT DISTINCT p_brand AS dataset_id, replace(p_name, ' ', '_') || " + _case(4, "", "_QC", "qc", "") + " AS field FROM part), l AS (SELECT DISTINCT a.dataset_id, a.field, b.field AS qc_field FROM f a JOIN f b ON a.dataset_id = b.dataset_id AND lower(b.field) IN (lower(a.field) || '_qc', lower(a.field) || 'qc'))"


@query("qc_links", _FIELDS + " SELECT dataset_id, field, qc_field FROM l")
def qc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.qc_links(_fields(spark, sf_dir))


_ROLE = "CASE WHEN ends_with(lower(field), '_qc') THEN 'quality_control' ELSE 'value' END"


@query("scientific_inventory", _FIELDS + f""", r AS (SELECT dataset_id, field, {_ROLE} AS role, 'component-' || substr(sha256(dataset_id || chr(31) || field), 1, 16) AS component_id FROM f), q AS (SELECT dataset_id, field, min(qc_field) AS qc_field FROM l GROUP BY 1, 2),
    n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY component_id) AS place, count(*) OVER (PARTITION BY dataset_id) AS every FROM (SELECT DISTINCT * FROM r))
    SELECT component_id, dataset_id, field, role, qc_field, role = 'value' AND qc_field IS NULL AS unresolved, every > 256 AS truncated FROM n LEFT JOIN q USING (dataset_id, field) WHERE place <= 256""")
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of every dataset, at most 256 each."""
    return c.scientific_inventory(_fields(spark, sf_dir)).select("component_id", "dataset_id", "field", "role", "qc_field", "unresolved", "truncated")


@query("suggest_views", _FIELDS + """, d AS (SELECT DISTINCT dataset_id, 'view-' || substr(sha256(dataset_id || chr(31) || 'table'), 1, 16) AS suggestion_id FROM f) SELECT dataset_id, 'table' AS kind, suggestion_id FROM d ORDER BY suggestion_id LIMIT 12""")
def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.suggest_views(c.scientific_inventory(_fields(spark, sf_dir), each=None)).select("dataset_id", "kind", "suggestion_id")


@query("profile_roles", f"""WITH {_CF}, e AS (SELECT p_brand AS dataset_id, name AS field, contains(low, 'adjusted') AS late, unnest(string_split(roles, ',')) AS role FROM c),
    o AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, role ORDER BY late, field) AS place FROM e) SELECT dataset_id, role, field FROM o WHERE place = 1""")
def profile_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.profile_roles(part(spark, sf_dir).select(F.col("p_brand").alias("dataset_id"), made_name().alias("field"), _attrs().alias("attrs")))


@query("materialized_fields", "SELECT DISTINCT p_brand AS dataset_id, p_name AS field FROM part JOIN (SELECT p_brand AS b, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY 1) ON p_brand = b AND p_name IN (lo, hi)")
def materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir).select(F.col("p_brand").alias("dataset_id"), F.col("p_name").alias("field"))
    files = p.groupBy("dataset_id").agg(F.concat(F.min("field"), F.lit(", "), F.max("field"), F.lit("&time>=2020")).alias("expression"))
    return c.materialized_fields(p.distinct(), files)


@query("default_array", "SELECT p_brand || p_type AS dataset_id, CASE count(*) FILTER (p_size % 10 = 0) WHEN 0 THEN 'no_cube' WHEN 1 THEN NULL ELSE 'ambiguous_cube' END AS error, CASE WHEN count(*) FILTER (p_size % 10 = 0) = 1 THEN min(p_partkey) FILTER (p_size % 10 = 0) END AS array FROM part GROUP BY 1")
def default_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1).cast("long")
    shape = F.when(F.col("p_size") % 10 == 0, F.array(one, one, F.col("p_size").cast("long"))).otherwise(F.array(one, one))
    arrays = part(spark, sf_dir).select(F.concat("p_brand", "p_type").alias("dataset_id"), F.col("p_partkey").cast("string").alias("array_path"), shape.alias("shape"))
    return a.default_array(arrays).select("dataset_id", "error", F.col("array_path").cast("long").alias("array"))


@query("cube_descriptors", "SELECT p_partkey, 'y,x,spectral' AS roles, p_retailprice AS scale, CAST(p_size AS DOUBLE) AS no_data FROM part WHERE p_size % 2 = 0")
def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("long")
    arrays = part(spark, sf_dir).select(
        F.col("p_partkey").cast("string").alias("array_path"), F.when(n % 2 == 0, F.array(n, n, n)).otherwise(F.array(n)).alias("shape"), F.when(n % 2 == 0, F.array(*map(F.lit, ("Northing", "lon", "band")))).otherwise(F.array(F.lit("x"))).alias("axis_names"),
        F.array(n).alias("chunk_shape"), F.create_map(F.lit("Scale_Factor"), F.col("p_retailprice").cast("string"), F.lit("_FillValue"), n.cast("string")).alias("attrs"),
    )
    return a.cube_descriptors(arrays).select(F.col("array_path").cast("long").alias("p_partkey"), F.array_join(F.transform("axes", lambda x: x["role"]), ",").alias("roles"), "scale", "no_data")


@query("resolve_resource", "SELECT CAST(s_nationkey AS VARCHAR) AS dataset_id, 'raster,tensor' AS modalities, count(*) AS n_variables, max(s_acctbal) AS north FROM supplier GROUP BY s_nationkey")
def resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("dataset_id"), "s_suppkey", "s_acctbal")
    row = lambda df, kind, variable, attribute, dtype, value: df.select("dataset_id", F.lit(kind).alias("row_type"), variable.alias("variable"), attribute.alias("attribute"), F.lit(dtype).alias("data_type"), value.alias("value"))
    variables = row(s, "variable", F.col("s_suppkey").cast("string"), F.lit(""), "float", F.lit(""))
    box = s.groupBy("dataset_id").agg(F.max("s_acctbal").cast("string").alias("n"))
    attributes = {"cdm_data_type": F.lit("Grid"), "geospatial_lat_max": F.col("n"), "geospatial_lat_min": F.lit("0"), "geospatial_lon_min": F.lit("0"), "geospatial_lon_max": F.lit("1")}
    info = variables
    for k, v in attributes.items():
        info = info.unionByName(row(box, "attribute", F.lit("NC_GLOBAL"), F.lit(k), "String", v))
    got = c.resolve_resource(box.select("dataset_id", F.lit("t").alias("title")), info)
    ring = F.from_json("coverage", "type string, coordinates array<array<array<double>>>")["coordinates"][0]
    return got.select("dataset_id", F.array_join("modalities", ",").alias("modalities"), F.size("variables").cast("long").alias("n_variables"), ring[2][1].alias("north"))


CASTAGNOLI = 0x82F63B78
_CRC = "WITH " + crc_sql("(SELECT doc_id AS r, encode(coalesce(text, '')) AS content FROM documents)", CASTAGNOLI)
#: Public test vectors of CRC-32C: the check value, and those of 32 bytes of zeros, ones, and numbers up and down.
VECTORS = {"313233343536373839": 0xE3069283, "00" * 32: 0x8A9136AA, "FF" * 32: 0x62A8AB43, bytes(range(32)).hex().upper(): 0x46DD794E, bytes(range(31, -1, -1)).hex().upper(): 0x113FDB5C}


@query("crc32c", _CRC + " SELECT r AS path, crc AS crc32c, 'ok' AS status FROM crcs")
def crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text as an object: its CRC-32C, and whether it is the one given in hexadecimal or decimal."""
    objects = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    objects = c.with_crc32c(objects.withColumns({"size": F.octet_length("content").cast("long"), "md5": F.md5("content")})).drop("content")
    text = F.when(F.col("path") % 2 == 0, F.lower(F.hex("crc32c"))).otherwise(F.col("crc32c").cast("string"))
    expected = objects.select("path", "size", F.lit("crc32c").alias("algorithm"), F.when(F.col("path") % 2 == 0, F.lpad(text, 8, "0")).otherwise(text).alias("checksum"))
    return c.verify_checksums(objects, expected).join(objects.select("path", "crc32c"), "path").select("path", "crc32c", "status")


@query("crc32c_of_ranges", _CRC + " SELECT r AS path, crc AS crc32c FROM crcs")
def crc32c_of_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in ranges of 700 bytes, summed apart and put together."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("whole"))
    size = F.octet_length("whole").cast("long")
    ranges = docs.withColumns({"size": size, "offset": F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)), F.lit(700).cast("long")))})
    ranges = ranges.withColumn("content", F.substring(F.col("whole"), F.col("offset").cast("int") + 1, F.lit(700))).drop("whole")
    return c.crc32c_of_ranges(ranges).select("path", "crc32c")


@query("crc32c_vectors", "SELECT hex, crc FROM (VALUES " + ", ".join(f"('{h}', {v})" for h, v in VECTORS.items()) + ") v(hex, crc), (SELECT count(*) AS n FROM documents) WHERE n > 0")
def crc32c_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public test vectors, each behind one half of every document's bytes and without them: exclusive or with the shifted sum of what stands before gives the vector's own."""
    vectors = F.explode(F.array(*map(F.lit, VECTORS))).alias("hex")
    docs = read(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).cast("binary").alias("before"), "doc_id", vectors).withColumn("content", F.unhex("hex"))

    @F.pandas_udf("long")
    def own(before: pd.Series, whole: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([x ^ c.crc32c_shift(b, int(k)) for b, x, k in zip(before, whole, n, strict=True)])

    sums = c.with_crc32c(c.with_crc32c(docs.withColumn("both", F.concat("before", "content")), "before").withColumnRenamed("crc32c", "crc_before"), "both")
    return sums.select("hex", own("crc_before", "crc32c", F.octet_length("content")).alias("crc")).distinct()


_BOUNDS = "min({0}_{1}key) AS min_x, max({0}_{1}key) AS max_x, min({0}_acctbal) AS min_y, max({0}_acctbal) AS max_y"


@query("suggest_pairs", f"""WITH p AS (SELECT c_nationkey AS n, {_BOUNDS.format("c", "cust")} FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS n, {_BOUNDS.format("s", "supp")} FROM supplier GROUP BY 1)
    SELECT a.n_regionkey AS asked, 'cloud-' || p.n AS dataset_id, 'cube-' || s.n AS other_id,
        CASE WHEN p.min_x < s.max_x AND s.min_x < p.max_x AND p.min_y < s.max_y AND s.min_y < p.max_y THEN 'exact' ELSE 'unavailable' END AS link
    FROM p JOIN nation a ON a.n_nationkey = p.n JOIN nation b ON b.n_regionkey = a.n_regionkey JOIN s ON s.n = b.n_nationkey""")
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as a cloud, its suppliers as a cube: which clouds and cubes of a region go together, and whether their boxes overlap."""

    def bounds(name: str, k: str, key: str) -> DataFrame:
        found = read(spark, sf_dir, name).groupBy(F.col(f"{k}_nationkey").alias("n_nationkey"))
        return found.agg(F.min(key).alias("min_x"), F.max(key).alias("max_x"), F.min(f"{k}_acctbal").alias("min_y"), F.max(f"{k}_acctbal").alias("max_y")).withColumns({"crs": F.lit("EPSG:32613"), "linkable": F.lit(True)})

    cloud = bounds("customer", "c", "c_custkey").withColumns({"dataset_id": F.concat(F.lit("cloud-"), "n_nationkey"), "path": F.lit("all")})
    cube = bounds("supplier", "s", "s_suppkey").withColumns({"dataset_id": F.concat(F.lit("cube-"), "n_nationkey"), "array_path": F.lit("/all"), "axis_names": F.array(F.lit("band"), F.lit("y"), F.lit("x"))})
    inventory = c.union_components(c.cloud_components(cloud), c.array_components(cube)).withColumn("qc_field", F.lit(None).cast("string"))
    asked = read(spark, sf_dir, "nation").select(F.explode(F.array(*(F.concat(F.lit(x), "n_nationkey") for x in ("cloud-", "cube-")))).alias("dataset_id"), F.col("n_regionkey").alias("asked"))
    return c.suggest_views(inventory.join(asked, "dataset_id"), 100, "asked").where("kind = 'cloud_and_cube'").select("asked", "dataset_id", "other_id", "link")


_COMPONENT = "'component-' || substr(sha256({0} || chr(31) || '{1}' || chr(31) || {2}), 1, 16)"


@query("suggest_views_of_components", f"""WITH p AS (SELECT c_nationkey AS n, c_mktsegment AS path, 'cloud-' || c_nationkey AS d, {_BOUNDS.format("c", "cust")} FROM customer GROUP BY 1, 2), s AS (SELECT s_nationkey AS n, 'cube-' || s_nationkey AS d, {_BOUNDS.format("s", "supp")} FROM supplier GROUP BY 1),
    cl AS (SELECT p.*, n_regionkey AS asked, {_COMPONENT.format("d", "points", "path")} AS c FROM p JOIN nation ON n_nationkey = n), cu AS (SELECT s.*, n_regionkey AS asked, {_COMPONENT.format("d", "array", "'/all'")} AS c FROM s JOIN nation ON n_nationkey = n),
    every AS (
        SELECT asked, 'point_cloud' AS kind, 1 AS panels, d AS dataset_id, c AS component_id, NULL AS other_id, NULL AS link, NULL AS reason, 'view-' || substr(sha256(d || chr(31) || 'point_cloud' || chr(31) || c), 1, 16) AS suggestion_id FROM cl
        UNION ALL SELECT asked, 'composite_and_spectrum', 2, d, c, NULL, NULL, NULL, 'view-' || substr(sha256(d || chr(31) || 'composite_and_spectrum' || chr(31) || c), 1, 16) FROM cu
        UNION ALL SELECT cl.asked, 'cloud_and_cube', 3, cl.d, cl.c, cu.d, CASE WHEN o THEN 'exact' ELSE 'unavailable' END, CASE WHEN same IS NULL THEN 'no_common_crs' WHEN NOT o THEN 'no_overlap' END,
            'view-' || substr(sha256(cl.d || chr(31) || cu.d || chr(31) || cl.c || chr(31) || cu.c), 1, 16)
        FROM cl JOIN cu ON cl.asked = cu.asked, LATERAL (SELECT CASE WHEN cl.path <> 'BUILDING' THEN 1 END AS same), LATERAL (SELECT coalesce(same = 1 AND cl.min_x < cu.max_x AND cu.min_x < cl.max_x AND cl.min_y < cu.max_y AND cu.min_y < cl.max_y, false) AS o)
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY panels DESC, coalesce(link = 'exact', false) DESC, suggestion_id) AS place FROM every)
    SELECT asked, kind, dataset_id, component_id, other_id, link, reason, suggestion_id FROM ranked WHERE place <= 140""")
def views_of_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation and segment as a cloud, a nation's suppliers as a cube; the segment BUILDING has another CRS. All kinds compete for 140 places in a region."""
    customers = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("path"))
    clouds = customers.agg(F.min("c_custkey").alias("min_x"), F.max("c_custkey").alias("max_x"), F.min("c_acctbal").alias("min_y"), F.max("c_acctbal").alias("max_y"))
    clouds = clouds.withColumns({"dataset_id": F.concat(F.lit("cloud-"), "n_nationkey"), "crs": F.when(F.col("path") == "BUILDING", "EPSG:4326").otherwise("EPSG:32613")})
    cubes = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("min_x"), F.max("s_suppkey").alias("max_x"), F.min("s_acctbal").alias("min_y"), F.max("s_acctbal").alias("max_y"))
    cubes = cubes.withColumns({"dataset_id": F.concat(F.lit("cube-"), "n_nationkey"), "array_path": F.lit("/all"), "axis_names": F.array(F.lit("band"), F.lit("y"), F.lit("x")), "crs": F.lit("EPSG:32613"), "linkable": F.lit(True)})
    inventory = c.union_components(c.cloud_components(clouds), c.array_components(cubes)).withColumn("qc_field", F.lit(None).cast("string"))
    asked = read(spark, sf_dir, "nation").select(F.explode(F.array(*(F.concat(F.lit(x), "n_nationkey") for x in ("cloud-", "cube-")))).alias("dataset_id"), F.col("n_regionkey").alias("asked"))
    return c.suggest_views(inventory.join(asked, "dataset_id"), 140, "asked").select("asked", "kind", "dataset_id", "component_id", "other_id", "link", "reason", "suggestion_id")
