"""Catalogues, plans, checksums and inferred metadata, set at a time."""

from __future__ import annotations

from functools import lru_cache
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.science import axis_role, cf_roles, coverage_polygon, field_role, finite, modality_from_cdm, modality_from_text, stable_id, try_double
from ..plans.spec import MAX_COMPONENTS, MAX_SUGGESTIONS, SpecError
from .quadtree import box_join

# ---- fields and axes


def qc_links(fields: DataFrame) -> DataFrame:
    """(dataset_id, field, qc_field): a field and ``<field>_qc`` or ``<field>qc`` of the same dataset, ignoring case."""
    qc = fields.select("dataset_id", F.col("field").alias("qc_field"), F.explode(F.array(F.regexp_extract(F.lower("field"), "^(.+)_qc$", 1), F.regexp_extract(F.lower("field"), "^(.+)qc$", 1))).alias("__of")).where("__of <> ''")
    return fields.withColumn("__of", F.lower("field")).join(qc, ["dataset_id", "__of"]).select("dataset_id", "field", "qc_field").distinct()


def field_components(fields: DataFrame) -> DataFrame:
    """(component_id, dataset_id, field, role, confidence) of every column of every dataset."""
    role = field_role(F.col("field"))
    return fields.select(stable_id("component-", [F.col("dataset_id"), F.col("field")]).alias("component_id"), "dataset_id", "field", role["role"].alias("role"), role["confidence"].alias("confidence"))


#: What a component of an array, a cloud or a layer may say of its place; null where its table does not.
PLACE = {"crs": "string", "min_x": "double", "min_y": "double", "max_x": "double", "max_y": "double", "linkable": "boolean"}


def _placed(rows: DataFrame, kind: str, name: str, role: Column, confidence: Column) -> DataFrame:
    place = (F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in PLACE.items())
    key = stable_id("component-", [F.col("dataset_id"), F.lit(kind), F.col(name)])
    return rows.select(key.alias("component_id"), "dataset_id", F.col(name).alias("field"), role.alias("role"), confidence.alias("confidence"), F.lit(kind).alias("kind"), *place)


def array_components(arrays: DataFrame) -> DataFrame:
    """Arrays (dataset_id, array_path, axis_names; columns of PLACE if known) as components: spectral cubes with a spectral, an x and a y axis, rasters with the latter two, other arrays."""
    roles = F.transform("axis_names", axis_role)
    flat = F.array_contains(roles, "x") & F.array_contains(roles, "y")
    role = F.when(flat & F.array_contains(roles, "spectral"), "spectral_cube").when(flat, "raster").otherwise("array")
    return _placed(arrays, "array", "array_path", role, F.when(role == "array", "low").otherwise("high"))


def cloud_components(clouds: DataFrame) -> DataFrame:
    """Point clouds (dataset_id, path; columns of PLACE if known) as components."""
    return _placed(clouds, "points", "path", F.lit("points"), F.lit("high"))


def layer_components(layers: DataFrame) -> DataFrame:
    """Vector layers (dataset_id, layer; columns of PLACE if known) as components; without a CRS of medium confidence."""
    crs = F.col("crs") if "crs" in layers.columns else F.lit(None)
    return _placed(layers, "vector", "layer", F.lit("geometry"), F.when(crs.isNotNull(), "high").otherwise("medium"))


def variable_roles(variables: DataFrame) -> DataFrame:
    """Roles from attributes. variables (dataset_id, field, attrs)."""
    return variables.select("dataset_id", "field", cf_roles(F.col("field"), F.col("attrs")).alias("roles"))


def axis_components(arrays: DataFrame) -> DataFrame:
    """(dataset_id, array_path, axis, name, role, length); arrays (dataset_id, array_path, axis_names, shape)."""
    axes = arrays.select("dataset_id", "array_path", F.posexplode(F.arrays_zip("axis_names", "shape")).alias("axis", "a"))
    return axes.select("dataset_id", "array_path", "axis", F.col("a.axis_names").alias("name"), axis_role(F.col("a.axis_names")).alias("role"), F.col("a.shape").alias("length"))


def materialized_fields(variables: DataFrame, files: DataFrame) -> DataFrame:
    """Variables that the stored subset expression of their dataset names; expressions list variables up to the first &."""
    named = files.select("dataset_id", F.explode(F.split(F.regexp_extract("expression", "^[^&]*", 0), ",")).alias("field")).select("dataset_id", F.trim("field").alias("field"))
    return variables.join(named, ["dataset_id", "field"], "left_semi")


def coordinate_summary(coordinates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Finite count, minimum and maximum of listed coordinates. coordinates (keys, value)."""
    v = finite(F.col("value").cast("double"))
    return coordinates.groupBy(*keys).agg(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"))


def regular_summary(axes: DataFrame) -> DataFrame:
    """The same for regular axes (start, step, length)."""
    end = F.col("start") + F.col("step") * (F.col("length") - 1)
    return axes.withColumns({"count": F.col("length").cast("long"), "min": F.least("start", end), "max": F.greatest("start", end)})


# ---- datasets against each other


def _crs_key() -> Column:
    """Authority and code, else the WKT."""
    key = F.coalesce(F.concat_ws(":", F.lower("authority"), F.lower("code")), F.lit(""))
    return F.when(F.col("code").isNotNull() & F.col("authority").isNotNull(), key).otherwise(F.col("wkt"))


_EDGES = ("min_x", "min_y", "max_x", "max_y")


def _registered(df: DataFrame, name: str, prefix: str) -> DataFrame:
    return df.select(F.col("dataset_id").alias(name), _crs_key().alias("__crs"), *(F.col(c).cast("double").alias(f"{prefix}_{c}") for c in _EDGES))


def register_point_cube(points: DataFrame, cubes: DataFrame) -> DataFrame:
    """points and cubes (dataset_id, authority, code, wkt, min_x, min_y, max_x, max_y): (point_id, cube_id, status, reason).

    Pairs of equal CRS (authority and code, else WKT) are joined by that key;
    pairs whose boxes do not overlap strictly stay as ``unavailable``. Datasets
    without a partner stay with the reason ``no_common_crs``. The result has a row
    for every pair of a CRS; point_cube_links() counts those that do not overlap.
    """
    pairs = _registered(points, "point_id", "p").join(_registered(cubes, "cube_id", "c"), "__crs", "left")
    overlap = (F.col("p_min_x") < F.col("c_max_x")) & (F.col("c_min_x") < F.col("p_max_x")) & (F.col("p_min_y") < F.col("c_max_y")) & (F.col("c_min_y") < F.col("p_max_y"))
    reason = F.when(F.col("cube_id").isNull(), "no_common_crs").when(~F.coalesce(overlap, F.lit(False)), "no_overlap")
    return pairs.select("point_id", "cube_id", F.when(reason.isNull(), "available").otherwise("unavailable").alias("status"), reason.alias("reason"))


def point_cube_links(points: DataFrame, cubes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """register_point_cube() for many datasets of one CRS: (pairs that are available, a row for each point_id with the numbers of others).

    Pairs (point_id, cube_id) are found by CRS and quadtree cells, so those that lie apart are never made. The second table holds point_id,
    available, unavailable (pairs of equal CRS without strict overlap; boxes with a null, or turned around, overlap nothing) and the reason why a point_id
    has no link: ``no_common_crs`` or ``no_overlap``. Repeated rows count as often as they are there.
    """
    p, c = _registered(points, "point_id", "p"), _registered(cubes, "cube_id", "c")
    names = [tuple(f"{side}_{e}" for e in _EDGES) for side in "pc"]
    known = [df.where("__crs is not null") for df in (p, c)]
    pairs = box_join(*known, *names, on=["__crs"], strict=True).select("point_id", "cube_id")
    partners = known[1].groupBy("__crs").agg(F.count(F.lit(1)).alias("n"))  # a row for each CRS
    possible = p.join(partners, "__crs", "left").groupBy("point_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("possible"))
    linked = pairs.groupBy("point_id").agg(F.count(F.lit(1)).alias("available"))
    same = possible["point_id"].eqNullSafe(linked["point_id"])
    found = possible.join(linked, same, "left").select(possible["point_id"], "possible", F.coalesce("available", F.lit(0)).alias("available"))
    reason = F.when(F.col("possible") == 0, "no_common_crs").when(F.col("available") == 0, "no_overlap")
    return pairs, found.select("point_id", "available", (F.col("possible") - F.col("available")).alias("unavailable"), reason.alias("reason"))


# ---- plans and objects


def dedup_plan_files(files: DataFrame) -> DataFrame:
    """One row per download URL over the whole plan; of equal ones the first name."""
    columns = files.columns
    return files.groupBy("download_url").agg(F.min_by(F.struct(*columns), "name").alias("f")).select(*(F.col("f")[c].alias(c) for c in columns))


def plan_totals(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number of files and sum of known sizes; the sum is null without files."""
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.when(F.count(F.lit(1)) > 0, F.coalesce(F.sum("size"), F.lit(0))).alias("bytes"))


def plan_hash(files: DataFrame) -> DataFrame:
    """(plan_id, plan_hash): SHA-256 over the plan's files, without times of approval and whatever their order.

    Files' digests are sorted and hashed within the 256 ranges of their first two
    digits, then the ranges' digests, so that no task holds a whole plan.
    """
    rows = files.select("plan_id", F.sha2(F.to_json(F.struct("download_url", "name", "size", "md5")), 256).alias("d"))
    together = lambda d: F.sha2(F.concat_ws("\n", d), 256)
    ranges = rows.groupBy("plan_id", F.substring("d", 1, 2).alias("r")).agg(together(F.array_sort(F.collect_list("d"))).alias("d"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("r", "d"))), lambda x: x["d"])
    return ranges.groupBy("plan_id").agg(together(whole).alias("plan_hash"))


def content_dedup(objects: DataFrame, digest: str = "digest", order: str = "path") -> DataFrame:
    """Objects of equal digest once: the first in order."""
    columns = objects.columns
    return objects.groupBy(digest).agg(F.min_by(F.struct(*columns), order).alias("o")).select(*(F.col("o")[c].alias(c) for c in columns))


#: Bytes of a lane; the lanes of all objects of a batch are worked on together.
LANE = 256


def _steps(c: np.ndarray, data: np.ndarray | None = None, n: int = LANE) -> np.ndarray:
    """The registers after one byte of each column of data, or after n zero bytes."""
    for k in range(n if data is None else data.shape[1]):
        c = _castagnoli()[(c ^ data[:, k] if data is not None else c) & 255] ^ c >> np.uint32(8)
    return c


@lru_cache
def _castagnoli() -> np.ndarray:
    """The byte table of the Castagnoli polynomial, reflected."""
    n = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        n = n >> np.uint32(1) ^ np.where(n & 1, np.uint32(0x82F63B78), np.uint32(0))
    return n


@lru_cache
def _over_a_lane() -> list[list[int]]:
    """What each byte of a register becomes when a lane of zeros follows."""
    return [_steps(np.arange(256, dtype=np.uint32) << np.uint32(8 * k)).tolist() for k in range(4)]


def crc32c(objects: list[bytes]) -> list[int]:
    """CRC-32C of each. The register is linear: with the first four bytes inverted it can begin at zero, zeros before
    an object change nothing, and lanes are put together by what a lane of zeros does to a register."""
    out, long = [0] * len(objects), [i for i, b in enumerate(objects) if len(b) >= 4]
    for i, b in enumerate(objects):
        if len(b) < 4:
            out[i] = int(_steps(np.array([0xFFFFFFFF], np.uint32), np.frombuffer(b, np.uint8).reshape(1, -1))[0]) ^ 0xFFFFFFFF
    many = [-(-len(objects[i]) // LANE) for i in long]
    raw = b"".join(bytes(-len(objects[i]) % LANE) + bytes(x ^ 255 for x in objects[i][:4]) + objects[i][4:] for i in long)
    lanes = _steps(np.zeros(sum(many), np.uint32), np.frombuffer(raw, np.uint8).reshape(-1, LANE)).tolist() if long else []
    a, b, c, d = _over_a_lane()
    at = 0
    for i, n in zip(long, many, strict=True):
        r = 0
        for lane in lanes[at : at + n]:
            r = a[r & 255] ^ b[r >> 8 & 255] ^ c[r >> 16 & 255] ^ d[r >> 24] ^ lane
        out[i] = r ^ 0xFFFFFFFF
        at += n
    return out


def with_crc32c(objects: DataFrame, content: str = "content") -> DataFrame:
    @F.pandas_udf("long")
    def digest(s: pd.Series) -> pd.Series:
        sums = crc32c([bytes(b) if b is not None else b"" for b in s])
        return pd.Series([None if b is None else n for b, n in zip(s, sums, strict=True)], dtype="Int64")

    return objects.withColumn("crc32c", digest(content))


#: x^8 modulo the polynomial, of reflected registers (where x^0 is the highest bit): one zero byte.
_ONE_BYTE = 1 << 23


def _times(a: int, b: int) -> int:
    """Product of two reflected registers modulo the Castagnoli polynomial."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0x82F63B78 if b & 1 else 0)
    return out


@lru_cache
def _zero_bytes(n: int) -> int:
    """x^(8 n): what n zero bytes multiply a register by."""
    out, square = 1 << 31, _ONE_BYTE
    while n:
        if n & 1:
            out = _times(out, square)
        square = _times(square, square)
        n >>= 1
    return out


def crc32c_shift(crc: int, after: int) -> int:
    """What a part's CRC-32C adds to the sum of a whole in which ``after`` bytes follow the part; sums of all parts are put together by exclusive or."""
    return _times(_zero_bytes(after), crc)


def crc32c_of_ranges(ranges: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """keys, size and crc32c of objects given in ranges (keys, size of the whole, offset, content), in any order and any tasks.

    Each task shifts the sum of its range by the bytes behind it; sums meet as one number a task. ``crc32c`` is null where the ranges do
    not add up to the size: one is missing, repeated or null. Ranges of no bytes count for nothing."""

    @F.pandas_udf("long")
    def part(content: pd.Series, after: pd.Series) -> pd.Series:
        raw = [bytes(b) if b is not None else b"" for b in content]
        return pd.Series([crc32c_shift(c, int(n)) if b and n >= 0 else 0 for b, c, n in zip(raw, crc32c(raw), after.fillna(-1), strict=True)])

    length = F.octet_length("content").cast("long")
    after = F.col("size") - F.col("offset") - length
    rows = ranges.select(*keys, "size", "offset", length.alias("__length"), part("content", after).alias("__crc"))
    # bytes and their places add up: no range is there twice in place of another
    held = rows.groupBy(*keys, "size").agg(
        F.bit_xor("__crc").alias("__crc"), F.sum("__length").alias("__bytes"), F.sum(F.col("__length").cast("decimal(38,0)") * (2 * F.col("offset") + F.col("__length"))).alias("__places"), F.count_if(F.col("__length").isNull()).alias("__nulls"),
    )
    whole = (F.col("__bytes") == F.col("size")) & (F.col("__places") == F.col("size").cast("decimal(38,0)") * F.col("size")) & (F.col("__nulls") == 0)
    return held.select(*keys, "size", F.when(whole, F.col("__crc")).alias("crc32c"))


def verify_checksums(objects: DataFrame, expected: DataFrame) -> DataFrame:
    """objects (path, size, md5, crc32c long), expected (path, size, algorithm, checksum text): (path, status ok, mismatch, unsupported or missing).

    CRC-32C may be given in hexadecimal, decimal or base 64."""
    e = expected.select("path", F.col("size").alias("__size"), F.lower("algorithm").alias("__algorithm"), F.trim("checksum").alias("__sum"))
    rows = e.join(objects, "path", "left")
    bytes4 = F.lpad(F.lower(F.hex(F.col("crc32c"))), 8, "0")
    crc = (F.lower("__sum") == bytes4) | (F.col("__sum") == F.col("crc32c").cast("string")) | (F.col("__sum") == F.base64(F.unhex(bytes4)))
    right = F.when(F.col("__algorithm") == "md5", F.lower("__sum") == F.col("md5")).when(F.col("__algorithm") == "crc32c", crc)
    size = F.col("__size").isNull() | (F.col("__size") == F.col("size"))
    status = F.when(F.col("size").isNull(), "missing").when(~size, "mismatch").when(right.isNull(), F.when(F.col("__algorithm").isNull(), "ok").otherwise("unsupported")).when(right, "ok").otherwise("mismatch")
    return rows.select("path", status.alias("status"))


def fingerprint_files(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """files (path, content): SHA-256 of each; with keys, one digest of each set, whatever the order of its files.

    A set's digest is a tree: files' lines (path:digest) are sorted and hashed within the 65,536 buckets of the first four digits of their
    path's SHA-256, buckets within the 256 groups of the first two, groups and the number of files at the root. So a set of any size is hashed in many tasks.
    """
    each = files.select(*keys, "path", F.sha2("content", 256).alias("digest"))
    if not keys:
        return each
    together = lambda lines: F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(lines))), 256).alias("digest")
    files_in = F.sum("__files").alias("__files")
    bucket = F.substring(F.sha2(F.col("path").cast("string"), 256), 1, 4)
    buckets = each.groupBy(*keys, bucket.alias("__bucket")).agg(together(F.concat_ws(":", "path", "digest")), F.count(F.lit(1)).alias("__files"))
    groups = buckets.groupBy(*keys, F.substring("__bucket", 1, 2).alias("__group")).agg(together(F.concat_ws(":", "__bucket", "digest")), files_in)
    roots = groups.groupBy(*keys).agg(together(F.concat_ws(":", "__group", "digest")), files_in)
    return roots.select(*keys, F.sha2(F.concat_ws("\n", F.col("__files").cast("string"), "digest"), 256).alias("digest"), F.lit("sha256").alias("algorithm"))


# ---- provider documents


def flatten_products(products: DataFrame, body: str = "json") -> DataFrame:
    """Product documents -> (product_code, name, description, modalities, sites, first_month, last_month)."""
    schema = "productCode string, productName string, productDescription string, siteCodes array<struct<siteCode:string,availableMonths:array<string>>>"
    p = products.select(F.from_json(body, schema).alias("p")).select("p.*")
    return site_availability(p.select(F.col("productCode").alias("product_code"), F.col("productName").alias("name"), F.col("productDescription").alias("description"), F.col("siteCodes").alias("sites"))).withColumn(
        "modalities", modality_from_text(F.concat_ws(" ", "name", "description"))
    )


def site_availability(products: DataFrame) -> DataFrame:
    """Distinct sorted sites, and first and last of all months; sites: array<struct<siteCode, availableMonths>>."""
    months = F.array_compact(F.flatten(F.transform(F.coalesce("sites", F.array().cast("array<struct<siteCode:string,availableMonths:array<string>>>")), lambda s: F.coalesce(s["availableMonths"], F.array().cast("array<string>")))))
    codes = F.array_sort(F.array_distinct(F.array_compact(F.transform("sites", lambda s: s["siteCode"]))))
    return products.withColumns({"first_month": F.array_min(months), "last_month": F.array_max(months), "sites": codes})


def flatten_plan_files(trees: DataFrame, body: str = "json") -> DataFrame:
    """Nested site / month / file documents -> one row per file, with the site and month it inherits."""
    schema = "data struct<sites:array<struct<siteCode:string,month:string,files:array<struct<name:string,size:bigint,md5:string,url:string,siteCode:string,month:string>>>>>"
    sites = trees.select(F.explode(F.from_json(body, schema)["data"]["sites"]).alias("s"))
    files = sites.select("s.siteCode", "s.month", F.explode("s.files").alias("f"))
    return files.select(F.coalesce("f.siteCode", "siteCode").alias("site"), F.coalesce("f.month", "month").alias("month"), "f.name", "f.size", "f.md5", F.col("f.url").alias("download_url"))


def parse_table_envelope(tables: DataFrame, body: str = "json") -> DataFrame:
    """``{table: {columnNames, rows}}`` -> one map of column name -> text per row; a row of another width is an error."""
    schema = "table struct<columnNames:array<string>,rows:array<array<string>>>"
    rows = tables.select(F.from_json(body, schema)["table"].alias("t")).select("t.columnNames", F.posexplode("t.rows").alias("row", "cells"))
    wide = F.when(F.size("cells") == F.size("columnNames"), F.map_from_arrays("columnNames", "cells")).otherwise(F.raise_error(F.lit("a row's width differs from the columns'")).cast("map<string,string>"))
    return rows.select("row", wide.alias("values"))


def attribute_pivot(info: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows (row_type, variable, attribute, data_type, value) -> (keys, variable, data_type, attrs map); the variable NC_GLOBAL holds the globals."""
    attrs = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("row_type") == "attribute", F.struct("attribute", "value")))))
    return info.groupBy(*keys, "variable").agg(F.max(F.when(F.col("row_type") == "variable", F.col("data_type"))).alias("data_type"), attrs.alias("attrs"))


def resolve_resource(search: DataFrame, info: DataFrame) -> DataFrame:
    """search (dataset_id, title, ...) with pivoted info: modalities, coverage polygon, time range, globals and variables."""
    pivoted = attribute_pivot(info, ["dataset_id"])
    g = pivoted.where("variable = 'NC_GLOBAL'").select("dataset_id", F.col("attrs").alias("globals"))
    names = pivoted.where("variable <> 'NC_GLOBAL'").groupBy("dataset_id").agg(F.array_sort(F.collect_list(F.struct("variable", "data_type"))).alias("variables"))
    a = lambda k: F.try_element_at("globals", F.lit(k))
    n = lambda k: try_double(a(k))
    rows = search.join(g, "dataset_id", "left").join(names, "dataset_id", "left")
    return rows.withColumns({
        "modalities": modality_from_cdm(F.coalesce(a("cdm_data_type"), F.lit(""))),
        "coverage": coverage_polygon(n("geospatial_lon_min"), n("geospatial_lon_max"), n("geospatial_lat_min"), n("geospatial_lat_max")),
        "start": a("time_coverage_start"), "end": a("time_coverage_end"),
    })


def profile_roles(variables: DataFrame) -> DataFrame:
    """(dataset_id, role, field): one variable for each role, adjusted ones last, then by name. variables (dataset_id, field, attrs)."""
    roles = variables.select("dataset_id", "field", F.explode(cf_roles(F.col("field"), F.col("attrs"))).alias("role"))
    return roles.groupBy("dataset_id", "role").agg(F.min_by("field", F.struct(F.lower("field").contains("adjusted"), "field")).alias("field"))


# ---- catalogue search


def catalog_search(resources: DataFrame, text: str | None = None, modalities: Sequence[str] = (), sites: Sequence[str] = (), start_month: str | None = None, end_month: str | None = None, limit: int = 100) -> DataFrame:
    """resources (id, name, description, modalities, sites, first_month, last_month): text in any of these ignoring case, any of the
    modalities, all of the sites, months that overlap; by id, at most 100."""
    out = resources
    if text:
        every = F.lower(F.concat_ws("\n", "id", "name", "description", F.array_join("modalities", "\n")))
        out = out.where(F.contains(every, F.lit(text.lower())))
    if modalities:
        out = out.where(F.arrays_overlap("modalities", F.array(*map(F.lit, modalities))))
    for s in sites:
        out = out.where(F.array_contains("sites", s))
    if start_month:
        out = out.where(F.col("last_month") >= start_month)
    if end_month:
        out = out.where(F.col("first_month") <= end_month)
    return out.orderBy("id").limit(max(1, min(limit, 100)))


def search_resources(resources: DataFrame, kinds: Sequence[str], modalities: Sequence[str] = (), limit: int = 100) -> DataFrame:
    """Collections, with any of the modalities; nothing unless ``collection`` is among the kinds asked for."""
    out = resources.where(F.lit(not kinds or "collection" in kinds))
    out = out.where(F.arrays_overlap("modalities", F.array(*map(F.lit, modalities)))) if modalities else out
    return out.orderBy("id").limit(max(1, min(limit, 100)))


def combine_crs(files: DataFrame) -> DataFrame:
    """(dataset_id, crs, warning): the one CRS of a dataset's files, or none and a warning when they differ."""
    found = files.groupBy("dataset_id").agg(F.array_sort(F.collect_set("crs")).alias("all"))
    return found.select("dataset_id", F.when(F.size("all") == 1, F.col("all")[0]).alias("crs"), F.when(F.size("all") > 1, F.concat(F.lit("files differ in CRS: "), F.array_join("all", ", "))).alias("warning"))


def merge_file_metadata(files: DataFrame) -> DataFrame:
    """files (dataset_id, modalities, cubes, crs, warnings): their unions for each dataset; ``unknown`` goes."""
    merged = files.groupBy("dataset_id").agg(
        F.array_remove(F.array_sort(F.array_distinct(F.flatten(F.collect_list("modalities")))), "unknown").alias("modalities"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("cubes")))).alias("cubes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("warnings"),
    )
    crs = combine_crs(files)
    return merged.join(crs, "dataset_id").select("dataset_id", "modalities", "cubes", "crs", F.array_compact(F.concat("warnings", F.array("warning"))).alias("warnings"))


def table_fields(df: DataFrame) -> tuple[Column, Column]:
    """fields (name, type, role), and time_series: whether a name suggests one."""
    names = [c.lower() for c in df.columns]
    fields = F.array(*(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), field_role(F.lit(f.name))["role"].alias("role")) for f in df.schema))
    return fields.alias("fields"), F.lit(any("time" in n or "date" in n for n in names)).alias("time_series")


def inspect_table(df: DataFrame) -> DataFrame:
    """One row: number of rows, fields with types, and whether a name suggests a time series. For Parquet files see sources.files.inspect_parquet()."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", *table_fields(df))


# ---- inventory and suggestions


def union_components(*parts: DataFrame, cap: int | None = None, each: int | None = MAX_COMPONENTS) -> DataFrame:
    """Components of several extractors: each once, the first ``each`` by id of every dataset; ``truncated`` where a dataset has more. All without ``each``; with ``cap`` only so many of all, by id."""
    if not parts:
        raise SpecError("no components")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.dropDuplicates(["component_id"])
    if each is None:
        out = out.withColumn("truncated", F.lit(False))
    else:
        # one more than stays, to see whether there are more
        place = F.row_number().over(Window.partitionBy("dataset_id").orderBy("component_id"))
        out = out.withColumn("__place", place).where(F.col("__place") <= each + 1)
        out = out.withColumn("truncated", F.max("__place").over(Window.partitionBy("dataset_id")) > each).where(F.col("__place") <= each).drop("__place")
    return out if cap is None else out.orderBy("component_id").limit(cap)


def scientific_inventory(fields: DataFrame, cap: int | None = None, each: int | None = MAX_COMPONENTS, *, others: Sequence[DataFrame] = ()) -> DataFrame:
    """Field components of every dataset with their QC fields, and whether a person must decide (a value of low confidence without one).

    ``others``: results of array_components, cloud_components and layer_components. For the limits see union_components."""
    parts = union_components(field_components(fields).withColumn("kind", F.lit("field")), *others, cap=cap, each=each)
    links = qc_links(fields).groupBy("dataset_id", "field").agg(F.min("qc_field").alias("qc_field")).withColumn("kind", F.lit("field"))
    joined = parts.join(links, ["dataset_id", "field", "kind"], "left")
    return joined.withColumn("unresolved", (F.col("role") == "value") & F.col("qc_field").isNull())


#: What each confidence counts in a ranking.
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}


def rank_suggestions(suggestions: DataFrame, k: int = MAX_SUGGESTIONS, group: str | None = None) -> DataFrame:
    """By confidence and panels descending, exact links before others, then id: the first k, of every group if there is a column of groups."""
    order = F.lit(0)
    for name, n in CONFIDENCE.items():
        order = F.when(F.col("confidence") == name, n).otherwise(order)
    linked = [F.desc(F.coalesce(F.col("link") == "exact", F.lit(False)))] if "link" in suggestions.columns else []
    ranked = [F.desc(order), F.desc("panels"), *linked, F.asc("suggestion_id")]
    if group is None:
        return suggestions.orderBy(*ranked).limit(k)
    return suggestions.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*ranked))).where(F.col("__rank") <= k).drop("__rank")


def _recipe(kind: str, panels: int, confidence: Column | str) -> Column:
    confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
    return F.struct(F.lit(kind).alias("kind"), F.lit(panels).alias("panels"), confidence.alias("confidence"))


def suggest_views(inventory: DataFrame, k: int = MAX_SUGGESTIONS, group: str | None = None) -> DataFrame:
    """View suggestions: profiles, maps, time series and tables of datasets by the roles of their fields; a point cloud, a composite with
    spectrum, a raster or a vector map of each component of that role; and every cloud beside cubes of other datasets.

    The first k of the ranking, for every asked group of datasets if there is a column of groups. ``component_id`` is the component's, of pairs the cloud's.
    Pairs are made within a group and have ``other_id`` and ``other_component`` (the cube's), ``link`` (exact if the CRS is the same and known, the cube is
    linkable and the boxes overlap strictly, else unavailable) and ``reason``, why a link is unavailable. ``unresolved`` is true where a person must decide:
    about a value without quality flags, or a link that is not verified. All exact pairs are ranked; of the unavailable ones those of 2 k clouds
    and 2 k cubes of a group, taken from its datasets in turn."""
    keys = ["dataset_id"] if group is None else [group, "dataset_id"]
    has = lambda r: F.array_contains("roles", r)
    placed = "crs" in inventory.columns
    field = F.col("kind") == "field" if "kind" in inventory.columns else F.lit(True)
    per = inventory.groupBy(*keys).agg(
        F.collect_set("role").alias("roles"), F.count_if(F.col("role") == "value").alias("values"), F.count("qc_field").alias("qc"), F.count_if(field).alias("fields"),
        F.count_if(field & (F.col("role") == "value") & F.col("qc_field").isNull()).alias("undecided"),
    )
    whole = F.explode(F.array_compact(F.array(
        F.when(has("vertical") & (F.col("values") > 0), _recipe("profile", 2, F.when(F.col("qc") > 0, "high").otherwise("medium"))),
        F.when(has("latitude") & has("longitude"), _recipe("map", 1, "high")),
        F.when(has("time") & (F.col("values") > 0), _recipe("time_series", 1, "medium")),
        F.when(F.col("fields") > 0, _recipe("table", 1, "low")),
    ))).alias("r")
    made = per.select(*keys, (F.col("undecided") > 0).alias("unresolved"), whole).select(*keys, "unresolved", "r.*")
    made = made.withColumn("suggestion_id", stable_id("view-", [F.col("dataset_id"), F.col("kind")]))
    crs = F.when(F.col("crs").isNotNull(), "high").otherwise("medium") if placed else "medium"
    role = F.col("role")
    of_one = F.when(role == "points", _recipe("point_cloud", 1, "high")).when(role == "spectral_cube", _recipe("composite_and_spectrum", 2, "high"))
    of_one = of_one.when(role == "raster", _recipe("raster", 1, "high")).when(role == "geometry", _recipe("vector_map", 1, crs))
    each = inventory.select(*keys, "component_id", of_one.alias("r")).where("r is not null").select(*keys, "component_id", "r.*").withColumn("unresolved", F.lit(False))
    each = each.withColumn("suggestion_id", stable_id("view-", [F.col("dataset_id"), F.col("kind"), F.col("component_id")]))
    made = made.unionByName(each, allowMissingColumns=True)
    if placed:
        made = made.unionByName(_cloud_and_cube(inventory, k, group), allowMissingColumns=True)
    return rank_suggestions(made, k, group)


def _cloud_and_cube(inventory: DataFrame, k: int, group: str | None) -> DataFrame:
    """Clouds beside cubes of other datasets in each group: exact pairs by CRS and quadtree cells, and as many unavailable ones as a ranking may need."""
    key = group or "__all"
    rows = inventory if group else inventory.withColumn(key, F.lit(0))
    box = ("min_x", "min_y", "max_x", "max_y")
    names = {"points": {"dataset_id": "dataset_id", "component_id": "component_id"}, "spectral_cube": {"dataset_id": "other_id", "component_id": "other_component"}}

    def side(role: str) -> DataFrame:
        return rows.where(F.col("role") == role).select(key, *(F.col(c).alias(names[role].get(c, f"{role}_{c}")) for c in ("dataset_id", "component_id", *PLACE)))

    clouds, cubes = side("points"), side("spectral_cube")
    boxes = (tuple(f"{role}_{c}" for c in box) for role in names)
    alike = clouds.withColumn("__crs", F.col("points_crs")), cubes.where("spectral_cube_linkable").withColumn("__crs", F.col("spectral_cube_crs"))
    exact = box_join(*(df.where("__crs is not null") for df in alike), *boxes, on=[key, "__crs"], strict=True).drop("__crs").where("dataset_id <> other_id")
    exact = exact.withColumns({"link": F.lit("exact"), "reason": F.lit(None).cast("string")})

    def some(df: DataFrame, dataset: str, component: str) -> DataFrame:
        """The first 2 k of each group, taken from its datasets in turn."""
        turn = df.withColumn("__turn", F.row_number().over(Window.partitionBy(key, dataset).orderBy(component))).where(F.col("__turn") <= 2 * k)
        return turn.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy("__turn", dataset, component))).where(F.col("__place") <= 2 * k).drop("__turn", "__place")

    pairs = some(clouds, "dataset_id", "component_id").join(some(cubes, "other_id", "other_component"), key).where("dataset_id <> other_id")
    apart = " OR ".join(f"points_min_{a} >= spectral_cube_max_{a} OR spectral_cube_min_{a} >= points_max_{a}" for a in "xy")
    reason = F.expr(f"CASE WHEN NOT coalesce(points_crs = spectral_cube_crs, false) THEN 'no_common_crs' WHEN NOT coalesce(spectral_cube_linkable, false) THEN 'no_transform' WHEN coalesce({apart}, true) THEN 'no_overlap' END")
    others = pairs.withColumns({"link": F.lit("unavailable"), "reason": reason}).where("reason is not null")
    return exact.unionByName(others.select(exact.columns)).select(
        *([group] if group else []), "dataset_id", "component_id", "other_id", "other_component", F.lit("cloud_and_cube").alias("kind"), F.lit(3).alias("panels"), F.lit("high").alias("confidence"),
        stable_id("view-", [F.col(c) for c in ("dataset_id", "other_id", "component_id", "other_component")]).alias("suggestion_id"), "link", "reason", (F.col("link") != "exact").alias("unresolved"),
    )


def validate_georef(cubes: DataFrame) -> DataFrame:
    """cubes (array_path, rows, cols, affine a-f, extent min_x..max_y): ``linkable`` if the bounds agree within a hundredth of a pixel."""
    right, bottom = F.col("a") + F.col("b") * F.col("cols"), F.col("d") + F.col("f") * F.col("rows")
    off = F.greatest(F.abs(F.col("a") - F.col("min_x")), F.abs(right - F.col("max_x")), F.abs(F.col("d") - F.col("max_y")), F.abs(bottom - F.col("min_y")))
    ok = off <= F.least(F.abs("b"), F.abs("f")) * 0.01
    return cubes.withColumns({"linkable": ok, "warning": F.when(~ok, "extent and transform disagree")})


def rgb_band_suggestion(cubes: DataFrame, keys: Sequence[str] = ("array_path",)) -> DataFrame:
    """(keys, rgb): the bands nearest to 650, 550 and 450 nm."""
    from .arrays import nearest_band

    bands = nearest_band(cubes, [650.0, 550.0, 450.0], keys)
    return bands.groupBy(*keys).agg(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("target", "band")))), lambda s: s["band"]).alias("rgb"))
