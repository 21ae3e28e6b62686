"""Row-level functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import Affine


def try_double(c: Column) -> Column:
    return c.try_cast("double")


def finite(c: Column) -> Column:
    """The number, or null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def finite_value(c: Column, fills: Sequence[str] = ()) -> Column:
    """Text trimmed; blank, fill, unparsable or non-finite is null. Numeric fills are compared as numbers."""
    text = F.trim(c.cast("string"))
    number = finite(try_double(text))
    textual = [f.strip() for f in fills]
    numeric = [float(f) for f in textual if _is_number(f)]
    bad = text.isin(*textual) if textual else F.lit(False)
    if numeric:
        bad = bad | F.coalesce(number.isin(*numeric), F.lit(False))
    return F.when(~bad, number)


def _is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")


def decode_sample(raw: Column, scale: float = 1.0, offset: float = 0.0, no_data: float | None = None, divisor: bool = False) -> Column:
    """raw * scale + offset; null where the raw value is the no-data value. A divisor-style factor is inverted."""
    factor = 1.0 / scale if divisor else scale
    value = raw.cast("double") * F.lit(factor) + F.lit(offset)
    return value if no_data is None else F.when(raw.cast("double") != F.lit(float(no_data)), value)


def stretch_u8(v: Column, low: Column, high: Column) -> Column:
    """Clamped to [low, high], scaled to 0..255, halves away from zero; null and NaN give 0."""
    share = (F.least(F.greatest(v, low), high) - low) / (high - low)
    return F.when(finite(v).isNotNull(), F.round(share * 255).cast("int")).otherwise(0)


def pixel_to_world(column: Column, row: Column, t: Affine) -> tuple[Column, Column]:
    """Coordinates of a pixel's centre."""
    x, y = column + 0.5, row + 0.5
    return t.a + t.b * x + t.c * y, t.d + t.e * x + t.f * y


def world_to_pixel(x: Column, y: Column, t: Affine) -> tuple[Column, Column]:
    """(column, row) that holds a point, for a north-up transform."""
    if not t.north_up:
        raise ValueError("the transform is rotated or not north-up")
    return F.floor((x - t.a) / t.b).cast("long"), F.floor((y - t.d) / t.f).cast("long")


def parse_map_info(c: Column) -> Column:
    """ENVI map info text (``UTM, reference column and row from 1, easting, northing, x and y size, ...``) -> struct of the
    six affine terms; null for other projections, with rotation, or with sizes that are not positive."""
    parts = F.transform(F.split(c, ","), lambda x: F.trim(x))
    at = lambda i: finite(try_double(F.try_element_at(parts, F.lit(i + 1))))
    turned = F.exists(F.slice(parts, 8, 100), lambda x: F.coalesce(F.abs(try_double(F.regexp_extract(x, r"^[Rr]otation=\s*(\S+)$", 1))) > 0, F.lit(False)))
    ok = (F.size(parts) >= 7) & (F.upper(parts[0]) == "UTM") & ~turned & (at(5) > 0) & (at(6) > 0)
    for i in (1, 2, 3, 4):
        ok = ok & at(i).isNotNull()
    left, top, zero = at(3) - (at(1) - 1) * at(5), at(4) + (at(2) - 1) * at(6), F.lit(0.0)
    return F.when(ok, F.struct(left.alias("a"), at(5).alias("b"), zero.alias("c"), top.alias("d"), zero.alias("e"), (-at(6)).alias("f")))


def epsg_from_wkt(c: Column) -> Column:
    """The last EPSG number of a WKT text."""
    found = F.regexp_extract_all(c, F.lit(r'(?i)EPSG"?\s*,\s*"?(\d+)'), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("int")


def unravel(index: Column, shape: Sequence[int]) -> list[Column]:
    """C row-major position -> index along each axis."""
    out, after = [], 1
    for n in reversed(shape):
        out.append((F.floor(index / after) % n).cast("long"))
        after *= n
    return out[::-1]


def ravel(indices: Sequence[Column], shape: Sequence[int]) -> Column:
    return reduce(lambda acc, x: acc * x[1] + x[0], zip(indices, shape, strict=True), F.lit(0).cast("long"))


#: Names, endings and parts of a lowered field name that suggest a role, in the order they are tried.
ROLE_RULES = [
    ("time", "medium", ("time", "timestamp", "datetime", "date"), ("_time",), ()),
    ("latitude", "medium", ("lat", "latitude"), (), ()),
    ("longitude", "medium", ("lon", "lng", "longitude"), (), ()),
    ("vertical", "medium", ("depth", "pressure", "pres", "height", "elevation", "altitude"), (), ()),
    ("quality_control", "medium", ("qc",), ("_qc",), ("quality_control",)),
    ("uncertainty", "low", (), ("_error", "_std"), ("uncert",)),
    ("identifier", "low", (), ("_id",), ("identifier", "site", "station", "platform", "profile", "cycle")),
]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def field_role(name: Column) -> Column:
    """struct(role, confidence): the first rule that fits; a value otherwise. Names are compared without signs at both ends."""
    low = F.lower(name)
    bare = F.regexp_replace(low, "^[^a-z0-9]+|[^a-z0-9]+$", "")
    out = F.struct(F.lit("value").alias("role"), F.lit("low").alias("confidence"))
    for role, confidence, names, endings, parts in reversed(ROLE_RULES):
        fits = _any([bare == n for n in names] + [low.endswith(e) for e in endings] + [low.contains(x) for x in parts])
        out = F.when(fits, F.struct(F.lit(role).alias("role"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def cf_roles(name: Column, attrs: Column) -> Column:
    """All roles that CF attributes (a map of texts) tell; without any, the role of the name."""
    attr = lambda k: F.lower(F.coalesce(F.try_element_at(attrs, F.lit(k)), F.lit("")))
    standard, axis, coordinate, kind = attr("standard_name"), attr("axis"), attr("_CoordinateAxisType"), attr("variable_type")
    told = {
        "time": (standard == "time") | (axis == "t") | (coordinate == "time"),
        "latitude": (standard == "latitude") | (coordinate == "lat"),
        "longitude": (standard == "longitude") | (coordinate == "lon"),
        "vertical": (standard == "depth") | standard.contains("pressure") | (axis == "z") | (coordinate == "height"),
        "quality_control": (kind == "quality_control") | F.lower(name).endswith("_qc"),
        "identifier": F.map_contains_key(attrs, "cf_role"),
    }
    told = {role: F.coalesce(c, F.lit(False)) for role, c in told.items()}
    measured = (kind == "environmental") | ((standard != "") & ~_any(list(told.values())))
    found = F.array_compact(F.array(*(F.when(c, F.lit(role)) for role, c in told.items()), F.when(measured, F.lit("value"))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(field_role(name)["role"]))


#: Names and parts of lowered axis names, in the order they are tried.
AXIS_RULES = [
    ("x", ("x", "lon", "longitude", "easting"), ()), ("y", ("y", "lat", "latitude", "northing"), ()), ("z", ("z",), ("height", "elevation", "depth")),
    ("time", (), ("time", "date")), ("spectral", ("band",), ("wave", "spectral")), ("channel", (), ("channel",)),
]


def axis_role(name: Column) -> Column:
    low, out = F.lower(name), F.lit("other")
    for role, names, parts in reversed(AXIS_RULES):
        out = F.when(_any([low == n for n in names] + [low.contains(x) for x in parts]), role).otherwise(out)
    return out


#: What keywords, file endings and feature types say about modalities, and the order of viewing.
MODALITY_WORDS = [
    (("hyperspectral", "spectrometer"), ("hyperspectral", "raster")), (("lidar", "point cloud"), ("point_cloud",)),
    (("geotiff", "raster", "elevation"), ("raster",)), (("time series", "sensor", "temperature"), ("tabular", "time_series")),
]
MODALITY_ENDINGS = {
    ("csv", "tsv", "parquet", "geoparquet", "arrow", "ipc"): ("tabular",), ("tif", "tiff", "cog"): ("raster",), ("h5", "hdf5", "nc", "nc4", "zarr"): ("hyperspectral", "tensor"),
    ("las", "laz", "copc", "ply"): ("point_cloud",), ("geojson", "json", "fgb", "gpkg", "shp"): ("vector",), ("png", "jpg", "jpeg", "webp"): ("image",),
}
MODALITY_CDM = {
    ("grid",): ("raster", "tensor"), ("trajectory", "profile", "trajectoryprofile", "timeseriesprofile"): ("vector", "time_series", "tabular"),
    ("timeseries",): ("time_series", "tabular"), ("point",): ("vector", "tabular"),
}
MODALITY_ORDER = ["point_cloud", "hyperspectral", "raster", "vector", "image", "time_series", "tabular", "tensor"]


def modality_from_text(c: Column) -> Column:
    """Sorted modalities whose keywords a text holds; tabular without any."""
    low = F.lower(c)
    found = F.flatten(F.array(*(F.when(_any([low.contains(w) for w in words]), F.array(*map(F.lit, says))).otherwise(F.array().cast("array<string>")) for words, says in MODALITY_WORDS)))
    return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array(F.lit("tabular")))


def _choose(c: Column, table: dict[tuple[str, ...], tuple[str, ...]], other: str) -> Column:
    out = F.array(F.lit(other))
    for names, says in table.items():
        out = F.when(F.lower(c).isin(*names), F.array(*map(F.lit, says))).otherwise(out)
    return out


def modality_from_extension(path: Column) -> Column:
    return _choose(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1), MODALITY_ENDINGS, "unknown")


def modality_from_cdm(c: Column) -> Column:
    return _choose(c, MODALITY_CDM, "tabular")


def primary_modality(c: Column) -> Column:
    """The first of the fixed order that an array holds, else unknown."""
    return F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, MODALITY_ORDER)), lambda m: F.array_contains(c, m)), F.lit(1)), F.lit("unknown"))


def merge_modalities(a: Column, b: Column) -> Column:
    """Unseen ones appended; ``unknown`` dropped."""
    return F.array_remove(F.array_union(a, b), "unknown")


def wavelength_factor(unit: Column) -> Column:
    """To nanometres: 1 or 1000, else null."""
    low = F.lower(F.trim(unit))
    return F.when(low.isin("nm", "nanometer", "nanometers"), 1.0).when(low.isin("um", "µm", "micrometer", "micrometers"), 1000.0)


def parse_range(c: Column) -> Column:
    """struct(low, high): the first and last finite number of text separated by commas or spaces; null unless there are two."""
    numbers = F.filter(F.transform(F.split(F.trim(c), r"[,\s]+"), lambda x: finite(try_double(x))), lambda x: x.isNotNull())
    return F.when(F.size(numbers) >= 2, F.struct(F.element_at(numbers, 1).alias("low"), F.element_at(numbers, -1).alias("high")))


def coverage_polygon(west: Column, east: Column, south: Column, north: Column) -> Column:
    """GeoJSON text of the closed ring around a box."""
    ring = F.array(*(F.array(x, y) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))))
    return F.when(west.isNotNull() & east.isNotNull() & south.isNotNull() & north.isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))


def license_citation(attrs: Column, title: Column, dataset_id: Column) -> Column:
    """struct(license, url, attribution_required, citation, doi) from a dataset's global attributes."""
    attr = lambda k: F.try_element_at(attrs, F.lit(k))
    name, low = attr("license"), F.lower(attr("license"))
    made = F.concat(title, F.coalesce(F.concat(F.lit(" ("), attr("institution"), F.lit(")")), F.lit("")), F.lit(", ERDDAP dataset "), dataset_id)
    return F.struct(
        name.alias("license"),
        F.coalesce(attr("license_url"), F.when(name.startswith("http"), name)).alias("url"),
        (low.contains("cc by") | low.contains("attribution")).alias("attribution_required"),
        F.coalesce(attr("citation"), made).alias("citation"),
        F.trim(F.regexp_replace(F.coalesce(attr("doi"), attr("DOI")), "^(doi:)+", "")).alias("doi"),
    )


def stable_id(prefix: str, parts: Sequence[Column], digits: int = 16) -> Column:
    """The prefix and a truncated SHA-256 of the parts."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, digits))


def parse_crs(c: Column) -> Column:
    """struct(authority, code): ``AUTH:CODE`` split; bare text is a code."""
    text, at = F.trim(c), F.instr(F.trim(c), ":")
    return F.when(text != "", F.struct(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).alias("authority"), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text).alias("code")))


#: 8-bit colours of point classes, and of all others.
CLASS_COLORS = {2: (166, 124, 82), 3: (152, 211, 121), 4: (74, 168, 80), 5: (18, 112, 52), 6: (198, 86, 64), 9: (65, 132, 220), 17: (130, 130, 140)}
OTHER_COLOR = (210, 214, 220)


def point_color(classification: Column, channels: Sequence[Column] = ()) -> Column:
    """array of 8-bit colours: red, green and blue of up to 16 bits where given, else the class's colour."""
    by_class = F.array(*map(F.lit, OTHER_COLOR))
    for k, color in CLASS_COLORS.items():
        by_class = F.when(classification == k, F.array(*map(F.lit, color))).otherwise(by_class)
    if not channels:
        return by_class
    eight = F.array(*(F.when(v > 255, F.shiftright(v, 8)).otherwise(v).cast("int") for v in channels))
    return F.when(reduce(lambda a, b: a & b, [v.isNotNull() for v in channels]), eight).otherwise(by_class)


def pick_envelope(x: Column, y: Column, scale: Column, extent: Column, projected: bool = True) -> Column:
    """struct(min_x, min_y, max_x, max_y) around a picked point: twice the coordinate scale, eight 32-bit rounding steps of the extent, or a floor, whichever is most."""
    tolerance = F.greatest(F.abs(scale) * 2, F.abs(extent) * (2.0**-23) * 8, F.lit(0.01 if projected else 1e-7))
    return F.struct((x - tolerance).alias("min_x"), (y - tolerance).alias("min_y"), (x + tolerance).alias("max_x"), (y + tolerance).alias("max_y"))


def display_to_source_pixel(position: Column, stride: int) -> Column:
    return F.greatest(F.floor(position * stride), F.lit(0)).cast("long")
