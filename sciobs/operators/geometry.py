"""Vector features: GeoJSON and WKB geometry, exact planar intersection, spatial joins."""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import MAX_RESULT_ROWS, Box, SpecError
from .quadtree import box_join

#: WKB geometry types.
_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
Parts = tuple[list, list, list]


def parse_wkb(data: bytes) -> Parts:
    """(points, lines, polygons as lists of rings) of a geometry; z and m are left out."""
    points: list = []
    lines: list = []
    polygons: list = []

    def read(at: int) -> int:
        order = "<" if data[at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", data, at + 1)
        at += 5
        if code & 0x20000000:
            at += 4
        extra = bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        extra += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
        kind, width = _TYPES[code % 1000], 2 + extra

        def coordinates(at: int, n: int) -> tuple[np.ndarray, int]:
            xy = np.frombuffer(data, order + "f8", n * width, at).reshape(n, width)[:, :2].astype(float)
            return xy, at + 8 * n * width

        if kind == "Point":
            xy, at = coordinates(at, 1)
            if np.isfinite(xy).all():
                points.append(xy[0])
            return at
        (n,) = struct.unpack_from(order + "I", data, at)
        at += 4
        if kind == "LineString":
            xy, at = coordinates(at, n)
            lines.append(xy)
        elif kind == "Polygon":
            rings = []
            for _ in range(n):
                (m,) = struct.unpack_from(order + "I", data, at)
                xy, at = coordinates(at + 4, m)
                rings.append(xy)
            polygons.append(rings)
        else:
            for _ in range(n):
                at = read(at)
        return at

    if data:
        read(0)
    return points, lines, polygons


def geojson_parts(geometry: dict) -> Parts:
    kind, c = geometry.get("type"), geometry.get("coordinates")
    xy = lambda p: np.asarray(p, float).reshape(-1, len(p[0]) if p else 2)[:, :2]
    if kind == "Feature":
        return geojson_parts(geometry["geometry"])
    if kind in ("GeometryCollection", "FeatureCollection"):
        parts = [geojson_parts(g) for g in geometry.get("geometries", geometry.get("features", []))]
        return tuple(sum((p[i] for p in parts), []) for i in range(3))
    if kind == "Point":
        return [np.asarray(c[:2], float)], [], []
    if kind == "MultiPoint":
        return list(xy(c)), [], []
    if kind == "LineString":
        return [], [xy(c)], []
    if kind == "MultiLineString":
        return [], [xy(x) for x in c], []
    if kind == "Polygon":
        return [], [], [[xy(r) for r in c]]
    if kind == "MultiPolygon":
        return [], [], [[xy(r) for r in p] for p in c]
    raise SpecError(f"unknown geometry {kind!r}")


def to_wkb(geometry: dict) -> bytes:
    """GeoJSON -> little-endian WKB, two dimensions."""
    kind, c = geometry["type"], geometry.get("coordinates")
    code = {v: k for k, v in _TYPES.items()}[kind]
    head = struct.pack("<BI", 1, code)
    pair = lambda p: struct.pack("<2d", p[0], p[1])
    run = lambda ps: struct.pack("<I", len(ps)) + b"".join(map(pair, ps))
    if kind == "Point":
        return head + pair(c)
    if kind == "LineString":
        return head + run(c)
    if kind == "Polygon":
        return head + struct.pack("<I", len(c)) + b"".join(map(run, c))
    members = geometry["geometries"] if kind == "GeometryCollection" else [{"type": kind[5:], "coordinates": x} for x in c]
    return head + struct.pack("<I", len(members)) + b"".join(map(to_wkb, members))


def geometry_box(geometry: dict) -> Box:
    """The bbox member, or the extremes of all coordinates."""
    if len(box := geometry.get("bbox", ())) >= 4:
        half = len(box) // 2
        return Box(box[0], box[1], box[half], box[half + 1])
    points, lines, polygons = geojson_parts(geometry)
    xy = [p.reshape(1, 2) for p in points] + lines + [r for p in polygons for r in p]
    if not xy:
        raise SpecError("the geometry has no coordinates")
    every = np.concatenate(xy)
    return Box(*every.min(axis=0).tolist(), *every.max(axis=0).tolist())


def _on_segments(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    cross = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0])
    inside = (np.minimum(a, b) <= p).all(axis=1) & (p <= np.maximum(a, b)).all(axis=1)
    return bool((inside & (cross == 0)).any())


def point_in_polygon(p: np.ndarray, rings: list[np.ndarray]) -> bool:
    """Even-odd over all rings; a point on a ring is inside."""
    odd = False
    for ring in rings:
        a, b = ring[:-1], ring[1:]
        if _on_segments(p, a, b):
            return True
        crosses = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
        if crosses.any():
            a, b = a[crosses], b[crosses]
            x = a[:, 0] + (p[1] - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
            odd ^= bool((x > p[0]).sum() % 2)
    return odd


def _segments(parts: Parts) -> tuple[np.ndarray, np.ndarray]:
    runs = parts[1] + [r for p in parts[2] for r in p]
    runs = [r for r in runs if len(r) > 1]
    none = np.zeros((0, 2))
    return (np.concatenate([r[:-1] for r in runs]), np.concatenate([r[1:] for r in runs])) if runs else (none, none)


def _cross_segments(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> bool:
    """Whether any segment a-b meets any segment c-d, touching included."""
    turn = lambda o, p, q: np.sign((p[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (p[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0]))
    a, b, c, d = a[:, None], b[:, None], c[None], d[None]
    near = (np.minimum(a, b) <= np.maximum(c, d)).all(-1) & (np.minimum(c, d) <= np.maximum(a, b)).all(-1)
    return bool((near & (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)).any())


def intersects(one: Parts, two: Parts) -> bool:
    """Planar intersection of any two geometries; boundaries belong to them."""
    sa, sb = _segments(one), _segments(two)
    for points, segments, other in ((one[0], sb, two), (two[0], sa, one)):
        for p in points:
            if len(segments[0]) and _on_segments(p, *segments) or any(point_in_polygon(p, rings) for rings in other[2]) or any((p == q).all() for q in other[0]):
                return True
    if len(sa[0]) and len(sb[0]) and _cross_segments(*sa, *sb):
        return True
    # one inside the other: any one vertex tells
    for inner, outer in ((one, two), (two, one)):
        starts = [line[0] for line in inner[1] if len(line)] + [p[0][0] for p in inner[2] if p and len(p[0])]
        if any(point_in_polygon(s, rings) for s in starts for rings in outer[2]):
            return True
    return False


#: WKB of a little-endian point without z and m, and how many comparisons of points and segments are made at once.
_POINT = np.dtype([("head", "S5"), ("xy", "<f8", 2)])
_POINT_HEAD, MAX_COMPARED = struct.pack("<BI", 1, 1), 1 << 20


def points_intersect(xy: np.ndarray, region: Parts) -> np.ndarray:
    """intersects() of many points with one geometry."""
    hit = np.zeros(len(xy), bool)
    for q in region[0]:
        hit |= (xy == q).all(axis=1)
    px, py, most = xy[:, :1], xy[:, 1:], max(1, MAX_COMPARED // max(1, len(xy)))

    def blocks(a: np.ndarray, b: np.ndarray):
        return ((a[k : k + most], b[k : k + most]) for k in range(0, len(a), most))

    for a, b in blocks(*_segments(region)):
        low, high = np.minimum(a, b), np.maximum(a, b)
        inside = (low[:, 0] <= px) & (px <= high[:, 0]) & (low[:, 1] <= py) & (py <= high[:, 1])
        hit |= (inside & ((b[:, 0] - a[:, 0]) * (py - a[:, 1]) - (b[:, 1] - a[:, 1]) * (px - a[:, 0]) == 0)).any(axis=1)
    for rings in region[2]:
        odd = np.zeros(len(xy), bool)
        for ring in rings:
            for a, b in blocks(ring[:-1], ring[1:]):
                slanted = a[:, 1] != b[:, 1]
                a, b = a[slanted], b[slanted]
                at = a[:, 0] + (py - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
                odd ^= (((a[:, 1] > py) != (b[:, 1] > py)) & (at > px)).sum(axis=1) % 2 == 1
        hit |= odd
    return hit & np.isfinite(xy).all(axis=1)


def shapes_intersect(shapes: Sequence, region: Parts) -> np.ndarray:
    """intersects() of WKB geometries with one geometry; plain points all at once."""
    shapes = [None if data is None else bytes(data) for data in shapes]
    plain = np.array([data is not None and len(data) == _POINT.itemsize and data.startswith(_POINT_HEAD) for data in shapes], bool)
    out = np.zeros(len(shapes), bool)
    if plain.any():
        out[plain] = points_intersect(np.frombuffer(b"".join(data for data, p in zip(shapes, plain, strict=True) if p), _POINT)["xy"], region)
    for k in np.flatnonzero(~plain):
        out[k] = shapes[k] is not None and intersects(parse_wkb(shapes[k]), region)
    return out


def intersects_constant(wkb: Column, geometry: dict) -> Column:
    """Whether WKB geometries intersect one GeoJSON geometry."""
    region = geojson_parts(geometry)

    @F.pandas_udf("boolean")
    def test(shapes: pd.Series) -> pd.Series:
        return pd.Series(shapes_intersect(shapes, region))

    return test(wkb)


def points_in_polygon(x: Column, y: Column, geometry: dict) -> Column:
    """Points in a constant polygon as a plain expression: no Python. On a ring is inside."""
    _, _, polygons = geojson_parts(geometry)
    hit = F.lit(False)
    for rings in polygons:
        crossings, edge = F.lit(0), F.lit(False)
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring[:-1].tolist(), ring[1:].tolist(), strict=True):
                cross = (F.lit(bx - ax) * (y - ay)) - (F.lit(by - ay) * (x - ax))
                edge = edge | ((cross == 0) & x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by)))
                if ay != by:
                    at = F.lit(ax) + (y - ay) * (bx - ax) / (by - ay)
                    crossings = crossings + F.when(((F.lit(ay) > y) != (F.lit(by) > y)) & (at > x), 1).otherwise(0)
        hit = hit | edge | (crossings % 2 == 1)
    return hit


def vector_region(features: DataFrame, geometry: dict, limit: int | None = MAX_RESULT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(up to ``limit`` features that intersect, number of all that do). With None all of them, in no order.

    features: (feature_index, geometry WKB, min_x, min_y, max_x, max_y, ...). The box test prunes row groups before the exact one."""
    box = geometry_box(geometry)
    near = features.where((F.col("max_x") >= box.min_x) & (F.col("min_x") <= box.max_x) & (F.col("max_y") >= box.min_y) & (F.col("min_y") <= box.max_y))
    found = near.where(intersects_constant(F.col("geometry"), geometry))
    rows = found if limit is None else found.orderBy("feature_index").limit(max(1, min(limit, MAX_RESULT_ROWS)))
    return rows, found.agg(F.count(F.lit(1)).alias("matched_features"))


def with_boxes(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Adds min_x, min_y, max_x, max_y of WKB geometries; null without finite coordinates."""

    @F.pandas_udf("min_x double, min_y double, max_x double, max_y double")
    def box(shapes: pd.Series) -> pd.DataFrame:
        out = []
        for data in shapes:
            points, lines, polygons = parse_wkb(bytes(data)) if data is not None else ([], [], [])
            xy = [p.reshape(1, 2) for p in points] + lines + [r for p in polygons for r in p]
            every = np.concatenate(xy) if xy else np.zeros((0, 2))
            every = every[np.isfinite(every).all(axis=1)]
            out.append((*every.min(axis=0), *every.max(axis=0)) if len(every) else (None,) * 4)
        return pd.DataFrame(out, columns=["min_x", "min_y", "max_x", "max_y"])

    return features.withColumn("__box", box(geometry)).select("*", "__box.*").drop("__box")


def layer_bounds(features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Extremes of all boxes of a layer."""
    return features.groupBy(*keys).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def inspect_features(features: DataFrame) -> DataFrame:
    """One row: number of features, sorted union of property names, bounds. features: with properties (map) and boxes."""
    keys = features.select(F.explode_outer(F.map_keys("properties")).alias("k")).agg(F.array_sort(F.collect_set("k")).alias("property_keys"))
    counts = features.agg(F.count(F.lit(1)).alias("features"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
    return counts.crossJoin(F.broadcast(keys))  # one row each


def geometry_primitives(features: DataFrame) -> DataFrame:
    """(feature_index, part, kind point or line, coordinates array<array<double>>): every geometry as points and strips; rings are closed strips."""

    @F.pandas_udf("array<struct<kind:string,coordinates:array<array<double>>>>")
    def cut(shapes: pd.Series) -> pd.Series:
        out = []
        for data in shapes:
            points, lines, polygons = parse_wkb(bytes(data)) if data is not None else ([], [], [])
            parts = [{"kind": "point", "coordinates": [p.tolist()]} for p in points]
            parts += [{"kind": "line", "coordinates": r.tolist()} for r in lines + [r for p in polygons for r in p]]
            out.append(parts)
        return pd.Series(out)

    return features.select("feature_index", F.posexplode(cut("geometry")).alias("part", "p")).select("feature_index", "part", "p.kind", "p.coordinates")


#: Parsed geometries that a task remembers of each side.
MEMO_SHAPES = 2000


def spatial_join(regions: DataFrame, features: DataFrame, exact: bool = True) -> DataFrame:
    """(region_id, feature_index) of regions and features that intersect, continents and plots alike.

    Both have boxes, which are joined by quadtree cells of their own sizes; exact also compares their WKB geometries.
    """
    box = ("min_x", "min_y", "max_x", "max_y")
    left = regions.select("region_id", F.col("geometry").alias("__rg"), *(F.col(c).cast("double").alias(f"__r_{c}") for c in box))
    right = features.select("feature_index", F.col("geometry").alias("__fg"), *(F.col(c).cast("double").alias(f"__f_{c}") for c in box))
    if not exact:
        left, right = left.drop("__rg"), right.drop("__fg")
    pairs = box_join(left, right, tuple(f"__r_{c}" for c in box), tuple(f"__f_{c}" for c in box))
    if exact:

        @F.pandas_udf("boolean")
        def test(a: pd.Series, b: pd.Series) -> pd.Series:
            known: dict[bytes, Parts] = {}

            def parts(data: bytes) -> Parts:
                data = bytes(data)
                if data not in known:
                    if len(known) >= 2 * MEMO_SHAPES:
                        known.clear()
                    known[data] = parse_wkb(data)
                return known[data]

            return pd.Series([x is not None and y is not None and intersects(parts(x), parts(y)) for x, y in zip(a, b, strict=True)])

        pairs = pairs.where(test("__rg", "__fg"))
    return pairs.select("region_id", "feature_index")


def region_table(spark, regions: dict[str, dict]) -> DataFrame:
    """A few GeoJSON regions as a table with WKB and boxes."""
    rows = [(k, to_wkb(g), *geometry_box(g).__dict__.values()) for k, g in regions.items()]
    return spark.createDataFrame(rows, "region_id string, geometry binary, min_x double, min_y double, max_x double, max_y double")


def geojson_text(geometry: dict) -> str:
    return json.dumps(geometry, separators=(",", ":"))
