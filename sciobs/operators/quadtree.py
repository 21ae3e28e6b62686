"""Joins of boxes of any sizes: a cell suits each box, whatever the others' sizes.

Cells of level e have an edge of 2^e (e may be negative). A box has a level of its own for
its width and one for its height, at which it touches at most MAX_CELLS cells, so a long
flat box has long flat cells; two boxes meet in cells of the coarser level of each axis. Of the
cells that two boxes share there, the pair is reported in the one that holds the lower left
corner of their common part, so none is found twice and nothing has to be made distinct.
Levels finer than the distance between boxes are put together where few small boxes share a cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import SpecError
from .intervals import spread_join

#: Edges of cells that a box is long, at its level: it touches one cell more a side at most.
EDGES = 3
MAX_CELLS = (EDGES + 1) ** 2
#: Bits of a cell's coordinate; a point's own level is where the distance from 0 needs so many.
BITS = 45

Names = tuple[str, str, str, str]
BOX: Names = ("min_x", "min_y", "max_x", "max_y")


def own_level(box: Names = BOX) -> Column:
    """The smallest e at which a box is at most EDGES cells long and wide, and coordinates of cells have few bits."""
    x0, y0, x1, y1 = map(F.col, box)
    side = F.greatest(x1 - x0, y1 - y0) / EDGES
    far = F.greatest(F.abs(x0), F.abs(y0), F.abs(x1), F.abs(y1))
    bits = lambda c: F.when(c > 0, F.ceil(F.log2(c))).otherwise(-1000)
    return F.greatest(bits(side), bits(far) - BITS, F.lit(-1000)).cast("int")


def cells(level: Column | int, box: Names = BOX) -> Column:
    """array of (level, cx, cy): the cells of a level that a closed box touches."""
    level = F.lit(level) if isinstance(level, int) else level
    at = lambda name: F.floor(F.col(name) / F.pow(F.lit(2.0), level)).cast("long")
    x0, y0, x1, y1 = map(at, box)
    return F.flatten(F.transform(F.sequence(x0, x1), lambda cx: F.transform(F.sequence(y0, y1), lambda cy: F.struct(level.alias("level"), cx.alias("cx"), cy.alias("cy")))))


def _sound(box: Names) -> Column:
    """A box with numbers, none infinite, that is not turned around."""
    finite = F.lit(True)
    for c in box:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return finite & (F.col(box[0]) <= F.col(box[2])) & (F.col(box[1]) <= F.col(box[3]))


#: Pairs of levels that one side's boxes may have; more are put together by coarser levels.
MAX_CLASSES = 48
#: Pairs of small boxes in one cell, for each box, up to which a coarser finest level is taken.
PAIRS_PER_BOX = 4

Class = tuple[int, int]


def _axis_level(low: str, high: str) -> Column:
    """The smallest e at which a side is at most EDGES cells long; POINT for one of no length."""
    side = (F.col(high) - F.col(low)) / EDGES
    return F.when(side > 0, F.greatest(F.ceil(F.log2(side)), F.lit(POINT))).otherwise(POINT).cast("int")


#: Level of a side of no length: below every other.
POINT = -1000


def _exponent(v: float) -> int:
    return math.frexp(v)[1] if v > 0 else POINT


def _finest(left: DataFrame, right: DataFrame, boxes: tuple[Names, Names], facts: list, natural: Class) -> Class:
    """The levels below which cells are of no use: at which a cell holds about one box, if the boxes lie evenly enough, else finer ones, and at last the natural ones."""
    many = max(f["n"] for f in facts)
    spans = [max(f[f"x{k}1"] for f in facts) - min(f[f"x{k}0"] for f in facts) for k in (0, 1)]
    tried = [max(n, _exponent(span / math.sqrt(many)) - 2) for n, span in zip(natural, spans, strict=True)]
    while tried != list(natural):
        at = [(F.floor(F.col(box[0]) / F.lit(2.0 ** tried[0])).alias("cx"), F.floor(F.col(box[1]) / F.lit(2.0 ** tried[1])).alias("cy")) for box in boxes]
        fine = [df.where((F.col("__x") < tried[0]) | (F.col("__y") < tried[1])) for df in (left, right)]
        both = fine[0].select(*at[0], F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(fine[1].select(*at[1], F.lit(0).alias("l"), F.lit(1).alias("r")))
        met = both.groupBy("cx", "cy").agg(F.sum("l").cast("double").alias("l"), F.sum("r").cast("double").alias("r")).agg(F.sum(F.col("l") * F.col("r"))).first()[0]
        if (met or 0) <= PAIRS_PER_BOX * sum(f["n"] for f in facts):
            break
        tried = [max(n, t - 6) for n, t in zip(natural, tried, strict=True)]
    return tuple(tried)


def _meetings(mine: set[Class], others: set[Class], first: bool) -> tuple[dict[Class, list], dict[Class, list]]:
    """For each of a side's pairs of levels the cells it makes: (those met by the other side's finer or equal boxes in x, by its coarser ones in x).

    Two boxes meet at the coarser level of each axis. ``how`` tells the four cases apart, so that a pair is met in one only: 0 the left is
    at least as coarse in both, 1 in x only; 2 the right is coarser in both, 3 in x only."""

    def wide(own: Class, other: Class) -> tuple[bool, int, int, int]:
        (a, b), (c, d) = (own, other) if first else (other, own)
        left_x, left_y = a >= c, b >= d
        return left_x, (0 if left_y else 1) if left_x else (3 if left_y else 2), max(a, c), max(b, d)

    out: tuple[dict, dict] = ({}, {})
    for own in mine:
        found = {wide(own, other) for other in others}
        for part, left_x in zip(out, (True, False), strict=True):
            part[own] = sorted(m[1:] for m in found if m[0] is left_x)
    return out


def _celled(df: DataFrame, box: Names, meetings: dict[Class, list]) -> DataFrame:
    """A row for each cell (__how, __ex, __ey, __cx, __cy) in which a box may meet others."""
    wanted = None
    for (a, b), cells_of in sorted(meetings.items()):
        if cells_of:
            made = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("how", "ex", "ey"), m, strict=True))) for m in cells_of))
            test = (F.col("__x") == a) & (F.col("__y") == b)
            wanted = F.when(test, made) if wanted is None else wanted.when(test, made)
    if wanted is None:
        wanted = F.array().cast("array<struct<how:int,ex:int,ey:int>>")
    kept_columns = [c for c in df.columns if c not in ("__x", "__y")]
    rows = df.withColumn("__m", F.explode(wanted)).select(*kept_columns, *(F.col(f"__m.{n}").alias(f"__{n}") for n in ("how", "ex", "ey")))
    for e, low, high, cell in (("__ex", box[0], box[2], "__cx"), ("__ey", box[1], box[3], "__cy")):
        at = lambda c, e=e: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col(e))).cast("long")
        rows = rows.withColumn(cell, F.explode(F.sequence(at(low), at(high))))
    return rows


def box_join(left: DataFrame, right: DataFrame, left_box: Names, right_box: Names, on: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` whose box overlaps its own, and with equal values of the columns ``on``.

    Boxes are closed, so those that touch overlap; not with ``strict``. Rows whose box has a null, NaN or infinite side, or is turned
    around, meet nothing. Repeated rows meet as often as they are there. Other columns of the two tables must differ in name.
    """
    same = (set(left.columns) & set(right.columns)) - set(on)
    if same:
        raise SpecError(f"both tables have {sorted(same)}")
    columns = [*on, *(c for c in left.columns if c not in on), *(c for c in right.columns if c not in on)]
    boxes = (left_box, right_box)
    left, right = (df.where(_sound(b)).withColumns({"__x": _axis_level(b[0], b[2]), "__y": _axis_level(b[1], b[3])}) for df, b in ((left, left_box), (right, right_box)))
    # few rows: exponents of 2, one for each axis
    facts = []
    for df, b in ((left, left_box), (right, right_box)):
        ends = [f(c).cast("double").alias(n) for f, c, n in ((F.min, b[0], "x00"), (F.max, b[2], "x01"), (F.min, b[1], "x10"), (F.max, b[3], "x11"))]
        facts.append(df.groupBy("__x", "__y").agg(F.count("*").alias("n"), *ends).collect())
    if not all(facts):
        return left.drop("__x", "__y").join(right.drop("__x", "__y"), list(on) or F.lit(False)).where(F.lit(False)).select(columns)
    levels = [{(r["__x"], r["__y"]) for r in side} for side in facts]
    whole = [{"n": sum(r["n"] for r in side), **{n: (min if n.endswith("0") else max)(r[n] for r in side) for n in ("x00", "x01", "x10", "x11")}} for side in facts]
    # finer than all of the other side is of no use, nor are coordinates of cells with too many bits
    far = [max(_exponent(max(abs(f[f"x{k}0"]), abs(f[f"x{k}1"]))) for f in whole) - BITS for k in (0, 1)]
    natural = tuple(max(max(min(c[k] for c in side) for side in levels), far[k], POINT) for k in (0, 1))
    least, step = _finest(left, right, boxes, whole, natural), 1
    up = lambda v, k: least[k] if v <= least[k] else least[k] - (least[k] - v) // step * step
    while max(len({(up(a, 0), up(b, 1)) for a, b in side}) for side in levels) > MAX_CLASSES:
        step *= 2
    rounded = [F.when(F.col(c) <= least[k], least[k]).otherwise(F.lit(least[k]) + F.ceil((F.col(c) - least[k]) / step) * step).cast("int") for k, c in enumerate(("__x", "__y"))]
    left, right = (df.withColumns({"__x": rounded[0], "__y": rounded[1]}) for df in (left, right))
    classes = [{(up(a, 0), up(b, 1)) for a, b in side} for side in levels]
    x, y = (F.greatest(F.col(left_box[i]), F.col(right_box[i])) for i in (0, 1))
    one = lambda a, b: (F.col(a) < F.col(b)) if strict else (F.col(a) <= F.col(b))
    overlap = one(left_box[0], right_box[2]) & one(right_box[0], left_box[2]) & one(left_box[1], right_box[3]) & one(right_box[1], left_box[3])
    cell = ["__how", "__ex", "__ey", "__cx", "__cy"]

    def met(few: DataFrame, many: DataFrame) -> DataFrame:
        joined = spread_join(few, many, [*on, *cell])
        corner = F.lit(True)
        for v, e, at in ((x, "__ex", "__cx"), (y, "__ey", "__cy")):
            corner = corner & (F.col(at) == F.floor(v / F.pow(F.lit(2.0), F.col(e))))
        return joined.where(corner & overlap).select(columns)

    l_cells, r_cells = _meetings(*classes, True), _meetings(*classes[::-1], False)
    large_left = met(_celled(left, left_box, l_cells[0]), _celled(right, right_box, r_cells[0])) if any(l_cells[0].values()) else None
    if not any(l_cells[1].values()):
        return large_left
    large_right = met(_celled(right, right_box, r_cells[1]), _celled(left, left_box, l_cells[1]))
    return large_right if large_left is None else large_left.unionByName(large_right)
