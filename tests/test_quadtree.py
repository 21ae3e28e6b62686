"""Box joins against comparing all with all."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sciobs.operators import intervals
from sciobs.operators import quadtree as q
from sciobs.plans.spec import SpecError

L, R = ("lx0", "ly0", "lx1", "ly1"), ("rx0", "ry0", "rx1", "ry1")


def boxes(seed, n):
    """Points, plots, continents, borders that touch, places near and far from 0, and rows that cannot take part."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = (r.choice([r.uniform(-50, 50), float(r.randrange(-8, 8)), r.uniform(-1e6, 1e6)]) for _ in "xy")
        w, h = (r.choice([0.0, 1.0, 10 ** r.uniform(-6, 2), 10 ** r.uniform(2, 6.3)]) for _ in "xy")
        out.append((i, x, y, x + w, y + h))
    return out + [(n, None, 0.0, 1.0, 1.0), (n + 1, 0.0, 0.0, float("nan"), 1.0), (n + 2, 0.0, 0.0, float("inf"), 1.0), (n + 3, 5.0, 5.0, 4.0, 9.0), (0, *out[0][1:]), (n + 4, 0.0, 0.0, 0.0, 0.0)]


def frame(spark, rows, k):
    return spark.createDataFrame(rows, f"{k}_id int, " + ", ".join(f"{k}{c} double" for c in ("x0", "y0", "x1", "y1")))


def sound(b):
    return all(v is not None and math.isfinite(v) for v in b[1:]) and b[1] <= b[3] and b[2] <= b[4]


@pytest.mark.parametrize("strict, block_rows, share", [(False, 20_000, 0.002), (True, 20_000, 0.002), (False, 5, 1e-9)])
def test_all_sizes(spark, monkeypatch, strict, block_rows, share):
    monkeypatch.setattr(intervals, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(intervals, "HOT_SHARE", share)
    a, b = boxes(1, 150), boxes(2, 250)
    less = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
    want = Counter((s[0], t[0]) for s in a if sound(s) for t in b if sound(t) if less(s[1], t[3]) and less(t[1], s[3]) and less(s[2], t[4]) and less(t[2], s[4]))
    got = q.box_join(frame(spark, a, "l"), frame(spark, b, "r"), L, R, strict=strict)
    assert Counter((x.l_id, x.r_id) for x in got.collect()) == want and len(want) > 500
    assert got.columns == ["l_id", *L, "r_id", *R]


def test_keys_and_empty_sides(spark):
    a, b = boxes(3, 60), boxes(4, 60)
    keyed = [frame(spark, rows, k).withColumn("k", F.col(f"{k}_id") % 3) for rows, k in ((a, "l"), (b, "r"))]
    got = q.box_join(*keyed, L, R, on=["k"])
    every = q.box_join(frame(spark, a, "l"), frame(spark, b, "r"), L, R).where("l_id % 3 = r_id % 3")
    assert sorted((x.l_id, x.r_id) for x in got.collect()) == sorted((x.l_id, x.r_id) for x in every.collect())
    assert q.box_join(keyed[0].limit(0), keyed[1], L, R, on=["k"]).collect() == []
    assert q.box_join(frame(spark, a, "l"), frame(spark, b[-6:-2], "r"), L, R).collect() == []
    with pytest.raises(SpecError):
        q.box_join(*keyed, L, R)


def test_covers_are_bounded(spark):
    """At its own level a box touches few cells, whatever its size and place."""
    rows = [b for b in boxes(5, 400) if sound(b)]
    sizes = frame(spark, rows, "l").select(F.size(q.cells(q.own_level(L), L)).alias("n")).collect()
    assert max(r.n for r in sizes) <= q.MAX_CELLS


def test_long_flat_boxes_meet_few_others(spark, monkeypatch):
    """Rows that share a cell, before the exact test: some for each row, not a square as wide as the longest boxes."""
    met = []
    join = q.spread_join

    def counted(*args):
        out = join(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(q, "spread_join", counted)
    r = random.Random(9)
    places = [(r.uniform(0, 1000), r.uniform(0, 1000)) for _ in range(3000)]
    many = [(i, x, y, x + 0.5, y + 0.5) for i, (x, y) in enumerate(places)]
    few = [(i, x, y, x + 400.0, y + 0.5) for i, (x, y) in enumerate(places[:150])]
    got = {(x.l_id, x.r_id) for x in q.box_join(frame(spark, few, "l"), frame(spark, many, "r"), L, R).collect()}
    assert got == {(a[0], b[0]) for a in few for b in many if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert sum(met) < 20 * len(few) + 4 * len(many)


def test_crowded_places_and_many_sizes(spark, monkeypatch):
    """Boxes far closer to each other than their mean distance, and more sizes than there may be classes."""
    monkeypatch.setattr(q, "MAX_CLASSES", 5)
    r = random.Random(10)
    rows = []
    for i in range(400):
        x, y = (c + r.uniform(0, 1e-3) for c in r.choice([(0.0, 0.0), (5e4, 9e4), (-7e4, 3e3)]))
        rows.append((i, x, y, x + r.choice([0.0, 10 ** r.uniform(-6, -2)]), y + r.choice([0.0, 10 ** r.uniform(-6, -2)])))
    got = Counter((x.l_id, x.r_id) for x in q.box_join(frame(spark, rows[:200], "l"), frame(spark, rows, "r"), L, R).collect())
    assert got == Counter((a[0], b[0]) for a in rows[:200] for b in rows if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
