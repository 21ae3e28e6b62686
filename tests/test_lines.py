"""Segments of ordered lines against a plain version."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sciobs.operators.lines import line_segments
from sciobs.plans.spec import SpecError


def plain(rows, edges):
    lines = {}
    for key, *vertex in rows:
        lines.setdefault(key, []).append(tuple(vertex))
    out = {}
    for key, vertices in lines.items():
        vertices.sort()
        for at in range(0, len(vertices) - 1, edges):
            out[key, at // edges] = vertices[at : at + edges + 1]
    return out


@pytest.mark.parametrize("edges", [1, 2, 7, 50, 1000])
def test_segments(spark, edges):
    r = random.Random(edges)
    rows = [(r.choice(["a", "a", "a", "b", "c", None]), r.randrange(300), r.randrange(5)) for _ in range(400)] + [("one", 1, 1), ("two", 1, 1), ("two", 1, 1)]
    rows += [("even", i, 0) for i in range(2 * edges + 1)]  # ends at a border
    df = spark.createDataFrame(rows, "key string, at int, v int").repartition(6)
    got = line_segments(df, ["key"], "at", ["v"], edges).collect()
    assert {(x.key, x.segment): [tuple(p) for p in x.line] for x in got} == plain(rows, edges)
    assert all(x.points == len(x.line) <= edges + 1 for x in got) and len(got) == len(plain(rows, edges))


def test_a_long_line_is_cut_in_many_tasks(spark):
    """A line of a million points: no task has more than a share of its vertices, and ends meet."""
    df = spark.range(1_000_000).select(F.lit("t").alias("key"), ((F.col("id") * 7919) % 1_000_000).alias("at"), F.lit(1.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = line_segments(df, ["key"], "at", ["v"], 10_000)
        got = lines.select("segment", "points", F.col("line")[0]["at"].alias("a"), F.element_at("line", -1)["at"].alias("b"), F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    got.sort()
    assert [(x.segment, x.a, x.b) for x in got] == [(i, 10_000 * i, min(10_000 * (i + 1), 999_999)) for i in range(100)]
    assert len({x.task for x in got}) > 1


def test_errors_and_empty_tables(spark):
    df = spark.createDataFrame([], "key string, at int, v int")
    assert line_segments(df, ["key"], "at", ["v"]).collect() == []
    with pytest.raises(SpecError):
        line_segments(df, ["key"], "key", ["v"])
    with pytest.raises(SpecError):
        line_segments(df, ["key"], "at", ["v"], 0)
