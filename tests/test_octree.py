"""Stored levels of a point cloud: against thinning by a scan, and by the files that a query reads."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sciobs.operators import octree
from sciobs.operators import points as p
from sciobs.plans.spec import Box, SpecError

SCHEMA = "source_index long, x double, y double, z double, classification int"


def cloud(spark, n=3000):
    r = random.Random(3)
    rows = [(i, r.uniform(-300, 700), r.uniform(-50, 900), r.uniform(0, 60), r.randrange(6)) for i in range(n)]
    rows += [(n + i, 12.5, 13.5, 1.0, 2) for i in range(500)]  # a crowded place
    rows += [(n + 500, None, 1.0, 1.0, 2), (n + 501, 5.0, None, 1.0, 2), (n + 502, 5.0, 5.0, None, 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("octree") / "cloud")
    octree.build_point_octree(cloud(spark), path, 64.0, 5)
    return path


def ids(df):
    return sorted(r.source_index for r in df.select("source_index").collect())


def test_every_point_is_in_one_node(spark, laid):
    assert ids(spark.read.parquet(laid)) == ids(cloud(spark))
    nodes = octree.octree_nodes(spark, laid)
    assert nodes.agg(F.sum("points")).first()[0] == cloud(spark).count() and nodes.count() == nodes.select("level", "node").distinct().count()


@pytest.mark.parametrize("level", range(5))
def test_levels_are_thinned_points(spark, laid, level):
    known = cloud(spark).dropna(subset=["x", "y", "z"])
    want = ids(p.thin_points(known, resolution=64.0 / 2**level))
    assert ids(spark.read.parquet(laid).where(F.col("level") <= level)) == want
    box = Box(-100.0, 0.0, 240.0, 333.0)
    by_level = octree.leveled_point_region(spark, laid, box, level=level, classes=[1, 2, 3], z_min=2.0)
    want = p.point_region(p.thin_points(known, resolution=64.0 / 2**level), box, [1, 2, 3], 2.0)
    assert ids(by_level[0]) == ids(want[0])
    got, want = ({k: round(v, 9) if k == "z_mean" else v for k, v in s.first().asDict().items()} for s in (by_level[1], want[1]))
    assert got == want


@pytest.mark.parametrize("resolution, level", [(1000.0, 0), (64.0, 0), (63.9, 1), (32.0, 1), (20.0, 2), (4.0, 4), (3.9, 5), (0.001, 5)])
def test_a_resolution_picks_a_level(spark, laid, resolution, level):
    assert octree.open_point_octree(spark, laid).level_for(resolution) == level
    box = Box(-1e6, -1e6, 1e6, 1e6)
    assert ids(octree.leveled_points(spark, laid, box, resolution=resolution)) == ids(octree.leveled_points(spark, laid, box, level=level))


def test_all_levels_are_the_region(spark, laid):
    box = Box(0.0, 0.0, 20.0, 20.0)
    assert ids(octree.leveled_points(spark, laid, box)) == ids(p.bbox_filter(cloud(spark), box))
    assert ids(octree.leveled_points(spark, laid, Box(5e8, 5e8, 6e8, 6e8))) == []


def files_read(df):
    """Files of a query's scan, by the scan's own count."""
    df._jdf.queryExecution().executedPlan().execute().count()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_a_query_reads_few_files(spark, laid, monkeypatch):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        every = files_read(octree.leveled_points(spark, laid, Box(-1e6, -1e6, 1e6, 1e6)))
        coarse = files_read(octree.leveled_points(spark, laid, Box(-1e6, -1e6, 1e6, 1e6), level=1))
        corner = files_read(octree.leveled_points(spark, laid, Box(-290.0, -40.0, -280.0, -30.0)))
        assert coarse < every / 2 and corner < every / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_awkward_clouds(spark, tmp_path):
    octree.build_point_octree(cloud(spark).limit(0), str(tmp_path / "empty"), 1.0, 3)
    assert octree.leveled_points(spark, str(tmp_path / "empty"), Box(0, 0, 1, 1)).count() == 0
    with pytest.raises(SpecError):
        octree.build_point_octree(cloud(spark), str(tmp_path / "x"), 0.0, 3)
    with pytest.raises(SpecError):
        octree.build_point_octree(cloud(spark).withColumn("tile", F.lit(1)), str(tmp_path / "x"), 1.0, 3)
    with pytest.raises(SpecError):
        octree.build_point_octree(cloud(spark).withColumn("x", F.col("x") * 1e9), str(tmp_path / "x"), 1e-3, 3)
    with pytest.raises(SpecError):
        octree.leveled_points(spark, str(tmp_path / "empty"), Box(0, 0, 1, 1), resolution=1.0, level=1)


def test_morton_keys(spark):
    r = random.Random(1)
    rows = [tuple(r.randrange(2**octree.KEY_BITS) for _ in range(3)) for _ in range(50)]
    got = spark.createDataFrame(rows, "a long, b long, c long").select("a", "b", "c", octree.interleave(F.col("a"), F.col("b"), F.col("c")).alias("k")).collect()
    assert all(g.k == sum((v >> i & 1) << (3 * i + k) for k, v in enumerate((g.a, g.b, g.c)) for i in range(octree.KEY_BITS)) for g in got)


def test_a_key_names_its_coordinates_few_times():
    """Spark makes an expression anew where its name stands, so a key of many bits must not name it for each."""
    key = str(octree.interleave(F.col("axis_a"), F.col("axis_b"), F.col("axis_c")))
    assert key.count("axis_a") == key.count("axis_c") == 2
