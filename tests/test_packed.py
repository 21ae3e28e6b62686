"""Features in curve order: against the plain region, and by what a region reads."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sciobs.operators import packed
from sciobs.operators.geometry import geometry_box, to_wkb, vector_region
from sciobs.plans.spec import Box, SpecError

SCHEMA = "feature_index long, geometry binary, min_x double, min_y double, max_x double, max_y double, name string"
REGION = {"type": "Polygon", "coordinates": [[[10, 10], [31, 12], [28, 33], [9, 25], [10, 10]]]}


def features(spark, n=4000):
    r = random.Random(6)
    rows = []
    for i in range(n):
        x, y, w = r.uniform(0, 100), r.uniform(0, 100), r.choice([0.0, 0.2, 0.5])
        shape = {"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]} if w else {"type": "Point", "coordinates": [x, y]}
        rows.append((i, to_wkb(shape), x, y, x + w, y + w, f"f{i}"))
    rows += [(n + i, to_wkb({"type": "Point", "coordinates": [20.0, 20.0]}), 20.0, 20.0, 20.0, 20.0, "crowd") for i in range(300)]
    rows += [(n + 300, None, None, None, None, None, "none"), (n + 301, None, float("nan"), 1.0, 2.0, 2.0, "nan")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("packed") / "layer")
    facts = packed.build_packed_features(features(spark), path, 32)
    assert facts.features == 4302 and facts.nodes >= 4302 // 32
    return path


def ids(df):
    return sorted(r[0] for r in df.select("feature_index").collect())


def test_curve_visits_every_cell_by_steps_of_one(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    rows = sorted((r.d, r.x, r.y) for r in cells.select("x", "y", packed.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect())
    assert [d for d, _, _ in rows] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows[:-1], rows[1:], strict=True))


def test_no_feature_is_lost(spark, laid):
    assert ids(spark.read.parquet(f"{laid}/features")) == ids(features(spark))


@pytest.mark.parametrize("most", [1, 3, 200])
def test_region_equals_the_plain_one(spark, laid, most):
    found, number = vector_region(features(spark), REGION)
    near = packed.packed_candidates(spark, laid, geometry_box(REGION), most)
    assert near.columns == features(spark).columns
    got, many = vector_region(near, REGION)
    assert ids(got) == ids(found) and len(ids(found)) > 300
    assert many.first() == number.first()
    assert ids(packed.packed_region(spark, laid, REGION)[0]) == ids(found)


def test_spans_hold_all_near_nodes_and_are_bounded(spark, laid):
    _, _, nodes = packed.open_packed_features(spark, laid)
    for box in (Box(0, 0, 100, 100), Box(40, 0, 41, 100), Box(20, 20, 20, 20), Box(70.5, 3.0, 78.0, 9.0)):
        near = {r.node for r in nodes.where((F.col("max_x") >= box.min_x) & (F.col("min_x") <= box.max_x) & (F.col("max_y") >= box.min_y) & (F.col("min_y") <= box.max_y)).collect()}
        for most in (1, 2, 7, 200):
            spans = packed.node_spans(nodes, box, most)
            assert len(spans) <= most and all(a <= b for a, b in spans)
            assert all(any(a <= n <= b for a, b in spans) for n in near)
    assert packed.node_spans(nodes, Box(500, 500, 501, 501)) == []


def test_a_small_region_reads_few_row_groups(spark, laid, tmp_path):
    _, stored, nodes = packed.open_packed_features(spark, laid)
    spans = packed.node_spans(nodes, Box(70.0, 70.0, 74.0, 74.0))
    read = total = 0
    for name in {f.removeprefix("file://") for f in stored.inputFiles()}:
        meta = pq.ParquetFile(name).metadata
        column = meta.schema.names.index("node")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(column).statistics
            total += meta.row_group(g).num_rows
            read += meta.row_group(g).num_rows * any(a <= s.max and s.min <= b for a, b in spans)
    assert 0 < read <= total / 4
    plan = packed.packed_candidates(spark, laid, Box(70.0, 70.0, 74.0, 74.0))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "node" in plan.split("PushedFilters")[1].split("]")[0]


def test_empty_and_wrong_inputs(spark, tmp_path):
    facts = packed.build_packed_features(features(spark).where("false"), str(tmp_path / "empty"))
    assert facts.features == 0
    found, number = packed.packed_region(spark, str(tmp_path / "empty"), REGION)
    assert found.count() == 0 and number.first()[0] == 0
    with pytest.raises(SpecError):
        packed.build_packed_features(features(spark).withColumn("node", F.lit(1)), str(tmp_path / "clash"))
