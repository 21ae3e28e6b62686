"""The same rows whatever the number of partitions."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import pytest

import sciobs.queries as core

SF = "/root/testdata/sf0.001"
if not Path(SF).is_dir():
    pytest.skip("no test tables", allow_module_level=True)


@pytest.mark.parametrize("name", ["profile_observations", "even_downsample", "rank_percentile", "spatial_join_exact", "read_source_records", "thin_points", "resolve_time_selections", "plan_hash", "fingerprint_sets"])
def test_partitions_do_not_matter(spark, name):
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(Counter(map(tuple, core.QUERIES[name](spark, SF).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and found[0]
