"""Profiles of a small float table: two casts, with a missing value, a missing position and a bad flag."""

from __future__ import annotations

import pytest

from sciobs.operators import profiles as p
from sciobs.plans.spec import Recipe, SpecError, ValueRole

DEPTHS = [0, 10, 25, 50, 100, 200, 400, 700]
TEMPS = ["18.40", "18.05", "17.62", "", "16.51", "14.82", "11.95", "8.21", "18.18", "17.91", "17.44", "16.96", "16.20", "14.51", "11.62", "7.94"]
FLAGS = ["1", "1", "1", "9", "1", "1", "1", "1", "1", "1", "4", "1", "1", "1", "1", "1"]
SCHEMA = "source_index long, platform string, cycle int, latitude string, longitude string, pres string, temp string, temp_qc string, psal string, psal_qc string"
TEMP, PSAL = ValueRole("temp", "temp_qc", ("1", "2")), ValueRole("psal", "psal_qc", ("1", "2"))


def recipe(*values, **more):
    return Recipe("platform", "cycle", "pres", values or (TEMP,), latitude="latitude", longitude="longitude", **more)


@pytest.fixture(scope="module")
def floats(spark):
    rows = [(i, "FLOAT", 1 + i // 8, "" if i == 6 else str(34.8 + i * 0.025), " " if i == 6 else str(-75.5 + i * 0.05), str(DEPTHS[i % 8]), TEMPS[i], FLAGS[i], str(35.0 + i / 100), "1") for i in range(16)]
    return spark.createDataFrame(rows, SCHEMA)


def test_summary(floats):
    (s,) = p.profile_qc_summary(floats, recipe()).collect()
    assert (s["source_rows"], s["valid_rows"], s["accepted_rows"], s["rejected_rows"], s["profiles"]) == (16, 15, 14, 1, 2)


def test_lines(floats):
    (t,) = p.trajectory_lines(floats, recipe()).collect()
    assert t["points"] == 13 and [x["row"] for x in t["line"]] == [i for i in range(16) if i not in (3, 6, 10)]
    lines = p.profile_lines(floats, recipe()).collect()
    assert len(lines) == 2 and sum(x["points"] for x in lines) == 14
    assert {x["row"]: (x["value"], x["height"]) for line in lines for x in line["line"]}[7] == (8.21, -700.0)
    up = p.profile_lines(floats, recipe(positive_down=False)).collect()
    assert {x["row"]: x["height"] for line in up for x in line["line"]}[7] == 700.0


def test_ranges(floats):
    (r,) = p.value_ranges(floats, recipe()).collect()
    assert (r["vertical_min"], r["vertical_max"], r["value_min"], r["value_max"]) == (0.0, 700.0, 7.94, 18.4)


def test_two_values_with_range_and_budget(floats):
    r = recipe(TEMP, PSAL, vertical_range=(10.0, 100.0), points_per_profile=3)
    rows = {s["field"]: s for s in p.profile_qc_summary(floats, r).collect()}
    assert set(rows) == {"temp", "psal"}
    for s in rows.values():
        assert s["displayed_rows"] <= 6 and s["downsampled_rows"] > 0 and s["range_filtered_rows"] > 0
    assert p.profile_observations(floats, r).count() == 32


def test_fill_values(spark):
    rows = [(i, "P" if i < 4 else "Q", 1, str(i), str(i), str(d), v, "1", "0", "1") for i, (d, v) in enumerate([(0, "18"), (10, "-9999"), (20, "NaN"), (30, "16"), (0, "20"), (10, "19")])]
    df = spark.createDataFrame(rows, SCHEMA)
    r = recipe(fills=("-9999",))
    (s,) = p.profile_qc_summary(df, r).collect()
    assert (s["valid_rows"], s["profiles"]) == (4, 2)
    assert p.trajectory_lines(df, r).count() == 2 and p.profile_lines(df, r).count() == 2
    (v,) = p.value_ranges(df, r).collect()
    assert (v["value_min"], v["value_max"]) == (16.0, 20.0)


def test_contracts(floats):
    assert p.validate_profile_source(floats, recipe()).first().asDict() == {"pres": True, "latitude": True, "longitude": True, "temp": True}
    with pytest.raises(SpecError):
        p.validate_profile_source(floats, recipe(ValueRole("nothing")))
    for bad in ({"vertical_range": (5.0, 1.0)}, {"vertical_range": (0.0, float("inf"))}, {"points_per_profile": 0}):
        with pytest.raises(SpecError):
            recipe(**bad)
    with pytest.raises(SpecError):
        recipe(*[TEMP] * 9)


@pytest.mark.parametrize("k", [1, 2, 3, 7])
def test_even_sampling(spark, k):
    rows = [(n, i) for n in range(1, 13) for i in range(n)]
    got = p.even_downsample(spark.createDataFrame(rows, "n long, i long"), ["n"], ["i"], k).collect()
    for n in range(1, 13):
        want = set(range(n)) if n <= k else {n // 2} if k == 1 else {s * (n - 1) // (k - 1) for s in range(k)}
        assert {r["i"] for r in got if r["n"] == n} == want
