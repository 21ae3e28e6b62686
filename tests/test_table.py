from __future__ import annotations

import pytest

from sciobs.operators import table as t
from sciobs.plans.spec import Aggregate, Filter, Sort, SpecError, TableQuery


@pytest.fixture(scope="module")
def sites(spark):
    return spark.createDataFrame([(0, "HARV", 3.5, "pass"), (1, "ABBY", 2.0, "pass"), (2, "HARV", 4.5, "fail"), (3, "OSBS", None, None)], "source_index long, site string, value double, qc string")


def test_grouped_mean(sites):
    q = TableQuery(filters=[Filter("qc", "eq", "pass")], group_by=["site"], aggregates=[Aggregate("mean", "value", "mean_value")], order_by=[Sort("site")])
    r = t.table_query(sites, q)
    assert [tuple(x) for x in r.data.collect()] == [("ABBY", 2.0), ("HARV", 3.5)]
    facts = r.facts()
    assert facts["matched_rows"] == 2 and facts["returned_rows"] == 2 and facts["deterministic_order"] and not facts["truncated"]
    assert t.table_query(sites, TableQuery(group_by=["site"], aggregates=[Aggregate("count", "*", "n")], limit=3)).facts()["truncated"]  # an exact fit counts as truncated


def test_null_filters(sites):
    count = lambda *f: t.filter_all(sites, [Filter(*f)]).count()
    assert count("value", "eq", None) == 1 and count("value", "ne", None) == 3
    assert count("qc", "ne", "pass") == 1 and count("site", "in", []) == 0 and count("site", "in", ["HARV", "OSBS"]) == 3
    assert count("site", "contains", "AR") == 2 and count("value", "contains", "3.5") == 1


def test_filters_reach_the_scan(spark, sites, tmp_path):
    sites.write.parquet(f"{tmp_path}/s")
    plan = t.project(t.filter_all(spark.read.parquet(f"{tmp_path}/s"), [Filter("value", "gte", 3.0)]), ["site"])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(value,3.0)" in plan and "ReadSchema: struct<site:string,value:double>" in plan


@pytest.mark.parametrize(
    "bad",
    [
        TableQuery(select=["nothing"]), TableQuery(filters=[Filter("site", "like", "x")]), TableQuery(filters=[Filter("site", "eq", ["x"])]), TableQuery(group_by=["site"]), TableQuery(filters=[Filter("site", "in", "x")]),
        TableQuery(aggregates=[Aggregate("median", "value")]), TableQuery(aggregates=[Aggregate("sum", "*")]), TableQuery(group_by=["site"], aggregates=[Aggregate("count", "*", "n")], order_by=[Sort("value")]), TableQuery(order_by=[Sort("nothing")]),
    ],
)
def test_errors(sites, bad):
    with pytest.raises(SpecError):
        t.table_query(sites, bad)


def test_source_rows(sites):
    assert [(r["position"], r["source_index"], r["site"]) for r in t.source_rows(sites, [3, 1], ["site"]).collect()] == [(0, 3, "OSBS"), (1, 1, "ABBY")]
    assert [r[0] for r in t.missing_rows(sites, [3, 9]).collect()] == [9]
    for bad in ([], [1, 1], [-1], list(range(10_001))):
        with pytest.raises(SpecError):
            t.source_rows(sites, bad)
    with pytest.raises(SpecError):
        t.source_rows(sites, [0], ["nothing"])


def test_order_and_preview(sites):
    assert [r["site"] for r in t.order_by(sites, [Sort("value", descending=True)]).collect()] == ["HARV", "HARV", "ABBY", "OSBS"]
    assert [r["site"] for r in t.order_by(sites, [Sort("value", nulls_first=True)]).collect()][0] == "OSBS"
    assert [tuple(r) for r in t.preview(sites, 9).collect()][3] == (3, "OSBS", "", "")


def test_bounds_already_given(sites):
    df = sites.withColumn("time", sites.site)
    assert t.temporal_bounds(df, "time", start="Z", constraints=[Filter("time", ">=", "A")]).count() == 4
    assert t.temporal_bounds(df, "time", start="H", end="HZ").count() == 2
    with pytest.raises(SpecError):
        t.constraint_filter(df, ["site"], [Filter("site", "contains", "x")])


@pytest.mark.parametrize("n,stride", [(10, 3), (4, 1), (9, 3), (8, 2)])
def test_stride(spark, n, stride):
    df = spark.range(n).withColumnRenamed("id", "source_index")
    assert [r[0] for r in t.stride_sample(df, 4).orderBy("source_index").collect()] == list(range(0, n, stride))
