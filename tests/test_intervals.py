"""Interval joins against comparing all with all; covers against their definition."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sciobs.operators import intervals as iv
from sciobs.operators.selections import resolve_time_selections, summarize_time_selections
from sciobs.plans.spec import Aggregate, SpecError
from sciobs.queries.selections import any_length


def test_covers(spark):
    r = random.Random(2)
    rows = [(0, 0), (1, 0), (-7, 90), (-(10**12), 10**12), (3, 3), (0, 63), (1, 62), (None, 4)]
    rows += [(a := r.randrange(-5000, 5000), a + r.choice([0, 1, 3, 17, 300, 9000])) for _ in range(80)]
    for row in spark.createDataFrame(rows, "a long, b long").select("a", "b", iv.cover(F.col("a"), F.col("b")).alias("c")).collect():
        if row.a is None or row.a > row.b:
            assert not row.c
            continue
        spans = sorted((c.block * iv.BASE**c.level, (c.block + 1) * iv.BASE**c.level) for c in row.c)
        assert spans[0][0] == row.a and spans[-1][1] == row.b + 1 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert all(n <= 2 * (iv.BASE - 1) for n in Counter(c.level for c in row.c).values())


@pytest.mark.parametrize("block_rows, share", [(20_000, 0.002), (3, 1e-9)])
def test_join(spark, monkeypatch, block_rows, share):
    """With and without salts; years beside minutes, a busy second, nulls, repeats, borders."""
    monkeypatch.setattr(iv, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(iv, "HOT_SHARE", share)
    r, zero = random.Random(4), dt.datetime(2024, 2, 28, 23, 59, 30)
    times = [zero + dt.timedelta(seconds=r.uniform(-4e7, 4e7)) for _ in range(400)] + [zero] * 60 + [zero + dt.timedelta(microseconds=1), None]
    obs = [(i, t) for i, t in enumerate(times)]
    picked = [(0, zero, zero), (1, zero - dt.timedelta(days=4000), zero + dt.timedelta(days=4000)), (2, zero, zero - dt.timedelta(1)), (3, None, zero), (4, zero, zero + dt.timedelta(seconds=5)), (4, zero, zero + dt.timedelta(seconds=5))]
    picked += [(10 + i, a := zero + dt.timedelta(seconds=r.uniform(-4e7, 4e7)), a + dt.timedelta(seconds=10 ** r.uniform(0, 7.5))) for i in range(60)]
    s = spark.createDataFrame(picked, "selection_id int, start timestamp, end timestamp")
    o = spark.createDataFrame(obs, "event_id int, time timestamp")
    want = Counter((i, e) for i, a, b in picked for e, t in obs if None not in (a, b, t) and a <= t <= b)
    for tick in (60.0, 1.0, 1e6):
        got = resolve_time_selections(s, o, tick_seconds=tick)
        assert Counter((x.selection_id, x.event_id) for x in got.collect()) == want
    assert resolve_time_selections(s.limit(0), o).collect() == [] and resolve_time_selections(s, o.limit(0)).collect() == []


def test_numbers_and_dates(spark):
    s = spark.createDataFrame([(1, -2.5, 3.0), (2, 3.0, 3.0)], "id int, a double, b double")
    v = spark.createDataFrame([(x / 2,) for x in range(-10, 10)], "v double")
    got = iv.interval_join(s, v, "a", "b", "v", 0.7)
    assert Counter((x.id, x.v) for x in got.collect()) == Counter([(1, x / 2) for x in range(-5, 7)] + [(2, 3.0)])
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    got = iv.interval_join(spark.createDataFrame([(day(0), day(40))], "a date, b date"), spark.createDataFrame([(day(n),) for n in range(-3, 90)], "v date"), "a", "b", "v")
    assert got.count() == 41
    with pytest.raises(SpecError):
        iv.interval_join(s, s, "a", "b", "a")


def test_a_busy_block_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(iv, "BLOCK_ROWS", 100)
    busy = spark.range(4000).select(F.col("id").alias("event_id"), F.lit(5.0).alias("time"))
    s = spark.createDataFrame([(1, 0.0, 1e6), (2, 5.0, 5.0)], "selection_id int, start double, end double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        each = [r["count"] for r in iv.interval_join(s, busy, "start", "end", "time").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(each) == 8000 and max(each) < 4000


ASKED = [Aggregate("count", alias="n"), Aggregate("count", "w"), Aggregate("sum", "w"), Aggregate("min", "w", "low"), Aggregate("max", "event_id", "last")]


@pytest.mark.parametrize("block_rows, share, parts", [(20_000, 0.002, "4"), (3, 1e-9, "1"), (3, 1e-9, "23")])
def test_summaries(spark, monkeypatch, block_rows, share, parts):
    """Against all pairs, with and without salts: years beside single moments, many equal times, nulls, repeated and reversed selections."""
    monkeypatch.setattr(iv, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(iv, "HOT_SHARE", share)
    r, zero = random.Random(5), dt.datetime(2024, 2, 28, 23, 59, 30)
    times = [zero + dt.timedelta(seconds=r.uniform(-4e7, 4e7)) for _ in range(300)] + [zero] * 50 + [zero + dt.timedelta(microseconds=k) for k in range(-20, 21)] + [None] * 3
    obs = [(i, t, r.choice([None, *range(-9, 10)])) for i, t in enumerate(times)]
    picked = [(0, zero, zero), (1, zero - dt.timedelta(days=4000), zero + dt.timedelta(days=4000)), (2, zero, zero - dt.timedelta(1)), (3, None, zero), (9, zero + dt.timedelta(days=999), zero + dt.timedelta(days=999))]
    picked += [(4, zero, zero + dt.timedelta(seconds=5))] * 2 + [(5, zero, zero)] * 30
    picked += [(10 + i, a := zero + dt.timedelta(microseconds=r.randrange(-25, 25)), a + dt.timedelta(microseconds=r.randrange(20))) for i in range(40)]
    picked += [(100 + i, a := zero + dt.timedelta(seconds=r.uniform(-4e7, 4e7)), a + dt.timedelta(seconds=10 ** r.uniform(0, 7.5))) for i in range(60)]
    want = Counter()
    for i, a, b in picked:
        met = [(e, w) for e, t, w in obs if None not in (a, b, t) and a <= t <= b]
        known = [w for _, w in met if w is not None]
        if met:
            want[i, a, b, len(met), len(known), sum(known) if known else None, min(known, default=None), max(e for e, _ in met)] += 1
    s = spark.createDataFrame(picked, "selection_id int, start timestamp, end timestamp")
    o = spark.createDataFrame(obs, "event_id int, time timestamp, w long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = summarize_time_selections(s, o, ASKED)
        assert got.columns == ["selection_id", "start", "end", "n", "count_w", "sum_w", "low", "last"]
        assert Counter(map(tuple, got.collect())) == want
        for none in (summarize_time_selections(s.limit(0), o, ASKED), summarize_time_selections(s, o.limit(0), ASKED)):
            assert none.dtypes == got.dtypes and none.collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_summaries_of_numbers(spark):
    s = spark.createDataFrame([(1, -2.5, 3.0), (2, 0.0, 0.0), (3, -0.0, -0.0), (4, 3.0, float("nan"))], "id int, a double, b double")
    v = spark.createDataFrame([(x / 2,) for x in range(-10, 10)] + [(-0.0,), (float("nan"),), (None,)], "v double")
    got = iv.interval_summaries(s, v, "a", "b", "v", [Aggregate("count", alias="n")])
    assert {x.id: x.n for x in got.collect()} == {1: 13, 2: 2, 3: 2, 4: 5}
    for asked in ([], [Aggregate("avg", "v")], [Aggregate("min", "v", "a")], [Aggregate("count", alias="n")] * 2):
        with pytest.raises(SpecError):
            iv.interval_summaries(s, v, "a", "b", "v", asked)


def _most_rows(node) -> int:
    """The most rows that an operator of a plan that has run gave."""
    name = node.nodeName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(k) for k in range(node.children().size())]
    own = node.metrics().apply("numOutputRows").value() if node.metrics().contains("numOutputRows") else 0
    return max([own, *map(_most_rows, inner)])


def test_selections_of_any_length_make_no_pairs(spark, tmp_path):
    """2,000 selections of years over 2,000 events: 2 million pairs, of which none is made."""
    n = 2000
    events = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id")).alias("ts"), (F.col("id") * 21).alias("user_id"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = any_length(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(21 * k, n - k, k, n - 1) for k in range(n)]
    assert n < _most_rows(found._jdf.queryExecution().executedPlan()) < 100 * n
