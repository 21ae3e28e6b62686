"""Jump consistent hashing against the published algorithm, and the laws of shards and slots."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sciobs.llm import queries, sharding

from .helpers import awkward, documents, empty


def jump(key: int, shards: int) -> int:
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * sharding.JUMP + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


KEYS = [0, 1, 2, 7, 256, 10863919174838991, 2016238256797177309, -1, -2, 2**63 - 1, -(2**63), *range(1000, 1200), *(i * 0x9E3779B97F4A7C15 % 2**63 for i in range(300))]


def test_published_jumps(spark):
    keys = spark.createDataFrame([(k,) for k in KEYS], "k long")
    for shards in (1, 2, 8, 9, 11, 57, 1000):
        got = {r.k: r.s for r in keys.select("k", sharding.jump(F.col("k"), shards).alias("s")).collect()}
        assert got == {k: jump(k, shards) for k in KEYS}, shards


def test_rows_that_jump_often_go_on(spark, monkeypatch):
    monkeypatch.setattr(sharding.math, "log", lambda x: -4)  # often: 0 steps
    keys = spark.createDataFrame([(k,) for k in KEYS[:40]], "k long")
    assert {r.k: r.s for r in keys.select("k", sharding.jump(F.col("k"), 300).alias("s")).collect()} == {k: jump(k, 300) for k in KEYS[:40]}


def laws(rows, shards):
    slots = {}
    for r in rows:
        assert r.law == "key" and r.grown_shard in (r.shard, shards) and 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "AT_ONCE", 3)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 2)
    rows = awkward() + [awkward()[4]] * 20 + [(None, None, "en", "s", 1)] * 5 + [(77, f"text {i}", "en", "s", 1) for i in range(30)]
    clash = documents(spark, rows).selectExpr("*", "1 AS shard", "2 AS slot", "'x' AS block", "3 AS many", "4 AS mixed", "'y' AS law", "5 AS size")
    got = sharding.shard_documents(clash).collect()
    laws(got, 8)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(-(2**63) if i is None else i, 8), jump(-(2**63) if i is None else i, 9)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert sharding.shard_documents(empty(spark)).collect() == []


def test_shards_are_even_and_growth_moves_its_share(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = sharding.shard_documents(rows).collect()
    laws(got, 8)
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) < 300
    assert abs(sum(r.grown_shard == 8 for r in got) - 20_000 / 9) < 200
    # slots are a shuffle: neighbours in a shard are not neighbours by id
    first = [r.doc_id for r in sorted(got, key=lambda r: r.slot) if r.shard == 0]
    assert sum(a < b for a, b in zip(first, first[1:], strict=False)) < 0.6 * len(first)
    moves = sharding.moved(rows.withColumn("shard", F.lit(1)), F.col("doc_id"), 8, 11).collect()
    assert all(r.new_shard >= 8 > r.shard for r in moves) and abs(len(moves) - 20_000 * 3 / 11) < 300


def test_the_plan_is_native(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    plan = sharding.shard_documents(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


def test_the_query_and_its_sql(spark, tmp_path):
    """On the awkward rows; repeated rows take each other's slots, so their order does not matter."""
    duckdb = pytest.importorskip("duckdb")
    documents(spark).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_jump_shards(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(queries.ORACLE_SQL["op12_jump_shards"])
    assert sorted(want.columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == Counter(want.fetchall())
