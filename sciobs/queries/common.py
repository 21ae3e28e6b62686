"""Bindings of operators to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects queries and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Sums of doubles depend on the order of rows: compare them rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rnd(c: Column | str, digits: int = 4) -> Column:
    return F.round(c, digits)


def crc_sql(source: str, polynomial: int) -> str:
    """SQL of WITH clauses that give ``crcs`` (r, crc), the reflected CRC-32 of each content of a table expression (r, content BLOB).

    Bits count with constants of their own, so bytes need no table; pieces of 256 bytes are put together by what 256 zero bytes make of a register."""

    def byte(low: str) -> str:
        found = "0"
        for j in range(8):
            c = 1 << j
            for _ in range(8):
                c = (c >> 1) ^ (polynomial if c & 1 else 0)
            found = f"xor({found}, (({low} >> {j}) & 1) * {c})"
        return found

    return f"""z AS MATERIALIZED (
        SELECT list(list_reduce(list_concat([(n & 255) << (8 * (n >> 8))], range(256)), lambda c, k: xor(c >> 8, {byte("c")})) ORDER BY n) AS z FROM range(1024) AS bytes(n)
    ), d AS (SELECT r, content, octet_length(content) AS n FROM {source}
    ), padded AS (
        SELECT r, 256 * ((n + 255) // 256) - n AS pad, unnest(range((n + 255) // 256)) AS k, lpad(hex(content), CAST(512 * ((n + 255) // 256) AS INTEGER), '0') AS h FROM d
    ), pieces AS (SELECT r, pad, k, substr(h, CAST(512 * k + 1 AS BIGINT), 512) AS h FROM padded
    ), sums AS (
        SELECT r, k, list_reduce(list_concat([CAST(0 AS BIGINT)], list_transform(range(256), lambda i: xor(CASE WHEN 256 * k + i - pad BETWEEN 0 AND 3 THEN 255 ELSE 0 END, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)))),
            lambda c, x: xor(c >> 8, {byte("xor(c, x)")})) AS c FROM pieces
    ), lists AS (SELECT r, list(c ORDER BY k) AS cs FROM sums GROUP BY r
    ), crcs AS (
        SELECT r, xor(4294967295, xor(4294967295 >> (8 * least(n, 4)), coalesce(list_reduce(list_concat([CAST(0 AS BIGINT)], cs),
            lambda a, x: xor(x, xor(xor(z[(a & 255) + 1], z[((a >> 8) & 255) + 257]), xor(z[((a >> 16) & 255) + 513], z[(a >> 24) + 769])))), 0))) AS crc
        FROM d LEFT JOIN lists USING (r), z
    )"""
