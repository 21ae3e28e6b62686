"""Table operators on events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.science import finite_value
from ..operators import table as t
from ..plans.spec import Aggregate, Filter, Sort, TableQuery
from ..sources.files import read_parquet_indexed
from .common import Registry, read, rounded

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql


@query("table_query", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean_value, max(value) AS max_value FROM events WHERE event_type IN ('view', 'click', 'purchase') AND value >= 10 GROUP BY event_type")
def table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = TableQuery(
        filters=[Filter("event_type", "in", ["view", "click", "purchase"]), Filter("value", "gte", 10)], group_by=["event_type"],
        aggregates=[Aggregate("count", "*", "n"), Aggregate("mean", "value", "mean_value"), Aggregate("max", "value", "max_value")], order_by=[Sort("n", descending=True)], limit=100,
    )
    return rounded(t.table_query(read(spark, sf_dir, "events"), q).data, "mean_value")


@query("project", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.project(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey", "o_totalprice"])


def _filter(name: str, table: str, filters: list[Filter], columns: list[str], where: str) -> None:
    @query(name, f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return t.project(t.filter_all(read(spark, sf_dir, table), filters), columns)


_filter("filter_eq", "orders", [Filter("o_orderstatus", "eq", "F")], ["o_orderkey", "o_orderstatus"], "o_orderstatus = 'F'")
_filter("filter_ne", "orders", [Filter("o_orderstatus", "ne", "F"), Filter("o_orderpriority", "ne", None)], ["o_orderkey", "o_orderstatus"], "o_orderstatus <> 'F' AND o_orderpriority IS NOT NULL")
_filter("filter_is_null", "events", [Filter("value", "eq", None)], ["event_id"], "value IS NULL")
_filter("filter_range", "lineitem", [Filter("l_quantity", "gte", 10), Filter("l_quantity", "<", 20), Filter("l_discount", ">", 0.05), Filter("l_tax", "lte", 0.04)], ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity >= 10 AND l_quantity < 20 AND l_discount > 0.05 AND l_tax <= 0.04")
_filter("filter_contains", "part", [Filter("p_type", "contains", "ECON"), Filter("p_size", "contains", 1)], ["p_partkey", "p_type", "p_size"], "contains(p_type, 'ECON') AND contains(CAST(p_size AS VARCHAR), '1')")
_filter("filter_in", "events", [Filter("event_type", "in", ["signup", "error"])], ["event_id", "event_type"], "event_type IN ('signup', 'error')")
_filter("filter_in_empty", "events", [Filter("event_type", "in", [])], ["event_id", "event_type"], "false")
_filter("filter_all", "lineitem", [Filter("l_returnflag", "=", "R"), Filter("l_linestatus", "!=", "O"), Filter("l_extendedprice", ">=", 1000.0)], ["l_orderkey", "l_linenumber"], "l_returnflag = 'R' AND l_linestatus <> 'O' AND l_extendedprice >= 1000")


@query("aggregate", "SELECT count(*) AS n, count(l_tax) AS n_tax, round(sum(l_quantity), 2) AS sum_quantity, round(avg(l_discount), 6) AS mean_discount, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem")
def aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = t.group_aggregate(read(spark, sf_dir, "lineitem"), [], [Aggregate("count", "*", "n"), Aggregate("count", "l_tax", "n_tax"), Aggregate("sum", "l_quantity", "sum_quantity"), Aggregate("avg", "l_discount", "mean_discount"), Aggregate("min", "l_extendedprice", "min_price"), Aggregate("max", "l_extendedprice", "max_price")])
    return rounded(rounded(made, "sum_quantity", digits=2), "mean_discount", digits=6)


@query("group_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_quantity), 4) AS mean_quantity FROM lineitem GROUP BY 1, 2")
def group_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = t.group_aggregate(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [Aggregate("count", "*", "n"), Aggregate("sum", "l_extendedprice", "sum_price"), Aggregate("mean", "l_quantity", "mean_quantity")])
    return rounded(rounded(made, "sum_price", digits=2), "mean_quantity")


@query("matched_count", "SELECT count(*) AS matched_rows FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity > 30")
def matched_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.matched_count(read(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz")).withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd")), [Filter("day", "gte", "1995-01-01"), Filter("l_quantity", "gt", 30)])


@query("order_by", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice ASC NULLS FIRST, o_orderkey LIMIT 500")
def order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.order_by(read(spark, sf_dir, "orders"), [Sort("o_orderpriority", descending=True), Sort("o_totalprice", nulls_first=True), Sort("o_orderkey")])
    return t.bounded_limit(t.project(rows, ["o_orderkey", "o_orderpriority", "o_totalprice"]), 500)


@query("bounded_limit", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100000")
def bounded_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.order_by(read(spark, sf_dir, "lineitem"), [Sort("l_orderkey"), Sort("l_linenumber")])
    return t.bounded_limit(t.project(rows, ["l_orderkey", "l_linenumber"]), 10_000_000)


def _indexed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet_indexed(spark, f"{sf_dir}/{name}.parquet").drop("file_path")


@query("read_parquet_indexed", "SELECT o_orderkey, row_number() OVER () - 1 AS source_index FROM orders")
def read_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, "orders").select("o_orderkey", "source_index")


@query("preview", "SELECT source_index, CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER () - 1 AS source_index FROM orders) WHERE source_index < 200")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.preview(_indexed(spark, sf_dir, "orders").select("source_index", "o_orderkey", "o_orderstatus"), 200)


_ROWS = [1200, 7, 999, 0, 1499, 42]


@query("source_rows", f"SELECT list_position({_ROWS}, source_index) - 1 AS position, source_index, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER () - 1 AS source_index FROM orders) WHERE source_index IN ({', '.join(map(str, _ROWS))})")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.source_rows(_indexed(spark, sf_dir, "orders"), _ROWS, ["o_orderkey", "o_totalprice"])


@query("constraint_filter", "SELECT user_id, value, event_type FROM events WHERE value >= 5 AND value <= 50 AND event_type <> 'error'")
def constraint_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.constraint_filter(read(spark, sf_dir, "events"), ["user_id", "value", "event_type"], [Filter("value", ">=", 5), Filter("value", "<=", 50), Filter("event_type", "!=", "error")])


@query("temporal_bounds", "SELECT event_id FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time FROM events) WHERE time >= '2024-01-05T00:00:00' AND time <= '2024-01-20T00:00:00' AND value > 1")
def temporal_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("time", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.temporal_bounds(rows, "time", "2024-01-05T00:00:00", "2024-01-20T00:00:00", [Filter("value", ">", 1)]).select("event_id")


@query("numeric_series_melt", """SELECT "row", field, value FROM (
    SELECT event_id AS "row", 'value' AS field, CAST(value AS DOUBLE) AS value FROM events UNION ALL
    SELECT event_id, 'event_type', TRY_CAST(event_type AS DOUBLE) FROM events UNION ALL SELECT event_id, 'user_id', CAST(user_id AS DOUBLE) FROM events) WHERE value IS NOT NULL""")
def numeric_series_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.numeric_series_melt(read(spark, sf_dir, "events"), ["value", "event_type", "user_id"], index="event_id")


@query("stride_sample", "SELECT o_orderkey FROM (SELECT *, row_number() OVER () - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i % CAST(ceil(n / 1000.0) AS BIGINT) = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.stride_sample(_indexed(spark, sf_dir, "orders"), 1000).select("o_orderkey")


@query("finite_value", "SELECT event_id, CASE WHEN trim(k) IN ('5', '7') THEN NULL ELSE TRY_CAST(trim(k) AS DOUBLE) END AS k FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)")
def finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", finite_value(F.get_json_object("props", "$.k"), ["5", "7.0"]).alias("k"))


@query("class_elevation_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (2, 5) AND l_discount >= 0.02 AND l_discount <= 0.06")
def class_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.class_elevation_filter(read(spark, sf_dir, "lineitem"), [2, 5], 0.02, 0.06, z="l_discount", classification="l_linenumber").select("l_orderkey", "l_linenumber")
