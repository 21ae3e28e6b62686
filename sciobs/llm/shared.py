"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id wherever ids are compared: below every other.
NO_ID = -(2**63)
#: Rows that travel to a Python worker at once; bounds its memory when texts are long.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Session settings that the Python stages rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is set and Spark itself is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sciobs-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it again: cuts the lineage,
    survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of this library that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Deletes a table that ``keep`` wrote, once nothing that is still to run reads it."""
    for path in {file.rpartition("/")[0] for file in df.inputFiles()}:
        remove(df.sparkSession, path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def id_key(column: str = "doc_id"):
    """The id as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def one_text(rows: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label): one row of each doc_id; of several texts the one with the smallest digest, a null text first."""
    order = F.coalesce(F.sha2(F.col("text").cast("string").cast("binary"), 256), F.lit(""))
    found = rows.groupBy("doc_id", label).agg(F.min_by(F.struct("text"), order).alias("one"))
    return found.select("doc_id", "one.text", label)


#: Keys with at least this share of all rows are joined by broadcast; there are at most 1 / share of them.
HOT_SHARE = 0.001


def join_spread(left: DataFrame, right: DataFrame, on: str, hot: Column) -> DataFrame:
    """Inner join with a right side of one row a key. The keys that ``hot`` (a condition on the right side)
    marks are joined by broadcast, so that none of them meets in one task; how many they are must be bounded."""
    some, rest = F.broadcast(right.where(hot)), right.where(~hot)
    return left.join(some, on).unionByName(left.join(F.broadcast(right.where(hot).select(on)), on, "left_anti").join(rest, on))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
