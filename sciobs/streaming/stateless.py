"""Stateless operators on streams: filters, projections, flags and row functions are plain columns, so they run on a streaming DataFrame unchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.profiles import flagged
from ..operators.table import filter_all, project
from ..plans.spec import Filter, Recipe


def stream_filter(df: DataFrame, filters: Sequence[Filter], select: Sequence[str] = ()) -> DataFrame:
    return project(filter_all(df, filters), select)


def stream_flags(df: DataFrame, recipe: Recipe) -> DataFrame:
    """Validity, range and QC flags of each value as observations arrive; sampling needs whole profiles and stays a batch step."""
    return flagged(df, recipe)


def append_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to Parquet, exactly once, and ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(df: DataFrame, time: str, width: str, late: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per window of event time and key; rows later than ``late`` are left out, so state stays bounded."""
    return df.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))
