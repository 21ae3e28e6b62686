"""Trajectories and vertical profiles from observation tables, by a recipe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.science import finite_value
from ..plans.spec import Recipe, SpecError
from .lines import SEGMENT_EDGES, line_segments
from .table import need


def qc_flags(code: Column | None, accepted: tuple[str, ...]) -> tuple[Column, Column]:
    """(accepted, missing). Without accepted codes all rows are accepted; a blank code is otherwise rejected."""
    if code is None:
        return F.lit(True), F.lit(False)
    text = F.coalesce(F.trim(code.cast("string")), F.lit(""))
    return (text.isin(*accepted) if accepted else F.lit(True)), text == ""


def vertical_range(c: Column, low: float, high: float) -> Column:
    if not low <= high:
        raise SpecError("the vertical range is not ordered")
    return c.between(low, high)


def validate_profile_source(df: DataFrame, r: Recipe) -> DataFrame:
    """One row: for each numeric role, whether the source has a finite value; unknown columns are an error."""
    need(df, [c for c in (r.trajectory, r.profile, r.vertical, r.latitude, r.longitude, *(v.field for v in r.values), *(v.qc_field for v in r.values)) if c])
    numeric = dict.fromkeys(c for c in (r.vertical, r.latitude, r.longitude, *(v.field for v in r.values)) if c)
    return df.agg(*(F.coalesce(F.max(finite_value(F.col(c), r.fills).isNotNull()), F.lit(False)).alias(c) for c in numeric))


def flagged(df: DataFrame, r: Recipe) -> DataFrame:
    """One row per source row and value field: no row is dropped, everything is a flag.

    (row, trajectory, profile, field, vertical, value, valid, in_range,
    qc_accepted, qc_missing)
    """
    need(df, [r.order, r.trajectory, r.profile, r.vertical])
    vertical = finite_value(F.col(r.vertical), r.fills)
    parts = []
    for v in r.values:
        accepted, missing = qc_flags(F.col(v.qc_field) if v.qc_field else None, v.accepted)
        parts.append(F.struct(F.lit(v.field).alias("field"), finite_value(F.col(v.field), r.fills).alias("value"), accepted.alias("qc_accepted"), missing.alias("qc_missing")))
    rows = df.select(F.col(r.order).alias("row"), F.col(r.trajectory).alias("trajectory"), F.col(r.profile).alias("profile"), vertical.alias("vertical"), F.explode(F.array(*parts)).alias("v"))
    inside = vertical_range(F.col("vertical"), *r.vertical_range) if r.vertical_range else F.lit(True)
    valid = F.col("vertical").isNotNull() & F.col("v.value").isNotNull() & F.col("trajectory").isNotNull() & F.col("profile").isNotNull()
    return rows.select("row", "trajectory", "profile", "v.field", "vertical", "v.value", valid.alias("valid"), (valid & F.coalesce(inside, F.lit(False))).alias("in_range"), "v.qc_accepted", "v.qc_missing")


def kept_in_sample(i: Column, n: Column, k: int) -> Column:
    """Whether position i of n is one of k evenly spread ones, in integers."""
    if k == 1:
        return i == F.floor(n / 2).cast("long")
    # i is kept if some slot s has floor(s * (n - 1) / (k - 1)) = i; the only candidate is the smallest with s * (n - 1) >= i * (k - 1)
    whole = lambda a, b: ((a - a % b) / b).cast("long")
    steps = F.greatest(n - 1, F.lit(1))
    slot = whole(i * (k - 1) + steps - 1, steps)
    return (n <= k) | (whole(slot * steps, F.lit(k - 1)) == i)


def even_downsample(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """At most k evenly spread rows of each group: all if there are no more; of one, the middle one."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"__i": (F.row_number().over(w.orderBy(*order)) - 1).cast("long"), "__n": F.count(F.lit(1)).over(w)})
    return rows.where(kept_in_sample(F.col("__i"), F.col("__n"), k)).drop("__i", "__n")


def profile_observations(df: DataFrame, r: Recipe) -> DataFrame:
    """flagged() with ``displayed``: in range and, where the recipe has a budget, one of the profile's evenly spread rows. Hidden rows stay."""
    rows = flagged(df, r)
    if r.points_per_profile is None:
        return rows.withColumn("displayed", F.col("in_range"))
    w = Window.partitionBy("field", "trajectory", "profile", "in_range")
    i = (F.row_number().over(w.orderBy("row")) - 1).cast("long")
    shown = kept_in_sample(i, F.count(F.lit(1)).over(w), r.points_per_profile)
    return rows.withColumn("displayed", F.col("in_range") & shown)


def profile_qc_summary(df: DataFrame, r: Recipe) -> DataFrame:
    """Tallies of each value field; missing codes count every source row."""
    rows = profile_observations(df, r)
    count = lambda c: F.count_if(c)
    shown = F.col("displayed")
    return rows.groupBy("field").agg(
        F.count(F.lit(1)).alias("source_rows"),
        count(F.col("valid")).alias("valid_rows"),
        count(shown).alias("displayed_rows"),
        count(F.col("in_range") & ~shown).alias("downsampled_rows"),
        count(F.col("valid") & ~F.col("in_range")).alias("range_filtered_rows"),
        count(shown & F.col("qc_accepted")).alias("accepted_rows"),
        count(shown & ~F.col("qc_accepted")).alias("rejected_rows"),
        count(F.col("qc_missing")).alias("missing_qc_rows"),
        F.count_distinct(F.when(shown, F.struct("trajectory", "profile"))).alias("profiles"),
    )


def value_ranges(df: DataFrame, r: Recipe) -> DataFrame:
    """(field, vertical and value minimum and maximum) of valid rows, whatever their QC."""
    return flagged(df, r).where("valid").groupBy("field").agg(
        F.min("vertical").alias("vertical_min"), F.max("vertical").alias("vertical_max"), F.min("value").alias("value_min"), F.max("value").alias("value_max")
    )


def trajectory_lines(df: DataFrame, r: Recipe, edges: int = SEGMENT_EDGES) -> DataFrame:
    """(trajectory, segment, points, line of (row, latitude, longitude)) of located rows that the first value's QC accepts, in source order; lines of two
    points and more, longer ones than ``edges`` in segments."""
    first = r.values[0]
    accepted, _ = qc_flags(F.col(first.qc_field) if first.qc_field else None, first.accepted)
    rows = df.select(F.col(r.order).alias("row"), F.col(r.trajectory).alias("trajectory"), finite_value(F.col(r.latitude), r.fills).alias("latitude"), finite_value(F.col(r.longitude), r.fills).alias("longitude"), accepted.alias("ok"))
    rows = rows.where("ok and latitude is not null and longitude is not null and trajectory is not null")
    return line_segments(rows, ["trajectory"], "row", ["latitude", "longitude"], edges)


def profile_lines(df: DataFrame, r: Recipe, edges: int = SEGMENT_EDGES) -> DataFrame:
    """(field, trajectory, profile, segment, points, line of (row, value, height)) of displayed and accepted rows; depths are negative heights."""
    rows = profile_observations(df, r).where("displayed and qc_accepted")
    height = -F.col("vertical") if r.positive_down else F.col("vertical")
    return line_segments(rows.withColumn("height", height), ["field", "trajectory", "profile"], "row", ["value", "height"], edges)
