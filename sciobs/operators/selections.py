"""Selections resolved set at a time: every selection of a table joins its data in one job.

A row that cannot be resolved keeps its selection with an ``error``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.science import decode_sample, pick_envelope, world_to_pixel
from ..plans.spec import Affine, Aggregate
from .geometry import spatial_join
from .intervals import interval_join, interval_summaries
from .pyramid import window_statistics


def resolve_row_picks(picks: DataFrame, layers: DataFrame, data: DataFrame) -> DataFrame:
    """picks (selection_id, dataset_id, entity_path, instance_id, mapping_kind, version), layers (layer_id, dataset_id, entity_prefix,
    suffixes, mapping_kind, version, stride), data (dataset_id, source_index, ...).

    A pick is believed only if one layer of its dataset has its entity path (the prefix and an allowed suffix), kind and version; its row is instance times stride.
    """
    found = picks.join(layers.select("dataset_id", "layer_id", "entity_prefix", "suffixes", F.col("mapping_kind").alias("__kind"), F.col("version").alias("__version"), "stride"), "dataset_id", "left")
    prefix = F.col("entity_path").startswith(F.col("entity_prefix"))
    suffix = F.exists("suffixes", lambda s: F.col("entity_path") == F.concat(F.col("entity_prefix"), s))
    rank = F.when(F.col("layer_id").isNull(), 0).when(~prefix, 1).when(~suffix, 2).when(F.col("mapping_kind") != F.col("__kind"), 3).when(F.col("version") != F.col("__version"), 4).otherwise(5)
    best = found.withColumn("__rank", F.coalesce(rank, F.lit(0))).withColumn("__best", F.max("__rank").over(Window.partitionBy("selection_id"))).where("__rank = __best")
    best = best.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("selection_id"))).withColumn("__i", F.row_number().over(Window.partitionBy("selection_id").orderBy("layer_id"))).where("__i = 1")
    index = F.try_multiply("instance_id", "stride")
    error = (
        F.when(F.col("__rank") == 0, "no_layer").when(F.col("__rank") == 1, "unknown_entity").when(F.col("__rank") == 2, "unknown_part").when(F.col("__rank") == 3, "wrong_mapping_kind")
        .when(F.col("__rank") == 4, "wrong_version").when(F.col("__n") > 1, "ambiguous_layer").when(F.col("instance_id") < 0, "negative_instance").when(index.isNull(), "index_overflow")
    )
    placed = best.select("selection_id", "dataset_id", "layer_id", F.when(error.isNull(), index).alias("source_index"), error.alias("error"))
    rows = data.withColumn("__there", F.lit(True))
    out = placed.join(rows, ["dataset_id", "source_index"], "left")
    return out.withColumn("error", F.coalesce("error", F.when(F.col("__there").isNull(), "row_out_of_range"))).drop("__there")


def resolve_time_selections(selections: DataFrame, observations: DataFrame, time: str = "time", tick_seconds: float = 60.0) -> DataFrame:
    """Observations with start <= time <= end of every selection (selection_id, start, end), years and minutes alike: joined by blocks of time that cover the selections, then exactly."""
    return interval_join(selections, observations, "start", "end", time, tick_seconds)


def summarize_time_selections(selections: DataFrame, observations: DataFrame, aggregates: list[Aggregate], time: str = "time") -> DataFrame:
    """Every selection (selection_id, start, end) that holds observations, with aggregates of those with start <= time <= end: added up by blocks, so that long selections don't repeat what they share."""
    return interval_summaries(selections, observations, "start", "end", time, aggregates)


def resolve_map_selections(regions: DataFrame, features: DataFrame, exact: bool = True) -> DataFrame:
    """(region_id, feature_index) of map regions and features (exactly) or points (by box)."""
    return spatial_join(regions, features, exact)


def resolve_pixel_spectra(selections: DataFrame, cells: DataFrame, wavelengths: DataFrame, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """selections (selection_id, array_path, y, x), cells (array_path, y, x, band, value): every band of every picked pixel."""
    found = selections.join(cells, ["array_path", "y", "x"]).join(wavelengths, "band")
    return found.select("selection_id", "array_path", "y", "x", "band", "wavelength", decode_sample(F.col("value"), scale, offset).alias("value"))


def resolve_world_points(points: DataFrame, affine: Affine, rows: int, cols: int, cells: DataFrame, wavelengths: DataFrame) -> DataFrame:
    """points (selection_id, array_path, world_x, world_y) -> pixel by the affine, then its spectrum; outside is ``unavailable``."""
    col, row = world_to_pixel(F.col("world_x"), F.col("world_y"), affine)
    inside = col.between(0, cols - 1) & row.between(0, rows - 1)
    placed = points.select("selection_id", "array_path", row.alias("y"), col.alias("x"), F.when(inside, "resolved").otherwise("unavailable").alias("status"))
    spectra = cells.join(wavelengths, "band")
    hit = placed.where("status = 'resolved'").join(spectra, ["array_path", "y", "x"], "left")
    missed = placed.where("status <> 'resolved'")
    columns = ["selection_id", "array_path", "y", "x", "status", "band", "wavelength", "value"]
    return hit.select(columns).unionByName(missed, allowMissingColumns=True).select(columns)


def route_selections(selections: DataFrame, layers: DataFrame) -> DataFrame:
    """selections (selection_id, kind, dataset_id), layers (layer_id, dataset_id, kinds array): the only layer of the dataset for the kind; none or several is an error."""
    found = selections.join(layers.select("dataset_id", "layer_id", F.explode("kinds").alias("kind")), ["dataset_id", "kind"], "left")
    per = found.groupBy("selection_id", "kind", "dataset_id").agg(F.count("layer_id").alias("n"), F.min("layer_id").alias("layer_id"))
    error = F.when(F.col("kind") == "entities", "no_source_predicate").when(F.col("n") == 0, "no_layer").when(F.col("n") > 1, "ambiguous_layer")
    return per.select("selection_id", "kind", "dataset_id", F.when(error.isNull(), F.col("layer_id")).alias("layer_id"), error.alias("error"))


def resolve_links(selections: DataFrame, rules: DataFrame) -> DataFrame:
    """selections (selection_id, kind, dataset_id, revision, view_revision), rules (rule_id, kind, source_dataset, target_dataset, available, reason).

    One row for every rule that applies, with a status: a stale revision is a conflict, an unavailable rule passes through with its reason."""
    found = selections.join(rules.withColumnRenamed("source_dataset", "dataset_id"), ["kind", "dataset_id"])
    status = F.when(F.col("revision") != F.col("view_revision"), "conflict").when(~F.col("available"), "unavailable").otherwise("resolved")
    return found.select("selection_id", "rule_id", "dataset_id", "target_dataset", status.alias("status"), F.when(status == "unavailable", F.col("reason")).alias("reason"))


def resolve_point_picks(picks: DataFrame, layers: DataFrame, points: DataFrame, extent: float, projected: bool = True, cell: float = 1.0) -> DataFrame:
    """picks (selection_id, dataset_id, instance_id, source_index, mapping_kind, version, x, y), layers (dataset_id, mapping_kind, version, stride, scale).

    A pick whose index equals instance times stride under a matching mapping is
    looked up; any other falls back to all points in a small box around it.
    """
    known = picks.join(layers, ["dataset_id", "mapping_kind", "version"], "left")
    sure = F.coalesce(F.col("source_index") == F.try_multiply("instance_id", "stride"), F.lit(False))
    known = known.withColumn("verified", sure)
    exact = known.where("verified").select("selection_id", "source_index", F.lit("verified").alias("how")).join(points, "source_index")
    box = pick_envelope(F.col("x"), F.col("y"), F.coalesce("scale", F.lit(0.0)), F.lit(float(extent)), projected)
    boxes = known.where("not verified").select("selection_id", box.alias("b")).select("selection_id", "b.*")
    at = lambda c: F.floor(c / cell).cast("long")
    boxes = boxes.withColumn("__cx", F.explode(F.sequence(at(F.col("min_x")), at(F.col("max_x"))))).withColumn("__cy", F.explode(F.sequence(at(F.col("min_y")), at(F.col("max_y")))))
    laid = points.withColumns({"__cx": at(F.col("x")), "__cy": at(F.col("y"))})
    near = boxes.join(laid, ["__cx", "__cy"]).where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")))
    return exact.select("selection_id", "how", *points.columns).unionByName(near.select("selection_id", F.lit("envelope").alias("how"), *points.columns))


def resolve_raster_selections(selections: DataFrame, pixels: DataFrame, affine: Affine, rows: int, cols: int, no_data: float | None = None, pyramid: DataFrame | None = None) -> DataFrame:
    """selections (selection_id, min_x, min_y, max_x, max_y; nulls without world geometry) -> statistics of every band in each window.

    Windows are covered by squares of a pyramid of sums, which ``raster_pyramid`` makes and may have stored; only pixels along their borders are read for them."""
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n), c)).cast("long")
    window = selections.select(
        "selection_id", F.col("min_x").isNull().alias("__none"),
        clip(F.floor((F.col("min_x") - affine.a) / affine.b), cols).alias("c0"), clip(F.ceil((F.col("max_x") - affine.a) / affine.b), cols).alias("c1"),
        clip(F.floor((F.col("max_y") - affine.d) / affine.f), rows).alias("r0"), clip(F.ceil((F.col("min_y") - affine.d) / affine.f), rows).alias("r1"),
    )
    error = F.when(F.col("__none"), "no_world_geometry").when((F.col("c0") >= F.col("c1")) | (F.col("r0") >= F.col("r1")), "empty_window")
    window = window.withColumn("error", error)
    stats = window_statistics(window.where("error is null"), pixels, rows, cols, no_data, pyramid)
    bad = window.where("error is not null").select("selection_id", "error")
    return stats.unionByName(bad, allowMissingColumns=True)


def resolve_spectral_selections(selections: DataFrame, cells: DataFrame, wavelengths: DataFrame) -> DataFrame:
    """selections (selection_id, y, x, low, high): the picked pixel's bands in an inclusive wavelength range."""
    found = selections.join(cells, ["y", "x"]).join(wavelengths, "band").where(F.col("wavelength").between(F.col("low"), F.col("high")))
    return found.select("selection_id", "y", "x", "band", "wavelength", "value")


def latest_selection(selections: DataFrame, view: str = "view_id", created: str = "created_at") -> DataFrame:
    """The most recent selection of each view: one aggregation, no sort."""
    columns = selections.columns
    last = selections.groupBy(view).agg(F.max_by(F.struct(*columns), F.struct(created, "selection_id")).alias("s"))
    return last.select(*(F.col("s")[c].alias(c) for c in columns))
