"""Profile operators on events: a user's events of a day as a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles as p
from ..plans.spec import Recipe, ValueRole
from .common import Registry, read, rnd

query = Registry()
QUERIES, ORACLE_SQL = query.queries, query.sql
RECIPE = Recipe("user_id", "day", "k", (ValueRole("value", "event_type", ("view", "click")),), order="event_id", latitude="k", longitude="value", vertical_range=(10.0, 80.0), points_per_profile=3, fills=("13",))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.get_json_object("props", "$.k").alias("k"), "value", "event_type")


_FLAGS = """
    WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN json_extract_string(props, '$.k') = '13' THEN NULL ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k,
                      CASE WHEN value = 13 THEN NULL ELSE value END AS value, event_type FROM events),
    f AS (SELECT event_id AS row, user_id AS trajectory, day AS profile, k AS vertical, value, k IS NOT NULL AND value IS NOT NULL AS valid,
                 coalesce(k IS NOT NULL AND value IS NOT NULL AND k BETWEEN 10 AND 80, false) AS in_range, event_type IN ('view', 'click') AS qc_accepted, trim(event_type) = '' AS qc_missing FROM e),
    g AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY trajectory, profile, in_range) AS n FROM f WINDOW w AS (PARTITION BY trajectory, profile, in_range ORDER BY row)),
    o AS (SELECT *, in_range AND (n <= 3 OR i IN (0, (n - 1) // 2, n - 1)) AS displayed FROM g)"""


@query("validate_profile_source", _FLAGS + " SELECT bool_or(vertical IS NOT NULL) AS k, bool_or(value IS NOT NULL) AS value FROM f")
def validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.validate_profile_source(_events(spark, sf_dir), RECIPE)


@query("qc_flag", "SELECT event_id, event_type IN ('view', 'click') AS qc_accepted, trim(event_type) = '' AS qc_missing FROM events")
def qc_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, missing = p.qc_flags(F.col("event_type"), ("view", "click"))
    return _events(spark, sf_dir).select("event_id", accepted.alias("qc_accepted"), missing.alias("qc_missing"))


@query("vertical_range", _FLAGS + " SELECT row, vertical FROM f WHERE vertical BETWEEN 10 AND 80")
def vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.flagged(_events(spark, sf_dir), RECIPE).where(p.vertical_range(F.col("vertical"), 10, 80)).select("row", "vertical")


@query("even_downsample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 5 OR i IN (0, (n - 1) // 4, 2 * (n - 1) // 4, 3 * (n - 1) // 4, n - 1)")
def even_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.even_downsample(read(spark, sf_dir, "events"), ["user_id"], ["event_id"], 5).select("event_id")


@query("profile_observations", _FLAGS + " SELECT row, trajectory, profile, vertical, value, valid, in_range, displayed, qc_accepted, qc_missing FROM o")
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile_observations(_events(spark, sf_dir), RECIPE).select("row", "trajectory", "profile", "vertical", "value", "valid", "in_range", "displayed", "qc_accepted", "qc_missing")


@query("profile_qc_summary", _FLAGS + """ SELECT 'value' AS field, count(*) AS source_rows, count(*) FILTER (valid) AS valid_rows, count(*) FILTER (displayed) AS displayed_rows, count(*) FILTER (in_range AND NOT displayed) AS downsampled_rows,
    count(*) FILTER (valid AND NOT in_range) AS range_filtered_rows, count(*) FILTER (displayed AND qc_accepted) AS accepted_rows, count(*) FILTER (displayed AND NOT qc_accepted) AS rejected_rows,
    count(*) FILTER (qc_missing) AS missing_qc_rows, count(DISTINCT CASE WHEN displayed THEN trajectory || '/' || profile END) AS profiles FROM o""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile_qc_summary(_events(spark, sf_dir), RECIPE)


@query("value_ranges", _FLAGS + " SELECT 'value' AS field, min(vertical) AS vertical_min, max(vertical) AS vertical_max, min(value) AS value_min, max(value) AS value_max FROM f WHERE valid")
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.value_ranges(_events(spark, sf_dir), RECIPE)


@query("trajectory_lines", _FLAGS + """ SELECT trajectory, count(*) AS points, min(row) AS first_row, max(row) AS last_row, round(sum(vertical * (rn % 7)), 4) AS weighted FROM
    (SELECT *, row_number() OVER (PARTITION BY trajectory ORDER BY row) - 1 AS rn FROM f WHERE qc_accepted AND valid) GROUP BY trajectory HAVING count(*) >= 2""")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = p.trajectory_lines(_events(spark, sf_dir), RECIPE)
    weighted = F.aggregate(F.transform("line", lambda x, i: x["latitude"] * (i % 7)), F.lit(0.0), lambda a, b: a + b)
    return lines.select("trajectory", F.col("points").cast("long").alias("points"), F.col("line")[0]["row"].alias("first_row"), F.element_at("line", -1)["row"].alias("last_row"), rnd(weighted).alias("weighted"))


@query("profile_lines", _FLAGS + """ SELECT trajectory, profile, count(*) AS points, min(row) AS first_row, max(row) AS last_row, round(sum(-vertical), 4) AS height FROM o WHERE displayed AND qc_accepted GROUP BY 1, 2 HAVING count(*) >= 2""")
def profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = p.profile_lines(_events(spark, sf_dir), RECIPE)
    height = F.aggregate(F.transform("line", lambda x: x["height"]), F.lit(0.0), lambda a, b: a + b)
    return lines.select("trajectory", "profile", F.col("points").cast("long").alias("points"), F.col("line")[0]["row"].alias("first_row"), F.element_at("line", -1)["row"].alias("last_row"), rnd(height).alias("height"))


@query("trajectory_segments", _FLAGS + """, n AS (SELECT *, row_number() OVER (PARTITION BY trajectory ORDER BY row) - 1 AS i FROM f WHERE qc_accepted AND valid),
    s AS (SELECT *, i // 7 AS segment FROM n UNION ALL SELECT *, i // 7 - 1 FROM n WHERE i % 7 = 0 AND i > 0)
    SELECT trajectory, CAST(segment AS INTEGER) AS segment, count(*) AS points, min(row) AS first_row, max(row) AS last_row, round(sum(vertical), 4) AS total FROM s GROUP BY 1, 2 HAVING count(*) >= 2""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in segments of seven edges."""
    lines = p.trajectory_lines(_events(spark, sf_dir), RECIPE, 7)
    total = F.aggregate(F.transform("line", lambda x: x["latitude"]), F.lit(0.0), lambda a, b: a + b)
    return lines.select("trajectory", "segment", F.col("points").cast("long").alias("points"), F.col("line")[0]["row"].alias("first_row"), F.element_at("line", -1)["row"].alias("last_row"), rnd(total).alias("total"))
