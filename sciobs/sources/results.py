"""Sinks: CSV, Parquet, GeoJSON, Arrow, and durable results with their provenance."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import DEFAULT_PREVIEW_ROWS
from .files import write_small


def _text(f: T.StructField) -> Column:
    """Text of a cell; nested values as JSON, null as empty."""
    c = F.col(f"`{f.name}`")
    nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
    plain = F.to_json(c) if nested else F.base64(c) if isinstance(f.dataType, T.BinaryType) else c.cast("string")
    return F.coalesce(plain, F.lit("")).alias(f.name)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Header in the frame's order; missing cells empty, nested ones as JSON."""
    df.select(*map(_text, df.schema)).write.option("header", True).option("sep", sep).option("emptyValue", "").option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, as_strings: bool = False) -> None:
    (df.select(*(c.cast("string").alias(f.name) for f in df.schema for c in [F.col(f"`{f.name}`")])) if as_strings else df).write.parquet(path)


def write_geojson(features: DataFrame, path: str) -> None:
    """One Feature per line; features (id, geometry as GeoJSON text, properties map)."""
    geometry = F.coalesce("geometry", F.lit("null"))
    line = F.concat(F.lit('{"type":"Feature","id":'), F.coalesce(F.to_json(F.struct(F.col("id").cast("string").alias("v")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.lit(1 << 30)), F.lit("null}")))
    line = F.concat(F.regexp_replace(line, r"\}$", ""), F.lit(',"geometry":'), geometry, F.lit(',"properties":'), F.coalesce(F.to_json("properties"), F.lit("null")), F.lit("}"))
    features.select(line.alias("value")).write.text(path)


def write_arrow_ipc(df: DataFrame, path: str) -> None:
    """One Arrow file per partition; needs the ``arrow_ipc`` data source."""
    from .datasources import ArrowIPC

    df.sparkSession.dataSource.register(ArrowIPC)
    df.write.format("arrow_ipc").mode("append").option("path", path).save()


def write_las(points: DataFrame, path: str, scale: Sequence[float] = (0.01, 0.01, 0.01), offset: Sequence[float] = (0.0, 0.0, 0.0)) -> None:
    """One uncompressed LAS 1.4 file per partition of points (x, y, z, and intensity and classification where they are there); needs the ``las`` data source.

    Coordinates are kept to the scale. One that is null, not finite or too far from the offset is an error; null intensities and classes are 0. Partitions without points give no file."""
    from .datasources import LAS

    points.sparkSession.dataSource.register(LAS)
    columns = [c for c in ("x", "y", "z", "intensity", "classification") if c in points.columns]
    numbers = lambda v: ",".join(repr(float(x)) for x in v)
    points.select(*columns).write.format("las").mode("append").option("path", path).option("scale", numbers(scale)).option("offset", numbers(offset)).save()


def table_checksum(df: DataFrame) -> Column:
    """An order-independent checksum of all rows, as an aggregate."""
    return F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("checksum")


def provenance(result_id: str, query: str, rows: int, checksum: str, schema: T.StructType, sources: Sequence[str] = (), citation: str | None = None, license: str | None = None, call: dict | None = None) -> dict:
    """A manifest of a result as an RO-Crate 1.1 document: its data and preview, the query that made it, what it read, rows, checksum and fields.

    ``citation`` and ``license`` are those of what was read. ``call`` (function and arguments, as JSON) makes the result again."""
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    ref = lambda i: {"@id": i}
    data, preview = f"../../data/{result_id}/", f"../../preview/{result_id}/"
    fields = [{"@id": f"#field-{k}", "@type": "PropertyValue", "name": f.name, "value": f.dataType.simpleString()} for k, f in enumerate(schema)]
    graph = [
        {"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "conformsTo": ref("https://w3id.org/ro/crate/1.1"), "about": ref("./")},
        {"@id": "./", "@type": "Dataset", "identifier": result_id, "name": query, "datePublished": now, "hasPart": [ref(data), ref(preview)], "mentions": ref("#query"), "variableMeasured": [ref(f["@id"]) for f in fields]},
        {"@id": data, "@type": "Dataset", "encodingFormat": "application/vnd.apache.parquet", "size": rows, "identifier": f"checksum:{checksum}"},
        {"@id": preview, "@type": "Dataset", "encodingFormat": "application/vnd.apache.parquet"},
        {"@id": "#query", "@type": "CreateAction", "description": query, "object": [ref(x) for x in sources], "result": ref(data), "endTime": now},
        *fields,
        *({"@id": x, "@type": "Dataset"} for x in sources),
    ]
    graph[1] |= {k: v for k, v in (("citation", citation), ("license", license)) if v is not None}
    if call is not None:
        text = json.dumps(call, sort_keys=True, default=str)
        graph.append({"@id": "#reproduction", "@type": "SoftwareSourceCode", "programmingLanguage": "JSON", "text": text})
        next(g for g in graph if g["@id"] == "#query")["instrument"] = ref("#reproduction")
    return {"@context": "https://w3id.org/ro/crate/1.1/context", "@graph": graph}


def persist_result(df: DataFrame, root: str, query: str, preview_rows: int = DEFAULT_PREVIEW_ROWS, order: Sequence[str] = (), sources: Sequence[str] = (), citation: str | None = None, license: str | None = None, call: dict | None = None) -> str:
    """Writes the data, a preview, one row of statistics and a provenance document under ``root``; returns the result's id.

    The preview holds the first rows by ``order``, then by all columns that can be sorted, so it is the same at every run.
    ``sources`` are the addresses of what was read; the document names them, with their citation, license and the call that makes the result again. See provenance()."""
    spark, began = df.sparkSession, time.time()
    result_id = f"result-{uuid.uuid4().hex[:16]}"
    where = f"{root.rstrip('/')}/data/{result_id}"
    seen = Observation()  # rows and checksum are added up by the job that writes
    df.observe(seen, F.count(F.lit(1)).alias("rows"), table_checksum(df).alias("checksum")).write.parquet(where)
    written = spark.read.parquet(where)
    sortable = [f"`{f.name}`" for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    written.orderBy(*order, *sortable).limit(preview_rows).write.parquet(f"{root.rstrip('/')}/preview/{result_id}")
    rows, checksum = seen.get["rows"], seen.get["checksum"]
    write_small(spark, f"{root.rstrip('/')}/provenance/{result_id}/ro-crate-metadata.json", json.dumps(provenance(result_id, query, rows, checksum, df.schema, sources, citation, license, call), indent=1))
    row = spark.range(1).select(F.lit(rows).cast("long").alias("rows"), F.lit(checksum).alias("checksum"))
    row.select(F.lit(result_id).alias("result_id"), F.lit(query).alias("query"), "rows", "checksum", F.lit(int((time.time() - began) * 1000)).cast("long").alias("elapsed_ms"), F.current_timestamp().alias("created_at"), F.lit(df.schema.json()).alias("schema")).write.mode("append").parquet(f"{root.rstrip('/')}/results")
    return result_id
