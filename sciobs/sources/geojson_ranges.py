"""Large GeoJSON FeatureCollections, each read by many tasks.

A file is cut into byte ranges. What a range does to a reader of JSON depends on where the reader stands: between
values, in a string, or behind a backslash in a string. So each range is scanned for the three and tells in which of them it ends
and by how much the depth of brackets changes; a pass over these facts (one small row a range) gives every range its
true beginning. Then ranges are scanned again: features are the objects directly in the array ``features`` of the file's
object; parts of those that lie across ranges are put together by their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.spec import SpecError
from .files import feature_rows, read_file_ranges
from .scratch import kept

BETWEEN, STRING, ESCAPED = 0, 1, 2
#: Bytes that a range keeps of the one before it: the name of an array and its bracket lie within as many.
BEFORE = 256
RANGE_BYTES = 16 << 20


def brackets(raw: bytes, state: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of brackets outside strings, +1 or -1 for each, the state behind the last byte) of bytes that begin in a state."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), state
    slash = b == 0x5C
    # how many backslashes stand in a row right before each byte; one that is behind another is no start of an escape
    place = np.arange(len(b))
    last_other = np.maximum.accumulate(np.where(slash, -1, place))
    run = place - 1 - np.concatenate([[-1], last_other[:-1]])
    if state == ESCAPED:  # the byte before the first is a backslash that counts
        first = int(np.argmin(slash)) if not slash.all() else len(b)
        run[: first + 1] += 1
    quote = np.flatnonzero((b == 0x22) & (run % 2 == 0))
    inside = np.zeros(len(b) + 1, np.int8)
    inside[quote + 1] = 1
    inside = (np.cumsum(inside) + (state != BETWEEN)) % 2 == 1
    opening, closing = (b == 0x7B) | (b == 0x5B), (b == 0x7D) | (b == 0x5D)
    at = np.flatnonzero((opening | closing) & ~inside[:-1])
    end = STRING if inside[-1] else BETWEEN
    if end == STRING and slash[-1] and (run[-1] + 1) % 2 == 1:
        end = ESCAPED
    return at, np.where(opening[at], 1, -1), end


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, offset, content in zip(pdf["path"], pdf["offset"], pdf["content"], strict=True):
            made = [brackets(bytes(content), s) for s in (BETWEEN, STRING, ESCAPED)]
            rows.append((path, offset, [end for *_, end in made], [int(signs.sum()) for _, signs, _ in made]))
        yield pd.DataFrame(rows, columns=["path", "offset", "ends", "deltas"])


def _beginnings(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one file: the state and depth in which each range begins."""
    state, depth, out = BETWEEN, 0, []
    for path, offset, ends, deltas in pdf.sort_values("offset")[["path", "offset", "ends", "deltas"]].itertuples(index=False):
        out.append((path, offset, state, depth))
        state, depth = int(ends[state]), depth + int(deltas[state])
    return pd.DataFrame(out, columns=["path", "offset", "state", "depth"])


def _named(raw: bytes, bracket: int, before: bytes) -> bool:
    """Whether the array that opens at a place of a range has the name ``features``."""
    head = (before + raw[max(0, bracket - BEFORE) : bracket] if bracket < BEFORE else raw[bracket - BEFORE : bracket]).rstrip(b" \t\r\n")
    return head.endswith(b":") and head[:-1].rstrip(b" \t\r\n").endswith(b'"features"')


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of the objects in arrays of the file's object, numbered within a range from 0 (which began before), and for a range the arrays that open."""
    for pdf in batches:
        for path, offset, state, depth, raw, before in pdf[["path", "offset", "state", "depth", "content", "before"]].itertuples(index=False):
            raw, before = bytes(raw), bytes(before or b"")
            at, signs, _ = brackets(raw, int(state))
            upto = depth + np.cumsum(signs)
            b = np.frombuffer(raw, np.uint8)
            arrays = at[(signs == 1) & (upto == 2) & (b[at] == 0x5B)] if len(at) else at
            starts = at[(signs == 1) & (upto == 3) & (b[at] == 0x7B)] if len(at) else at
            stops = at[(signs == -1) & (upto == 2) & (b[at] == 0x7D)] if len(at) else at
            rows = [(path, offset, -1, int(offset + x), _named(raw, int(x), before), None) for x in arrays]
            begun, stops = starts.tolist(), stops.tolist()
            if depth >= 3:  # the range begins in an object
                stop = stops.pop(0) + 1 if stops else len(raw)
                rows.append((path, offset, 0, int(offset), False, raw[:stop]))
            for i, start in enumerate(begun):
                stop = stops[i] + 1 if i < len(stops) else len(raw)
                rows.append((path, offset, i + 1, int(offset + start), False, raw[start:stop]))
            yield pd.DataFrame(rows, columns=["path", "offset", "number", "place", "features", "piece"])


def read_large_geojson(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What ``read_geojson`` makes of FeatureCollections, for files of any length: a task holds a range, and a feature as a whole.

    Files are UTF-8 and correct JSON whose top value is the collection; features come in the file's order. The name ``features`` stands at most
    BEFORE bytes before its bracket. A file that is no collection gives no row. See ``read_file_ranges`` for where files may lie."""
    if range_bytes < 1:
        raise SpecError("a range has at least one byte")
    ranges = read_file_ranges(spark, path, range_bytes).select("path", "offset", "content")
    facts = kept(ranges.mapInPandas(_facts, "path string, offset long, ends array<int>, deltas array<long>"), "json-ranges")
    begins = facts.groupBy("path").applyInPandas(_beginnings, "path string, offset long, state int, depth long")
    # the last bytes before a range, of as many ranges as it takes
    reach = -(-BEFORE // range_bytes)
    tails = ranges.select("path", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("k"), "offset", F.expr(f"substring(content, greatest(1, octet_length(content) - {BEFORE} + 1), {BEFORE})").alias("tail"))
    tails = tails.select("path", (F.col("offset") + F.col("k") * range_bytes).alias("offset"), "k", "tail")
    before = tails.groupBy("path", "offset").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "tail"))).alias("t")).select("path", "offset", F.expr("aggregate(t, X'', (a, x) -> concat(a, x.tail))").alias("before"))
    whole = ranges.join(begins, ["path", "offset"]).join(before, ["path", "offset"], "left")
    pieces = kept(whole.mapInPandas(_pieces, "path string, offset long, number int, place long, features boolean, piece binary"), "json-pieces")
    # the array that an object lies in is the last that opened before it; few arrays open in a file's object
    arrays = pieces.where("number = -1").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "features"))).alias("arrays"))
    starts = pieces.where("number > 0").groupBy("path", "offset").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    ranged = facts.select("path", "offset").join(starts, ["path", "offset"], "left").select("path", "offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    numbered = pieces.where("number >= 0").join(ranged, ["path", "offset"]).withColumn("object", F.col("earlier") + F.col("number") - 1)
    texts = numbered.groupBy("path", "object").agg(F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"))
    texts = texts.join(arrays, "path").withColumn("own", F.element_at(F.filter("arrays", lambda a: a["place"] < F.col("first")), -1)["features"]).where("own")
    texts = texts.select("path", "object", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.piece))").cast("string").alias("text"))
    # features follow one another, so their numbers from the first one on have no gaps
    first = texts.groupBy("path").agg(F.min("object").alias("first"))
    placed = texts.join(first, "path").withColumn("feature_index", F.col("object") - F.col("first"))
    return feature_rows(placed.select(F.col("path").alias("file_path"), "feature_index", "text"))
