"""Python data sources: Arrow IPC and uncompressed LAS, read and written.

``spark.dataSource.register(ArrowIPC)``, then ``spark.read.format("arrow_ipc").schema(...).load(path)``. Paths are opened where the task runs, so they must be on storage that every executor mounts.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

#: Batches or points of one partition.
BATCHES, POINTS = 16, 1_000_000


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(glob.glob(os.path.join(path, "*.arrow"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]


def _open(path: str):
    """(reader, number of batches or None for a stream)."""
    source = pa.memory_map(path)
    try:
        reader = pa.ipc.open_file(source)
        return reader, reader.num_record_batches
    except pa.ArrowInvalid:
        source.seek(0)
        return pa.ipc.open_stream(source), None


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    end: int | None


class ArrowIPC(DataSource):
    """Arrow or Feather files and streams with ``source_index``: the position in batch and row order."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        reader, _ = _open(_files(self.options["path"])[0])
        return from_arrow_schema(reader.schema).add("source_index", "long")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrowReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ArrowWriter(self.options["path"])


class _ArrowReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names = path, schema.names

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for file in _files(self.path):
            _, n = _open(file)
            out += [_Range(file, 0, None)] if n is None else [_Range(file, i, min(n, i + BATCHES)) for i in range(0, n, BATCHES)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        reader, n = _open(partition.path)
        at = 0
        if n is None:
            batches = iter(reader)
        else:
            at = sum(reader.get_batch(i).num_rows for i in range(partition.first))  # the file is mapped: only batch headers are read
            batches = (reader.get_batch(i) for i in range(partition.first, partition.end))
        for batch in batches:
            index = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            columns = {**{f: batch.column(f) for f in batch.schema.names}, "source_index": index}
            yield pa.RecordBatch.from_arrays([columns[c] for c in self.names], names=self.names)


@dataclass
class _Wrote(WriterCommitMessage):
    path: str | None


class _ArrowWriter(DataSourceArrowWriter):
    """One IPC file per partition."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Wrote:
        os.makedirs(self.path, exist_ok=True)
        name, writer = os.path.join(self.path, f"part-{uuid.uuid4().hex}.arrow"), None
        for batch in batches:
            writer = writer or pa.ipc.new_file(name + ".tmp", batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return _Wrote(None)
        writer.close()
        return _Wrote(name)

    def commit(self, messages: list[_Wrote | None]) -> None:
        for m in messages:
            if m and m.path:
                os.replace(m.path + ".tmp", m.path)

    def abort(self, messages: list[_Wrote | None]) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path + ".tmp"):
                os.remove(m.path + ".tmp")


#: Bytes of a LAS public header field -> (offset, struct code); and where classification lies by point format.
_LAS = {"data": (96, "<I"), "format": (104, "<B"), "length": (105, "<H"), "points": (107, "<I"), "minor": (25, "<B"), "points_14": (247, "<Q"), "scale": (131, "<3d"), "offset": (155, "<3d")}


def las_header(path: str) -> dict:
    with open(path, "rb") as f:
        head = f.read(375)
    if head[:4] != b"LASF":
        raise ValueError(f"{path} is not a LAS file")
    get = lambda k: struct.unpack_from(_LAS[k][1], head, _LAS[k][0])
    out = {k: get(k)[0] for k in ("data", "format", "length", "points", "minor")} | {"scale": get("scale"), "offset": get("offset")}
    if out["format"] & 0x80:
        raise ValueError("compressed points are not read")
    if out["minor"] >= 4 and not out["points"]:
        out["points"] = get("points_14")[0]
    return out


class LAS(DataSource):
    """Points of uncompressed LAS files: source_index, x, y, z, intensity, classification."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "source_index long, x double, y double, z double, intensity int, classification int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LasReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        triple = lambda k, default: tuple(map(float, self.options.get(k, default).split(",")))
        return _LasWriter(self.options["path"], triple("scale", "0.01,0.01,0.01"), triple("offset", "0,0,0"))


class _LasReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*.las"))) if os.path.isdir(self.path) else [self.path]
        return [_Range(f, i, min(n, i + POINTS)) for f in files for n in [las_header(f)["points"]] for i in range(0, n, POINTS)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        h = las_header(partition.path)
        new = h["format"] >= 6
        kind = np.dtype({"names": ["x", "y", "z", "i", "c"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1"], "offsets": [0, 4, 8, 12, 16 if new else 15], "itemsize": h["length"]})
        for at in range(partition.first, partition.end, 65_536):
            n = min(65_536, partition.end - at)
            p = np.fromfile(partition.path, kind, n, offset=h["data"] + at * h["length"])
            xyz = [p[a] * s + o for a, s, o in zip("xyz", h["scale"], h["offset"], strict=True)]
            c = p["c"] if new else p["c"] & 31
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *map(pa.array, xyz), pa.array(p["i"].astype(np.int32)), pa.array(c.astype(np.int32))], names=["source_index", "x", "y", "z", "intensity", "classification"])


#: Length of a version 1.4 header; fields of a point of format 6; and places of other header fields.
_HEAD_14, _POINT_6 = 375, [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8")]
_LAS_MORE = {"encoding": (6, "<H"), "major": (24, "<B"), "head": (94, "<H"), "bounds": (179, "<6d"), "first_returns": (255, "<Q")}


class _LasWriter(DataSourceArrowWriter):
    """One LAS 1.4 file of points of format 6 per partition; coordinates are rounded to the scale."""

    def __init__(self, path: str, scale: tuple[float, ...], offset: tuple[float, ...]):
        if len(scale) != 3 or len(offset) != 3 or min(scale) <= 0:
            raise ValueError("scale and offset have three numbers, and scales are positive")
        self.path, self.scale, self.offset = path.removeprefix("file://"), scale, offset

    def _points(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, np.dtype(_POINT_6))
        out["returns"] = 0x11  # the first of one return
        for k, axis in enumerate("xyz"):
            whole = np.round((batch.column(axis).to_numpy(zero_copy_only=False).astype(np.float64) - self.offset[k]) / self.scale[k])
            if not (np.abs(whole) < 2**31).all():
                raise ValueError(f"{axis} is null, not finite, or too large for this scale and offset")
            out[axis] = whole
        for name, most in (("intensity", 65535), ("classification", 255)):
            if name in batch.schema.names:
                v = batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)
                if len(v) and not (0 <= v.min() and v.max() <= most):
                    raise ValueError(f"{name} lies outside of 0 to {most}")
                out[name] = v
        return out

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Wrote:
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{uuid.uuid4().hex}.las")
        count, low, high = 0, np.full(3, np.inf), np.full(3, -np.inf)
        with open(name + ".tmp", "wb") as file:
            file.write(bytes(_HEAD_14))
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = self._points(batch)
                file.write(points.tobytes())
                count += len(points)
                for k, axis in enumerate("xyz"):
                    low[k], high[k] = min(low[k], points[axis].min()), max(high[k], points[axis].max())
            file.seek(0)
            file.write(self._header(count, low, high))
        if not count:
            os.remove(name + ".tmp")
            return _Wrote(None)
        return _Wrote(name)

    def _header(self, count: int, low: np.ndarray, high: np.ndarray) -> bytes:
        """The legacy count stays 0, as points of this format ask for."""
        ends = [e[k] * self.scale[k] + self.offset[k] for k in range(3) for e in (high, low)] if count else [0.0] * 6
        head = bytearray(_HEAD_14)
        head[:4] = b"LASF"
        size = np.dtype(_POINT_6).itemsize
        known = {"data": _HEAD_14, "format": 6, "length": size, "points": 0, "minor": 4, "points_14": count, "scale": self.scale, "offset": self.offset}
        known |= {"encoding": 16, "major": 1, "head": _HEAD_14, "bounds": ends, "first_returns": count}
        for key, value in known.items():
            at, code = (_LAS | _LAS_MORE)[key]
            struct.pack_into(code, head, at, *(value if isinstance(value, (tuple, list)) else [value]))
        return bytes(head)

    commit = _ArrowWriter.commit
    abort = _ArrowWriter.abort
