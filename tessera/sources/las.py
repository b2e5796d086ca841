"""LAS point clouds (formats 0-3 and 6-8) as a data source with a partition per range of records."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.files import listed, opened

_OLD = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("class_bits", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_NEW = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("flags", "u1"), ("class_bits", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2")]
_GPS = [("gps_time", "<f8")]
_RGB = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
#: Record layouts of the LAS specification by point format.
FORMATS = {0: _OLD, 1: _OLD + _GPS, 2: _OLD + _RGB, 3: _OLD + _GPS + _RGB, 6: _NEW + _GPS, 7: _NEW + _GPS + _RGB, 8: _NEW + _GPS + _RGB + [("nir", "<u2")]}

SCHEMA = "file string, ordinal long, x double, y double, z double, intensity int, return_number int, number_of_returns int, classification int, scan_angle int, user_data int, point_source_id int, gps_time double, red int, green int, blue int, nir int"


class LasError(ValueError):
    """A file that is not a supported LAS file."""


@dataclass(frozen=True)
class Header:
    form: int
    length: int
    start: int
    count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]


def read_header(head: bytes, size: int) -> Header:
    """The header's fields; refuses compressed, waveform and truncated files."""
    if len(head) < 227 or head[:4] != b"LASF":
        raise LasError("not a LAS file")
    start, form, length, count = struct.unpack_from("<I", head, 96)[0], head[104], *struct.unpack_from("<HI", head, 105)
    if form & 0x80:
        raise LasError("compressed records are not supported")
    if form not in FORMATS:
        raise LasError(f"point format {form} is not supported")
    if head[24:26] == b"\x01\x04" and len(head) >= 255:
        count = struct.unpack_from("<Q", head, 247)[0]
    if length < np.dtype(FORMATS[form]).itemsize or start + count * length > size:
        raise LasError("the header's count and the file's size disagree")
    v = struct.unpack_from("<6d", head, 131)
    return Header(form, length, start, count, v[:3], v[3:])


@dataclass
class Records(InputPartition):
    path: str
    header: Header
    first: int
    count: int


class LasReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, per_partition: int):
        self.path, self.chunk, self.per_partition = path, chunk, per_partition

    def partitions(self) -> list[Records]:
        out = []
        for path, size in listed(self.path, (".las",)):
            with opened(path) as f:
                h = read_header(f.read(375), size)
            out += [Records(path, h, k, min(self.per_partition, h.count - k)) for k in range(0, h.count, self.per_partition)]
        return out or [Records("", None, 0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        h = part.header
        fields = FORMATS[h.form]
        plain = np.dtype(fields)
        layout = np.dtype({"names": plain.names, "formats": [t for _, t in fields], "offsets": [plain.fields[n][1] for n in plain.names], "itemsize": h.length})
        with opened(part.path) as f:
            f.seek(h.start + part.first * h.length)
            for at in range(0, part.count, self.chunk):
                n = min(self.chunk, part.count - at)
                rows = np.frombuffer(f.read(n * h.length), layout)
                bits = rows["bits"].astype(np.int32)
                old = h.form < 6
                cols = {
                    "file": pa.array([part.path] * n), "ordinal": np.arange(part.first + at, part.first + at + n),
                    **{a: rows[a.upper()] * h.scale[k] + h.offset[k] for k, a in enumerate("xyz")},
                    "intensity": rows["intensity"].astype(np.int32), "return_number": bits & (7 if old else 15), "number_of_returns": bits >> 3 & 7 if old else bits >> 4,
                    "classification": rows["class_bits"].astype(np.int32) & (31 if old else 255),
                }
                for name in ("scan_angle", "user_data", "point_source_id", "gps_time", "red", "green", "blue", "nir"):
                    kind = pa.float64() if name == "gps_time" else pa.int32()
                    cols[name] = pa.array(rows[name].astype(np.float64 if name == "gps_time" else np.int32)) if name in plain.names else pa.nulls(n, kind)
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()})


class LasSource(DataSource):
    """spark.read.format("las").load(path): a file or a folder of .las files.

    Coordinates are integer * scale + offset. ordinal is the record's number in its file. Columns a
    format lacks are null. Options: chunkPoints (100000) rows a batch, partitionPoints (4000000).
    """

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        return LasReader(self.options["path"], int(self.options.get("chunkPoints", 100_000)), int(self.options.get("partitionPoints", 4_000_000)))
