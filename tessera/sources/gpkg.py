"""GeoPackage layers over sqlite3, with a partition per range of row ids."""

from __future__ import annotations

import json
import os
import sqlite3
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "layer string, fid long, srs_id int, kind string, parts array<array<array<array<double>>>>, properties string, problem string"
_KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon"}
#: Bytes of an envelope by the indicator in a geometry blob's flags.
_ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


class GeometryError(ValueError):
    """A blob that is not a supported geometry."""


def decode_wkb(data: bytes, at: int = 0) -> tuple[str, list, int]:
    """Kind, parts -> rings -> points -> numbers, and the place after the geometry. Z is kept, M refused; ISO and extended codes, both byte orders."""
    if len(data) < at + 5 or data[at] > 1:
        raise GeometryError("truncated or bad byte order")
    end = "<" if data[at] else ">"
    code = struct.unpack_from(end + "I", data, at + 1)[0]
    at += 5
    has_z, has_m = bool(code & 0x80000000), bool(code & 0x40000000)
    if code & 0x20000000:
        at += 4
    code &= 0x1FFFFFFF
    has_z, has_m, code = has_z or code // 1000 in (1, 3), has_m or code // 1000 in (2, 3), code % 1000
    if has_m or code not in _KINDS:
        raise GeometryError("unsupported geometry")
    dims = 3 if has_z else 2

    def number() -> int:
        nonlocal at
        if len(data) < at + 4:
            raise GeometryError("truncated")
        at += 4
        return struct.unpack_from(end + "I", data, at - 4)[0]

    def points(n: int) -> list[list[float]]:
        nonlocal at
        if len(data) < at + 8 * dims * n:
            raise GeometryError("truncated")
        flat = struct.unpack_from(f"{end}{dims * n}d", data, at)
        at += 8 * dims * n
        return [list(flat[k : k + dims]) for k in range(0, len(flat), dims)]

    if code == 1:
        p = points(1)
        return "Point", [] if all(v != v for v in p[0]) else [[p]], at
    if code == 2:
        p = points(number())
        return "LineString", [[p]] if p else [], at
    if code == 3:
        rings = [points(number()) for _ in range(number())]
        return "Polygon", [rings] if rings else [], at
    parts = []
    for _ in range(number()):
        kind, inner, at = decode_wkb(data, at)
        if f"Multi{kind}" != _KINDS[code]:
            raise GeometryError("mixed parts")
        parts += inner
    return _KINDS[code], parts, at


def decode_blob(blob: bytes, srs: int) -> tuple[str | None, list | None]:
    """Kind and parts of a geometry blob; (None, None) for null and empty ones. The blob's system must be its layer's."""
    if blob is None:
        return None, None
    if len(blob) < 8 or blob[:2] != b"GP" or blob[2] != 0:
        raise GeometryError("not a geometry blob")
    flags = blob[3]
    if struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)[0] != srs:
        raise GeometryError("another reference system than its layer's")
    envelope = flags >> 1 & 7
    if flags & 0x20 or envelope not in _ENVELOPE:
        raise GeometryError("extended geometry")
    if flags & 0x10:
        return None, None
    kind, parts, end = decode_wkb(blob, 8 + _ENVELOPE[envelope])
    if end != len(blob):
        raise GeometryError("bytes after the geometry")
    return (kind, parts) if parts else (None, None)


def _connect(path: str) -> sqlite3.Connection:
    """Read without locks or recovery; refused while a log or journal holds changes that this would not see."""
    real = os.path.realpath(path)
    if os.path.exists(real + "-wal") and os.path.getsize(real + "-wal"):
        raise ValueError(f"{path} has an active write-ahead log: checkpoint it and close its writer")
    if os.path.exists(real + "-journal"):
        with open(real + "-journal", "rb") as journal:
            if any(journal.read(28)):
                raise ValueError(f"{path} has an active rollback journal: recover it and close its writer")
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def layers(path: str) -> list[tuple[str, str, str, int]]:
    """(layer, geometry column, key column, srs_id) of the feature layers in name order."""
    with _connect(path) as db:
        found = db.execute("SELECT c.table_name, g.column_name, g.srs_id FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) JOIN gpkg_spatial_ref_sys s ON s.srs_id = g.srs_id WHERE c.data_type = 'features' ORDER BY 1").fetchall()
        out = []
        for table, column, srs in found:
            keys = [r[1] for r in db.execute(f"PRAGMA table_info({_name(table)})") if r[5] and r[2].upper() == "INTEGER"]
            if len(keys) != 1:
                raise ValueError(f"layer {table} has no integer primary key")
            out.append((table, column, keys[0], srs))
        return out


def selected(available: list[str], wanted: list[str] | None, every: bool) -> list[str]:
    """The layers to read: all, those named, or the only one. Unknown, repeated and ambiguous choices are refused."""
    if every:
        return list(available)
    if wanted:
        if len(set(wanted)) != len(wanted) or not set(wanted) <= set(available):
            raise ValueError(f"unknown or repeated layers in {wanted}")
        return list(wanted)
    if len(available) != 1:
        raise ValueError(f"choose from the layers {available}")
    return list(available)


@dataclass
class Rows(InputPartition):
    layer: str
    column: str
    key: str
    srs: int
    low: int
    high: int


class GpkgReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file:")
        self.wanted = json.loads(options.get("layers", "[]"))
        self.every = options.get("allLayers", "false").lower() == "true"
        self.step = int(options.get("partitionRows", 500_000))

    def partitions(self) -> list[Rows]:
        known = {name: (name, *rest) for name, *rest in layers(self.path)}
        out = []
        with _connect(self.path) as db:
            for name in selected(list(known), self.wanted, self.every):
                _, column, key, srs = known[name]
                (high,) = db.execute(f"SELECT max({_name(key)}) FROM {_name(name)}").fetchone()
                starts = f"SELECT {_name(key)} FROM {_name(name)} WHERE {_name(key)} >= ? ORDER BY 1 LIMIT 1 OFFSET ?"
                (low,) = db.execute(f"SELECT min({_name(key)}) FROM {_name(name)}").fetchone()
                while low is not None:
                    after = db.execute(starts, (low, self.step)).fetchone()
                    out.append(Rows(name, column, key, srs, low, after[0] - 1 if after else high))
                    low = after[0] if after else None
        return out or [Rows("", "", "", 0, 0, -1)]

    def read(self, part: Rows) -> Iterator[tuple]:
        if not part.layer:
            return
        with _connect(self.path) as db:
            rows = db.execute(f"SELECT * FROM {_name(part.layer)} WHERE {_name(part.key)} BETWEEN ? AND ? ORDER BY {_name(part.key)}", (part.low, part.high))
            names = [d[0] for d in rows.description]
            g, k = names.index(part.column), names.index(part.key)
            for row in rows:
                values = {n: v.hex() if isinstance(v, bytes) else v for n, v in zip(names, row) if n not in (part.column, part.key)}
                kind = parts = problem = None
                try:
                    kind, parts = decode_blob(row[g], part.srs)
                    problem = "no_geometry" if parts is None else None
                except GeometryError as e:
                    problem = str(e)
                yield (part.layer, row[k], part.srs, kind, parts, json.dumps(values, ensure_ascii=False), problem)


class GpkgSource(DataSource):
    """spark.read.format("gpkg").load(path) of one GeoPackage on a folder that all executors mount; it must not change meanwhile.

    Options: layers (JSON list of names), allLayers, partitionRows. Rows with geometry that can't be
    decoded have a problem and null parts; null and empty geometry is no_geometry.
    """

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GpkgReader:
        return GpkgReader(dict(self.options))
