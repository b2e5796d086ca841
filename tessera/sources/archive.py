"""Archives of stored members with an index of name hashes, and what is wrong with them."""

from __future__ import annotations

import hashlib
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.files import listed, opened

#: Name of the index member in the archive format's specification.
INDEX = "@3dtilesIndex1@"
SCHEMA = "archive string, name string, size long, crc long, offset long, data binary"


class ArchiveError(ValueError):
    """An archive that breaks the format's rules."""


def index_key(name: str) -> bytes:
    return hashlib.md5(name.encode()).digest()


def index_order(key: bytes) -> tuple[int, int]:
    """Rows of the index go by the two halves of the hash as little-endian numbers."""
    return struct.unpack("<QQ", key)


def catalog(path: str) -> list[tuple[str, int, int, int]]:
    """(name, size, crc, offset) of the members but the index, which is checked: last member, stored, sorted, one row per member."""
    with opened(path) as f, zipfile.ZipFile(f) as z:
        members = z.infolist()
        if not members or members[-1].filename != INDEX:
            raise ArchiveError("the index is not the last member")
        if any(m.compress_type != zipfile.ZIP_STORED for m in members):
            raise ArchiveError("a member is compressed")
        names = [m.filename for m in members]
        if len(set(names)) != len(names):
            raise ArchiveError("a name is repeated")
        for n in names:
            if n.startswith("/") or "\\" in n or any(p in ("", ".", "..") for p in n.rstrip("/").split("/")):
                raise ArchiveError(f"unsafe name {n!r}")
        index = z.read(INDEX)
    if len(index) % 24:
        raise ArchiveError("the index has a broken row")
    rows = [(index[k : k + 16], struct.unpack_from("<Q", index, k + 16)[0]) for k in range(0, len(index), 24)]
    if [index_order(r[0]) for r in rows] != sorted(index_order(r[0]) for r in rows):
        raise ArchiveError("the index is not sorted")
    if dict(rows) != {index_key(m.filename): m.header_offset for m in members[:-1]}:
        raise ArchiveError("index and members disagree")
    return [(m.filename, m.file_size, m.CRC, m.header_offset) for m in members[:-1]]


@dataclass
class Span(InputPartition):
    path: str
    members: list


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.bytes, self.with_data = options["path"], int(options.get("partitionBytes", 128 << 20)), options.get("data", "true").lower() == "true"

    def partitions(self) -> list[Span]:
        out: list[Span] = []
        for path, _ in listed(self.path, (".3tz",)):
            span, total = [], 0
            for m in catalog(path):
                if span and total + m[1] > self.bytes:
                    out.append(Span(path, span))
                    span, total = [], 0
                span.append(m)
                total += m[1]
            if span:
                out.append(Span(path, span))
        return out or [Span("", [])]

    def read(self, part: Span) -> Iterator[tuple]:
        if not part.members:
            return
        if not self.with_data:
            yield from ((part.path, *m, None) for m in part.members)
            return
        with opened(part.path) as f, zipfile.ZipFile(f) as z:
            for m in part.members:
                yield (part.path, *m, z.read(m[0]))


class ArchiveSource(DataSource):
    """spark.read.format("3tz").load(path): a row per member of an archive or a folder of archives. Options: data (false leaves the bytes out), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "3tz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))
