"""Tiles listed from binary subtrees (3D Tiles 1.1)."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.sinks.subtree import stream_bits


class SubtreeError(ValueError):
    """Bytes that are not one well-formed subtree."""


def _bits(value: object, size: int, views: list, body: bytes) -> np.ndarray:
    """The numbers of the bits that are set."""
    if not isinstance(value, dict) or ("constant" in value) == ("bitstream" in value):
        raise SubtreeError("an availability is a constant or a bit stream")
    if "constant" in value:
        if value["constant"] not in (0, 1) or isinstance(value["constant"], bool):
            raise SubtreeError("constants are 0 or 1")
        found = np.arange(size * value["constant"])
    else:
        at = value["bitstream"]
        if type(at) is not int or not 0 <= at < len(views) or not isinstance(views[at], dict):
            raise SubtreeError("no such buffer view")
        start, length = views[at].get("byteOffset", 0), views[at].get("byteLength")
        if views[at].get("buffer") != 0 or type(start) is not int or type(length) is not int or start < 0 or start + length > len(body):
            raise SubtreeError("a buffer view outside the internal buffer")
        if length != -(-size // 8):
            raise SubtreeError(f"a stream of {size} bits in {length} bytes")
        every = np.unpackbits(np.frombuffer(body, np.uint8, length, start), bitorder="little")
        if every[size:].any():
            raise SubtreeError("unused bits are set")
        found = np.flatnonzero(every[:size])
    if value.get("availableCount", len(found)) != len(found):
        raise SubtreeError("availableCount is not the number of bits")
    return found


def decode(data: bytes, dims: int, levels: int) -> tuple[list[tuple[int, int, bool]], list[int]]:
    """(level, place, content) below the subtree's root, which is (0, 0), and the places of its child subtrees.

    Refused: foreign or truncated bytes, external buffers, wrong stream lengths or counts, set unused bits,
    tiles without their parent, contents without their tile, child subtrees without a tile above.
    """
    tiles, _, children = stream_bits(dims, levels)
    if len(data) < 24 or data[:4] != b"subt":
        raise SubtreeError("not a subtree")
    version, text, size = struct.unpack_from("<IQQ", data, 4)
    if version != 1 or text % 8 or size % 8 or len(data) != 24 + text + size:
        raise SubtreeError("header and length differ")
    try:
        doc = json.loads(data[24 : 24 + text])
    except ValueError as e:
        raise SubtreeError("the document is not JSON") from e
    if not isinstance(doc, dict):
        raise SubtreeError("the document is not an object")
    body, views, buffers = data[24 + text :], doc.get("bufferViews", []), doc.get("buffers", [])
    if not isinstance(views, list) or not isinstance(buffers, list) or (views and (len(buffers) != 1 or not isinstance(buffers[0], dict) or "uri" in buffers[0])):
        raise SubtreeError("only the internal buffer is read")
    if buffers:
        length = buffers[0].get("byteLength") if isinstance(buffers[0], dict) else None
        if type(length) is not int or not size - 8 < length <= size:
            raise SubtreeError("the buffer's length differs from its chunk")
        body = body[:length]
    here = _bits(doc.get("tileAvailability"), tiles, views, body)
    contents = doc.get("contentAvailability", [])
    if not isinstance(contents, list):
        raise SubtreeError("contentAvailability is a list")
    filled = np.unique(np.concatenate([np.arange(0), *(_bits(c, tiles, views, body) for c in contents)]))
    below = _bits(doc.get("childSubtreeAvailability"), children, views, body)
    present = np.zeros(tiles, bool)
    present[here] = True
    first = tiles - (1 << dims * (levels - 1))
    if not present[:1].all() or not present[(here[here > 0] - 1) >> dims].all():
        raise SubtreeError("a tile without its parent")
    if not present[filled].all() or not present[first + (below >> dims)].all():
        raise SubtreeError("a content or child subtree without its tile")
    starts = [((1 << dims * k) - 1) // ((1 << dims) - 1) for k in range(levels)]
    depth = np.searchsorted(starts, here, "right") - 1
    has = np.isin(here, filled)
    return [(int(d), int(i - starts[d]), bool(c)) for i, d, c in zip(here, depth, has)], below.tolist()


def listed_tiles(subtrees: DataFrame, dims: int, levels: int) -> DataFrame:
    """(level, place, content) of all tiles in subtrees(level, place, data); a damaged one fails the job. Null data has no tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for level, place, data in zip(*(b.column(n).to_pylist() for n in ("level", "place", "data"))):
                rows = [] if data is None else decode(data, dims, levels)[0]
                columns = [pa.array([level + d for d, _, _ in rows], pa.int32()), pa.array([(place << dims * d) + p for d, p, _ in rows], pa.int64()), pa.array([c for _, _, c in rows], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["level", "place", "content"])

    return subtrees.select("level", "place", "data").mapInArrow(run, "level int, place long, content boolean")
