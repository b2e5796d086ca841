"""Availability of implicit tiles as binary subtrees (3D Tiles 1.1).

Tiles are (level, place, content): place is the Morton number within the level, dims 2 for quadtrees and
3 for octrees, levels the number of levels that a subtree holds. Repeated tiles count once, with content if
any has it; null levels or places are refused.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STREAMS = ("tile", "content", "child")
#: No stream of a subtree has more bits than this, so that one task can hold it.
MOST_BITS = 1 << 22


def stream_bits(dims: int, levels: int) -> tuple[int, int, int]:
    """The number of bits of each of STREAMS."""
    if dims not in (2, 3) or levels < 1 or 1 << dims * levels > MOST_BITS:
        raise ValueError(f"subtrees of {levels} levels in {dims} dimensions")
    tiles = ((1 << dims * levels) - 1) // ((1 << dims) - 1)
    return tiles, tiles, 1 << dims * levels


def availability(tiles: DataFrame, dims: int, levels: int) -> DataFrame:
    """(root_level, root_place, stream, available, constant, words) for each subtree and each of STREAMS.

    Bits are or-ed to 64-bit words before they are exchanged; a stream of one value has it as constant and no words.
    """
    totals = stream_bits(dims, levels)
    bad = F.col("level").isNull() | F.col("place").isNull() | (F.col("level") < 0) | (F.col("place") < 0)
    level = F.when(bad, F.raise_error(F.lit("a tile without level or place")).cast("int")).otherwise(F.col("level").cast("int"))
    t = tiles.select(level.alias("level"), F.col("place").cast("long").alias("place"), F.coalesce(F.col("content").cast("boolean"), F.lit(False)).alias("content"))
    depth = F.col("level") % levels
    below = f"{dims} * (level % {levels})"
    inner = t.withColumn("bit", F.expr(f"(shiftleft(1L, {below}) - 1) div {(1 << dims) - 1} + place % shiftleft(1L, {below})"))
    at = inner.select((F.col("level") - depth).alias("root_level"), F.expr(f"shiftright(place, {below})").alias("root_place"), "bit", F.explode(F.when(F.col("content"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("s"))
    roots = t.where((depth == 0) & (F.col("level") > 0))
    children = roots.select((F.col("level") - levels).alias("root_level"), F.shiftright("place", dims * levels).alias("root_place"), (F.col("place") % (1 << dims * levels)).alias("bit"), F.lit(2).alias("s"))
    key = ["root_level", "root_place", "s"]
    words = at.unionByName(children).groupBy(*key, F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("value"))
    found = words.groupBy(*key).agg(F.sum(F.expr("bit_count(value)")).cast("long").alias("available"), F.array_sort(F.collect_list(F.struct("word", "value"))).alias("words"))
    every = found.select("root_level", "root_place").distinct().withColumn("s", F.explode(F.array(*(F.lit(k) for k in range(3)))))
    full = every.join(found, key, "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    total = F.element_at(F.array(*(F.lit(n).cast("long") for n in totals)), F.col("s") + 1)
    constant = F.when(F.col("available") == 0, 0).when(F.col("available") == total, 1)
    name = F.element_at(F.array(*(F.lit(n) for n in STREAMS)), F.col("s") + 1)
    return full.select("root_level", "root_place", name.alias("stream"), "available", constant.alias("constant"), F.when(constant.isNull(), F.col("words")).alias("words"))


def _encoded(streams: dict[str, dict], sizes: dict[str, int]) -> bytes:
    body, views, doc = bytearray(), [], {}
    for name, field in (("tile", "tileAvailability"), ("content", "contentAvailability"), ("child", "childSubtreeAvailability")):
        s = streams[name]
        if s["constant"] is None:
            bits = bytearray(-(-sizes[name] // 64) * 8)
            for w in s["words"]:
                struct.pack_into("<q", bits, 8 * w["word"], w["value"])
            length = -(-sizes[name] // 8)
            views.append({"buffer": 0, "byteOffset": len(body), "byteLength": length})
            body += bits[:length] + bytes(-length % 8)
            value = {"bitstream": len(views) - 1, "availableCount": s["available"]}
        else:
            value = {"constant": s["constant"]}
        doc[field] = [value] if name == "content" else value
    if views:
        doc |= {"buffers": [{"byteLength": len(body)}], "bufferViews": views}
    text = json.dumps(doc, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    return b"subt" + struct.pack("<IQQ", 1, len(text), len(body)) + text + bytes(body)


def subtrees(tiles: DataFrame, dims: int, levels: int) -> DataFrame:
    """(level, place, data): one binary subtree for each root at a multiple of levels. The bytes don't depend on the rows' order."""
    sizes = dict(zip(STREAMS, stream_bits(dims, levels)))
    streams = F.collect_list(F.struct("stream", "available", "constant", "words"))
    grouped = availability(tiles, dims, levels).groupBy(F.col("root_level").alias("level"), F.col("root_place").alias("place")).agg(streams.alias("streams"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                data = _encoded({s["stream"]: s for s in row.column("streams")[0].as_py()}, sizes)
                yield pa.RecordBatch.from_arrays([row.column("level"), row.column("place"), pa.array([data], pa.binary())], ["level", "place", "data"])

    return grouped.mapInArrow(run, "level int, place long, data binary")
