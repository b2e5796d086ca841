"""Reports as lines of JSON, PNG tiles and their addresses."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report_lines(reports: DataFrame, *order: str) -> DataFrame:
    """One JSON text per report in a total order, to be written with write.text."""
    return reports.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*reports.columns)).alias("value"))


def png(pixels: np.ndarray) -> bytes:
    """(h, w, 4) bytes as PNG, RGB when every pixel is opaque, else RGBA."""
    if (pixels[..., 3] == 255).all():
        pixels = pixels[..., :3]
    h, w, n = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(pixels, "u1"))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if n == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def tile_address(z: Column, x: Column, y: Column) -> Column:
    return F.concat(F.lit("tiles/"), F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string")), F.lit(".png"))


def png_tiles(pixels: DataFrame, size: int = 256) -> DataFrame:
    """(name, data) per tile of pixels(z, x, y, row, col, r, g, b, a); pixels without a row are transparent black. A group is one tile."""

    def encode(key, part):
        canvas = np.zeros((size, size, 4), "u1")
        canvas[part["row"].to_numpy(), part["col"].to_numpy()] = part[["r", "g", "b", "a"]].to_numpy()
        import pandas as pd

        return pd.DataFrame({"name": [f"tiles/{key[0]}/{key[1]}/{key[2]}.png"], "data": [png(canvas)]})

    return pixels.groupBy("z", "x", "y").applyInPandas(encode, "name string, data binary")
