"""Binary glTF of point tiles and triangle tiles, written and read back."""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Constants of the glTF 2.0 format.
MAGIC, JSON_CHUNK, BIN_CHUNK, FLOAT, UINT = 0x46546C67, 0x4E4F534A, 0x004E4942, 5126, 5125
ARRAYS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
NUMBERS = {5120: "i1", 5121: "u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}


class GlbError(ValueError):
    """Bytes that are not a supported binary glTF."""


def frame(document: dict, body: bytes) -> bytes:
    """Header and chunks, each padded to 4 bytes."""
    text = json.dumps(document, separators=(",", ":"), ensure_ascii=False).encode()
    text += b" " * (-len(text) % 4)
    body += b"\0" * (-len(body) % 4)
    chunks = struct.pack("<II", len(text), JSON_CHUNK) + text + (struct.pack("<II", len(body), BIN_CHUNK) + body if body else b"")
    return struct.pack("<III", MAGIC, 2, 12 + len(chunks)) + chunks


def unframe(data: bytes) -> tuple[dict, bytes]:
    if len(data) < 20 or struct.unpack_from("<I", data)[0] != MAGIC or struct.unpack_from("<I", data, 4)[0] != 2:
        raise GlbError("not a binary glTF 2.0")
    if struct.unpack_from("<I", data, 8)[0] != len(data):
        raise GlbError("the header's length is not the file's")
    at, chunks = 12, {}
    while at < len(data):
        n, kind = struct.unpack_from("<II", data, at)
        if at + 8 + n > len(data) or n % 4:
            raise GlbError("broken chunk")
        chunks[kind] = data[at + 8 : at + 8 + n]
        at += 8 + n
    return json.loads(chunks[JSON_CHUNK]), chunks.get(BIN_CHUNK, b"")


def accessor(document: dict, body: bytes, k: int) -> np.ndarray:
    """One accessor as (count, width) numbers; sparse ones are refused."""
    a = document["accessors"][k]
    view = document["bufferViews"][a["bufferView"]]
    if "sparse" in a or a["componentType"] not in NUMBERS or a["type"] not in ARRAYS:
        raise GlbError("unsupported accessor")
    dtype, width = np.dtype(NUMBERS[a["componentType"]]), ARRAYS[a["type"]]
    stride = view.get("byteStride", dtype.itemsize * width)
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    end = start + stride * (a["count"] - 1) + dtype.itemsize * width
    if end > view.get("byteOffset", 0) + view["byteLength"] or end > len(body):
        raise GlbError("an accessor leaves its view")
    return np.ndarray((a["count"], width), dtype, body, start, (stride, dtype.itemsize))


def points_glb(xyz: np.ndarray) -> bytes:
    """Points as 32-bit offsets from their least corner, which is the node's translation; Z up becomes Y up."""
    up = np.stack([xyz[:, 0], xyz[:, 2], -xyz[:, 1]], 1)
    origin = up.min(axis=0)
    local = (up - origin).astype("<f4")
    body = local.tobytes()
    document = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "translation": origin.tolist()}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "mode": 0}]}],
        "accessors": [{"bufferView": 0, "componentType": FLOAT, "count": len(local), "type": "VEC3", "min": local.min(axis=0).tolist(), "max": local.max(axis=0).tolist()}],
        "bufferViews": [{"buffer": 0, "byteLength": len(body), "target": 34962}], "buffers": [{"byteLength": len(body)}],
    }
    return frame(document, body)


def point_tiles(points: DataFrame, path: str = "path", ordinal: str = "ordinal") -> DataFrame:
    """(path, n, sha256, data): one binary glTF per tile, its points in order. A group is one tile, bounded by the tree's budget."""

    def encode(t: pa.Table) -> pa.Table:
        t = t.sort_by(ordinal)
        xyz = np.stack([t[a].to_numpy() for a in "xyz"], 1)
        return pa.table({path: t[path][:1], "n": pa.array([len(xyz)], pa.int64()), "data": pa.array([points_glb(xyz)], pa.binary())})

    got = points.select(path, ordinal, "x", "y", "z").groupBy(path).applyInArrow(encode, f"{path} string, n long, data binary")
    return got.select(path, "n", F.sha2("data", 256).alias("sha256"), "data")


def decoded_points(tiles: DataFrame, path: str = "path") -> DataFrame:
    """(path, k, x, y, z): the points of binary glTF tiles(path, data), back in Z up."""

    def decode(batches):
        for b in batches:
            for name, data in zip(b[path].to_pylist(), b["data"].to_pylist()):
                document, body = unframe(data)
                for node in document["nodes"]:
                    if "mesh" not in node:
                        continue
                    for p in document["meshes"][node["mesh"]]["primitives"]:
                        at = accessor(document, body, p["attributes"]["POSITION"]).astype(float) + np.asarray(node.get("translation", [0, 0, 0]))
                        yield pa.RecordBatch.from_pydict({path: [name] * len(at), "k": np.arange(len(at)), "x": at[:, 0].copy(), "y": -at[:, 2], "z": at[:, 1].copy()})

    return tiles.select(path, "data").mapInArrow(decode, f"{path} string, k long, x double, y double, z double")
