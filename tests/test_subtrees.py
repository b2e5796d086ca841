"""Binary subtrees: an exact round trip, bytes by hand, and damaged ones."""

import json
import random
import struct

import pytest

from tessera.sinks.subtree import availability, subtrees
from tessera.sources.subtree import SubtreeError, decode, listed_tiles

SCHEMA = "level int, place long, content boolean"


def tree(dims, depth, leaves, seed):
    rng = random.Random(seed)
    out = {}
    for _ in range(leaves):
        place = rng.randrange(1 << dims * depth)
        for k in range(depth + 1):
            at = (depth - k, place >> dims * k)
            out[at] = out.get(at, False) or rng.random() < 0.3
    return [(*at, c) for at, c in out.items()]


@pytest.mark.parametrize("dims,levels,depth,leaves", [(2, 3, 7, 90), (3, 2, 5, 60), (2, 1, 3, 20), (3, 4, 3, 4000), (2, 5, 0, 1)])
def test_round_trip(spark, dims, levels, depth, leaves):
    rows = tree(dims, depth, leaves, leaves)
    frame = spark.createDataFrame(rows + rows[:3], SCHEMA)
    packed = subtrees(frame, dims, levels)
    assert sorted(tuple(r) for r in listed_tiles(packed, dims, levels).collect()) == sorted(rows)
    roots = {(r["level"], r["place"]): bytes(r["data"]) for r in packed.collect()}
    assert set(roots) == {(v - v % levels, p >> dims * (v % levels)) for v, p, _ in rows}
    below = {(v + levels, (p << dims * levels) + c) for (v, p), data in roots.items() for c in decode(data, dims, levels)[1]}
    assert below == set(roots) - {(0, 0)}
    again = subtrees(frame.repartition(5), dims, levels).collect()
    assert {(r["level"], r["place"]): bytes(r["data"]) for r in again} == roots


def test_bytes(spark):
    frame = spark.createDataFrame([(0, 0, True), (1, 2, True), (1, 2, None)], SCHEMA)
    (row,) = subtrees(frame, 2, 2).collect()
    doc = {"tileAvailability": {"bitstream": 0, "availableCount": 2}, "contentAvailability": [{"bitstream": 1, "availableCount": 2}], "childSubtreeAvailability": {"constant": 0}}
    doc |= {"buffers": [{"byteLength": 16}], "bufferViews": [{"buffer": 0, "byteOffset": 0, "byteLength": 1}, {"buffer": 0, "byteOffset": 8, "byteLength": 1}]}
    text = json.dumps(doc, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 8)
    assert bytes(row["data"]) == b"subt" + struct.pack("<IQQ", 1, len(text), 16) + text + bytes([0b1001]) + bytes(7) + bytes([0b1001]) + bytes(7)
    got = {r["stream"]: (r["available"], r["constant"]) for r in availability(frame, 2, 2).collect()}
    assert got == {"tile": (2, None), "content": (2, None), "child": (0, 0)}


def framed(doc, body=b""):
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 8)
    return b"subt" + struct.pack("<IQQ", 1, len(text), len(body)) + text + body


def test_damaged():
    def doc(tile=None, content=None, child=None, views=((0, 1),), **more):
        return {"tileAvailability": tile or {"bitstream": 0}, "contentAvailability": content or [], "childSubtreeAvailability": child or {"constant": 0}, "buffers": [{"byteLength": 8}], "bufferViews": [{"buffer": 0, "byteOffset": a, "byteLength": n} for a, n in views]} | more

    good = bytes([0b1001]) + bytes(7)
    assert decode(framed(doc(), good), 2, 2) == ([(0, 0, False), (1, 2, False)], [])
    whole = framed({"tileAvailability": {"constant": 1}, "childSubtreeAvailability": {"constant": 1}})
    assert len(decode(whole, 2, 2)[0]) == 5 and len(decode(whole, 2, 2)[1]) == 16
    bad = [b"", b"subt", framed(doc(), good)[:-1], framed(doc(), good) + b"x", b"SUBT" + framed(doc(), good)[4:], framed([]), framed({}), framed(doc(), bytes([0b1000]) + bytes(7)), framed(doc(), bytes([0b101001]) + bytes(7))]
    bad += [framed(doc(views=v), good) for v in (((0, 2),), ((8, 1),), ((-1, 1),))] + [framed(doc(tile=t), good) for t in ({"constant": 2}, {"constant": True}, {"bitstream": 1}, {"bitstream": 0, "constant": 1}, {"bitstream": 0, "availableCount": 3})]
    bad += [framed(doc(content=[{"constant": 1}]), good), framed(doc(child={"constant": 1}), good), framed(doc(buffers=[{"byteLength": 8, "uri": "x"}]), good), framed(doc(buffers=[{"byteLength": 80}]), good)]
    for data in bad:
        with pytest.raises(SubtreeError):
            decode(data, 2, 2)


def test_refused_tiles(spark):
    for row in [(None, 0, True), (0, None, True), (-1, 0, True)]:
        with pytest.raises(Exception, match="without level or place"):
            subtrees(spark.createDataFrame([row], SCHEMA), 2, 2).collect()
    with pytest.raises(ValueError):
        subtrees(spark.createDataFrame([], SCHEMA), 3, 9)
    empty = subtrees(spark.createDataFrame([], SCHEMA), 2, 2)
    assert empty.count() == 0 and listed_tiles(empty, 2, 2).count() == 0
