"""Sources and sinks against files made by hand and exact round trips."""

import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest

from tessera.sinks.archive import package, write_archive
from tessera.sinks.glb import GlbError, decoded_points, point_tiles, unframe
from tessera.sinks.text import png, report_lines
from tessera.sources.archive import ArchiveError, ArchiveSource, catalog
from tessera.sources.geojson import crs_name, read_geojson, read_geojson_lines
from tessera.sources.gpkg import GpkgReader, GpkgSource
from tessera.sources.las import FORMATS, LasError, LasSource, read_header


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    features = [
        {"type": "Feature", "id": "a", "properties": {"n": 1}, "geometry": {"type": "Point", "coordinates": [1.5, 2, 3]}},
        {"type": "Feature", "id": 7, "properties": None, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
        {"type": "Feature", "properties": {}, "geometry": None},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": []}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": []}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPoint", "coordinates": [[1, 2], [3]]}},
    ]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features, "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}}, indent=1))
    rows = read_geojson(spark, str(tmp_path / "c.geojson")).orderBy("seq").collect()
    assert [r["id"] for r in rows] == ["a", "7", "2", "3", "4", "5", "6"]
    assert [r["problem"] for r in rows] == [None, None, None, "no_geometry", "no_geometry", "unsupported_geometry", "bad_coordinates"]
    assert rows[0]["parts"] == [[[[1.5, 2.0, 3.0]]]] and rows[1]["parts"] == [[[[0.0, 0.0], [1.0, 1.0]]]] and len(rows[2]["parts"]) == 2 and rows[2]["vertices"] == 8
    assert json.loads(rows[0]["properties"]) == {"n": 1}
    assert crs_name(spark, str(tmp_path / "c.geojson")).first()["epsg"] == 3857
    (tmp_path / "g.geojson").write_text(json.dumps({"type": "Polygon", "coordinates": square}))
    bare = read_geojson(spark, str(tmp_path / "g.geojson"), vertex_limit=3).collect()
    assert [(r["kind"], r["problem"]) for r in bare] == [("Polygon", "vertex_limit")]
    (tmp_path / "l.geojsonl").write_text("\n".join(json.dumps(f) for f in features) + "\n\n")
    assert read_geojson_lines(spark, str(tmp_path / "l.geojsonl")).where("problem is null").count() == 3
    (tmp_path / "bad.geojson").write_text("not json")
    assert [r["problem"] for r in read_geojson(spark, str(tmp_path / "bad.geojson")).collect()] == ["no_geometry"]


def las(path, form, n, version=(1, 2), extra=0):
    dtype = np.dtype(FORMATS[form])
    rows = np.zeros(n, dtype)
    rows["X"], rows["Y"], rows["Z"] = np.arange(n), -np.arange(n), 5
    rows["bits"] = 0b00010001 if form < 6 else 0b00100001
    rows["class_bits"] = 7
    head = bytearray(375 if version == (1, 4) else 227)
    head[:4], head[24], head[25], head[104] = b"LASF", *version, form
    struct.pack_into("<I", head, 96, len(head))
    struct.pack_into("<HI", head, 105, dtype.itemsize + extra, 0 if version == (1, 4) else n)
    struct.pack_into("<6d", head, 131, 0.001, 0.001, 0.5, 500000.0, 5000000.0, 80.0)
    if version == (1, 4):
        struct.pack_into("<Q", head, 247, n)
    path.write_bytes(bytes(head) + b"".join(r.tobytes() + b"\1" * extra for r in rows))


@pytest.mark.parametrize("form,version,extra", [(0, (1, 2), 0), (3, (1, 2), 8), (7, (1, 4), 0)])
def test_las(spark, tmp_path, form, version, extra):
    las(tmp_path / "a.las", form, 250, version, extra)
    spark.dataSource.register(LasSource)
    got = spark.read.format("las").option("chunkPoints", "40").option("partitionPoints", "100").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 3
    rows = got.orderBy("ordinal").collect()
    assert [r["ordinal"] for r in rows] == list(range(250))
    assert rows[9]["x"] == 9 * 0.001 + 500000.0 and rows[9]["y"] == -9 * 0.001 + 5000000.0 and rows[9]["z"] == 82.5
    assert (rows[0]["return_number"], rows[0]["number_of_returns"], rows[0]["classification"]) == (1, 2, 7)
    assert (rows[0]["red"] is None) == (form == 0) and rows[0]["nir"] is None


def test_las_refusals(tmp_path):
    las(tmp_path / "a.las", 0, 3)
    data = bytearray((tmp_path / "a.las").read_bytes())
    assert read_header(bytes(data), len(data)).count == 3
    for at, value in ((104, 0x80), (104, 4), (107, 9), (0, 0)):
        broken = bytearray(data)
        broken[at] = value
        with pytest.raises(LasError):
            read_header(bytes(broken), len(broken))


def test_gpkg(spark, tmp_path):
    path = tmp_path / "a.gpkg"
    blob = lambda wkb, srs=3857, flags=1: b"GP\0" + bytes([flags]) + struct.pack("<i", srs) + wkb
    point = struct.pack("<BIdd", 1, 1, 1.0, 2.0)
    line = struct.pack(">BII4d", 0, 2, 2, 0.0, 0.0, 1.0, 1.0)
    multi = struct.pack("<BII", 1, 1006, 1) + struct.pack("<BIII9d", 1, 1003, 1, 3, *range(9))
    with sqlite3.connect(path) as db:
        db.executescript("""CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER PRIMARY KEY); INSERT INTO gpkg_spatial_ref_sys VALUES (3857);
        CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT); INSERT INTO gpkg_contents VALUES ('roads', 'features'), ('si"tes', 'features');
        CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, srs_id INTEGER); INSERT INTO gpkg_geometry_columns VALUES ('roads', 'geom', 3857), ('si"tes', 'geom', 3857);
        CREATE TABLE roads (fid INTEGER PRIMARY KEY, geom BLOB, large INTEGER); CREATE TABLE "si""tes" (fid INTEGER PRIMARY KEY, geom BLOB);""")
        db.executemany("INSERT INTO roads VALUES (?, ?, ?)", [(1, blob(point), 2**60 + 3), (2, blob(line), None), (5, blob(multi), 11), (9, None, 0), (10, blob(point, 4326), 0), (11, blob(point + b"x"), 0), (12, blob(point, flags=17), 0)])
    db.close()
    spark.dataSource.register(GpkgSource)
    read = spark.read.format("gpkg").option("partitionRows", "4")
    rows = read.option("layers", '["roads"]').load(str(path)).orderBy("fid").collect()
    assert [r["kind"] for r in rows] == ["Point", "LineString", "MultiPolygon", None, None, None, None]
    assert rows[0]["parts"] == [[[[1.0, 2.0]]]] and rows[1]["parts"] == [[[[0.0, 0.0], [1.0, 1.0]]]] and rows[2]["parts"] == [[[[0.0, 1.0, 2.0], [3.0, 4.0, 5.0], [6.0, 7.0, 8.0]]]]
    assert json.loads(rows[0]["properties"]) == {"large": 2**60 + 3}
    assert [r["problem"] for r in rows[3:]] == ["no_geometry", "another reference system than its layer's", "bytes after the geometry", "no_geometry"]
    assert read.option("allLayers", "true").load(str(path)).count() == 7
    with pytest.raises(Exception, match="choose from"):
        spark.read.format("gpkg").load(str(path)).count()
    with sqlite3.connect(path) as db:
        db.execute("INSERT INTO roads(fid) VALUES (-9000000000000000000), (9000000000000000000)")
    db.close()
    parts = GpkgReader({"path": str(path), "layers": '["roads"]', "partitionRows": "4"}).partitions()
    assert [p.low for p in parts] == [-9000000000000000000, 9, 9000000000000000000] and all(p.high + 1 == q.low for p, q in zip(parts, parts[1:]))
    assert read.option("allLayers", "false").load(str(path)).count() == 9
    for suffix, live in (("-wal", b"x"), ("-journal", b"\0\1")):
        log = tmp_path / f"a.gpkg{suffix}"
        log.write_bytes(live)
        with pytest.raises(Exception, match="active"):
            GpkgReader({"path": str(path), "allLayers": "true"}).partitions()
        log.write_bytes(b"\0" * 40 if suffix == "-journal" else b"")
    assert len(GpkgReader({"path": str(path), "allLayers": "true"}).partitions()) > 0


def test_archive(spark, tmp_path):
    rows = [("t/b.glb", b"22"), ("tileset.json", b"{}"), ("t/a.glb", b"1"), ("a.txt", b"")]
    frame = spark.createDataFrame(rows, "name string, data binary")
    out = tmp_path / "a.3tz"
    assert write_archive(frame, str(out)) == 4
    first = out.read_bytes()
    assert [m[0] for m in catalog(str(out))] == ["tileset.json", "a.txt", "t/a.glb", "t/b.glb"]
    assert write_archive(frame.repartition(3), str(out), replace=True) == 4 and out.read_bytes() == first
    with pytest.raises(FileExistsError):
        write_archive(frame, str(out))
    spark.dataSource.register(ArchiveSource)
    got = spark.read.format("3tz").option("partitionBytes", "2").load(str(tmp_path)).collect()
    assert sorted((r["name"], bytes(r["data"]), r["crc"]) for r in got) == sorted((n, d, zlib.crc32(d)) for n, d in rows)
    for bad in ([("a", b"")], [*rows, ("a.txt", b"")], [*rows, ("../x", b"")], [*rows, ("n", None)], []):
        with pytest.raises(ArchiveError):
            write_archive(spark.createDataFrame(bad, "name string, data binary"), str(tmp_path / "bad.3tz"))
    assert not (tmp_path / "bad.3tz").exists() and not list(tmp_path.glob(".staged-*"))
    (tmp_path / "tree/t x").mkdir(parents=True)
    (tmp_path / "tree/tileset.json").write_text("{}")
    (tmp_path / "tree/t x/a+b.bin").write_bytes(b"z")
    assert package(spark, str(tmp_path / "tree"), str(tmp_path / "p.3tz")) == 2
    assert [m[0] for m in catalog(str(tmp_path / "p.3tz"))] == ["tileset.json", "t x/a+b.bin"]
    spoiled = bytearray(first)
    spoiled[first.rindex(b"PK\1\2") - 8] ^= 1
    (tmp_path / "s.3tz").write_bytes(bytes(spoiled))
    with pytest.raises(Exception, match="index and members|CRC"):
        catalog(str(tmp_path / "s.3tz"))


def test_glb(spark):
    rows = [(str(i % 3), i, 1e6 + i / 8, -i / 4, float(i)) for i in range(60)]
    tiles = point_tiles(spark.createDataFrame(rows, "path string, ordinal long, x double, y double, z double")).cache()
    assert {r["n"] for r in tiles.collect()} == {20}
    back = sorted((r["x"], r["y"], r["z"]) for r in decoded_points(tiles).collect())
    assert back == sorted(r[2:] for r in rows)
    data = bytes(tiles.first()["data"])
    for bad in (b"", data[:-4], b"x" + data[1:]):
        with pytest.raises(GlbError):
            unframe(bad)


def test_png_and_reports(spark):
    pixels = np.full((2, 3, 4), 255, "u1")
    assert png(pixels)[25] == 2 and zlib.decompress(png(pixels)[41:-16]) == b"\0" + b"\xff" * 9 + b"\0" + b"\xff" * 9
    pixels[0, 0, 3] = 0
    assert png(pixels)[25] == 6
    frame = spark.createDataFrame([(2, "b"), (1, None)], "id long, t string")
    assert [r["value"] for r in report_lines(frame, "id").collect()] == ['{"id":1}', '{"id":2,"t":"b"}']
