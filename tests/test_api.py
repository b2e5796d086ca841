"""Point clouds to archives and back, samples against a plain version, and source systems."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_files import las

from tessera import api
from tessera.functions import crs
from tessera.operators import points
from tessera.sinks.archive import write_archive
from tessera.sinks.glb import decoded_points


def test_samples(spark):
    rng = random.Random(8)
    rows = [(i, rng.random(), rng.random() * 2, rng.random() / 3) for i in range(900)]
    leaves = points.octree(spark.createDataFrame(rows, "ordinal long, x double, y double, z double"), 27).cache()
    path = {r["ordinal"]: r["path"] for r in leaves.collect()}
    got = {}
    for r in points.samples(leaves, 27).collect():
        got.setdefault(r["path"], []).append(r)
    inner = {p[:k] for p in path.values() for k in range(len(p))}
    assert set(got) == inner
    edges, low = {}, [min(r[k] for r in rows) for k in (1, 2, 3)]
    for p in sorted(inner, key=len):
        own = [r for r in rows if path[r[0]].startswith(p) and len(path[r[0]]) > len(p)]
        longest = max(max(r[k] for r in own) - min(r[k] for r in own) for k in (1, 2, 3))
        edge, kept = chain_sample(own, edges[p[:-1]] if p else longest / 2.5, 27, low)
        assert len(kept) <= 27
        edges[p] = edge
        assert sorted(r["ordinal"] for r in got[p]) == [r[0] for r in kept]
        assert got[p][0]["edge"] == pytest.approx(edge)



def chain_sample(rows, top, budget, low):
    """As plain_sample, with chains that end where the longest extent holds the edge budget times."""
    longest = max(max(r[k] for r in rows) - min(r[k] for r in rows) for k in (1, 2, 3))
    best = None
    for edge in (top, top / 2.0**0.5):
        while True:
            cells = {}
            for r in sorted(rows):
                cells.setdefault(tuple(math.floor((r[k + 1] - low[k]) / edge) for k in range(3)), r)
            if len(cells) <= budget and (best is None or edge < best[0]):
                best = (edge, sorted(cells.values()))
            if not (longest > 0 and longest / edge < budget):
                break
            edge /= 2
    return best


@pytest.mark.parametrize("tight", [1e-6, 1e-12])
def test_samples_of_a_tight_cluster(spark, tight):
    rng = random.Random(9)
    rows = [(i, rng.random(), rng.random(), rng.random()) for i in range(40)]
    rows += [(40 + i, tight * rng.random(), tight * rng.random(), tight * rng.random()) for i in range(300)]
    leaves = points.octree(spark.createDataFrame(rows, "ordinal long, x double, y double, z double"), 27).cache()
    path = {r["ordinal"]: r["path"] for r in leaves.collect()}
    got = {}
    for r in points.samples(leaves, 27).collect():
        got.setdefault(r["path"], []).append(r)
    inner = {p[:k] for p in path.values() for k in range(len(p))}
    assert set(got) == inner
    edges, whole, low = {}, 0, [min(r[k] for r in rows) for k in (1, 2, 3)]
    for p in sorted(inner, key=len):
        own = [r for r in rows if path[r[0]].startswith(p) and len(path[r[0]]) > len(p)]
        longest = max(max(r[k] for r in own) - min(r[k] for r in own) for k in (1, 2, 3))
        edges[p], kept = chain_sample(own, edges[p[:-1]] if p else longest / 2.5, 27, low)
        assert sorted(r["ordinal"] for r in got[p]) == [r[0] for r in kept]
        assert got[p][0]["edge"] == pytest.approx(edges[p])
        whole += longest < tight * 2 and len(kept) > 8
    assert whole


def test_point_cloud_to_archive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    las(tmp_path / "in/a.las", 3, 700)
    las(tmp_path / "in/b.las", 0, 300)
    out = str(tmp_path / "c.3tz")
    report = api.point_cloud_to_3tz(spark, str(tmp_path / "in"), out, crs="EPSG:32633", max_points=20)
    assert report["points"] == 1000 and report["depth"] > api.DOCUMENT_LEVELS
    assert api.validate(spark, out).collect() == []
    tiles = api.list_tiles(spark, out).collect()
    contents = [t["uri"] for t in tiles if t["uri"].endswith(".glb")]
    assert len(contents) == len(set(contents)) == report["tiles"]
    leaves = {t["uri"] for t in tiles if t["role"] == "leaf" and t["uri"].endswith(".glb")}
    members = api.archive_members(spark, out)
    shown = decoded_points(members.where(F.col("name").isin(*leaves)).select(F.col("name").alias("path"), "data"))
    assert shown.count() == 1000
    most = decoded_points(members.where(F.col("name").endswith(".glb")).select(F.col("name").alias("path"), "data")).groupBy("path").count()
    assert most.agg(F.max("count")).first()[0] <= 20


def test_validate_finds_problems(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("ordinal"), *((F.col("id") * k % 17).cast("double").alias(a) for k, a in ((3, "x"), (5, "y"), (7, "z"))))
    api.cloud_to_3tz(rows, str(tmp_path / "a.3tz"), 40)
    members = api.archive_members(spark, str(tmp_path / "a.3tz")).select("name", "data").collect()
    gone = next(m["name"] for m in members if m["name"].endswith("0.glb"))
    spoiled = [(m["name"], b"nothing" if m["name"] == "t/root.glb" else bytes(m["data"]).replace(b'"geometricError":0.0', b'"geometricError":99.0')) for m in members if m["name"] != gone] + [("x.bin", b"1")]
    write_archive(spark.createDataFrame(spoiled, "name string, data binary"), str(tmp_path / "b.3tz"))
    found = {(r["subject"].split("#")[0], r["problem"]) for r in api.validate(spark, str(tmp_path / "b.3tz")).collect()}
    assert {(gone, "missing"), ("x.bin", "unreferenced"), ("tileset.json", "error rises"), ("t/root.glb", "not a binary glTF 2.0")} <= found
    with pytest.raises(ValueError):
        api.cloud_to_3tz(rows.limit(0), str(tmp_path / "e.3tz"))


def test_source_systems(spark):
    assert crs.resolve_source_crs("urn:ogc:def:crs:EPSG::32733") == crs.Crs(32733, "utm", 15.0, False)
    assert crs.resolve_source_crs("+proj=utm +zone=10 +datum=WGS84 +units=m +no_defs").code == 32610
    assert crs.resolve_source_crs("OGC:CRS84").code == 4326
    for bad in ("EPSG:2154", "+proj=utm +zone=61", "+proj=lcc", "nonsense", "+proj=utm +zone=3 +k=2"):
        with pytest.raises(crs.CrsError):
            crs.resolve_source_crs(bad)
    frame = spark.createDataFrame([(9.0, 0.0), (11.7, 48.1), (6.3, -35.0), (9.0001, 83.9)], "lon double, lat double")
    for code in (32632, 32732, 3857):
        c = crs.resolve_source_crs(str(code))
        x, y = crs.from_lonlat(c, F.col("lon"), F.col("lat"))
        back = frame.select("lon", "lat", x.alias("x"), y.alias("y")).withColumn("b", F.array(*crs.to_lonlat(c, F.col("x"), F.col("y"))))
        for r in back.collect():
            assert r["b"] == pytest.approx([r["lon"], r["lat"]], abs=1e-9)
    x, y = crs.from_lonlat(crs.resolve_source_crs("32632"), F.lit(9.0), F.lit(45.0))
    r = frame.limit(1).select(x.alias("x"), y.alias("y")).first()
    # the meridian arc to 45 degrees on WGS84 is 4984944.378 m
    assert r["x"] == pytest.approx(500000, abs=1e-6) and r["y"] == pytest.approx(4984944.378 * 0.9996, abs=1e-2)
