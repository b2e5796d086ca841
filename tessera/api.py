"""Conversions and checks end to end: point clouds to tile archives, lists of tiles, validation."""

from __future__ import annotations

import json
import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions import crs as crs_of
from tessera.functions.geodesy import geodetic_to_ecef
from tessera.functions.crs import resolve_source_crs, supported_epsg_codes  # noqa: F401  part of the surface
from tessera.operators import points
from tessera.operators.checkpoints import stored
from tessera.operators.hierarchy import prefix_stats
from tessera.sinks.archive import ROOT, write_archive
from tessera.sinks.glb import GlbError, point_tiles, unframe
from tessera.sources.archive import ArchiveSource
from tessera.sources.las import LasSource

AXES = ("x", "y", "z")
#: Levels of tiles in one document; a document holds 8^0 + ... + 8^3 tiles at most.
DOCUMENT_LEVELS = 4


def earth_centred(rows: DataFrame, definition: str) -> DataFrame:
    """x, y, z in a source system to Earth-centred metres; rows outside the system's domain get nulls."""
    crs = crs_of.resolve_source_crs(definition)
    if crs.kind == "geocentric":
        return rows
    lon, lat = crs_of.to_lonlat(crs, F.col("x"), F.col("y"))
    rows = rows.withColumn("_lon", F.radians(lon)).withColumn("_lat", F.radians(lat))
    ecef = geodetic_to_ecef(F.col("_lon"), F.col("_lat"), F.col("z"))
    return rows.select(*(c for c in rows.columns if c not in (*AXES, "_lon", "_lat")), *(e.alias(a) for a, e in zip(AXES, ecef)))


def point_tree(rows: DataFrame, max_points: int) -> tuple[DataFrame, DataFrame]:
    """The points of every tile (path, ordinal, x, y, z) and the tiles (path, leaf, error, l*, h*). A parent's error is its sample's or its largest child's, a leaf's is 0."""
    leaves = stored(points.octree(rows.select("ordinal", *AXES), max_points), "leaves")
    sampled = stored(points.samples(leaves, max_points), "sampled")
    own = points.bounds(leaves, "path").withColumn("error", F.lit(0.0)).withColumn("leaf", F.lit(True))
    inner = sampled.groupBy("path").agg(F.first("error").alias("error"))
    errors = own.select("path", "error").unionByName(inner)
    error = prefix_stats(errors, F.max("error").alias("error"))
    sides = [(f"{p}{a}", f) for a in AXES for p, f in (("l", F.min), ("h", F.max))]
    boxes = prefix_stats(own.select("path", *(s for s, _ in sides)), *(f(s).alias(s) for s, f in sides))
    tiles = error.join(boxes, "prefix").withColumnRenamed("prefix", "path").join(own.select("path", "leaf"), "path", "left").na.fill(False, ["leaf"])
    return leaves.select("path", "ordinal", *AXES).unionByName(sampled.select("path", "ordinal", *AXES)), tiles


def content_name(path: str) -> str:
    return f"t/{path or 'root'}.glb"


def document_name(path: str) -> str:
    return f"d/{path}.json" if path else ROOT


def _volume(r) -> dict:
    """A tile's box as centre and half axes. Data is Z up here as in the document."""
    half = [max((r[f"h{a}"] - r[f"l{a}"]) / 2, 1e-6) for a in AXES]
    centre = [(r[f"h{a}"] + r[f"l{a}"]) / 2 for a in AXES]
    return {"box": [*centre, half[0], 0, 0, 0, half[1], 0, 0, 0, half[2]]}


def documents(tiles: DataFrame) -> DataFrame:
    """(name, data): the tree as documents of DOCUMENT_LEVELS levels that link to each other, each made in its own group."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        start = part["doc"].iloc[0]
        nodes = {}
        for r in part.sort_values("path").to_dict("records"):
            path = r["path"]
            node = {"boundingVolume": _volume(r), "geometricError": float(r["error"]), "refine": "REPLACE"}
            linked = path != start and len(path) % DOCUMENT_LEVELS == 0 and not r["leaf"]
            node["content"] = {"uri": ("" if not start else "../") + (document_name(path) if linked else content_name(path))}
            nodes[path] = node
            if path != start:
                nodes[path[:-1]].setdefault("children", []).append(node)
        root = nodes[start]
        document = {"asset": {"version": "1.1"}, "geometricError": max(1.0, root["geometricError"], 0.0), "root": root}
        return pd.DataFrame({"name": [document_name(start)], "data": [json.dumps(document, separators=(",", ":"), sort_keys=True).encode()]})

    own = F.floor(F.length("path") / DOCUMENT_LEVELS) * DOCUMENT_LEVELS
    here = tiles.withColumn("doc", F.expr("substring(path, 1, cast(length(path) div {0} * {0} as int))".format(DOCUMENT_LEVELS)))
    here = here.where((F.length("path") > own) | (F.length("path") == 0) | ~F.col("leaf"))
    # a tile at a document's edge is also the linking node (or, if a leaf, a plain one) of the document above
    above = tiles.where((F.length("path") > 0) & (F.length("path") == own)).withColumn("doc", F.expr(f"substring(path, 1, length(path) - {DOCUMENT_LEVELS})"))
    return here.unionByName(above).groupBy("doc").applyInPandas(build, "name string, data binary")


def point_cloud_to_3tz(spark: SparkSession, source: str, target: str, crs: str | None = None, max_points: int = 8192, replace: bool = False) -> dict:
    """LAS files to one archive of point tiles; returns counts. Ordinals go by file, then record."""
    spark.dataSource.register(LasSource)
    rows = spark.read.format("las").load(source)
    rows = rows.select(F.struct("file", "ordinal").alias("ordinal"), *AXES)
    if crs:
        rows = earth_centred(rows, crs)
        if not rows.where("x is null or y is null or z is null").isEmpty():
            raise ValueError("points outside the system's domain")
    return cloud_to_3tz(rows, target, max_points, replace)


def cloud_to_3tz(rows: DataFrame, target: str, max_points: int = 8192, replace: bool = False) -> dict:
    """Points (ordinal, x, y, z) to one archive; empty and nonfinite input is refused."""
    bad = reduce(lambda a, b: a | b, (F.col(a).isNull() | F.isnan(a) | (F.abs(F.col(a)) == math.inf) for a in AXES))
    if rows.isEmpty() or not rows.where(bad).isEmpty():
        raise ValueError("points must be there and finite")
    shown, tiles = point_tree(rows, max_points)
    tiles = stored(tiles, "tiles")
    contents = point_tiles(shown).select(F.concat(F.lit("t/"), F.when(F.col("path") == "", "root").otherwise(F.col("path")), F.lit(".glb")).alias("name"), "data")
    n = write_archive(stored(contents.unionByName(documents(tiles)), "members"), target, replace)
    found = tiles.agg(F.count("*").alias("tiles"), F.sum(F.col("leaf").cast("long")).alias("leaves"), F.max(F.length("path")).alias("depth")).first().asDict()
    return found | {"members": n, "points": rows.count()}


_TILE = "struct<depth:int,uri:string,role:string,error:double,parent_error:double,outside:boolean>"


def _tiles_of(data: bytes) -> list[dict]:
    document = json.loads(data)
    out, todo = [], [(document["root"], 0, None, None)]
    while todo:
        node, depth, parent_error, parent_box = todo.pop()
        box = node["boundingVolume"].get("box")
        span = [(box[k] - box[3 + 4 * k], box[k] + box[3 + 4 * k]) for k in range(3)] if box else None
        slack = 1e-9 * max((abs(v) for s in span or [] for v in s), default=0) + 2e-6
        outside = bool(span and parent_box and any(s[0] < p[0] - slack or s[1] > p[1] + slack for s, p in zip(span, parent_box)))
        children = node.get("children", [])
        out.append({"depth": depth, "uri": node.get("content", {}).get("uri"), "role": "coarse" if children else "leaf", "error": float(node["geometricError"]), "parent_error": parent_error, "outside": outside})
        todo += [(c, depth + 1, float(node["geometricError"]), span) for c in reversed(children)]
    return out


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("3tz").load(path)


def list_tiles(spark: SparkSession, path: str) -> DataFrame:
    """(document, position, depth, uri, role, error, parent_error, outside): the nodes of all documents of an archive, uri as a member's name."""

    @pandas_udf(f"array<{_TILE}>")
    def parse(data: pd.Series) -> pd.Series:
        return pd.Series([_tiles_of(bytes(d)) for d in data])

    docs = archive_members(spark, path).where(F.col("name").endswith(".json")).select(F.col("name").alias("document"), F.posexplode(parse("data")).alias("position", "t"))
    plain = F.when(F.startswith("t.uri", F.lit("../")), F.expr("substring(t.uri, 4)")).otherwise(F.col("t.uri"))
    return docs.select("document", "position", "t.depth", plain.alias("uri"), "t.role", "t.error", "t.parent_error", "t.outside")


def validate(spark: SparkSession, path: str) -> DataFrame:
    """(subject, problem) rows, none for a sound archive: missing and unreferenced members, rising errors, boxes outside their parent, broken contents.

    The index and the members' checksums are checked while reading.
    """
    members = archive_members(spark, path)
    tiles = stored(list_tiles(spark, path), "listed")

    @pandas_udf("string")
    def broken(data: pd.Series) -> pd.Series:
        def why(d: bytes) -> str | None:
            try:
                document, body = unframe(bytes(d))
                return None if document["buffers"][0]["byteLength"] <= len(body) else "short buffer"
            except (GlbError, KeyError, ValueError, IndexError) as e:
                return str(e) or "broken content"

        return pd.Series([why(d) for d in data], dtype=object)

    names, refs = members.select("name"), tiles.where("uri is not null").select(F.col("uri").alias("name"))
    missing = refs.distinct().join(names, "name", "left_anti").select(F.col("name").alias("subject"), F.lit("missing").alias("problem"))
    unused = names.where(F.col("name") != ROOT).join(refs, "name", "left_anti").select(F.col("name").alias("subject"), F.lit("unreferenced").alias("problem"))
    subject = F.concat_ws("#", "document", F.col("position").cast("string")).alias("subject")
    rising = tiles.where("error > parent_error").select(subject, F.lit("error rises").alias("problem"))
    outside = tiles.where("outside").select(subject, F.lit("outside its parent").alias("problem"))
    contents = members.where(F.col("name").endswith(".glb")).select(F.col("name").alias("subject"), broken("data").alias("problem")).where("problem is not null")
    return missing.union(unused).union(rising).union(outside).union(contents)
