"""GeoJSON: collections, single features and bare geometries, parsed by Spark's JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How deep each type's coordinates are nested below parts -> rings -> points -> numbers.
_DEPTH = {"Point": 1, "MultiPoint": 2, "LineString": 2, "Polygon": 3, "MultiLineString": 3, "MultiPolygon": 4}
_ROOT = "type string, id string, geometry string, properties string, coordinates string, features array<string>, crs struct<properties:struct<name:string>>"
_FEATURE = "type string, id string, geometry string, properties string"
_GEOMETRY = "type string, coordinates string"


def _coordinates(kind: Column, text: Column) -> Column:
    """parts -> rings or paths -> points -> numbers. A line is one path; multi types have a part each."""
    read = lambda depth: F.from_json(text, "array<" * depth + "double" + ">" * depth)
    return (
        F.when(kind == "Point", F.array(F.array(F.array(read(1)))))
        .when(kind == "LineString", F.array(F.array(read(2))))
        .when(kind == "MultiPoint", F.transform(read(2), lambda p: F.array(F.array(p))))
        .when(kind == "Polygon", F.array(read(3)))
        .when(kind == "MultiLineString", F.transform(read(3), lambda p: F.array(p)))
        .when(kind == "MultiPolygon", read(4))
    )


def _decoded(features: DataFrame, vertex_limit: int) -> DataFrame:
    """seq, id, kind, parts, properties and problem of each row of (seq, text)."""
    f = features.select("file", "seq", F.from_json("text", _FEATURE).alias("f"), "bare")
    text = F.coalesce(F.col("bare"), F.col("f.geometry"))
    g = f.withColumn("g", F.from_json(text, _GEOMETRY))
    kind = F.col("g.type")
    parts = F.when(F.col("g.coordinates").isNotNull() & (F.col("g.coordinates") != "[]"), _coordinates(kind, F.col("g.coordinates")))
    got = g.select("file", "seq", F.col("f.id").alias("id"), kind.alias("kind"), parts.alias("parts"), F.col("f.properties").alias("properties"), text.alias("_t"))
    vertices = F.aggregate("parts", F.lit(0), lambda n, rings: n + F.aggregate(rings, F.lit(0), lambda m, ring: m + F.size(ring)))
    got = got.withColumn("vertices", F.when(F.col("parts").isNull(), 0).otherwise(vertices))
    bad_number = F.exists(F.flatten(F.flatten("parts")), lambda p: (F.size(p) < 2) | F.exists(p, lambda v: v.isNull()))
    problem = (
        F.when(F.col("_t").isNull() | F.col("parts").isNull() & F.coalesce(F.col("kind").isin(*_DEPTH), F.lit(False)), "no_geometry")
        .when(F.col("kind").isNull() | ~F.col("kind").isin(*_DEPTH), "unsupported_geometry")
        .when(F.coalesce(bad_number, F.lit(True)), "bad_coordinates")
        .when(F.col("vertices") > vertex_limit, "vertex_limit")
    )
    return got.withColumn("problem", problem).drop("_t")


def read_geojson(spark: SparkSession, paths: str | list[str], vertex_limit: int = 1_000_000) -> DataFrame:
    """(file, seq, id, kind, parts, properties, vertices, problem) per feature of whole GeoJSON documents.

    A document is one task's work, so that large inputs should come as many files or as lines
    (read_geojson_lines). id is the JSON text of the feature's id; without one it is the row number.
    problem is null for sound rows, else no_geometry (null or empty), unsupported_geometry,
    bad_coordinates or vertex_limit; a text that isn't JSON is one row with unsupported root.
    """
    whole = spark.read.text(paths, wholetext=True).select("value", F.input_file_name().alias("file"))
    root = whole.select("file", "value", F.from_json("value", _ROOT).alias("r"))
    is_bare = F.col("r.type").isin(*_DEPTH)
    texts = F.when(F.col("r.type") == "FeatureCollection", F.coalesce("r.features", F.array().cast("array<string>"))).otherwise(F.array("value"))
    rows = root.select("file", is_bare.alias("is_bare"), F.posexplode(texts).alias("seq", "text"))
    rows = rows.select("file", F.col("seq").cast("long").alias("seq"), "text", F.when(F.col("is_bare"), F.col("text")).alias("bare"))
    return _decoded(rows, vertex_limit).withColumn("id", F.coalesce("id", F.col("seq").cast("string")))


def read_geojson_lines(spark: SparkSession, paths: str | list[str], vertex_limit: int = 1_000_000) -> DataFrame:
    """One feature a line: files split by blocks. seq grows within a file's block order but has gaps; rows without id take it."""
    lines = spark.read.text(paths).select(F.col("value").alias("text"), F.input_file_name().alias("file")).where(F.trim("text") != "")
    rows = lines.select("file", F.monotonically_increasing_id().alias("seq"), "text", F.lit(None).cast("string").alias("bare"))
    return _decoded(rows, vertex_limit).withColumn("id", F.coalesce("id", F.col("seq").cast("string")))


def crs_name(spark: SparkSession, path: str) -> DataFrame:
    """(file, epsg) of each document: the named system, 4326 where there is none or it is CRS84."""
    root = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", _ROOT).alias("r"))
    name = F.col("r.crs.properties.name")
    code = F.regexp_extract(name, r"(?i)^(?:urn:ogc:def:crs:)?EPSG:{1,2}(?:[0-9.]*:)?([0-9]+)$", 1)
    return root.select("file", F.when(name.isNull() | name.rlike("(?i)CRS84$"), 4326).when(code != "", code.cast("int")).alias("epsg"))
