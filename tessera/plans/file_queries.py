"""Queries through files: rows are written to the shared folder and read back by a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import crs
from tessera.operators import points
from tessera.operators.checkpoints import shared_uri
from tessera.plans.registry import query
from tessera.plans.tables import CLOUD, cloud, table
from tessera.sinks.glb import decoded_points, point_tiles
from tessera.sinks.text import report_lines
from tessera.sources.geojson import read_geojson_lines


def _as_text(df: DataFrame) -> str:
    """A folder of text files with df's only column."""
    uri = shared_uri(df.sparkSession, "lines")
    df.write.text(uri)
    return uri


@query("src_geojson", "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'LineString' ELSE 'Point' END AS kind, c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN 0 WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::INT AS vertices, CASE WHEN c_custkey % 10 = 0 THEN 'no_geometry' END AS problem FROM customer")
def src_geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    at = F.format_string("[%d.5,%d]", F.col("c_nationkey"), k)
    geometry = F.when(k % 10 == 0, F.lit("null")).when(k % 3 == 0, F.concat(F.lit('{"type":"LineString","coordinates":['), at, F.lit(","), at, F.lit("]}"))).otherwise(F.concat(F.lit('{"type":"Point","coordinates":'), at, F.lit("}")))
    text = F.concat(F.lit('{"type":"Feature","id":'), k.cast("string"), F.lit(',"properties":'), F.to_json(F.struct(F.col("c_name").alias("name"))), F.lit(',"geometry":'), geometry, F.lit("}"))
    got = read_geojson_lines(spark, _as_text(c.select(text.alias("value"))))
    return got.select("id", "kind", F.get_json_object("properties", "$.name").alias("name"), "vertices", "problem")


@query("src_geojson_geom", "SELECT c_custkey::VARCHAR AS id, c_nationkey + 0.5::DOUBLE AS x, c_custkey::DOUBLE AS y FROM customer")
def src_geojson_geom(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.format_string('{"type":"Feature","id":%d,"properties":null,"geometry":{"type":"Point","coordinates":[%d.5,%d]}}', "c_custkey", "c_nationkey", "c_custkey")
    point = F.get(F.get(F.get("parts", F.lit(0)), F.lit(0)), F.lit(0))
    return read_geojson_lines(spark, _as_text(c.select(text.alias("value")))).select("id", F.get(point, F.lit(0)).alias("x"), F.get(point, F.lit(1)).alias("y"))


@query("snk_glb", f"WITH {CLOUD}, b AS (SELECT label, min(x) AS lx, max(y) AS hy, min(z) AS lz FROM pts GROUP BY label) SELECT label::VARCHAR AS path, row_number() OVER (PARTITION BY label ORDER BY ordinal) - 1 AS k, round((x - lx)::FLOAT::DOUBLE + lx, 6) AS x, round(-((-y + hy)::FLOAT::DOUBLE - hy), 6) AS y, round((z - lz)::FLOAT::DOUBLE + lz, 6) AS z FROM pts JOIN b USING (label)")
def snk_glb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile per label, written as binary glTF and decoded again."""
    tiles = point_tiles(cloud(spark, sf_dir).withColumn("path", F.col("label").cast("string")))
    return decoded_points(tiles).select("path", "k", *(F.round(a, 6).alias(a) for a in "xyz"))


@query("snk_reports_jsonl", "SELECT event_id AS line, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events")
def snk_reports_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    lines = spark.read.text(_as_text(report_lines(e, "event_id")))
    return lines.select(F.get_json_object("value", "$.event_id").cast("long").alias("line"), "value")


@query("prj_crs", "SELECT c_custkey AS id, round(8.0::DOUBLE + (c_custkey % 400) / 100.0::DOUBLE, 8) AS lon, round(c_nationkey * 3.0::DOUBLE, 8) AS lat FROM customer")
def prj_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees to a UTM zone and back: the inverse returns what went in."""
    zone = crs.resolve_source_crs("EPSG:32632")
    c = table(spark, sf_dir, "customer")
    x, y = crs.from_lonlat(zone, F.lit(8.0) + (F.col("c_custkey") % 400) / F.lit(100.0), F.col("c_nationkey") * F.lit(3.0))
    lon, lat = crs.to_lonlat(zone, F.col("x"), F.col("y"))
    projected = c.select(F.col("c_custkey").alias("id"), x.alias("x"), y.alias("y"))
    return projected.select("id", F.round(lon, 8).alias("lon"), F.abs(F.round(lat, 8)).alias("lat"))


@query("prj_crs_resolve", "SELECT 32600 + n AS code, 'utm' AS kind, n * 6.0::DOUBLE - 183 AS meridian, true AS north FROM range(1, 61) t(n) UNION ALL SELECT 32700 + n, 'utm', n * 6.0 - 183, false FROM range(1, 61) t(n) UNION ALL VALUES (3857, 'mercator', 0, true), (4326, 'geographic', 0, true), (4979, 'geographic', 0, true), (4978, 'geocentric', 0, true)")
def prj_crs_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [crs.resolve_source_crs(f"EPSG:{c}") for c in crs.supported_epsg_codes()]
    return spark.createDataFrame([(c.code, c.kind, c.meridian, c.north) for c in found], "code long, kind string, meridian double, north boolean")


@query("lod_point_samples")
def lod_point_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of every inner octree node, each on its own grid."""
    leaves = points.octree(cloud(spark, sf_dir).drop("label"), 64)
    return points.samples(leaves, 64).select("path", "ordinal", F.round("edge", 9).alias("edge"), F.round("error", 9).alias("error"))
