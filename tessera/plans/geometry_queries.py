"""Queries over lines and polygons made from the parts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import geometry as op
from tessera.plans.registry import query
from tessera.plans.tables import table


def houses(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Each part as a polygon: a house of five corners, every third one with a square hole, every seventh with a second part.

    dealt: parts are spread over tasks by key first, for what works on one geometry at a time; their file is too small to be split.
    """
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    p = p.repartition("p_partkey") if dealt else p
    k, w, h = F.col("p_partkey"), F.col("p_size").cast("double"), (F.col("p_retailprice") / 100).cast("double")
    pt = lambda x, y: F.array(x if not isinstance(x, float) else F.lit(x), y if not isinstance(y, float) else F.lit(y))
    outer = F.array(pt(0.0, 0.0), pt(w, 0.0), pt(w, h), pt(w / 2, h + w), pt(0.0, h), pt(0.0, 0.0))
    hole = F.array(pt(w / 4, h / 4), pt(w / 4, h / 2), pt(w / 2, h / 2), pt(w / 2, h / 4), pt(w / 4, h / 4))
    far = F.array(pt(w + 10, 0.0), pt(w + 20, 0.0), pt(w + 20, h), pt(w + 10, 0.0))
    rings = F.when(k % 3 == 0, F.array(outer, hole)).otherwise(F.array(outer))
    parts = F.when(k % 7 == 0, F.array(rings, F.array(far))).otherwise(F.array(rings))
    return p.select(k.alias("id"), w.alias("w"), h.alias("h"), parts.alias("parts"))


_HOUSES = "g AS (SELECT p_partkey AS id, p_size::DOUBLE AS w, (p_retailprice / 100)::DOUBLE AS h FROM part)"
_AREA = "round(w * h + w * w / 2 - CASE WHEN id % 3 = 0 THEN w * h / 16 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 5 * h ELSE 0 END, 9)"


@query("geo_area", f"WITH {_HOUSES} SELECT id, {_AREA} AS area FROM g")
def geo_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = F.aggregate(F.transform("parts", op.polygon_area), F.lit(0.0), lambda s, v: s + v)
    return houses(spark, sf_dir).select("id", F.round(area, 9).alias("area"))


@query("geo_parts_rings", f"""WITH {_HOUSES} SELECT id, 0::INT AS part, 0::INT AS ring, 6::INT AS points FROM g UNION ALL SELECT id, 0, 1, 5 FROM g WHERE id % 3 = 0 UNION ALL SELECT id, 1, 0, 4 FROM g WHERE id % 7 = 0""")
def geo_parts_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.exploded_rings(houses(spark, sf_dir)).select("id", "part", "ring", F.size("points").alias("points"))


@query("lod_strip_holes", f"WITH {_HOUSES} SELECT id, CASE WHEN id % 7 = 0 THEN 2 ELSE 1 END::INT AS rings FROM g")
def lod_strip_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = houses(spark, sf_dir).withColumn("parts", op.without_holes(F.col("parts")))
    return stripped.select("id", F.aggregate("parts", F.lit(0), lambda s, r: s + F.size(r)).alias("rings"))


@query("geo_triangulate", f"WITH {_HOUSES} SELECT id, {_AREA} AS area, (3 + CASE WHEN id % 3 = 0 THEN 6 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS triangles FROM g")
def geo_triangulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles cover a polygon exactly: their number and area are those of the polygon."""
    t = op.triangles(houses(spark, sf_dir, dealt=True), "id")
    at = lambda c, k: F.get(c, F.lit(k))
    doubled = (at("b", 0) - at("a", 0)) * (at("c", 1) - at("a", 1)) - (at("b", 1) - at("a", 1)) * (at("c", 0) - at("a", 0))
    return t.groupBy("id").agg(F.round(F.sum(doubled / 2), 9).alias("area"), F.count("*").alias("triangles"))


@query("geo_valid", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'self_intersection' END AS problem FROM part")
def geo_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth house has two corners swapped, so that its walls cross."""
    swapped = lambda r: F.concat(F.slice(r, 1, 1), F.slice(r, 3, 1), F.slice(r, 2, 1), F.slice(r, 4, 3))
    g = houses(spark, sf_dir, dealt=True)
    bent = F.transform("parts", lambda rings: F.transform(rings, lambda r: F.when((F.col("id") % 5 == 0) & (F.size(r) == 6), swapped(r)).otherwise(r)))
    return op.checked(g.withColumn("parts", bent)).select("id", "problem")


@query("prj_intrinsic", "SELECT o_orderkey AS id, o_custkey % 3 <> 1 AS keeps FROM orders")
def prj_intrinsic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    lift = F.when(F.col("o_custkey") % 3 == 1, 1.0).otherwise(F.lit(0.0))
    x, z = F.col("o_orderkey").cast("double"), F.col("o_totalprice").cast("double")
    ring = F.array(F.array(x, x, z), F.array(x + 1, x, z), F.array(x, x + 1, z + lift))
    return o.select(F.col("o_orderkey").alias("id"), op.constant_height(ring).alias("keeps"))


@query("lod_rdp", """WITH g AS (SELECT o_orderkey AS id, (o_custkey % 10)::DOUBLE / 10 AS bump FROM orders)
SELECT id, CASE WHEN bump > 0.45 THEN 3 ELSE 2 END::INT AS points, CASE WHEN bump > 0.45 THEN 0.0 ELSE bump END::DOUBLE AS simplify_error FROM g""")
def lod_rdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of three points with a bump in its middle, which stays above the tolerance only."""
    bump = (F.col("o_custkey") % 10).cast("double") / 10
    pt = lambda x, y: F.array(F.lit(float(x)), y, F.lit(0.0))
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(pt(0, F.lit(0.0)), pt(1, bump), pt(2, F.lit(0.0))).alias("points"))
    return op.simplified(lines, 0.45).select("id", F.size("points").alias("points"), "simplify_error")


_BOXES = "g AS (SELECT p_partkey AS id, (p_partkey % 50)::DOUBLE AS x, p_size::DOUBLE AS a, (1 + p_partkey % 7)::DOUBLE AS b, (p_partkey % 2)::DOUBLE AS c, (p_partkey % 11 - 5)::DOUBLE AS u, (p_partkey % 13 - 6)::DOUBLE AS v FROM part)"


@query("geo_obb", f"WITH {_BOXES} SELECT id, x + 0.75::DOUBLE * a + b AS hx, x - 0.75::DOUBLE * a - b AS lx, a + 0.75::DOUBLE * b AS hy, -a - 0.75::DOUBLE * b AS ly, abs(0.75::DOUBLE * u + v) / 1.25::DOUBLE <= 1.25::DOUBLE * a + 0.0625 AND abs(0.75::DOUBLE * v - u) / 1.25::DOUBLE <= 1.25::DOUBLE * b + 0.0625 AND c <= 1 AS inside FROM g")
def geo_obb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes turned about the vertical (half axes along (3, 4) and (-4, 3)), some without height: extents of their corners, and whether a point beside the centre is inside."""
    key = F.col("p_partkey")
    a, b, c = F.col("p_size").cast("double"), (key % 7 + 1).cast("double"), (key % 2).cast("double")
    x, zero = (key % 50).cast("double"), F.lit(0.0)
    box = F.array(x, zero, zero, a * 0.75, a, zero, -b, b * 0.75, zero, zero, zero, c)
    point = F.array(x + (key % 11 - 5), (key % 13 - 6).cast("double"), c)
    boxes = table(spark, sf_dir, "part").select(key.alias("id"), op.path_box(op.box_corners(box)).alias("e"), op.box_contains(box, point, 0.0625).alias("inside"))
    return boxes.select("id", "e.lx", "e.hx", "e.ly", "e.hy", "inside")
