"""Queries over point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numeric import prefix
from tessera.operators import points as op
from tessera.plans.registry import query
from tessera.plans.tables import CLOUD, LINES, cloud, lines

_BOX = ", ".join(f"{f}({a}) + 0.0::DOUBLE AS {p}{a}" for a in "xyz" for f, p in (("min", "l"), ("max", "h")))

OCTREE_SQL = f"""WITH RECURSIVE {CLOUD},
root AS (SELECT ordinal, x, y, z, '' AS path, min(x) OVER () AS cx, max(x) OVER () AS dx, min(y) OVER () AS cy, max(y) OVER () AS dy, min(z) OVER () AS cz, max(z) OVER () AS dz, count(*) OVER () AS n FROM pts),
t AS (SELECT *, n <= 32 AS leaf FROM root UNION ALL
 SELECT ordinal, x, y, z, path, cx, dx, cy, dy, cz, dz, n, n <= 32 AS leaf FROM (
  SELECT *, count(*) OVER (PARTITION BY path) AS n FROM (
   SELECT ordinal, x, y, z, CASE WHEN one THEN path ELSE path || b END AS path,
          CASE WHEN x >= mx THEN mx ELSE cx END AS cx, CASE WHEN x >= mx THEN dx ELSE mx END AS dx, CASE WHEN y >= my THEN my ELSE cy END AS cy, CASE WHEN y >= my THEN dy ELSE my END AS dy,
          CASE WHEN z >= mz THEN mz ELSE cz END AS cz, CASE WHEN z >= mz THEN dz ELSE mz END AS dz FROM (
    SELECT *, min(b) OVER (PARTITION BY path) = max(b) OVER (PARTITION BY path) AS one FROM (
     SELECT *, (x >= mx)::INT + 2 * (y >= my)::INT + 4 * (z >= mz)::INT AS b FROM (
      SELECT *, cx + (dx - cx) / 2 AS mx, cy + (dy - cy) / 2 AS my, cz + (dz - cz) / 2 AS mz FROM t WHERE NOT leaf))))))
"""


@query("par_octree", OCTREE_SQL + "SELECT ordinal, x, y, z, path FROM t WHERE leaf")
def octree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.octree(cloud(spark, sf_dir).drop("label"), 32)


@query("agg_point_stats", OCTREE_SQL + f"SELECT path, count(*) AS n, {_BOX} FROM t WHERE leaf GROUP BY path")
def point_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.bounds(op.octree(cloud(spark, sf_dir).drop("label"), 32), "path")


@query("agg_bounds", f"WITH {LINES} SELECT count(*) AS n, {_BOX} FROM pts")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.bounds(lines(spark, sf_dir))


@query("agg_voxel_first", f"""WITH {CLOUD}, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts),
k AS (SELECT *, floor((x - lx) / 0.25)::BIGINT AS kx, floor((y - ly) / 0.25)::BIGINT AS ky, floor((z - lz) / 0.25)::BIGINT AS kz FROM pts, b)
SELECT kx, ky, kz, min(ordinal) AS ordinal, arg_min(x, ordinal) AS x, arg_min(y, ordinal) AS y, arg_min(z, ordinal) AS z FROM k GROUP BY kx, ky, kz""")
def voxel_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.voxel_first(cloud(spark, sf_dir), 0.25)


@query("win_voxel_first", f"""WITH {CLOUD}, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz FROM pts),
k AS (SELECT ordinal, floor((x - lx) / 0.5)::BIGINT AS kx, floor((y - ly) / 0.5)::BIGINT AS ky, floor((z - lz) / 0.5)::BIGINT AS kz FROM pts, b)
SELECT kx, ky, kz, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY ordinal) AS r FROM k) WHERE r = 1""")
def voxel_first_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.voxel_first(cloud(spark, sf_dir), 0.5).select("kx", "ky", "kz", "ordinal")


@query("agg_parent_sample", f"""WITH {CLOUD}, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS longest FROM pts),
g AS (SELECT c AS chain, j, greatest(longest, 2.2250738585072014e-308) / 3.5 / (CASE WHEN c = 1 THEN 1.4142135623730951 ELSE 1.0 END)::DOUBLE / (2 ** j) AS edge FROM b, range(2) t(c), range(8) u(j)),
k AS (SELECT chain, j, edge, floor((x - lx) / edge)::BIGINT AS kx, floor((y - ly) / edge)::BIGINT AS ky, floor((z - lz) / edge)::BIGINT AS kz FROM pts, b, g)
SELECT chain::INT AS chain, j::INT AS j, any_value(edge) AS edge, count(DISTINCT (kx, ky, kz)) AS voxels, count(DISTINCT (kx, ky, kz)) <= 64 AS fits FROM k GROUP BY chain, j""")
def parent_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.parent_sample(cloud(spark, sf_dir), 64)


@query("agg_voxel_grid", f"""WITH {CLOUD}, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pts)
SELECT ordinal, least(floor((x - lx) / (hx - lx) * 8.0::DOUBLE), 7)::BIGINT AS kx, least(floor((y - ly) / (hy - ly) * 8.0::DOUBLE), 7)::BIGINT AS ky, least(floor((z - lz) / (hz - lz) * 8.0::DOUBLE), 7)::BIGINT AS kz FROM pts, b""")
def voxel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.voxel_grid(cloud(spark, sf_dir), 512).select("ordinal", "kx", "ky", "kz")


@query("agg_voxel_count", f"""WITH {CLOUD}, b AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pts),
k AS (SELECT pts.*, least(floor((x - lx) / (hx - lx) * 4.0::DOUBLE), 3)::BIGINT AS kx, least(floor((y - ly) / (hy - ly) * 4.0::DOUBLE), 3)::BIGINT AS ky, least(floor((z - lz) / (hz - lz) * 4.0::DOUBLE), 3)::BIGINT AS kz FROM pts, b),
f AS (SELECT kx, ky, kz, 'all' AS layer, count(*) AS n, min(ordinal) AS ordinal, arg_min(x, ordinal) AS fx, arg_min(y, ordinal) AS fy, arg_min(z, ordinal) AS fz FROM k GROUP BY kx, ky, kz)
SELECT layer, kx, ky, kz, any_value(n) AS point_count, any_value(f.ordinal) AS ordinal, max(round(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy) + (z - fz) * (z - fz)), 9)) AS error FROM k JOIN f USING (kx, ky, kz) GROUP BY layer, kx, ky, kz""")
def voxel_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.voxel_counts(cloud(spark, sf_dir).withColumn("layer", F.lit("all")), 64).withColumn("error", F.round("error", 9))


_STEPS = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _morton_sql(source: str, keys: str) -> str:
    at = ", ".join(f"greatest(0, least(floor(({a} - l{a}) / side * 2097152.0::DOUBLE), 2097151))::BIGINT AS s{a}" for a in "xyz")
    sql = f"""WITH {source}, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS side FROM pts),
m0 AS (SELECT pts.*, {at} FROM pts, b)"""
    for k, (shift, mask) in enumerate(_STEPS):
        sql += f", m{k + 1} AS (SELECT * REPLACE ({', '.join(f'((s{a} | ((s{a} & {mask >> shift}) << {shift})) & {mask}) AS s{a}' for a in 'xyz')}) FROM m{k})"
    return sql + f", keyed AS (SELECT {keys}, sx | (sy << 1) | (sz << 2) AS key FROM m{len(_STEPS)})"


@query("par_morton", _morton_sql(CLOUD, "ordinal") + " SELECT ordinal, key FROM keyed")
def morton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.morton_keys(cloud(spark, sf_dir)).select("ordinal", "key")


@query("srt_morton", _morton_sql(LINES, "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice") + " SELECT key >> 42 AS prefix, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM keyed GROUP BY key >> 42")
def morton_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = op.morton_keys(lines(spark, sf_dir))
    return keyed.groupBy(prefix(F.col("key"), 7).alias("prefix")).agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


@query("win_morton_rank", _morton_sql(CLOUD, "ordinal") + " SELECT ordinal, key >> 57 AS cell, row_number() OVER (PARTITION BY key >> 57 ORDER BY key, ordinal) AS rank FROM keyed")
def morton_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    keyed = op.morton_keys(cloud(spark, sf_dir)).withColumn("cell", prefix(F.col("key"), 2))
    return keyed.select("ordinal", "cell", F.row_number().over(Window.partitionBy("cell").orderBy("key", "ordinal")).cast("long").alias("rank"))


@query("par_cell_tree", _morton_sql(CLOUD, "ordinal") + """, s AS (SELECT d AS depth, key >> (3 * (21 - d)) AS prefix, count(*) AS n FROM keyed, range(22) t(d) GROUP BY d, key >> (3 * (21 - d)))
SELECT depth::INT AS depth, prefix, n FROM s WHERE (n <= 40 OR depth = 21) AND (depth = 0 OR EXISTS (SELECT 1 FROM s p WHERE p.depth = s.depth - 1 AND p.prefix = s.prefix >> 3 AND p.n > 40))""")
def cell_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cell_leaves(op.morton_keys(cloud(spark, sf_dir)), 40)


@query("prj_quantize16", f"""WITH {CLOUD}, b AS (SELECT label, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pts GROUP BY label)
SELECT label, ordinal, floor((x - lx) / (CASE WHEN hx > lx THEN hx - lx ELSE 1 END) * 65535.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS qx, floor((y - ly) / (CASE WHEN hy > ly THEN hy - ly ELSE 1 END) * 65535.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS qy,
floor((z - lz) / (CASE WHEN hz > lz THEN hz - lz ELSE 1 END) * 65535.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS qz FROM pts JOIN b USING (label)""")
def quantize16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.quantized16(cloud(spark, sf_dir), "label")


@query("prj_y_up", f"WITH {CLOUD} SELECT ordinal, x, z AS y, -y AS z FROM pts")
def y_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).select("ordinal", "x", F.col("z").alias("y"), (-F.col("y")).alias("z"))


@query("win_seen_bucket", f"WITH {CLOUD} SELECT label, ordinal, least(7, ((row_number() OVER w - 1) * 8) // (count(*) OVER (PARTITION BY label)))::BIGINT AS bucket FROM pts WINDOW w AS (PARTITION BY label ORDER BY ordinal)")
def seen_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    pts = cloud(spark, sf_dir)
    n = pts.groupBy("label").agg(F.count("*").alias("n"))
    seen = F.row_number().over(Window.partitionBy("label").orderBy("ordinal")) - 1
    return pts.withColumn("seen", seen).join(n, "label").select("label", "ordinal", F.least(F.lit(7), F.floor(F.col("seen") * 8 / F.col("n"))).cast("long").alias("bucket"))
