"""Queries over rasters, terrain, map tiles and coordinates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geodesy
from tessera.operators import lod
from tessera.operators import raster as op
from tessera.plans.registry import query
from tessera.plans.tables import RASTER, raster, table


@query("prj_gray", f"WITH {RASTER} SELECT row, col, floor(least(greatest(255.0::DOUBLE * ((value - 900.0::DOUBLE) / 1000.0::DOUBLE), 0), 255) + 0.5::DOUBLE)::BIGINT AS level FROM cells")
def prj_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).select("row", "col", op.gray(F.col("value"), 900.0, 1900.0).alias("level"))


@query("prj_alpha", f"WITH {RASTER} SELECT row, col, floor(least(greatest(value / 8, 0), 255) + 0.5::DOUBLE)::BIGINT AS alpha FROM cells")
def prj_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).select("row", "col", F.floor(F.least(F.greatest(F.col("value") / 8, F.lit(0.0)), F.lit(255.0)) + F.lit(0.5)).cast("long").alias("alpha"))


@query("prj_rgb8", "SELECT event_id, ((user_id * 37 % 65536) + 128) // 257 AS red FROM events")
def prj_rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", op.rgb8(F.col("user_id") * 37 % 65536).alias("red"))


@query("flt_nodata", f"WITH {RASTER} SELECT row, col, value FROM cells WHERE NOT abs(value - 1000.0::DOUBLE) <= 50.0::DOUBLE")
def flt_nodata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).where(~op.is_nodata(F.col("value"), 1000.0, 0.05)).select("row", "col", "value")


@query("flt_mask", f"WITH {RASTER} SELECT row, col, CASE WHEN valid THEN value ELSE 0.0::DOUBLE END AS value, CASE WHEN valid THEN 255 ELSE 0 END::BIGINT AS alpha FROM cells")
def flt_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("valid")
    return raster(spark, sf_dir).select("row", "col", F.when(v, F.col("value")).otherwise(0.0).alias("value"), F.when(v, 255).otherwise(0).cast("long").alias("alpha"))


@query("agg_height_range", f"WITH {RASTER} SELECT min(value) AS low, max(value) AS high FROM cells WHERE valid")
def agg_height_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).where("valid").agg(F.min("value").alias("low"), F.max("value").alias("high"))


_ERRORS = """d AS (SELECT l_returnflag AS flag, l_extendedprice * l_discount AS d FROM lineitem),
 b AS (SELECT flag, d, CASE WHEN d = 0 THEN 0 ELSE least(greatest(ceil((log2(d) + 256) * 32), 1), 16383) END::INT AS bin FROM d),
 c AS (SELECT flag, bin, count(*) AS n FROM b GROUP BY flag, bin),
 r AS (SELECT flag, bin, sum(n) OVER (PARTITION BY flag ORDER BY bin) AS upto FROM c),
 s AS (SELECT flag, count(*) AS samples, avg(d) AS mean, max(d) AS worst FROM d GROUP BY flag),
 q AS (SELECT flag, samples, mean, worst, (SELECT min(bin) FROM r WHERE r.flag = s.flag AND upto >= ceil(samples * 95 / 100.0)) AS a, (SELECT min(bin) FROM r WHERE r.flag = s.flag AND upto >= ceil(samples * 99 / 100.0)) AS z FROM s)"""


@query("agg_error_stats", f"WITH {_ERRORS} SELECT flag, samples, round(mean, 4) AS mean, round(CASE WHEN a = 0 THEN 0 ELSE least(2.0 ** (a / 32.0 - 256), worst) END, 4) AS p95, round(CASE WHEN z = 0 THEN 0 ELSE least(2.0 ** (z / 32.0 - 256), worst) END, 4) AS p99, worst FROM q")
def agg_error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") * F.col("l_discount")).alias("d"))
    return lod.error_statistics(li, "d", "flag").select("flag", "samples", *(F.round(c, 4).alias(c) for c in ("mean", "p95", "p99")), "worst")


_NODES = RASTER + ", nodes AS (SELECT row + a AS i, col + b AS j, min(valid) AS valid, count(*) AS pixels FROM cells, range(2) t(a), range(2) u(b) GROUP BY row + a, col + b)"


@query("lod_dem_valid", f"WITH {_NODES} SELECT i, j, valid, pixels FROM nodes")
def lod_dem_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.valid_nodes(raster(spark, sf_dir))


@query("lod_dem_mesh", f"WITH {_NODES}, good AS (SELECT i - a AS i, j - b AS j FROM nodes, range(2) t(a), range(2) u(b) WHERE valid GROUP BY i - a, j - b HAVING count(*) = 4) SELECT i, j, h::INT AS half FROM good, range(2) v(h)")
def lod_dem_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.mesh_cells(op.valid_nodes(raster(spark, sf_dir)))


@query("lod_dem_sample", f"""WITH {RASTER}, p AS (SELECT c_custkey AS id, (c_custkey % 39)::DOUBLE + 0.25::DOUBLE AS y, (c_custkey % 49)::DOUBLE + 0.5::DOUBLE AS x FROM customer),
n AS (SELECT id, a, b, floor(y)::BIGINT + a AS row, floor(x)::BIGINT + b AS col, (CASE WHEN a = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END) * 0.5::DOUBLE AS w FROM p, range(2) t(a), range(2) u(b)),
g AS (SELECT id, a, b, value * w AS t FROM n LEFT JOIN (SELECT * FROM cells WHERE valid) USING (row, col))
SELECT id, CASE WHEN count(t) = 4 THEN round(sum(t), 6) END AS value FROM g GROUP BY id""")
def lod_dem_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    points = table(spark, sf_dir, "customer").select(k.alias("id"), ((k % 39).cast("double") + 0.25).alias("y"), ((k % 49).cast("double") + 0.5).alias("x"))
    return op.bilinear(raster(spark, sf_dir), points).select("id", F.round("value", 6).alias("value"))


@query("par_windows", "SELECT c::INT AS col, r::INT AS row, least(256, 1000 - c)::INT AS width, least(256, 700 - r)::INT AS height FROM range(0, 1000, 256) t(c), range(0, 700, 256) u(r)")
def par_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.explode(op.windows(1000, 700, 256)).alias("w")).select("w.*")


@query("par_pyramid", "SELECT level, col, row, 1 << (3 - level) AS stride, least(5, (col + 1) << (3 - level)) - (col << (3 - level)) AS width, least(6, (row + 1) << (3 - level)) - (row << (3 - level)) AS height FROM range(4) t(level), range(8) u(col), range(8) v(row) WHERE (col << (3 - level)) < 5 AND (row << (3 - level)) < 6")
def par_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of the pyramid over 5 x 6 leaves."""
    depth, side = op.pyramid(5, 6)
    grid = spark.range(depth + 1).withColumnRenamed("id", "level").withColumn("stride", F.expr(f"shiftleft(1L, cast({depth} - level as int))"))
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.lit(n) - 1) / F.col("stride")).cast("long")))
    t = grid.withColumn("col", axis(5)).withColumn("row", axis(6))
    clip = lambda c, n: F.least(F.lit(n).cast("long"), (F.col(c) + 1) * F.col("stride")) - F.col(c) * F.col("stride")
    return t.select("level", "col", "row", "stride", clip("col", 5).alias("width"), clip("row", 6).alias("height"))


@query("par_xyz_pyramid", "SELECT z, x0, y0, x1, y1, (x1 - x0 + 1) * (y1 - y0 + 1) AS tiles FROM (SELECT z, 517 >> (10 - z) AS x0, 340 >> (10 - z) AS y0, 611 >> (10 - z) AS x1, 402 >> (10 - z) AS y1 FROM range(0, 11) t(z))")
def par_xyz_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = spark.range(11).withColumnRenamed("id", "z")
    at = [F.expr(f"shiftright({v}L, cast(10 - z as int))").alias(n) for v, n in ((517, "x0"), (340, "y0"), (611, "x1"), (402, "y1"))]
    return z.select("z", *at).withColumn("tiles", (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1))


@query("par_xyz_nearest", f"WITH {RASTER} SELECT x, y, value FROM (SELECT x, y, x * 4 + 2 AS col, y * 4 + 2 AS row FROM range(12) t(x), range(10) u(y)) LEFT JOIN cells USING (row, col)")
def par_xyz_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = spark.range(120).select((F.col("id") % 12).alias("x"), F.floor(F.col("id") / 12).cast("long").alias("y"))
    return pixels.withColumn("col", F.col("x") * 4 + 2).withColumn("row", F.col("y") * 4 + 2).join(raster(spark, sf_dir), ["row", "col"], "left").select("x", "y", "value")


_LON, _LAT = "(c_custkey % 350 - 174.3::DOUBLE)", "(c_custkey % 160 - 79.7::DOUBLE)"
_H = 3.141592653589793 * 6378137.0


@query("par_xyz_cover", f"SELECT c_custkey, floor(512.0::DOUBLE * (1.0::DOUBLE + 6378137.0::DOUBLE * {_LON} * {math.pi / 180}::DOUBLE / {_H}::DOUBLE))::BIGINT AS tx, floor(512.0::DOUBLE * (1.0::DOUBLE - 6378137.0::DOUBLE * ln(tan({math.pi / 4}::DOUBLE + {_LAT} * {math.pi / 180}::DOUBLE / 2.0::DOUBLE)) / {_H}::DOUBLE))::BIGINT AS ty FROM customer")
def par_xyz_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = geodesy.mercator_tile(k % 350 - F.lit(174.3), k % 160 - F.lit(79.7), 10)
    return table(spark, sf_dir, "customer").select("c_custkey", F.floor(x).cast("long").alias("tx"), F.floor(y).cast("long").alias("ty"))


_RAD = "p AS (SELECT c_custkey, (c_custkey % 350 - 174.3::DOUBLE) * 0.017453292519943295::DOUBLE AS lon, (c_custkey % 160 - 79.7::DOUBLE) * 0.017453292519943295::DOUBLE AS lat, c_acctbal AS h FROM customer)"
_ECEF = _RAD + f", n AS (SELECT *, 6378137.0::DOUBLE / sqrt(1.0::DOUBLE - {geodesy.E2!r}::DOUBLE * sin(lat) * sin(lat)) AS n FROM p), e AS (SELECT c_custkey, lon, lat, h, (n + h) * cos(lat) * cos(lon) AS x, (n + h) * cos(lat) * sin(lon) AS y, (n * {1 - geodesy.E2!r}::DOUBLE + h) * sin(lat) AS z FROM n)"


def _ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, rad = F.col("c_custkey"), F.lit(0.017453292519943295)
    c = table(spark, sf_dir, "customer").select("c_custkey", ((k % 350 - F.lit(174.3)) * rad).alias("lon"), ((k % 160 - F.lit(79.7)) * rad).alias("lat"), F.col("c_acctbal").alias("h"))
    x, y, z = geodesy.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.col("h"))
    return c.select("c_custkey", "lon", "lat", "h", x.alias("x"), y.alias("y"), z.alias("z"))


@query("prj_geodetic_ecef", f"WITH {_ECEF} SELECT c_custkey, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM e")
def prj_geodetic_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ecef(spark, sf_dir).select("c_custkey", *(F.round(a, 4).alias(a) for a in "xyz"))


@query("prj_ecef_geodetic", f"WITH {_ECEF} SELECT c_custkey, round(lon, 9) AS lon, round(lat, 9) AS lat, round(h, 3) AS h FROM e")
def prj_ecef_geodetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat, h = geodesy.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return _ecef(spark, sf_dir).select("c_custkey", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"), F.round(h, 3).alias("h"))


@query("prj_enu", None)
def prj_enu(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n, u = geodesy.ecef_to_enu(F.col("x"), F.col("y"), F.col("z"), 0.1, 0.8, 200.0)
    return _ecef(spark, sf_dir).select("c_custkey", F.round(e, 4).alias("east"), F.round(n, 4).alias("north"), F.round(u, 4).alias("up"))
