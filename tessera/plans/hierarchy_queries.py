"""Queries over tile trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numeric import morton
from tessera.operators import hierarchy as op
from tessera.plans.registry import query
from tessera.plans.tables import FEATURES, features, table
from tessera.sinks.subtree import availability, subtrees
from tessera.sources.subtree import listed_tiles

_KD = f"""WITH RECURSIVE {FEATURES}, t AS (SELECT *, '' AS path, count(*) OVER () <= 64 AS leaf FROM feats UNION ALL
 SELECT layer, id, x, y, z, segment, path || side, count(*) OVER (PARTITION BY path || side) <= 64 FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY path ORDER BY along, layer, id) <= n // 2 THEN '0' ELSE '1' END AS side FROM (
   SELECT *, CASE WHEN ez > ex AND ez > ey THEN z WHEN ey > ex THEN y ELSE x END AS along FROM (
    SELECT *, count(*) OVER w AS n, max(x) OVER w - min(x) OVER w AS ex, max(y) OVER w - min(y) OVER w AS ey, max(z) OVER w - min(z) OVER w AS ez FROM t WHERE NOT leaf WINDOW w AS (PARTITION BY path)))))
"""


def _kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.kd_median(features(spark, sf_dir), 64, ("layer", "id"))


@query("par_kd_median", _KD + "SELECT layer, id, x, y, z, segment, path FROM t WHERE leaf")
def par_kd_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kd(spark, sf_dir)


@query("par_leaf_test", _KD + "SELECT path, count(*) AS n, count(*) <= 64 AS fits FROM t WHERE leaf GROUP BY path")
def par_leaf_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kd(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n")).withColumn("fits", F.col("n") <= 64)


@query("win_median_cut", f"WITH {FEATURES}, r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY x, id) AS k, count(*) OVER (PARTITION BY layer) AS n FROM feats) SELECT layer, id, x FROM r WHERE k = n // 2")
def win_median_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    n = f.groupBy("layer").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("layer").orderBy("x", "id"))
    return f.withColumn("k", k).join(n, "layer").where(F.col("k") == F.floor(F.col("n") / 2)).select("layer", "id", "x")


_PREFIXES = _KD + ", p AS (SELECT substr(path, 1, k) AS prefix, x, y, z FROM t, range(65) u(k) WHERE leaf AND k <= length(path))"


@query("agg_prefix_stats", _PREFIXES + " SELECT prefix, count(*) AS n, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM p GROUP BY prefix")
def agg_prefix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = op.leaf_then_prefix(_kd(spark, sf_dir))
    return got.withColumn("n", F.col("n").cast("long"))


def _first(level: int) -> int:
    """Key of the first tile of a level."""
    return ((1 << 2 * level) - 1) // 3


def _base4(n: Column) -> Column:
    return F.conv(n.cast("string"), 10, 4)


def _once(value: Column) -> Column:
    """A column that is computed once a row, whatever reads it."""
    return F.explode(F.array(value))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile tree of all parts: keys fill the levels of a tree of four children a tile in order, so that it deepens as the table grows. Errors mostly fall.
    Keys beyond level 30, the last one, begin it again.

    Paths are generated, not projected: the optimizer would copy their expression into every filter that is pushed below them.
    """
    k = F.col("p_partkey").cast("long")
    level = F.when(k >= F.lit(_first(30)), 30).when(k > 0, F.length(_base4(k * 3 + 1)) - 1).otherwise(0)
    p = table(spark, sf_dir, "part").select(k.alias("p_partkey"), F.col("p_retailprice").cast("double").alias("error"), F.col("p_size").cast("long").alias("size"), _once(level).alias("level"))
    at = (k - F.expr("(shiftleft(1L, 2 * level) - 1) div 3")).bitwiseAND(F.expr("shiftleft(1L, 2 * level) - 1"))
    digits = F.when(F.col("level") > 0, F.lpad(_base4(at), F.col("level"), F.lit("0"))).otherwise("")
    parent = F.when(F.length("path") > 0, F.expr("substring(path, 1, length(path) - 1)"))
    return p.select("error", "size", _once(digits).alias("path")).select("path", "error", "size", _once(parent).alias("parent"))


_TILES = """levels AS (SELECT *, len(list_filter(range(1, 31), lambda n: p_partkey >= ((1::BIGINT << (2 * n)::INT) - 1) // 3)) AS level FROM part),
tiles AS (SELECT path, error, size, CASE WHEN length(path) > 0 THEN substr(path, 1, length(path) - 1) END AS parent FROM (SELECT p_retailprice::DOUBLE AS error, p_size::BIGINT AS size,
 array_to_string(list_transform(range(1, level + 1), lambda i: ((p_partkey - ((1::BIGINT << (2 * level)::INT) - 1) // 3) >> (2 * (level - i))::INT) & 3), '') AS path FROM levels))"""


@query("agg_max_error", f"WITH {_TILES} SELECT a.path, max(b.error) AS error FROM tiles a JOIN tiles b ON starts_with(b.path, a.path) GROUP BY a.path")
def agg_max_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.max_error(_tiles(spark, sf_dir))


@query("hier_roles", f"""WITH {_TILES}, h AS (SELECT a.path, any_value(a.parent) AS parent, max(length(b.path)) - length(a.path) AS height FROM tiles a JOIN tiles b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT h.path, h.height::INT AS height, CASE WHEN h.height >= 4 THEN 'skeleton' WHEN h.path = '' THEN 'implicit_root' WHEN u.height >= 4 AND h.height = 0 THEN 'explicit_leaf' WHEN u.height >= 4 THEN 'implicit_root' ELSE 'implicit' END AS role FROM h LEFT JOIN h u ON u.path = h.parent""")
def hier_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.roles(_tiles(spark, sf_dir).select("path"))


@query("val_error_order", f"WITH {_TILES} SELECT c.path, c.parent, c.error, p.error AS parent_error FROM tiles c JOIN tiles p ON p.path = c.parent WHERE c.error > p.error")
def val_error_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.error_violations(_tiles(spark, sf_dir))


@query("jn_parent_child", f"WITH {_TILES} SELECT c.path, p.error AS parent_error FROM tiles c JOIN tiles p ON p.path = c.parent")
def jn_parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tiles(spark, sf_dir)
    up = t.select(F.col("path").alias("parent"), F.col("error").alias("parent_error"))
    return t.join(up.hint("merge"), "parent").select("path", "parent_error")


@query("val_budgets", f"WITH {_TILES} SELECT path, size, size <= 40 AS within FROM tiles")
def val_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("path", "size", (F.col("size") <= 40).alias("within"))


@query("agg_depth_bounds", f"WITH {_TILES} SELECT length(path)::INT AS depth, count(*) AS n, min(error) AS least, max(error) AS most FROM tiles GROUP BY length(path)")
def agg_depth_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).groupBy(F.length("path").alias("depth")).agg(F.count("*").alias("n"), F.min("error").alias("least"), F.max("error").alias("most"))


@query("agg_level_report", f"WITH {_TILES} SELECT length(path)::INT AS level, count(*) AS tiles, sum(size)::BIGINT AS size FROM tiles GROUP BY length(path)")
def agg_level_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).groupBy(F.length("path").alias("level")).agg(F.count("*").alias("tiles"), F.sum("size").alias("size"))


@query("agg_counters", f"WITH {_TILES} SELECT count(*) AS tiles, count(*) FILTER (path NOT IN (SELECT parent FROM tiles WHERE parent IS NOT NULL)) AS leaves, max(size) AS largest, max(error) AS worst FROM tiles")
def agg_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tiles(spark, sf_dir)
    inner = t.where("parent is not null").select(F.col("parent").alias("path"), F.lit(1).alias("inner")).distinct()
    t = t.join(inner.hint("merge"), "path", "left")
    return t.agg(F.count("*").alias("tiles"), F.sum(F.col("inner").isNull().cast("long")).alias("leaves"), F.max("size").alias("largest"), F.max("error").alias("worst"))


@query("agg_leaf_fragments", f"WITH {_TILES} SELECT parent, count(*) AS fragments, sum(size)::BIGINT AS total FROM tiles WHERE parent IS NOT NULL GROUP BY parent")
def agg_leaf_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).where("parent is not null").groupBy("parent").agg(F.count("*").alias("fragments"), F.sum("size").alias("total"))


@query("agg_empty_parent", f"WITH {_TILES} SELECT path, greatest(error, 16.0::DOUBLE * size) AS error FROM tiles")
def agg_empty_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("path", op.empty_parent_error(F.col("error"), F.col("size").cast("double")).alias("error"))


@query("agg_top_error", f"WITH {_TILES} SELECT path, greatest(1.0::DOUBLE, error * 2.0::DOUBLE, size::DOUBLE) AS error FROM tiles WHERE path = ''")
def agg_top_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).where("path = ''").select("path", op.top_error(F.col("error"), 2.0, F.col("size").cast("double")).alias("error"))


@query("win_preorder", f"WITH {_TILES} SELECT path, row_number() OVER (ORDER BY path) - 1 AS place FROM tiles")
def win_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.feature_queries import _placed

    return _placed(_tiles(spark, sf_dir).select("path"), "path").withColumn("place", F.col("place") - 1)


@query("lod_levels", f"WITH {_TILES} SELECT path, level, size * (2.0::DOUBLE ** (level - 1)) AS tolerance FROM tiles, range(1, 4) t(level)")
def lod_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tiles(spark, sf_dir).select("path", "size", F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>")).alias("level"))
    return t.select("path", "level", (F.col("size") * F.pow(F.lit(2.0), F.col("level") - 1)).alias("tolerance"))


@query("lod_skip_level", f"WITH {_TILES}, l AS (SELECT parent, path, size, lag(size) OVER (PARTITION BY parent ORDER BY path) AS finer FROM tiles WHERE parent IS NOT NULL) SELECT path, size FROM l WHERE finer IS NULL OR size < finer")
def lod_skip_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    finer = F.lag("size").over(Window.partitionBy("parent").orderBy("path"))
    return _tiles(spark, sf_dir).where("parent is not null").withColumn("finer", finer).where("finer is null or size < finer").select("path", "size")


@query("hier_morton", "SELECT x, y, z, sum((((x >> k) & 1) << (3 * k)) | (((y >> k) & 1) << (3 * k + 1)) | (((z >> k) & 1) << (3 * k + 2)))::BIGINT AS place FROM range(16) t(x), range(16) u(y), range(16) v(z), range(4) w(k) GROUP BY x, y, z")
def hier_morton(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    cells = spark.range(4096).select(i.bitwiseAND(F.lit(15)).alias("x"), F.shiftright(i, 4).bitwiseAND(F.lit(15)).alias("y"), F.shiftright(i, 8).alias("z"))
    return cells.withColumn("place", morton(F.col("x"), F.col("y"), F.col("z")))


@query("hier_templates", f"WITH {_TILES} SELECT path, length(path) || '-' || size || '-' || (size * 3) AS uri FROM tiles")
def hier_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("path", F.format_string("%d-%d-%d", F.length("path"), F.col("size"), F.col("size") * 3).alias("uri"))


@query("hier_derived_box", "SELECT level, x, x * (100.0::DOUBLE / (1 << level)) AS low, (x + 1) * (100.0::DOUBLE / (1 << level)) AS high FROM range(0, 6) t(level), range(0, 32) u(x) WHERE x < (1 << level)")
def hier_derived_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.range(6).withColumnRenamed("id", "level").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, cast(level as int)) - 1"))))
    width = F.lit(100.0) / F.expr("shiftleft(1L, cast(level as int))")
    return cells.select("level", "x", (F.col("x") * width).alias("low"), ((F.col("x") + 1) * width).alias("high"))


_CELLS = """leaves AS (SELECT (p_partkey * 37 + p_size * 11) % 4096 AS place, p_size % 2 = 1 AS content FROM part UNION ALL SELECT x, false FROM range(64) t(x)),
 cells AS (SELECT 6 - k AS level, place >> (2 * k) AS place, bool_or(content AND k = 0 OR k = 3) AS content FROM leaves, range(7) t(k) GROUP BY 1, 2)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles over leaves that the parts choose at level 6 of a quadtree, the first 64 always; level 3 and some leaves have content."""
    p = table(spark, sf_dir, "part").select(((F.col("p_partkey") * 37 + F.col("p_size") * 11) % 4096).alias("place"), (F.col("p_size") % 2 == 1).alias("content"))
    leaves = p.unionByName(spark.range(64).select(F.col("id").alias("place"), F.lit(False).alias("content")))
    up = leaves.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return up.select((F.lit(6) - F.col("k")).alias("level"), F.expr("shiftright(place, 2 * k)").alias("place"), ((F.col("content") & (F.col("k") == 0)) | (F.col("k") == 3)).alias("content"))


_STREAMS = """marks AS (SELECT level - level % 3 AS root_level, place >> (2 * (level % 3)) AS root_place, 'tile' AS stream, 21 AS total, level, place FROM cells
 UNION ALL SELECT level - level % 3, place >> (2 * (level % 3)), 'content', 21, level, place FROM cells WHERE content
 UNION ALL SELECT level - 3, place >> 6, 'child', 64, level, place FROM cells WHERE level % 3 = 0 AND level > 0)"""


@query("agg_availability", f"WITH {_CELLS}, {_STREAMS} SELECT r.root_level::INT AS root_level, r.root_place, v.stream, count(m.level) AS available, CASE WHEN count(m.level) = 0 THEN 0 WHEN count(m.level) = max(v.total) THEN 1 END::INT AS constant FROM (SELECT DISTINCT root_level, root_place FROM marks) r CROSS JOIN (VALUES ('tile', 21), ('content', 21), ('child', 64)) v(stream, total) LEFT JOIN marks m ON m.root_level = r.root_level AND m.root_place = r.root_place AND m.stream = v.stream GROUP BY ALL")
def agg_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return availability(_cells(spark, sf_dir), 2, 3).drop("words")


@query("src_subtree", f"WITH {_CELLS} SELECT level::INT AS level, place, content FROM cells")
def src_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles written as binary subtrees of three levels and listed from them again."""
    return listed_tiles(subtrees(_cells(spark, sf_dir), 2, 3), 2, 3)


@query("src_list_tiles", f"WITH {_TILES} SELECT path, length(path)::INT AS depth, NOT EXISTS (SELECT 1 FROM tiles c WHERE c.parent = tiles.path) AS leaf, error FROM tiles")
def src_list_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tiles(spark, sf_dir)
    inner = t.select(F.col("parent").alias("path")).where("path is not null").distinct().withColumn("inner", F.lit(True))
    return t.join(inner.hint("merge"), "path", "left").select("path", F.length("path").alias("depth"), F.col("inner").isNull().alias("leaf"), "error")


@query("src_tileset", "WITH RECURSIVE t AS (SELECT r_regionkey AS id, r_name AS name, 0 AS depth FROM region UNION ALL SELECT n_nationkey, n_name, t.depth + 1 FROM t JOIN nation ON n_regionkey = t.id WHERE t.depth = 0) SELECT id, name, depth::INT AS depth FROM t")
def src_tileset(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(0).alias("depth"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("up"))
    below = n.join(roots.select(F.col("id").alias("up")), "up").select("id", "name", F.lit(1).alias("depth"))
    return roots.unionByName(below)
