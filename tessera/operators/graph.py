"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.checkpoints import stored
from tessera.operators.hierarchy import prefixes


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, component): the least node of each node's component; edges with a null end are ignored, a node linked to itself is alone.

    Alternating large and small stars: every round links each node's neighbours to the least one
    of them, by two aggregations and equi-joins. Only minima are kept per node, no neighbour lists,
    so that a hub costs no more than its edges. Rounds grow with the logarithm of the longest chain.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null").distinct()
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    links = stored(e.where("u <> v"), "stars")

    def both(x: DataFrame) -> DataFrame:
        return x.select("u", "v").union(x.select(F.col("v").alias("u"), F.col("u").alias("v")))

    for _ in range(rounds):
        sides = both(links)
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(lowest, "u")
        after = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v"))).distinct()
        after = stored(after, "stars")
        # stars only: nobody's centre is itself linked below another node, and nobody has two centres
        unsettled = not after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() or not after.groupBy("u").count().where("count > 1").isEmpty()
        links = after
        if not unsettled:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def co_render_groups(holders: DataFrame) -> DataFrame:
    """(path, grp): tiles that must be drawn on one grid: holders(vertex, path) that share a vertex, unless one is the other's ancestor.

    A vertex's holders that are related to all others are a chain from the top; below it there are
    two branches at least, so that all the rest hangs together. These link to their least one: a
    vertex costs a link per holder, not all pairs. Which tiles are relatives is asked of the tiles
    once, not of every vertex's holders; where none are, the least and greatest holder tell all.
    """
    rows = holders.select("vertex", "path").where("vertex is not null and path is not null")
    tiles = stored(holders.select("path").where("path is not null").distinct(), "groups")
    lines = tiles.select("path", F.explode(prefixes()).alias("prefix")).where("prefix <> path")
    pairs = stored(lines.join(tiles.withColumnRenamed("path", "prefix"), "prefix", "left_semi").select("path", "prefix"), "groups")
    if pairs.isEmpty():
        mixed = rows
        least = rows.groupBy("vertex").agg(F.min("path").alias("b"), F.max("path").alias("last")).where("b <> last").drop("last")
    else:
        h = rows.distinct()
        kin = h.join(pairs, "path").join(h.withColumnRenamed("path", "prefix"), ["vertex", "prefix"])
        related = kin.select("vertex", "path").union(kin.select("vertex", "prefix")).groupBy("vertex", "path").agg(F.count("*").alias("kin"))
        total = h.groupBy("vertex").agg(F.count("*").alias("n"))
        mixed = h.join(total, "vertex").join(related, ["vertex", "path"], "left").where(F.coalesce("kin", F.lit(0)) + 1 < F.col("n")).select("vertex", "path")
        least = mixed.groupBy("vertex").agg(F.min("path").alias("b"))
    links = mixed.join(least, "vertex").select(F.col("path").alias("a"), "b").distinct()
    alone = tiles.select(F.col("path").alias("a"), F.col("path").alias("b"))
    return components(stored(links.union(alone), "groups")).select(F.col("node").alias("path"), F.col("component").alias("grp"))
