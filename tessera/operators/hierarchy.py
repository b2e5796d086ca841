"""Tile trees keyed by path strings: partitions by median, bottom-up passes, implicit addresses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from tessera.functions.numeric import norm
from tessera.operators.checkpoints import stored

AXES = ("x", "y", "z")
#: Rows of a prefix that one task finishes by itself.
WHOLE = 50_000


def _halved(cut: DataFrame, names: list[str], order: tuple[str, ...]) -> DataFrame:
    """Rows with 0 or 1 appended to their path by rank in their prefix, without a task that holds a whole prefix.

    The rows are dealt by ranges of (path, order), sorted and stored with their place in the part;
    a row's rank is its place after its part's first row of the prefix, plus the prefix's rows in earlier parts.
    """
    dealt = cut.select(*names, "path", "n", *(c for c in order if c not in names)).repartitionByRange("path", *order).sortWithinPartitions("path", *order)
    dealt = stored(dealt.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "kd")
    runs = dealt.groupBy("path", "part").agg(F.min("seq").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("path", "part", (F.col("first") - F.coalesce(before, F.lit(0))).alias("base"))
    side = F.when(F.col("seq") - F.col("base") < F.floor(F.col("n") / 2), "0").otherwise("1")
    return dealt.join(runs, ["path", "part"]).select(*names, F.concat("path", side).alias("path"))


def _halves(at: np.ndarray, rank: np.ndarray, max_features: int, depth: int) -> list[str]:
    """The digits below a prefix for each of its points (n x 3), rank being their place in the order that settles ties."""
    out = np.full(len(at), "", object)
    open_parts = [(np.arange(len(at)), "")]
    while open_parts:
        rows, path = open_parts.pop()
        if len(rows) <= max_features or len(path) == depth:
            out[rows] = path
            continue
        own = at[rows]
        x, y, z = np.nan_to_num(np.nanmax(own, axis=0) - np.nanmin(own, axis=0))
        along = own[:, 2 if z > x and z > y else 1 if y > x else 0]
        by = rows[np.lexsort((rank[rows], np.where(np.isnan(along), -np.inf, along)))]
        open_parts += [(by[: len(by) // 2], path + "0"), (by[len(by) // 2 :], path + "1")]
    return out.tolist()


def kd_median(features: DataFrame, max_features: int, order: tuple[str, ...] = ("sortkey", "id"), max_depth: int = 64) -> DataFrame:
    """features with the path of their leaf in a binary partition at medians.

    The longest axis of a prefix's box is cut (the earlier one on ties); the count div 2 first
    rows in (axis, order) go to 0, the others to 1. Prefixes of more than WHOLE rows are cut a
    level a pass, all together; smaller ones are finished by one task each.
    """
    names = features.columns
    shape = StructType([*features.schema.fields, StructField("path", StringType())])
    limit = max(WHOLE, max_features)

    def finish(table: pa.Table) -> pa.Table:
        at = np.stack([table.column(a).to_numpy().astype(float) for a in AXES], axis=1)
        rank = np.empty(len(at), np.int64)
        rank[pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start").to_numpy()] = np.arange(len(at))
        before = table.column("path")[0].as_py()
        digits = _halves(at, rank, max_features, max_depth - len(before))
        return table.set_column(table.schema.get_field_index("path"), "path", pa.array([before + d for d in digits], pa.string()))

    rows = features.withColumn("path", F.lit(""))
    done = []
    for depth in range(max_depth):
        box = [f(a).alias(f"{p}{a}") for a in AXES for f, p in ((F.min, "l"), (F.max, "h"))]
        stats = rows.groupBy("path").agg(F.count("*").alias("n"), *box)
        ex = {a: F.col(f"h{a}") - F.col(f"l{a}") for a in AXES}
        axis = F.when((ex["z"] > ex["x"]) & (ex["z"] > ex["y"]), "z").when(ex["y"] > ex["x"], "y").otherwise("x")
        split = stored(stats.select("path", "n", axis.alias("axis")).where(F.col("n") > limit), "kd")
        if split.isEmpty():
            break
        if depth:
            done.append(rows.join(split.select("path"), "path", "left_anti").select(*names, "path"))
        cut = rows.join(split, "path").withColumn("along", F.when(F.col("axis") == "x", F.col("x")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("z")))
        rows = _halved(cut, names, ("along", *order))
    else:
        return _together(done, rows.select(*names, "path"))
    return _together([d.groupBy("path").applyInArrow(finish, shape) for d in done], rows.select(*names, "path").groupBy("path").applyInArrow(finish, shape))


def _together(parts: list[DataFrame], last: DataFrame) -> DataFrame:
    for p in parts:
        last = last.unionByName(p)
    return last


def prefixes(path: str = "path") -> Column:
    """All prefixes of a path, itself and the empty one included."""
    return F.transform(F.sequence(F.lit(0), F.length(path)), lambda k: F.substring(F.col(path), F.lit(1), k))


def prefix_stats(rows: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates of every prefix at once. Leaves are summed before their prefixes are exploded, so that the explosion is of tiles, not of rows."""
    return rows.select(F.explode(prefixes()).alias("prefix"), "*").groupBy("prefix").agg(*aggs)


def leaf_then_prefix(rows: DataFrame) -> DataFrame:
    """Count and box per prefix from the leaf aggregates."""
    box = [f(a).alias(f"{p}{a}") for a in AXES for f, p in ((F.min, "l"), (F.max, "h"))]
    leaves = rows.groupBy("path").agg(F.count("*").alias("n"), *box)
    again = [f(f"{p}{a}").alias(f"{p}{a}") for a in AXES for f, p in ((F.min, "l"), (F.max, "h"))]
    return prefix_stats(leaves, F.sum("n").alias("n"), *again)


def _of_tiles(tiles: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregates of those prefixes that are tiles themselves, which are told by their own row instead of a join."""
    return prefix_stats(tiles, *aggs, F.max(F.length("prefix") == F.length("path")).alias("own")).where("own").drop("own")


def max_error(tiles: DataFrame) -> DataFrame:
    """Each tile's error raised to the largest below it: tiles(path, error) -> (path, error)."""
    return _of_tiles(tiles, F.max("error").alias("error")).select(F.col("prefix").alias("path"), "error")


def heights(tiles: DataFrame) -> DataFrame:
    """Height of each tile: 0 for a leaf, else one more than its highest child's; tiles(path)."""
    depth = tiles.select("path", F.length("path").alias("deepest"))
    return _of_tiles(depth, F.max("deepest").alias("deepest")).select(F.col("prefix").alias("path"), (F.col("deepest") - F.length("prefix")).alias("height"))


def roles(tiles: DataFrame, levels: int = 4) -> DataFrame:
    """Delivery role by height: parents of `levels` levels or more are skeleton, what hangs below them is explicit leaf or implicit root, the rest implicit."""
    high = heights(tiles)
    parent = high.select(F.col("path").alias("up"), (F.col("height") >= levels).alias("up_skeleton"))
    joined = high.withColumn("up", F.expr("substring(path, 1, length(path) - 1)")).join(parent.hint("merge"), "up", "left")
    root = F.length("path") == 0
    role = (
        F.when(F.col("height") >= levels, "skeleton")
        .when(root, "implicit_root")
        .when(F.col("up_skeleton") & (F.col("height") == 0), "explicit_leaf")
        .when(F.col("up_skeleton"), "implicit_root")
        .otherwise("implicit")
    )
    return joined.select("path", "height", role.alias("role"))


def error_violations(tiles: DataFrame) -> DataFrame:
    """Children whose error exceeds their parent's: tiles(path, parent, error)."""
    up = tiles.select(F.col("path").alias("parent"), F.col("error").alias("parent_error"))
    return tiles.where("parent is not null").join(up.hint("merge"), "parent").where("error > parent_error").select("path", "parent", "error", "parent_error")


def bounds_violations(tiles: DataFrame) -> DataFrame:
    """Children whose box leaves their parent's: tiles(path, parent, l*, h*)."""
    up = tiles.select(F.col("path").alias("parent"), *(F.col(f"{p}{a}").alias(f"p{p}{a}") for a in AXES for p in "lh"))
    out = F.lit(False)
    for a in AXES:
        out = out | (F.col(f"l{a}") < F.col(f"pl{a}")) | (F.col(f"h{a}") > F.col(f"ph{a}"))
    return tiles.where("parent is not null").join(up.hint("merge"), "parent").where(out).select("path", "parent")


def diagonal(p: str = "") -> Column:
    return norm(*(F.col(f"{p}h{a}") - F.col(f"{p}l{a}") for a in AXES))


def empty_parent_error(error: Column, diag: Column, scale: float = 16.0) -> Column:
    """A tile without content shows nothing of its box, so that its error is a multiple of the diagonal at least."""
    return F.greatest(error, F.lit(scale) * diag)


def top_error(root_error: Column, margin: float, diag: Column) -> Column:
    return F.greatest(F.lit(1.0), root_error * F.lit(margin), diag)


def unresolved(members: DataFrame, references: DataFrame, name: str = "name") -> DataFrame:
    """References without a member and members without a reference, told by one aggregation over both; a null name resolves nothing."""
    both = references.select(name, F.lit(True).alias("asked"), F.lit(False).alias("there")).unionByName(members.select(name, F.lit(False).alias("asked"), F.lit(True).alias("there")))
    sides = both.groupBy(name).agg(F.max("asked").alias("asked"), F.max("there").alias("there"))
    open_end = F.col(name).isNull()
    missing = F.when(F.col("asked") & (~F.col("there") | open_end), "missing")
    unused = F.when(F.col("there") & (~F.col("asked") | open_end), "unreferenced")
    return sides.select(name, F.explode(F.array_compact(F.array(missing, unused))).alias("problem"))
