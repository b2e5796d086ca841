"""Point clouds: octrees, samples and keys. Points are rows with an ordinal and x, y, z doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tessera.functions.numeric import cell, integer_root, morton, no_negative_zero, norm
from tessera.operators.checkpoints import stored

AXES = ("x", "y", "z")
MAX_DEPTH = 31
#: Rows of a node that one task finishes by itself.
WHOLE = 50_000
#: Octant digits of a pass at most, and halvings after which no two doubles share a cell that can be halved.
DIGITS, HALVINGS = 7, 2200


def bounds(points: DataFrame, *by: str) -> DataFrame:
    """Count and box, over all points or per group."""
    aggs = [F.count("*").alias("n")]
    aggs += [no_negative_zero(f(a)).alias(f"{p}{a}") for a in AXES for f, p in ((F.min, "l"), (F.max, "h"))]
    return points.groupBy(*by).agg(*aggs)


def _branching_cell(low: np.ndarray, high: np.ndarray, cell: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (n x 3 corners) halved towards the data in low .. high while it lies in one octant; and which ones never branch."""
    c, d = (x.copy() for x in cell)
    todo = np.ones(len(c), bool)
    for _ in range(HALVINGS):
        mid = c + (d - c) / 2.0
        above = low >= mid
        todo &= ((high < mid) | above).all(axis=1)
        if not todo.any():
            break
        c = np.where(todo[:, None] & above, mid, c)
        d = np.where(todo[:, None] & ~above, mid, d)
    return c, d, todo


def _octants(at: np.ndarray, c: np.ndarray, d: np.ndarray, digits: int) -> np.ndarray:
    """The octants (x + 2y + 4z above the middle) that points (n x 3) fall into on the way down from their cells, three bits each, the first one uppermost."""
    key = np.zeros(len(at), np.int64)
    for _ in range(digits):
        mid = c + (d - c) / 2.0
        above = at >= mid
        key = key << 3 | above @ np.array([1, 2, 4])
        c, d = np.where(above, mid, c), np.where(above, d, mid)
    return key


def _dealt(rank: np.ndarray, n: int, max_points: int, depth: int) -> list[str]:
    """Digits of rows without extent, dealt by rank into 8 buckets a level until these fit."""
    out = [""] * len(rank)
    open_parts = [(np.arange(len(rank)), rank, n, 0)]
    while open_parts:
        rows, seen, n, k = open_parts.pop()
        if n <= max_points or k == depth or not len(rows):
            continue
        bucket = np.minimum(7, np.floor(seen * 8 / n)).astype(np.int64)
        for b in np.unique(bucket).tolist():
            here = bucket == b
            first = -(-b * n // 8)
            size = (-(-(b + 1) * n // 8) if b < 7 else n) - first
            for i in rows[here].tolist():
                out[i] += str(b)
            open_parts.append((rows[here], seen[here] - first, size, k + 1))
    return out


def _subtree(at: np.ndarray, ordinal: np.ndarray, cell: tuple[np.ndarray, np.ndarray], max_points: int, depth: int) -> np.ndarray:
    """The digits below a node for each of its points (n x 3)."""
    out = np.full(len(at), "", object)
    open_nodes = [(np.arange(len(at)), *cell, "")]
    while open_nodes:
        rows, c, d, path = open_nodes.pop()
        if len(rows) <= max_points or len(path) == depth:
            out[rows] = path
            continue
        own = at[rows]
        c, d, stuck = _branching_cell(own.min(axis=0)[None], own.max(axis=0)[None], (c[None], d[None]))
        if stuck[0]:
            rank = np.empty(len(rows), np.int64)
            rank[np.argsort(ordinal[rows], kind="stable")] = np.arange(len(rows))
            out[rows] = [path + x for x in _dealt(rank, len(rows), max_points, depth - len(path))]
            continue
        mid = c[0] + (d[0] - c[0]) / 2.0
        above = own >= mid
        octant = above @ np.array([1, 2, 4])
        for o in np.unique(octant).tolist():
            up = np.array([o & 1, o >> 1 & 1, o >> 2 & 1], bool)
            open_nodes.append((rows[octant == o], np.where(up, mid, c[0]), np.where(up, d[0], mid), path + str(o)))
    return out


def _xyz(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(a).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(a).to_numpy() for a in AXES], axis=1).astype(float)


def octree(points: DataFrame, max_points: int, ordinal: str = "ordinal", max_depth: int = MAX_DEPTH) -> DataFrame:
    """points with the path of their leaf: one digit 0..7 (x + 2y + 4z above the cell's middle) per level.

    A node with more than max_points rows splits at the middle of its cell, which is the root's
    box halved on the way down; before that, the cell shrinks while all rows share an octant. Rows
    of a node without extent are dealt by order into 8 buckets.

    A node of at most WHOLE rows is finished in one task. For larger ones a pass computes several digits
    of all rows at once, counts the cells that are met, and reads from the counts of their prefixes
    which digits branch: an aggregation a pass, not a level. A large node without extent is ranked by
    range partitions and prefix counts, so that no task holds it.
    """
    names = points.columns
    shape = StructType([*points.schema.fields, StructField("path", StringType())])
    root = bounds(points).first()
    if not root["n"]:
        return points.withColumn("path", F.lit(""))
    top = tuple(np.array([[root[f"{p}{a}"] for a in AXES]]) for p in "lh")
    limit = max(WHOLE, max_points)

    def finish(table: pa.Table) -> pa.Table:
        at, before = _xyz(table), table.column("path")[0].as_py()
        digits = _subtree(at, table.column(ordinal).to_numpy(), (top[0][0], top[1][0]), max_points, max_depth - len(before))
        return table.set_column(table.schema.get_field_index("path"), "path", pa.array([before + x for x in digits], pa.string()))

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each open node: where its cell branches, and whether it never does."""
        for batch in batches:
            low, high = (np.stack([batch.column(f"{p}{a}").to_numpy(zero_copy_only=False) for a in AXES], axis=1).astype(float) for p in "lh")
            c, d, stuck = _branching_cell(low, high, tuple(np.repeat(x, len(low), axis=0) for x in top))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("n"), *(pa.array(x[:, k]) for x in (c, d) for k in range(3)), pa.array(stuck)], names=["path", "n", *(f"{p}{a}" for p in "cd" for a in AXES), "stuck"])

    rows, done = points.withColumn("path", F.lit("")), []
    large = None if root["n"] <= limit else spark_row(points, root)
    while large is not None:
        nodes = stored(large.mapInArrow(cells_of, "path string, n long, " + ", ".join(f"{p}{a} double" for p in "cd" for a in AXES) + ", stuck boolean"), "octree")
        digits = max(2, min(DIGITS, 1 + int(np.ceil(np.log(nodes.agg(F.max("n")).first()[0] / limit) / np.log(8)))))
        spread = nodes.where("not stuck").select("path", *(F.col(f"{p}{a}").alias(f"cell {p}{a}") for p in "cd" for a in AXES))

        def key(batches: Iterator[pa.RecordBatch], digits: int = digits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c, d = (np.stack([batch.column(f"cell {p}{a}").to_numpy(zero_copy_only=False) for a in AXES], axis=1).astype(float) for p in "cd")
                found = _octants(_xyz(batch), c, d, digits)
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (*names, "path")), pa.array(found)], names=[*names, "path", "cell key"])

        keyed = stored(rows.join(spread, "path").select(*names, "path", *spread.columns[1:]).mapInArrow(key, StructType([*shape.fields, StructField("cell key", LongType())])), "octree")
        cells = stored(keyed.groupBy("path", "cell key").agg(F.count("*").alias("n")).withColumnRenamed("cell key", "k"), "octree")
        levels = F.explode(F.sequence(F.lit(0), F.lit(digits))).alias("level")
        prefix = cells.select("path", "k", "n", levels).withColumn("p", F.expr(f"shiftright(k, cast(3 * ({digits} - level) as int))"))
        sums = prefix.groupBy("path", "level", "p").agg(F.sum("n").alias("n"))
        children = sums.where("level > 0").groupBy("path", (F.col("level") - 1).alias("level"), F.shiftright("p", 3).alias("p")).agg(F.count("*").alias("m"))
        branching = sums.join(children, ["path", "level", "p"]).where((F.col("n") > limit) & (F.col("m") > 1)).select("path", "level", "p")
        digit = F.expr(f"cast(shiftright(k, cast(3 * ({digits} - 1 - level) as int)) & 7L as string)")
        taken = prefix.where(F.col("level") < digits).join(branching, ["path", "level", "p"]).groupBy("path", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", digit.alias("digit")))), lambda x: x["digit"]), "").alias("digits"))
        new = cells.join(taken, ["path", "k"], "left").select("path", F.col("k").alias("cell key"), F.concat("path", F.coalesce("digits", F.lit(""))).alias("new"))
        new = stored(new.withColumn("new", F.substring("new", 1, max_depth)), "octree")
        moved = keyed.join(new, ["path", "cell key"]).select(*names, F.col("new").alias("path"))
        sizes = cells.join(new.withColumnRenamed("cell key", "k"), ["path", "k"]).groupBy(F.col("new").alias("path")).agg(F.sum("n").alias("n")).where(F.col("n") > limit)
        stuck = nodes.where("stuck").select("path", F.col("n").alias("node rows"))
        if not stuck.isEmpty():
            done.append(_ranked_buckets(rows.join(stuck, "path"), names, ordinal, max_points, max_depth, shape))
        sizes = stored(sizes, "octree")
        rows, large = moved, None
        if not sizes.isEmpty():
            rows = stored(moved, "octree")
            at_end = sizes.where(F.length("path") >= max_depth).select("path")
            if not at_end.isEmpty():
                done.append(rows.join(at_end, "path", "left_semi").select(*names, "path"))
                rows = rows.join(at_end, "path", "left_anti").select(*names, "path")
            open_nodes = sizes.where(F.length("path") < max_depth).select("path")
            if not open_nodes.isEmpty():
                small = rows.join(open_nodes, "path", "left_anti").select(*names, "path")
                done.append(small.groupBy("path").applyInArrow(finish, shape))
                rows = rows.join(open_nodes, "path", "left_semi").select(*names, "path")
                large = bounds(rows, "path")
    result = rows.groupBy("path").applyInArrow(finish, shape)
    for part in done:
        result = result.unionByName(part)
    return result


def spark_row(points: DataFrame, root) -> DataFrame:
    """The root's statistics as a table of one row."""
    kinds = "path string, n long, " + ", ".join(f"{p}{a} double" for a in AXES for p in "lh")
    return points.sparkSession.createDataFrame([("", root["n"], *(float(root[f"{p}{a}"]) for a in AXES for p in "lh"))], kinds)


def _ranked_buckets(flat: DataFrame, names: list[str], ordinal: str, max_points: int, max_depth: int, shape: StructType) -> DataFrame:
    """Rows of large nodes without extent, with the digits that their rank in order gives. Ranks come from range partitions and prefix counts."""
    dealt = flat.select(*names, "path", "node rows").repartitionByRange("path", ordinal).sortWithinPartitions("path", ordinal)
    dealt = stored(dealt.withColumn("node part", F.spark_partition_id()).withColumn("node seq", F.monotonically_increasing_id()), "octree")
    runs = dealt.groupBy("path", "node part").agg(F.min("node seq").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("path").orderBy("node part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("path", "node part", (F.col("first") - F.coalesce(before, F.lit(0))).alias("node base"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = np.array(batch.column("path").to_pylist(), object)
            rank, n = batch.column("node rank").to_numpy(zero_copy_only=False), batch.column("node rows").to_numpy(zero_copy_only=False)
            new = paths.copy()
            for p in set(paths.tolist()):
                here = paths == p
                new[here] = [p + x for x in _dealt(rank[here].astype(np.int64), int(n[here][0]), max_points, max_depth - len(p))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(new.tolist(), pa.string())], names=[*names, "path"])

    ranked = dealt.join(runs, ["path", "node part"]).select(*names, "path", "node rows", (F.col("node seq") - F.col("node base")).alias("node rank"))
    return ranked.mapInArrow(deal, shape)


def voxel_first(points: DataFrame, edge: float, ordinal: str = "ordinal") -> DataFrame:
    """The first record per cubic voxel of one edge, anchored at the least corner."""
    box = F.broadcast(bounds(points).select("lx", "ly", "lz"))
    keys = [F.floor((F.col(a) - F.col(f"l{a}")) / F.lit(edge)).cast("long").alias(f"k{a}") for a in AXES]
    keyed = points.crossJoin(box).select(ordinal, *AXES, *keys)
    first = F.min_by(F.struct(*AXES), F.col(ordinal)).alias("p")
    got = keyed.groupBy("kx", "ky", "kz").agg(F.min(ordinal).alias(ordinal), first)
    return got.select("kx", "ky", "kz", ordinal, *(F.col(f"p.{a}").alias(a) for a in AXES))


def parent_sample(points: DataFrame, budget: int, ordinal: str = "ordinal", halvings: int = 8) -> DataFrame:
    """Occupied voxels per candidate edge of two halving chains, whether they fit the budget, and the finest that does, for the root node.

    One pass: each row is exploded to its key in each candidate grid; the number of grids is
    bounded by `halvings`, not by the rows.
    """
    side = integer_root(budget)
    box = bounds(points).withColumn("longest", F.greatest(*(F.col(f"h{a}") - F.col(f"l{a}") for a in AXES)))
    top = F.greatest(F.col("longest"), F.lit(2.2250738585072014e-308)) / F.lit(side - 0.5)
    grids = F.array(*(F.struct(F.lit(c).alias("chain"), F.lit(j).alias("j"), (top / F.lit(2.0**0.5 if c else 1.0) / F.lit(float(2**j))).alias("edge")) for c in (0, 1) for j in range(halvings)))
    rows = points.crossJoin(F.broadcast(box.withColumn("grids", grids))).select(*AXES, "lx", "ly", "lz", F.explode("grids").alias("g"))
    key = F.struct(*(F.floor((F.col(a) - F.col(f"l{a}")) / F.col("g.edge")).cast("long") for a in AXES))
    counts = rows.select("g.chain", "g.j", "g.edge", key.alias("key")).groupBy("chain", "j").agg(F.first("edge").alias("edge"), F.count_distinct("key").alias("voxels"))
    return counts.withColumn("fits", F.col("voxels") <= budget)


def voxel_grid(points: DataFrame, budget: int) -> DataFrame:
    """Key of each row in a grid of floor(cbrt(budget)) cells a side over the box; axes without extent have cell 0."""
    side = integer_root(budget)
    boxed = points.crossJoin(F.broadcast(bounds(points).drop("n")))
    keys = []
    for a in AXES:
        extent = F.col(f"h{a}") - F.col(f"l{a}")
        at = F.floor((F.col(a) - F.col(f"l{a}")) / extent * F.lit(float(side)))
        keys.append(F.when(extent > 0, F.least(at, F.lit(side - 1))).otherwise(F.lit(0)).cast("long").alias(f"k{a}"))
    return boxed.select(*points.columns, *keys)


def voxel_counts(points: DataFrame, budget: int, layer: str = "layer", order: str = "ordinal") -> DataFrame:
    """Per layer and voxel: points, first point in order, and the largest distance to it; the grid's side halves until the cells fit."""
    side = integer_root(budget)
    while True:
        keyed = voxel_grid(points, side**3)
        cells = keyed.groupBy(layer, "kx", "ky", "kz").agg(F.count("*").alias("n"), F.min_by(F.struct(order, *AXES), F.col(order)).alias("first"))
        if side == 1 or cells.count() <= budget:
            break
        side //= 2
    far = keyed.join(cells, [layer, "kx", "ky", "kz"])
    away = norm(*(F.col(a) - F.col(f"first.{a}") for a in AXES))
    return far.groupBy(layer, "kx", "ky", "kz").agg(F.first("n").alias("point_count"), F.first(F.col(f"first.{order}")).alias(order), F.max(away).alias("error"))


def morton_keys(points: DataFrame) -> DataFrame:
    """63-bit Morton key of each row in the isotropic cube at the least corner."""
    box = bounds(points).withColumn("side", F.greatest(*(F.col(f"h{a}") - F.col(f"l{a}") for a in AXES)))
    cubed = points.crossJoin(F.broadcast(box.select("lx", "ly", "lz", "side")))
    key = morton(*(cell(F.col(a), F.col(f"l{a}"), F.col("side")) for a in AXES))
    return cubed.select(*points.columns, key.alias("key"))


def cell_leaves(keyed: DataFrame, capacity: int, depths: int = 21) -> DataFrame:
    """Leaf cells before packing: for each row's key, the shallowest prefix whose whole span fits. One aggregation over all depths."""
    from tessera.functions.numeric import MORTON_BITS

    depth = F.explode(F.sequence(F.lit(0), F.lit(depths))).alias("depth")
    per_key = keyed.groupBy("key").agg(F.count("*").alias("n"))
    spans = per_key.select("key", "n", depth)
    at = F.expr(f"shiftright(key, 3 * ({MORTON_BITS} - depth))")
    sums = spans.withColumn("prefix", at).groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    fits = sums.where((F.col("n") <= capacity) | (F.col("depth") == depths))
    parent = sums.where(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    is_root = (F.col("depth") == 0)
    roots = fits.where(is_root)
    below = fits.withColumn("up", F.shiftright("prefix", 3)).join(parent, ["depth", "up"], "left_semi").select("depth", "prefix", "n")
    return below.unionByName(roots.select("depth", "prefix", "n"))


def quantized16(points: DataFrame, by: str) -> DataFrame:
    """16-bit codes of each row within its tile's box, and whether a tile is too coarse for its source step."""
    boxed = points.join(bounds(points, by), by)
    codes = []
    for a in AXES:
        scale = F.when(F.col(f"h{a}") > F.col(f"l{a}"), F.col(f"h{a}") - F.col(f"l{a}")).otherwise(F.lit(1.0))
        codes.append(F.floor((F.col(a) - F.col(f"l{a}")) / scale * F.lit(65535.0) + F.lit(0.5)).cast("long").alias(f"q{a}"))
    return boxed.select(by, "ordinal", *codes)


def _halved(edge: Column, times: Column) -> Column:
    """edge halved so often; in two steps, as one power of two may pass the largest double."""
    half = F.floor(times / 2)
    return edge / F.pow(F.lit(2.0), half) / F.pow(F.lit(2.0), times - half)


def halvings(longest: Column, edge: Column, budget: int) -> Column:
    """How often an edge is halved until a node's longest extent holds it budget times, or it would be zero; none without an extent."""
    most = F.least(F.floor(F.log2(edge)) + 1074, F.lit(2046))
    near = F.ceil(F.log2(F.lit(float(budget))) + F.log2(edge) - F.log2(longest))
    # the logarithms may be off by one
    tries = [F.greatest(F.lit(0), F.least(near + k, most)) for k in (-1, 0, 1)]
    enough = [longest / _halved(edge, h) >= budget for h in tries]
    return F.when(longest > 0, F.when(enough[0], tries[0]).when(enough[1], tries[1]).otherwise(tries[2])).otherwise(F.lit(0)).cast("int")


def samples(leaves: DataFrame, budget: int, ordinal: str = "ordinal") -> DataFrame:
    """(path, ordinal, x, y, z, edge, error) for every inner node of an octree: the first record per voxel of the finest grid within the budget.

    leaves are octree() rows. All grids stand at the least corner of the root. A node's are two halving chains
    from its parent's edge, which its own points, being some of the parent's, always fit; at the
    root they start at the longest extent over (side - 0.5). One level a pass, as a node needs its
    parent's edge: rows meet their node's finest grids once, by a partial aggregation; the coarser
    grids of a chain nest in these and are counted on their cells. A chain ends
    where the node's longest extent holds its edge budget times. error is the voxel's diagonal
    clamped to the node's extent.
    """
    side = integer_root(budget)
    # so many levels above the finest an edge is the longest extent or more, and 8 voxels hold the node
    levels = F.least(F.col("halvings"), F.lit((2 * budget).bit_length())) if budget >= 8 else F.col("halvings")
    corner = bounds(leaves).first()
    rows = leaves.select(F.col("path").alias("leaf"), ordinal, *AXES)
    edges, out = None, []
    deepest = leaves.agg(F.max(F.length("path"))).first()[0] or 0
    for depth in range(deepest):
        at = rows.where(F.length("leaf") > depth).withColumn("path", F.substring("leaf", 1, depth))
        box = bounds(at, "path").withColumn("longest", F.greatest(*(F.col(f"h{a}") - F.col(f"l{a}") for a in AXES)))
        if edges is None:
            top = F.greatest(F.col("longest"), F.lit(2.2250738585072014e-308)) / F.lit(side - 0.5)
            box = box.withColumn("top", top)
        else:
            up = edges.select(F.col("path").alias("up"), F.col("edge").alias("top"))
            box = box.withColumn("up", F.expr("substring(path, 1, length(path) - 1)")).join(up, "up").drop("up")
        grids = F.explode(F.array(*(F.struct(F.lit(c).alias("chain"), edge.alias("coarse"), halvings(F.col("longest"), edge, budget).alias("halvings")) for c, edge in enumerate((F.col("top"), F.col("top") / F.lit(2.0**0.5)))))).alias("g")
        keyed = at.join(box.select("path", "top", "longest"), "path").select("path", ordinal, *AXES, grids)
        finest = _halved(F.col("g.coarse"), F.col("g.halvings"))
        # beyond 2**53 steps from the corner doubles don't tell neighbours apart; the key only has to stay a long
        keys = [F.floor(F.least((F.col(a) - F.lit(corner[f"l{a}"])) / finest, F.lit(9.2e18))).cast("long").alias(f"k{a}") for a in AXES]
        cells = keyed.select("path", "g.chain", "g.coarse", "g.halvings", *keys, ordinal, *AXES).groupBy("path", "chain", *(f"k{a}" for a in AXES))
        cells = stored(cells.agg(F.first("coarse").alias("coarse"), F.first("halvings").alias("halvings"), F.min(F.struct(ordinal, *AXES)).alias("first")), "samples")
        level = F.explode(F.sequence(F.lit(0), levels)).alias("level")
        shift = [F.expr(f"shiftright(k{a}, level)").alias(f"k{a}") for a in AXES]
        counts = cells.select("path", "chain", "coarse", "halvings", *(f"k{a}" for a in AXES), level).select("path", "chain", "coarse", "halvings", "level", *shift).distinct()
        counts = counts.groupBy("path", "chain", "level").agg(F.first("coarse").alias("coarse"), F.first("halvings").alias("halvings"), F.count("*").alias("voxels"))
        counts = counts.withColumn("edge", _halved(F.col("coarse"), F.col("halvings") - F.col("level")))
        fits = F.col("voxels") <= budget
        chosen = counts.groupBy("path").agg(F.min_by(F.struct("chain", "level", "edge"), F.struct((~fits).alias("over"), F.when(fits, F.col("edge")).otherwise(-F.col("edge")))).alias("c"))
        chosen = stored(chosen.select("path", "c.*").join(box, "path"), "edges")
        first = cells.join(chosen.select("path", "chain", "level"), ["path", "chain"]).select("path", *shift, "first")
        first = first.groupBy("path", *(f"k{a}" for a in AXES)).agg(F.min("first").alias("first"))
        error = norm(*(F.least(F.col("edge"), F.col(f"h{a}") - F.col(f"l{a}")) for a in AXES))
        out.append(first.join(chosen.select("path", "edge", error.alias("error")), "path").select("path", "first.*", "edge", "error"))
        edges = chosen
    empty = leaves.select("path", ordinal, *AXES).where(F.lit(False)).withColumn("edge", F.lit(0.0)).withColumn("error", F.lit(0.0))
    for o in out:
        empty = empty.unionByName(o)
    return empty
