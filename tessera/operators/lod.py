"""Levels of detail: tolerances, enclosing boxes, terrain deviations, lattices, codes and mips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import norm
from tessera.operators.hierarchy import prefix_stats, prefixes

AXES = ("x", "y", "z")
SQRT2 = 2.0**0.5


def parent_tolerance(tiles: DataFrame, levels: int = 1, share: float = 64.0) -> DataFrame:
    """Tolerance of each tile(path, diagonal): a share of its diagonal, and at least sqrt(2) times the top tolerance of its children.

    A tile `d` levels above another must have (sqrt(2) * 2^(levels-1))^d times its tolerance, so that
    one aggregation over all prefixes gives what a loop from the leaves would.
    """
    grow = SQRT2 * 2.0 ** (levels - 1)
    own = tiles.select("path", (F.col("diagonal") / share).alias("own"))
    up = F.col("own") * F.pow(F.lit(grow), F.length("path") - F.length("prefix"))
    return prefix_stats(own, F.max(up).alias("tolerance")).withColumnRenamed("prefix", "path").join(tiles.select("path"), "path", "left_semi")


def enclosing_boxes(tiles: DataFrame) -> DataFrame:
    """Half sizes that hold the boxes of all tiles below: tiles(path, c<axis>, e<axis>), one box per path with all ancestors present.

    A child needs |child centre - centre| + half. Summed along a path this is a difference of two
    prefix sums of the centres' steps, so that a maximum over descendants gives all tiles at once.
    """
    parent = tiles.select(F.col("path").alias("up"), *(F.col(f"c{a}").alias(f"p{a}") for a in AXES))
    stepped = tiles.withColumn("up", F.when(F.length("path") > 0, F.expr("substring(path, 1, length(path) - 1)"))).join(parent, "up", "left")
    steps = stepped.select("path", *(F.coalesce(F.abs(F.col(f"c{a}") - F.col(f"p{a}")), F.lit(0.0)).alias(f"s{a}") for a in AXES))
    lines = tiles.select("path", *(f"e{a}" for a in AXES), F.explode(prefixes()).alias("prefix"))
    depth = lines.join(steps.withColumnRenamed("path", "prefix"), "prefix")
    total = depth.groupBy("path").agg(*(F.sum(f"s{a}").alias(f"t{a}") for a in AXES), *(F.first(f"e{a}").alias(f"e{a}") for a in AXES))
    best = prefix_stats(total, *(F.max(F.col(f"e{a}") + F.col(f"t{a}")).alias(f"m{a}") for a in AXES)).withColumnRenamed("prefix", "path")
    return best.join(total, "path").select("path", *(F.greatest(F.col(f"m{a}") - F.col(f"t{a}"), F.col(f"e{a}")).alias(f"e{a}") for a in AXES))


def sample_error(edge: Column, *extents: Column) -> Column:
    """How far a dropped point can be from its voxel's first one: the voxel's diagonal, clamped to the data's extent."""
    return norm(*(F.least(edge, e) for e in extents))


def rounding(points: DataFrame, by: str) -> DataFrame:
    """Per tile, the largest distance between a position and its 32-bit form relative to the tile's least corner."""
    low = points.groupBy(by).agg(*(F.min(a).alias(f"l{a}") for a in AXES))
    local = {a: F.col(a) - F.col(f"l{a}") for a in AXES}
    off = norm(*(local[a] - local[a].cast("float").cast("double") for a in AXES))
    return points.join(low, by).groupBy(by).agg(F.max(off).alias("rounding"))


def lattice_exponent(extent: Column, bits: int = 16) -> Column:
    """The least exponent e such that 2^e steps number an extent in `bits` bits; 0 for no extent."""
    return F.when(extent > 0, F.ceil(F.log2(extent / F.lit(float(2**bits - 1))))).otherwise(F.lit(0)).cast("long")


def snapped(value: Column, exponent: Column) -> Column:
    """The nearest multiple of 2^exponent, halves up."""
    step = F.pow(F.lit(2.0), exponent.cast("double"))
    return F.floor(value / step + F.lit(0.5)) * step


def octahedral(x: Column, y: Column, z: Column, bits: int = 12) -> tuple[Column, Column]:
    """Signed codes of a direction folded onto an octahedron; the zero vector is (0, 0)."""
    total = F.abs(x) + F.abs(y) + F.abs(z)
    u, v = x / total, y / total
    sign = lambda c: F.when(c >= 0, 1.0).otherwise(-1.0)
    fu = F.when(z < 0, (1 - F.abs(v)) * sign(u)).otherwise(u)
    fv = F.when(z < 0, (1 - F.abs(u)) * sign(v)).otherwise(v)
    top = float(2 ** (bits - 1) - 1)
    code = lambda c: F.when(total > 0, F.floor(c * F.lit(top) + F.lit(0.5))).otherwise(F.lit(0)).cast("long")
    return code(fu), code(fv)


def terrain_deviation(cells: DataFrame, stride: int) -> DataFrame:
    """Per coarse cell (crow, ccol) of a lattice(row, col, value): the largest |fine value - coarse surface| at its fine nodes.

    A cell is two triangles along the diagonal from its least to its greatest corner. Cells whose
    four corners aren't all there are left out; null values count as absent. The corners come by
    sending each coarse node to the four cells it touches: two equi-joins' worth of shuffle at any size.
    """
    nodes = cells.where("value is not null").select("row", "col", "value")
    coarse = nodes.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
    touch = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)))).alias("t")
    sent = coarse.select((F.col("row") / stride).cast("long").alias("i"), (F.col("col") / stride).cast("long").alias("j"), "value", touch)
    sent = sent.select((F.col("i") - F.col("t.r")).alias("crow"), (F.col("j") - F.col("t.c")).alias("ccol"), "value", (F.col("t.r") * 2 + F.col("t.c")).alias("corner"))
    corners = sent.groupBy("crow", "ccol").agg(*(F.max(F.when(F.col("corner") == k, F.col("value"))).alias(f"v{k}") for k in range(4))).na.drop()
    at = nodes.select(F.floor(F.col("row") / stride).alias("crow"), F.floor(F.col("col") / stride).alias("ccol"), "value", ((F.col("row") % stride) / stride).alias("fr"), ((F.col("col") % stride) / stride).alias("fc"))
    v0, v1, v2, v3 = (F.col(f"v{k}") for k in range(4))  # v0 least, v1 one column on, v2 one row on, v3 both
    r, c = F.col("fr"), F.col("fc")
    surface = F.when(r <= c, v0 + (v1 - v0) * c + (v3 - v1) * r).otherwise(v0 + (v2 - v0) * r + (v3 - v2) * c)
    return at.join(corners, ["crow", "ccol"]).groupBy("crow", "ccol").agg(F.max(F.abs(F.col("value") - surface)).alias("deviation"))


def skirts(tiles: DataFrame, least: float = 1.0) -> DataFrame:
    """Skirt depth per tile(row, col, error) and side with a neighbour: both errors together, `least` at least."""
    step = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.lit(r).alias("r"), F.lit(c).alias("c")) for n, r, c in (("south", -1, 0), ("north", 1, 0), ("west", 0, -1), ("east", 0, 1))))).alias("s")
    here = tiles.select("row", "col", "error", step).select("row", "col", "error", "s.side", (F.col("row") + F.col("s.r")).alias("brow"), (F.col("col") + F.col("s.c")).alias("bcol"))
    beside = tiles.select(F.col("row").alias("brow"), F.col("col").alias("bcol"), F.col("error").alias("beside"))
    return here.join(beside, ["brow", "bcol"]).select("row", "col", "side", F.greatest(F.col("error") + F.col("beside"), F.lit(least)).alias("depth"))


def srgb_to_linear(c: Column) -> Column:
    s = c / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    s = F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)
    return F.floor(s * 255.0 + 0.5).cast("long")


def mip(texels: DataFrame, value: str = "value", mode: str = "color") -> DataFrame:
    """The next coarser level of texels(row, col, value): mean in linear light ("color"), plain mean ("mask") or most frequent, least on ties ("id")."""
    cell = [F.floor(F.col(k) / 2).alias(k) for k in ("row", "col")]
    if mode == "id":
        counted = texels.groupBy(*cell, F.col(value).alias("v")).agg(F.count("*").alias("n"))
        return counted.groupBy("row", "col").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(value))
    if mode == "mask":
        return texels.groupBy(*cell).agg(F.avg(value).alias(value))
    return texels.groupBy(*cell).agg(linear_to_srgb(F.avg(srgb_to_linear(F.col(value)))).alias(value))


def escaped_vertices(vertices: DataFrame, boxes: DataFrame) -> DataFrame:
    """(vertex, path, prefix): vertices outside the box of their tile or of one of its ancestors. vertices(vertex, path, x, y, z), boxes(path, l*, h*).

    Leaves are compared with their ancestors as boxes first: a vertex in its leaf's box is inside every
    box that holds this one, so that vertices meet only ancestors that don't. All vertices meet their leaf once.
    """
    outside = F.lit(False)
    for a in AXES:
        outside = outside | (F.col(a) < F.col(f"l{a}")) | (F.col(a) > F.col(f"h{a}"))
    sides = [f"{p}{a}" for a in AXES for p in "lh"]
    used = vertices.groupBy("path").agg(*(f(a).alias(f"u{p}{a}") for a in AXES for f, p in ((F.min, "l"), (F.max, "h"))))
    pairs = used.select("*", F.explode(prefixes()).alias("prefix")).join(boxes.select(F.col("path").alias("prefix"), *sides), "prefix")
    broken = F.lit(False)
    for a in AXES:
        broken = broken | (F.col(f"ul{a}") < F.col(f"l{a}")) | (F.col(f"uh{a}") > F.col(f"h{a}"))
    suspects = pairs.where(broken).select("path", "prefix", *sides)
    return vertices.join(suspects, "path").where(outside).select("vertex", "path", "prefix")


#: Fixed values of the error histogram: bins a factor of two, the exponent of the first bin, and their number.
BINS_PER_OCTAVE, LEAST_EXPONENT, BINS = 32, -256, 16_384


def error_statistics(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, p95, p99 and largest of non-negative distances: samples(*by, value). Null, negative and infinite ones are refused.

    Percentiles are upper edges of logarithmic bins, never above the largest. At most BINS rows a group are
    exchanged after a partial count, so that a hot group is no larger than any other.
    """
    d = F.col(value).cast("double")
    good = d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d < F.lit(float("inf")))
    d = F.when(good, d).otherwise(F.raise_error(F.lit("a distance is null, negative or not finite")).cast("double"))
    step = F.ceil((F.log2("d") - LEAST_EXPONENT) * BINS_PER_OCTAVE)
    bin_ = F.when(F.col("d") == 0, 0).otherwise(F.least(F.greatest(step, F.lit(1)), F.lit(BINS - 1))).cast("int")
    counts = samples.select(*by, d.alias("d")).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("d").alias("total"), F.max("d").alias("top"))
    bins = F.array_sort(F.collect_list(F.struct("bin", "n")))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("samples"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("top").alias("worst"), bins.alias("bins"))

    def percentile(percent: int) -> Column:
        rank = F.ceil(F.col("samples") * percent / 100.0)
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("bin"))
        reached = F.aggregate("bins", start, lambda a, b: F.when(a.n >= rank, a).otherwise(F.struct((a.n + b.n).alias("n"), b.bin.alias("bin")))).bin
        edge = F.pow(F.lit(2.0), reached / BINS_PER_OCTAVE + LEAST_EXPONENT)
        return F.when(F.col("samples") == 0, None).when(reached == 0, 0.0).otherwise(F.least(edge, F.col("worst")))

    return whole.select(*by, "samples", "mean", percentile(95).alias("p95"), percentile(99).alias("p99"), "worst")
