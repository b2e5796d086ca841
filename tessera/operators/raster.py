"""Rasters and terrain lattices as long tables of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gray(value: Column, low: float, high: float) -> Column:
    """Display level 0..255, rounded half up."""
    scaled = F.lit(255.0) * ((value - F.lit(low)) / F.lit(high - low))
    return F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0)) + F.lit(0.5)).cast("long")


def rgb8(value: Column) -> Column:
    """16-bit colour to 8 bits."""
    return F.floor((value + 128) / F.lit(257)).cast("long")


def is_nodata(value: Column, nodata: float, tolerance: float = 0.0) -> Column:
    """NaN matches NaN; other values within a relative tolerance."""
    if nodata != nodata:
        return F.isnan(value)
    return F.abs(value - F.lit(nodata)) <= F.lit(tolerance * max(1.0, abs(nodata)))


def windows(width: int, height: int, size: int) -> Column:
    """Array of block windows with clipped far edges."""
    one = lambda r: lambda c: F.struct(c.alias("col"), r.alias("row"), F.least(F.lit(size), F.lit(width) - c).alias("width"), F.least(F.lit(size), F.lit(height) - r).alias("height"))
    cols = F.sequence(F.lit(0), F.lit(width - 1), F.lit(size))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1), F.lit(size)), lambda r: F.transform(cols, one(r))))


def pyramid(leaves_x: int, leaves_y: int) -> tuple[int, int]:
    """(levels below the root, padded leaves a side) of a power-of-two lattice pyramid."""
    side = 1
    while side < max(leaves_x, leaves_y):
        side *= 2
    return side.bit_length() - 1, side


def valid_nodes(samples: DataFrame) -> DataFrame:
    """Lattice nodes (pixel corners): valid if all pixels that touch them are; samples(row, col, valid)."""
    corner = F.explode(F.array(*(F.struct((F.col("row") + i).alias("i"), (F.col("col") + j).alias("j")) for i in (0, 1) for j in (0, 1))))
    return samples.select("valid", corner.alias("n")).groupBy(F.col("n.i").alias("i"), F.col("n.j").alias("j")).agg(F.min("valid").alias("valid"), F.count("*").alias("pixels"))


def bilinear(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Values at fractional lattice places: samples(row, col, value, valid), points(id, y, x) in pixel-centre units.

    Contributors with weight zero are ignored; any other one that is missing or invalid makes the value null.
    Four corners per point, joined on (row, col), so that the raster is never collected.
    """
    y0, x0 = F.floor("y").cast("long"), F.floor("x").cast("long")
    fy, fx = F.col("y") - y0, F.col("x") - x0
    weights = [(0, 0, (F.lit(1.0) - fy) * (F.lit(1.0) - fx)), (0, 1, (F.lit(1.0) - fy) * fx), (1, 0, fy * (F.lit(1.0) - fx)), (1, 1, fy * fx)]
    corners = F.explode(F.array(*(F.struct((y0 + i).alias("row"), (x0 + j).alias("col"), w.alias("w"), F.lit(2 * i + j).alias("k")) for i, j, w in weights)))
    need = points.select("id", corners.alias("c")).select("id", "c.*").where("w > 0")
    got = need.join(samples.where("valid").select("row", "col", "value"), ["row", "col"], "left")
    terms = F.array_sort(F.collect_list(F.struct("k", (F.col("value") * F.col("w")).alias("t"))))
    summed = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t["t"])
    return got.groupBy("id").agg(F.when(F.count("value") == F.count("*"), summed).alias("value"))


def mesh_cells(nodes: DataFrame) -> DataFrame:
    """Two triangles for each lattice cell whose corners are all valid: nodes(i, j, valid) -> (i, j, half)."""
    cell = F.explode(F.array(*(F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j")) for a in (0, 1) for b in (0, 1))))
    good = nodes.where("valid").select(cell.alias("c")).groupBy(F.col("c.i").alias("i"), F.col("c.j").alias("j")).agg(F.count("*").alias("n")).where("n = 4")
    return good.select("i", "j", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
