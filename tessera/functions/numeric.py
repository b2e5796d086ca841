"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits per axis of a Morton key.
MORTON_BITS = 21
#: (shift, mask) steps that spread 21 bits to every third place.
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def half_up(c: Column) -> Column:
    """floor(c + 0.5) as a long."""
    return F.floor(c + F.lit(0.5)).cast("long")


def spread(c: Column) -> Column:
    out = c.cast("long")
    for shift, mask in _SPREAD:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def morton(x: Column, y: Column, z: Column) -> Column:
    """Interleaved bits, x lowest."""
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def prefix(key: Column, depth: int) -> Column:
    return F.shiftright(key, 3 * (MORTON_BITS - depth))


def cell(c: Column, origin: Column, side: Column) -> Column:
    """Cell of a coordinate on one axis of an isotropic cube of 2**21 cells."""
    at = F.floor((c - origin) / side * F.lit(float(1 << MORTON_BITS)))
    return F.when(side > 0, F.least(F.greatest(at, F.lit(0)), F.lit((1 << MORTON_BITS) - 1))).otherwise(F.lit(0)).cast("long")


def integer_root(budget: int, power: int = 3) -> int:
    """Largest s with s ** power <= budget; cube roots of floats differ between engines."""
    s = 1
    while (s + 1) ** power <= budget:
        s += 1
    return s


def norm(*axes: Column) -> Column:
    total = axes[0] * axes[0]
    for a in axes[1:]:
        total = total + a * a
    return F.sqrt(total)


def no_negative_zero(c: Column) -> Column:
    return c + F.lit(0.0)
