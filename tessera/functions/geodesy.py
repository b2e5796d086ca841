"""WGS84 conversions in column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: WGS84 semi-major axis and flattening
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def geodetic_to_ecef(lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """Radians and metres to Earth-centred metres."""
    n = F.lit(A) / F.sqrt(F.lit(1.0) - F.lit(E2) * F.sin(lat) * F.sin(lat))
    flat = (n + height) * F.cos(lat)
    return flat * F.cos(lon), flat * F.sin(lon), (n * F.lit(1 - E2) + height) * F.sin(lat)


def ecef_to_geodetic(x: Column, y: Column, z: Column, rounds: int = 5) -> tuple[Column, Column, Column]:
    """Longitude, latitude (radians) and height by fixed-point rounds on the latitude; defined off the polar axis."""
    p = F.sqrt(x * x + y * y)
    lat = F.atan2(z, p * F.lit(1 - E2))
    n = None
    for _ in range(rounds):
        n = F.lit(A) / F.sqrt(F.lit(1.0) - F.lit(E2) * F.sin(lat) * F.sin(lat))
        lat = F.atan2(z + F.lit(E2) * n * F.sin(lat), p)
    n = F.lit(A) / F.sqrt(F.lit(1.0) - F.lit(E2) * F.sin(lat) * F.sin(lat))
    return F.atan2(y, x), lat, p * F.cos(lat) + z * F.sin(lat) - F.lit(A) * F.lit(A) / n


def ecef_to_enu(x: Column, y: Column, z: Column, lon0: float, lat0: float, h0: float) -> tuple[Column, Column, Column]:
    """Local east, north, up about an origin."""
    import math

    n = A / math.sqrt(1 - E2 * math.sin(lat0) ** 2)
    ox, oy, oz = (n + h0) * math.cos(lat0) * math.cos(lon0), (n + h0) * math.cos(lat0) * math.sin(lon0), (n * (1 - E2) + h0) * math.sin(lat0)
    dx, dy, dz = x - F.lit(ox), y - F.lit(oy), z - F.lit(oz)
    sl, cl, sp, cp = math.sin(lon0), math.cos(lon0), math.sin(lat0), math.cos(lat0)
    east = dx * F.lit(-sl) + dy * F.lit(cl)
    north = dx * F.lit(-sp * cl) + dy * F.lit(-sp * sl) + dz * F.lit(cp)
    up = dx * F.lit(cp * cl) + dy * F.lit(cp * sl) + dz * F.lit(sp)
    return east, north, up


WORLD_HALF = 3.141592653589793 * A


def mercator_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional Web Mercator tile coordinates of degrees at a zoom."""
    import math

    r = F.lit(math.pi / 180)
    mx, my = F.lit(A) * lon * r, F.lit(A) * F.log(F.tan(F.lit(math.pi / 4) + lat * r / F.lit(2.0)))
    half = float(2**zoom) / 2
    return F.lit(half) * (F.lit(1.0) + mx / F.lit(WORLD_HALF)), F.lit(half) * (F.lit(1.0) - my / F.lit(WORLD_HALF))
