"""Source systems: what a definition means, and column arithmetic between projected, geographic and Earth-centred coordinates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 ellipsoid.
A, INV_F = 6378137.0, 298.257223563
_N = 1 / (2 * INV_F - 1)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the transverse Mercator series in the third flattening, to the fourth order.
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACKWARD = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
#: From the conformal latitude to the latitude, in the same parameter.
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_E = (2 / INV_F - 1 / INV_F**2) ** 0.5


class CrsError(ValueError):
    """A definition that names no supported system."""


@dataclass(frozen=True)
class Crs:
    """kind: geographic, mercator, utm or geocentric; meridian and north for utm."""

    code: int
    kind: str
    meridian: float = 0.0
    north: bool = True


def supported_epsg_codes() -> list[int]:
    return [3857, 4326, 4978, 4979, *range(32601, 32661), *range(32701, 32761)]


def resolve_source_crs(definition: str) -> Crs:
    """EPSG:n, urn:ogc:def:crs:EPSG::n, a bare number, CRS84, or a utm/longlat/merc PROJ text on WGS84."""
    text = definition.strip()
    if re.fullmatch(r"(?i)(urn:ogc:def:crs:)?OGC:(1\.3:)?CRS84", text):
        return Crs(4326, "geographic")
    m = re.fullmatch(r"(?i)(?:(?:urn:ogc:def:crs:)?EPSG:(?:[0-9.]*:)?)?([0-9]{4,6})", text)
    if m:
        code = int(m[1])
        if code not in supported_epsg_codes():
            raise CrsError(f"EPSG:{code} is not supported")
    elif text.startswith("+proj="):
        p = dict((w.lstrip("+").split("=", 1) + [""])[:2] for w in text.split())
        if p.get("datum", p.get("ellps", "WGS84")) != "WGS84" or p.get("units", "m") != "m":
            raise CrsError("only metres on WGS84 are supported")
        unknown = set(p) - {"proj", "zone", "south", "datum", "ellps", "units", "no_defs", "type"}
        if unknown:
            raise CrsError(f"unknown parameters {sorted(unknown)}")
        if p["proj"] == "utm" and p.get("zone", "").isdigit() and 1 <= int(p["zone"]) <= 60:
            code = (32700 if "south" in p else 32600) + int(p["zone"])
        elif p["proj"] in ("longlat", "latlong"):
            code = 4326
        elif p["proj"] == "geocent":
            code = 4978
        else:
            raise CrsError(f"projection {p['proj']} is not supported")
    else:
        raise CrsError(f"not a definition of a reference system: {definition!r}")
    if code == 4978:
        return Crs(code, "geocentric")
    if code in (4326, 4979):
        return Crs(code, "geographic")
    if code == 3857:
        return Crs(code, "mercator")
    return Crs(code, "utm", code % 100 * 6 - 183.0, code < 32700)


def _series(xi: Column, eta: Column, terms: tuple[float, ...], sign: float) -> tuple[Column, Column]:
    x, y = xi, eta
    for k, c in enumerate(terms, 1):
        x = x + F.lit(sign * c) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y + F.lit(sign * c) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    return x, y


def to_lonlat(crs: Crs, x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude; null outside the projection's domain."""
    if crs.kind == "geographic":
        inside = (F.abs(y) <= 90) & (F.abs(x) <= 360)
        return F.when(inside, x), F.when(inside, y)
    if crs.kind == "mercator":
        return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - F.lit(1.5707963267948966))
    if crs.kind != "utm":
        raise CrsError(f"{crs.kind} coordinates have no horizontal inverse")
    xi = (y - F.lit(0.0 if crs.north else 10_000_000.0)) / F.lit(0.9996 * _RADIUS)
    eta = (x - F.lit(500_000.0)) / F.lit(0.9996 * _RADIUS)
    xi1, eta1 = _series(xi, eta, _BACKWARD, -1.0)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for k, c in enumerate(_LATITUDE, 1):
        lat = lat + F.lit(c) * F.sin(2 * k * chi)
    inside = F.abs(x - F.lit(500_000.0)) < 3_000_000
    return F.when(inside, F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + F.lit(crs.meridian)), F.when(inside, F.degrees(lat))


def from_lonlat(crs: Crs, lon: Column, lat: Column) -> tuple[Column, Column]:
    if crs.kind == "geographic":
        return lon, lat
    if crs.kind == "mercator":
        return F.radians(lon) * A, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * A
    if crs.kind != "utm":
        raise CrsError(f"{crs.kind} coordinates have no horizontal form")
    phi, lam = F.radians(lat), F.radians(lon - F.lit(crs.meridian))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_E) * F.atanh(F.lit(_E) * F.sin(phi)))
    xi, eta = _series(F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t)), _FORWARD, 1.0)
    return F.lit(500_000.0) + F.lit(0.9996 * _RADIUS) * eta, F.lit(0.0 if crs.north else 10_000_000.0) + F.lit(0.9996 * _RADIUS) * xi
