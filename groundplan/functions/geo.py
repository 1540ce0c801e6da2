"""Coordinates: national grid to latitude and longitude, bounds, and resolution of mixed inputs."""

from __future__ import annotations

from collections.abc import Callable
from math import radians

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Airy 1830 and WGS84 ellipsoids, the grid's projection, and the datum shift.
AIRY = (6377563.396, 6356256.909)
WGS84 = (6378137.0, 6356752.314245)
SCALE, LAT0, LON0, EAST0, NORTH0 = 0.9996012717, radians(49), radians(-2), 400000.0, -100000.0
SHIFT = (446.448, -125.157, 542.060)
ROTATION = tuple(radians(s / 3600) for s in (0.1502, 0.2470, 0.8421))
GROWTH = -20.4894e-6
UK_BOUNDS = {"wide": (49.0, 61.5, -8.8, 2.2), "schedule": (49.0, 61.0, -8.0, 2.0), "upload": (49.0, 61.0, -8.6, 2.1)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; plain reuse would copy its whole expression."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def _meridian(lat: Column) -> Column:
    a, b = AIRY
    n = (a - b) / (a + b)
    d, t = lat - LAT0, lat + LAT0
    return b * SCALE * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(t) + (15 / 8 * (n**2 + n**3)) * F.sin(2 * d) * F.cos(2 * t) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * t)
    )


def _footpoint(north: Column, rounds: int = 4) -> Column:
    a = AIRY[0] * SCALE
    lat = LAT0 + (north - NORTH0) / a
    for _ in range(rounds):
        lat = let(lat, lambda v: v + (north - NORTH0 - _meridian(v)) / a)
    return lat


def _pair(a: Column, b: Column, names: tuple[str, str] = ("a", "b")) -> Column:
    return F.struct(a.alias(names[0]), b.alias(names[1]))


def _airy_degrees(lat: Column, d: Column) -> Column:
    """(a: latitude, b: longitude) on the grid's own ellipsoid, in radians, from the footpoint and the easting's distance."""
    a, b = AIRY
    e2 = 1 - (b / a) ** 2
    t, sec = F.tan(lat), 1 / F.cos(lat)
    s2 = F.pow(F.sin(lat), F.lit(2.0))
    nu, rho = a * SCALE / F.sqrt(1 - e2 * s2), a * SCALE * (1 - e2) / F.pow(1 - e2 * s2, F.lit(1.5))

    def series(r: Column) -> Column:
        nu, rho, t, sec = r["nu"], r["rho"], r["t"], r["sec"]
        t2, eta = t * t, nu / rho - 1
        phi = lat - d * d * t / (2 * rho * nu) + F.pow(d, F.lit(4.0)) * t / (24 * rho * F.pow(nu, F.lit(3.0))) * (5 + 3 * t2 + eta - 9 * t2 * eta) - F.pow(d, F.lit(6.0)) * t / (720 * rho * F.pow(nu, F.lit(5.0))) * (61 + 90 * t2 + 45 * t2 * t2)
        lam = LON0 + d * sec / nu - F.pow(d, F.lit(3.0)) * sec / (6 * F.pow(nu, F.lit(3.0))) * (nu / rho + 2 * t2) + F.pow(d, F.lit(5.0)) * sec / (120 * F.pow(nu, F.lit(5.0))) * (5 + 28 * t2 + 24 * t2 * t2)
        return _pair(phi, lam)

    return let(F.struct(nu.alias("nu"), rho.alias("rho"), t.alias("t"), sec.alias("sec")), series)


def _shifted(p: Column) -> Column:
    """(lat, lon) in degrees on WGS84 of a point in radians on the grid's ellipsoid."""
    a, b = AIRY
    e2 = 1 - (b / a) ** 2
    phi, lam = p["a"], p["b"]
    radius = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), F.lit(2.0)))
    space = F.struct((radius * F.cos(phi) * F.cos(lam)).alias("x"), (radius * F.cos(phi) * F.sin(lam)).alias("y"), (radius * (1 - e2) * F.sin(phi)).alias("z"))
    rx, ry, rz = ROTATION
    k = 1 + GROWTH
    moved = let(space, lambda q: F.struct((SHIFT[0] + k * q["x"] - rz * q["y"] + ry * q["z"]).alias("x"), (SHIFT[1] + rz * q["x"] + k * q["y"] - rx * q["z"]).alias("y"), (SHIFT[2] - ry * q["x"] + rx * q["y"] + k * q["z"]).alias("z")))
    a2, b2 = WGS84
    f2 = 1 - (b2 / a2) ** 2

    def degrees(q: Column) -> Column:
        flat = F.hypot(q["x"], q["y"])
        lat = F.atan2(q["z"], flat * (1 - f2))
        for _ in range(3):
            lat = let(lat, lambda v: F.atan2(q["z"] + f2 * a2 / F.sqrt(1 - f2 * F.pow(F.sin(v), F.lit(2.0))) * F.sin(v), flat))
        return _pair(F.degrees(lat), F.degrees(F.atan2(q["y"], q["x"])), ("lat", "lon"))

    return let(moved, degrees)


def grid_to_degrees(east: Column, north: Column) -> Column:
    """(lat, lon) of eastings and northings, by the inverse transverse Mercator series and a seven-parameter shift."""
    point = let(_footpoint(north), lambda lat: _airy_degrees(lat, east - EAST0))
    return let(point, _shifted)


def in_uk(lat: Column, lon: Column, bounds: str = "wide") -> Column:
    south, top, west, east = UK_BOUNDS[bounds]
    return lat.between(south, top) & lon.between(west, east)


def resolve(lat: Column, lon: Column, east: Column, north: Column) -> Column:
    """(lat, lon, source): as given, swapped, from the grid, or null."""
    point = lambda a, b, s: F.struct(a.cast("double").alias("lat"), b.cast("double").alias("lon"), F.lit(s).alias("source"))
    grid = let(grid_to_degrees(east, north), lambda g: F.when(in_uk(g["lat"], g["lon"]), point(g["lat"], g["lon"], "grid")))
    return F.when(in_uk(lat, lon), point(lat, lon, "direct")).when(in_uk(lon, lat), point(lon, lat, "swapped")).otherwise(grid)


def degree_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.hypot(lat1 - lat2, lon1 - lon2)


def centroid(ring: Column) -> tuple[Column, Column]:
    """Mean of the vertices of an array of (x, y) structs."""
    total = lambda k: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k])
    n = F.nullif(F.size(ring), F.lit(0))
    return total("x") / n, total("y") / n


