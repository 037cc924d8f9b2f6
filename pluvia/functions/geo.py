"""Geometry as columns: projection, distances, rectangle clipping, tile covers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and the UTM scale factor.
_A = 6378137.0
_F = 1.0 / 298.257223563
_K0 = 0.9996
EARTH_KM = 6371.0088


def utm(lon: Column, lat: Column, central_meridian: float = 75.0) -> tuple[Column, Column]:
    """Easting and northing in metres, Krueger series to the third order (sub-millimetre in a zone)."""
    n = _F / (2.0 - _F)
    radius = _A / (1.0 + n) * (1.0 + n**2 / 4.0 + n**4 / 64.0)
    alpha = (
        n / 2.0 - 2.0 * n**2 / 3.0 + 5.0 * n**3 / 16.0,
        13.0 * n**2 / 48.0 - 3.0 * n**3 / 5.0,
        61.0 * n**3 / 240.0,
    )
    e = 2.0 * math.sqrt(n) / (1.0 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(central_meridian))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, start=1):
        x = x + F.lit(a) * F.cos(2.0 * j * xi) * F.sinh(2.0 * j * eta)
        y = y + F.lit(a) * F.sin(2.0 * j * xi) * F.cosh(2.0 * j * eta)
    return F.lit(500000.0) + F.lit(_K0 * radius) * x, F.lit(_K0 * radius) * y


def haversine_km(lon1: Column, lat1: Column, lon2, lat2) -> Column:
    """Great-circle distance; within about 0.5 % of the ellipsoid."""
    p1, p2 = F.radians(lat1), F.radians(F.lit(lat2))
    dp, dl = (p2 - p1) / 2.0, (F.radians(F.lit(lon2)) - F.radians(lon1)) / 2.0
    h = F.pow(F.sin(dp), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl), 2)
    return F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(h))


def in_box(lon: Column, lat: Column, box: dict[str, float]) -> Column:
    """Inclusive on all sides."""
    return lon.between(box["min_lon"], box["max_lon"]) & lat.between(box["min_lat"], box["max_lat"])


def km_to_box(lon: Column, lat: Column, box: dict[str, float], corners_only: bool = True) -> Column:
    """0 inside; else to the nearest corner, or to the nearest edge point with corners_only=False."""
    if corners_only:
        far = F.least(
            *[haversine_km(lon, lat, x, y) for x in (box["min_lon"], box["max_lon"]) for y in (box["min_lat"], box["max_lat"])]
        )
    else:
        x = F.least(F.greatest(lon, F.lit(box["min_lon"])), F.lit(box["max_lon"]))
        y = F.least(F.greatest(lat, F.lit(box["min_lat"])), F.lit(box["max_lat"]))
        far = haversine_km(lon, lat, x, y)
    return F.when(in_box(lon, lat, box), F.lit(0.0)).otherwise(far)


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment; a zero-length segment counts as a point."""
    dx, dy = x2 - x1, y2 - y1
    len2 = dx * dx + dy * dy
    raw = ((px - x1) * dx + (py - y1) * dy) / F.when(len2 > 0, len2)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))
    t = F.when(len2 > 0, t).otherwise(F.lit(0.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def clipped_length(x1: Column, y1: Column, x2: Column, y2: Column, lx: Column, ly: Column, hx: Column, hy: Column) -> Column:
    """Length of the part of a segment inside a rectangle (parameter interval of the four half planes)."""
    dx, dy = x2 - x1, y2 - y1

    def bounds(d, start, lo, hi):
        a, b = (lo - start) / F.when(d != 0, d), (hi - start) / F.when(d != 0, d)
        inside = (start >= lo) & (start <= hi)
        enter = F.when(d != 0, F.least(a, b)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0))
        leave = F.when(d != 0, F.greatest(a, b)).when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))
        return enter, leave

    ex, ox = bounds(dx, x1, lx, hx)
    ey, oy = bounds(dy, y1, ly, hy)
    enter = F.greatest(F.lit(0.0), ex, ey)
    leave = F.least(F.lit(1.0), ox, oy)
    return F.greatest(F.lit(0.0), leave - enter) * F.sqrt(dx * dx + dy * dy)


def tile_index(v: Column, size) -> Column:
    return F.floor(v / size).cast("bigint")


def tile_cover(lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column, size: float) -> Column:
    """Array of (tx, ty) tiles that a box touches."""
    xs = F.sequence(tile_index(lo_x, size), tile_index(hi_x, size))
    ys = F.sequence(tile_index(lo_y, size), tile_index(hi_y, size))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("tx"), y.alias("ty")))))


def segment_tiles(x1: Column, y1: Column, x2: Column, y2: Column, size) -> Column:
    """The tiles a segment runs through, in order: array of (tx, ty, t0, t1), t0 to t1 being its part in the tile.

    The crossings of vertical and horizontal grid lines are merged by their place on the segment; between two
    of them lies one tile, found at the middle. So n columns and m rows give at most n + m - 1 tiles.
    """

    def crossings(a: Column, b: Column) -> Column:
        first, last = tile_index(F.least(a, b), size), tile_index(F.greatest(a, b), size)
        lines = F.when(last > first, F.sequence(first + 1, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (k * size - a) / (b - a))))

    def tile(part: Column) -> Column:
        middle = (part["t0"] + part["t1"]) / 2.0
        return F.struct(
            tile_index(x1 + middle * (x2 - x1), size).alias("tx"), tile_index(y1 + middle * (y2 - y1), size).alias("ty"),
            part["t0"].alias("t0"), part["t1"].alias("t1"),
        )

    def parts(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.struct(F.get(t, i).alias("t0"), F.get(t, i + 1).alias("t1")))
        return F.filter(pairs, lambda p: p["t0"] < p["t1"])

    places = F.array_sort(F.concat(F.array(F.lit(0.0)), crossings(x1, x2), crossings(y1, y2), F.array(F.lit(1.0))))
    # the sorted crossings are computed once per row, though the lambda reads them twice
    return F.transform(F.flatten(F.transform(F.array(places), parts)), tile)
