"""Nearest, distance and clip-length queries: J11, J12, J13."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.catalog.base import Views, query
from pluvia.functions.geo import utm
from pluvia.functions.numeric import round_to
from pluvia.operators import spatial

_n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
_R = 0.9996 * 6378137.0 / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_E = 2 * _n**0.5 / (1 + _n)
_AL = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240)


def _utm_sql(table, key, cols):
    """UTM zone 43 of lon, lat as SQL, from the same published series; atanh by logarithms."""
    at = lambda z: f"(0.5e0 * ln((1 + {z}) / (1 - {z})))"
    sh = lambda z: f"((exp({z}) - exp(-({z}))) / 2)"
    ch = lambda z: f"((exp({z}) + exp(-({z}))) / 2)"
    t = sh(f"({at('s')} - {_E!r} * {at(f'({_E!r} * s)')})")
    x = "eta + " + " + ".join(f"{a!r} * cos({2 * j} * xi) * {sh(f'{2 * j} * eta')}" for j, a in enumerate(_AL, 1))
    y = "xi + " + " + ".join(f"{a!r} * sin({2 * j} * xi) * {ch(f'{2 * j} * eta')}" for j, a in enumerate(_AL, 1))
    return (
        f"{table}_1 AS (SELECT {cols}, sin(radians(lat)) AS s, radians(lon - 75) AS lam FROM {key}),"
        f"{table}_2 AS (SELECT *, {t} AS t FROM {table}_1),"
        f"{table}_3 AS (SELECT *, atan2(t, cos(lam)) AS xi, {at('(sin(lam) / sqrt(1 + t * t))')} AS eta FROM {table}_2),"
        f"{table} AS (SELECT *, 500000 + {_R!r} * ({x}) AS x, {_R!r} * ({y}) AS y FROM {table}_3)"
    )


def projected(df, *keep):
    x, y = utm(F.col("lon"), F.col("lat"))
    return df.select(*keep, x.alias("x"), y.alias("y"))


@query(
    "J11_nearest_centre",
    f"""WITH {_utm_sql('sp', 'sites', 'site, lon, lat')}, {_utm_sql('zp', 'zones', 'zone, lon, lat')},
    d AS (SELECT site, zone, (sp.x - zp.x) * (sp.x - zp.x) + (sp.y - zp.y) * (sp.y - zp.y) AS d2 FROM sp, zp)
    SELECT site, arg_min(zone, (round(d2), zone)) AS zone, round_even(sqrt(min(d2)), 0) AS metres FROM d GROUP BY site""",
    ("sites", "zones"),
)
def _(v: Views):
    sites, centres = projected(v.sites, "site"), projected(v.zones, "zone")
    near = spatial.nearest_point(sites, "site", centres, tie=("zone",))
    return near.select("site", "zone", round_to(F.sqrt("d2"), 0).alias("metres"))


_DIST = """WITH g AS (SELECT x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 1e-30) AS len2 FROM segments WHERE waterway IN ('drain', 'ditch')),
    p AS (SELECT s_suppkey AS id, ((s_suppkey * 7717) % 11000) * 1e0 - 500 AS px, ((s_suppkey * 3571) % 11000) * 1e0 - 500 AS py FROM supplier),
    t AS (SELECT id, px, py, x1, y1, dx, dy, greatest(0e0, least(1e0, ((px - x1) * dx + (py - y1) * dy) / len2)) AS t FROM p, g)
    SELECT id, round_even(min(sqrt((px - (x1 + t * dx)) * (px - (x1 + t * dx)) + (py - (y1 + t * dy)) * (py - (y1 + t * dy)))) * 1e3, 0) / 1e3 AS distance_m FROM t GROUP BY id"""


@query("J12_nearest_line_distance", _DIST, ("segments",))
def _(v: Views):
    k = F.col("s_suppkey")
    points = v.table("supplier").select(
        k.alias("id"), ((k * 7717) % 11000 - 500).cast("double").alias("x"), ((k * 3571) % 11000 - 500).cast("double").alias("y")
    )
    drains = v.segments.filter(F.col("waterway").isin("drain", "ditch"))
    return spatial.nearest_line_distance(points, "id", drains).withColumn("distance_m", round_to(F.col("distance_m"), 3))


_CLIP = """WITH r AS (SELECT 'R' || CAST(s_suppkey AS VARCHAR) AS zone, (s_suppkey % 10) * 1e3 AS lx, ((s_suppkey // 10) % 10) * 1e3 AS ly, (s_suppkey % 10) * 1e3 + 1e3 AS hx, ((s_suppkey // 10) % 10) * 1e3 + 1e3 AS hy FROM supplier),
    c AS (SELECT zone, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, lx, ly, hx, hy FROM r JOIN segments ON least(x1, x2) <= hx AND greatest(x1, x2) >= lx AND least(y1, y2) <= hy AND greatest(y1, y2) >= ly),
    e AS (SELECT zone, sqrt(dx * dx + dy * dy) AS len,
       CASE WHEN dx <> 0 THEN least((lx - x1) / dx, (hx - x1) / dx) ELSE 0 END AS ex, CASE WHEN dx <> 0 THEN greatest((lx - x1) / dx, (hx - x1) / dx) ELSE 1 END AS ox,
       CASE WHEN dy <> 0 THEN least((ly - y1) / dy, (hy - y1) / dy) ELSE 0 END AS ey, CASE WHEN dy <> 0 THEN greatest((ly - y1) / dy, (hy - y1) / dy) ELSE 1 END AS oy FROM c),
    s AS (SELECT zone, sum(greatest(0, least(1, ox, oy) - greatest(0, ex, ey)) * len) AS total FROM e GROUP BY zone)
    SELECT r.zone, round_even(coalesce(total, 0) * 1e3, 0) / 1e3 AS length_m, round_even(coalesce(total, 0) * 1e3, 0) / 1e3 AS m_per_km2 FROM r LEFT JOIN s ON r.zone = s.zone"""


@query("J13_line_length_in_zone", _CLIP, ("segments",))
def _(v: Views):
    k = F.col("s_suppkey")
    x, y = (k % 10) * F.lit(1000.0), (F.floor(k / 10) % 10) * F.lit(1000.0)
    rects = v.table("supplier").select(
        F.concat(F.lit("R"), k.cast("string")).alias("zone"), x.alias("lo_x"), y.alias("lo_y"), (x + 1000.0).alias("hi_x"), (y + 1000.0).alias("hi_y")
    )
    out = spatial.line_length_in_zones(v.segments, rects, 700.0)
    return out.select("zone", *[round_to(F.col(c), 3).alias(c) for c in ("length_m", "m_per_km2")])
