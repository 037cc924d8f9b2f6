"""Pixel table queries: D16, D17, E16-E18, G06, G07, J19, J20, P19-P21."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.catalog.base import Views, query
from pluvia.functions.classify import wetness_proxy
from pluvia.functions.numeric import round_to
from pluvia.operators import raster, spatial

# pixel centres at 68 + (col + 0.5)/64 and 30 - (row + 0.5)/64: exact in binary
GRID = raster.Affine(68.0, 30.0, 1 / 64, 1 / 64)
FINE = raster.Affine(68.0, 30.0, 1 / 128, 1 / 128)
_AT = "68 + (col + 0.5e0) / 64 AS lon, 30 - (\"row\" + 0.5e0) / 64 AS lat"
_HIT = "lon >= zlon - 0.125e0 AND lon < zlon + 0.125e0 AND lat >= zlat - 0.125e0 AND lat < zlat + 0.125e0"
_ZZ = "zz AS (SELECT zone, lat AS zlat, lon AS zlon FROM zones)"


def rects(v: Views):
    return spatial.zone_rectangles(v.zones.select("zone", "lat", "lon"), fv.CELL_HALF_DEG)


@query(
    "D16_zonal_statistics",
    f"""WITH {_ZZ}, px AS (SELECT z, {_AT} FROM pixels WHERE z IS NOT NULL), h AS (SELECT zone, z FROM px JOIN zz ON {_HIT})
    SELECT zz.zone, avg(z) AS mean, min(z) AS min, max(z) AS max, count(z) AS valid_px FROM zz LEFT JOIN h ON zz.zone = h.zone GROUP BY 1""",
    ("pixels", "zones"),
)
def _(v: Views):
    return raster.zonal_stats(v.pixels, GRID, rects(v), 0.25)


_SH = lambda codes: f"round_even(count(*) FILTER (cls IN ({', '.join(map(str, codes))})) * 1e2 / count(*) * 1e4, 0) / 1e4"


@query(
    "D17_class_shares",
    f"""WITH {_ZZ}, px AS (SELECT cls, {_AT} FROM pixels WHERE cls <> 0),
    h AS (SELECT zone, {_SH(fv.LC_BUILT_UP)} AS built_up_pct, {_SH(fv.LC_VEGETATION)} AS vegetation_pct, {_SH(fv.LC_WATER)} AS water_cover_pct, {_SH(fv.LC_CROPLAND)} AS cropland_pct, count(*) AS n FROM px JOIN zz ON {_HIT} GROUP BY 1)
    SELECT zz.zone, built_up_pct, vegetation_pct, water_cover_pct, cropland_pct, coalesce(n, 0) AS lc_valid_px FROM zz LEFT JOIN h ON zz.zone = h.zone""",
    ("pixels", "zones"),
)
def _(v: Views):
    return raster.class_shares(v.pixels, GRID, rects(v), 0.25)


@query(
    "D17_class_counts",
    f"WITH {_ZZ}, px AS (SELECT cls, {_AT} FROM pixels WHERE cls <> 0) SELECT zone, cls, count(*) AS n FROM px JOIN zz ON {_HIT} GROUP BY 1, 2",
    ("pixels", "zones"),
)
def _(v: Views):
    return raster.class_counts(v.pixels, GRID, rects(v), 0.25)


@query(
    "E16_focal_fraction",
    """WITH e AS (SELECT min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM pixels),
    s AS (SELECT y AS "row", x AS col FROM e, LATERAL (SELECT unnest(range(r0, r1 + 1)) AS y), LATERAL (SELECT unnest(range(c0, c1 + 1)) AS x)),
    d AS (SELECT s."row", s.col, CASE WHEN cls = 50 THEN 1 ELSE 0 END AS b, CASE WHEN cls <> 0 THEN 1 ELSE 0 END AS v FROM s LEFT JOIN pixels p ON p."row" = s."row" AND p.col = s.col),
    a AS (SELECT "row", col, sum(b) OVER w AS b, sum(v) OVER w AS v FROM d WINDOW w AS (PARTITION BY "row" ORDER BY col RANGE BETWEEN 34 PRECEDING AND 34 FOLLOWING)),
    c AS (SELECT "row", col, CAST(sum(b) OVER w AS DOUBLE) AS b, CAST(sum(v) OVER w AS DOUBLE) AS v FROM a WINDOW w AS (PARTITION BY col ORDER BY "row" RANGE BETWEEN 34 PRECEDING AND 34 FOLLOWING))
    SELECT c."row", c.col, CASE WHEN v > 0 THEN b / v END AS fraction FROM c JOIN pixels p ON p."row" = c."row" AND p.col = c.col""",
    ("pixels",),
)
def _(v: Views):
    return raster.local_fraction(v.pixels)


# a 3x3 block by self-joins, with border pixels repeated
_NB = """WITH b AS (SELECT min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM pixels),
    k AS (SELECT p."row", p.col, p.z, greatest(p."row" - 1, r0) AS up, least(p."row" + 1, r1) AS dn, greatest(p.col - 1, c0) AS lf, least(p.col + 1, c1) AS rt, r0, r1, c0, c1 FROM pixels p, b),
    n AS (SELECT k."row", k.col, k.z, k.r0, k.r1, k.c0, k.c1, a.z AS a, b.z AS b, c.z AS c, d.z AS d, f.z AS f, g.z AS g, h.z AS h, i.z AS i FROM k
      LEFT JOIN pixels a ON a."row" = up AND a.col = lf LEFT JOIN pixels b ON b."row" = up AND b.col = k.col LEFT JOIN pixels c ON c."row" = up AND c.col = rt
      LEFT JOIN pixels d ON d."row" = k."row" AND d.col = lf LEFT JOIN pixels f ON f."row" = k."row" AND f.col = rt
      LEFT JOIN pixels g ON g."row" = dn AND g.col = lf LEFT JOIN pixels h ON h."row" = dn AND h.col = k.col LEFT JOIN pixels i ON i."row" = dn AND i.col = rt)"""


@query(
    "E17_horn_slope",
    f"""{_NB}, s AS (SELECT "row", col, z, ((c + 2 * f + i) - (a + 2 * d + g)) / 240e0 AS gx, ((g + 2 * h + i) - (a + 2 * b + c)) / 240e0 AS gy FROM n)
    SELECT "row", col, CASE WHEN z IS NOT NULL THEN round_even(degrees(atan(sqrt(gx * gx + gy * gy))) * 1e6, 0) / 1e6 END AS slope_deg FROM s""",
    ("pixels",),
)
def _(v: Views):
    return raster.horn_slope(v.pixels, 30.0, 30.0).withColumn("slope_deg", round_to(F.col("slope_deg"), 6))


@query(
    "E18_central_slope",
    f"""{_NB}, s AS (SELECT "row", col, z, CASE WHEN col = c0 THEN (f - z) / 30e0 WHEN col = c1 THEN (z - d) / 30e0 ELSE (f - d) / 60e0 END AS gx,
      CASE WHEN "row" = r0 THEN (h - z) / 30e0 WHEN "row" = r1 THEN (z - b) / 30e0 ELSE (h - b) / 60e0 END AS gy FROM n)
    SELECT "row", col, CASE WHEN z IS NOT NULL THEN round_even(degrees(atan(sqrt(gx * gx + gy * gy))) * 1e6, 0) / 1e6 END AS slope_deg FROM s""",
    ("pixels",),
)
def _(v: Views):
    return raster.central_slope(v.pixels).withColumn("slope_deg", round_to(F.col("slope_deg"), 6))


_TILES = """t AS (SELECT 1 AS tile, "row", col, z FROM pixels WHERE col < 60 UNION ALL SELECT 2, "row", col, z + 1000 FROM pixels WHERE col >= 40)"""


@query(
    "G06_mosaic",
    f"""WITH {_TILES} SELECT "row", col, arg_min(z, tile) FILTER (z IS NOT NULL) AS z FROM t GROUP BY 1, 2""",
    ("pixels",),
)
def _(v: Views):
    one = v.pixels.filter("col < 60").select(F.lit(1).alias("tile"), "row", "col", "z")
    two = v.pixels.filter("col >= 40").select(F.lit(2).alias("tile"), "row", "col", (F.col("z") + 1000).alias("z"))
    return raster.mosaic(one.unionByName(two))


@query("G07_stride_sample", 'SELECT "row", col, z FROM pixels WHERE "row" % 8 = 0 AND col % 8 = 0 AND z IS NOT NULL', ("pixels",))
def _(v: Views):
    return raster.stride_sample(v.pixels).select("row", "col", "z")


@query(
    "G07_every_kth",
    'SELECT "row", col FROM (SELECT "row", col, row_number() OVER (ORDER BY "row", col) - 1 AS p FROM pixels WHERE z IS NOT NULL) WHERE p % 5 = 0',
    ("pixels",),
)
def _(v: Views):
    return raster.every_kth(v.pixels.filter("z IS NOT NULL").select("row", "col"), ["row", "col"], 5)


_PTS = """pt AS (SELECT c_custkey AS id, 67.9e0 + (c_custkey % 180) / 1e2 AS lon, 30.05e0 - (c_custkey % 290) / 1e2 AS lat FROM customer),
    ix AS (SELECT *, CAST(floor((30 - lat) * 64) AS INTEGER) AS r, CAST(floor((lon - 68) * 64) AS INTEGER) AS c FROM pt)"""


def _points(v: Views):
    k = F.col("c_custkey")
    return v.table("customer").select(
        k.alias("id"), (F.lit(67.9) + (k % 180) / F.lit(100.0)).alias("lon"), (F.lit(30.05) - (k % 290) / F.lit(100.0)).alias("lat")
    )


@query("J19_raster_sampling", f'WITH {_PTS} SELECT id, z, cls FROM ix LEFT JOIN pixels p ON p."row" = r AND p.col = c', ("pixels",))
def _(v: Views):
    return raster.sample_points(_points(v), v.pixels, GRID, ["z", "cls"]).select("id", "z", "cls")


@query(
    "J20_band_stack",
    """WITH src AS (SELECT "row", col, z, z / 10 AS s FROM pixels),
    qt AS (SELECT 2 * "row" + q // 2 AS "row", 2 * col + q % 2 AS col, cls FROM pixels, (SELECT CAST(unnest(range(4)) AS INTEGER) AS q)),
    tg AS (SELECT "row", col, cls, ("row" + 0.5e0) / 2 - 0.5e0 AS fy, (col + 0.5e0) / 2 - 0.5e0 AS fx FROM qt),
    nb AS (SELECT t."row", t.col, CAST(floor(fy) AS INTEGER) + dy AS sr, CAST(floor(fx) AS INTEGER) + dx AS sc,
       (CASE WHEN dx = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) * (CASE WHEN dy = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END) AS w
       FROM tg t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx)),
    bl AS (SELECT nb."row", nb.col, sum(w * z) / sum(w) AS elevation_m, sum(w * s) / sum(w) AS slope_deg FROM nb JOIN src ON src."row" = sr AND src.col = sc WHERE w > 0 AND z IS NOT NULL GROUP BY 1, 2)
    SELECT tg."row", tg.col, round_even(elevation_m * 1e6, 0) / 1e6 AS elevation_m, round_even(slope_deg * 1e6, 0) / 1e6 AS slope_deg, cls FROM tg LEFT JOIN bl ON tg."row" = bl."row" AND tg.col = bl.col""",
    ("pixels",),
)
def _(v: Views):
    p = v.pixels
    elev = p.select("row", "col", F.col("z").alias("elevation_m"))
    slope = p.select("row", "col", (F.col("z") / 10).alias("slope_deg"))
    # every pixel as the coarse source of its four quarters
    quarters = p.select("row", "col", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("q")).select(
        (F.col("row") * 2 + F.floor(F.col("q") / 2)).cast("int").alias("row"), (F.col("col") * 2 + F.col("q") % 2).cast("int").alias("col")
    )
    out = raster.stack_bands(quarters, FINE, elev, slope, GRID, p.select("row", "col", "cls"), GRID)
    return out.withColumns({c: round_to(F.col(c), 6) for c in ("elevation_m", "slope_deg")})


@query(
    "P19_wetness_proxy",
    'SELECT "row", col, round_even(ln(50e0 / tan(radians(greatest(z / 10e0, 0.15e0)))) * 1e2, 0) / 1e2 + 0e0 AS twi FROM pixels WHERE z IS NOT NULL',
    ("pixels",),
)
def _(v: Views):
    return v.pixels.filter("z IS NOT NULL").select("row", "col", wetness_proxy(F.col("z") / 10.0).alias("twi"))


@query(
    "P20_rule_label",
    """WITH s AS (SELECT "row", col, z AS elevation_m, (("row" * 13 + col * 7) % 1500) * 1e0 AS d FROM pixels WHERE z IS NOT NULL), q AS (SELECT quantile_cont(elevation_m, 0.35) AS cut FROM s)
    SELECT "row", col, CASE WHEN d <= 700 AND elevation_m < cut THEN 1 ELSE 0 END AS label FROM s, q""",
    ("pixels",),
)
def _(v: Views):
    d = ((F.col("row") * 13 + F.col("col") * 7) % 1500).cast("double")
    s = v.pixels.filter("z IS NOT NULL").select("row", "col", F.col("z").alias("elevation_m"), d.alias("dist_to_drainage_m"))
    # the default guard wants 5000 samples; the smallest test scale has fewer pixels
    out = raster.proxy_label(s, minimum=1000)
    return out.select("row", "col", F.col("hydrologic_vulnerability_proxy").alias("label"))


_LC = " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in fv.LAND_COVER)
_LB = " ".join(f"WHEN {c} THEN {b}e0" for c, _, b in fv.LAND_COVER)


@query(
    "P21_land_cover_mapping",
    f"""WITH {_PTS}, j AS (SELECT id, z, cls, 'Z' || CAST(id % 4 AS VARCHAR) AS zone FROM ix LEFT JOIN pixels p ON p."row" = r AND p.col = c)
    SELECT id, CASE WHEN z IS NOT NULL AND cls IS NOT NULL THEN CASE cls {_LC} ELSE 'Urban_Suburban' END ELSE 'Fallback ' || CAST(id % 4 AS VARCHAR) END AS land_cover,
      CASE WHEN z IS NOT NULL AND cls IS NOT NULL THEN CASE cls {_LB} ELSE 55e0 END ELSE (id % 4) * 1e0 END AS built_up_percentage FROM j""",
    ("pixels",),
)
def _(v: Views):
    zone = F.concat(F.lit("Z"), (F.col("id") % 4).cast("string"))
    sampled = raster.sample_points(_points(v), v.pixels, GRID, ["z", "cls"]).withColumn("zone", zone)
    # nodata in any band discards the whole sample
    sampled = raster.land_cover_attributes(sampled.withColumn("cls", F.when(F.col("z").isNotNull(), F.col("cls"))))
    fallback = v.spark.range(4).select(
        F.concat(F.lit("Z"), F.col("id").cast("string")).alias("zone"), F.concat(F.lit("Fallback "), F.col("id").cast("string")).alias("land_cover"),
        F.col("id").cast("double").alias("built_up_percentage"),
    )
    out = raster.with_zone_fallback(sampled, fallback, ["land_cover", "built_up_percentage"])
    return out.select("id", "land_cover", "built_up_percentage")
