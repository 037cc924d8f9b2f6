"""Join, lookup and set queries: J, G, D12-D15."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.catalog.base import Views, query, zone_id
from pluvia.functions.geo import in_box
from pluvia.functions.numeric import round_to
from pluvia.operators import joins, series, spatial, stats
from pluvia.session import cut_lineage

TILE = 0.25


def rects(v: Views):
    return spatial.zone_rectangles(v.zones.select("zone", "lat", "lon"), fv.CELL_HALF_DEG)


# first zone that strictly contains the point, in SQL
_RECT = "lon > zlon - 0.125e0 AND lon < zlon + 0.125e0 AND lat > zlat - 0.125e0 AND lat < zlat + 0.125e0"
_Z = "(SELECT zone AS z, lat AS zlat, lon AS zlon FROM zones)"


@query(
    "J01_nearest_cell",
    """WITH cells AS (SELECT DISTINCT lon AS clon, lat AS clat FROM zones WHERE elevation_mean_m > 0),
    p AS (SELECT site, lon, lat, clon, clat, (clon - lon) * (clon - lon) + (clat - lat) * (clat - lat) AS d2 FROM sites, cells)
    SELECT site, arg_min(clat, (d2, clat, clon)) AS grid_lat, arg_min(clon, (d2, clat, clon)) AS grid_lon FROM p GROUP BY site""",
    ("sites", "zones"),
)
def _(v: Views):
    cells = v.zones.filter("elevation_mean_m > 0").select(F.col("lat").alias("grid_lat"), F.col("lon").alias("grid_lon"))
    near = spatial.nearest_point(v.sites, "site", cells, "lon", "lat", "grid_lon", "grid_lat", ("grid_lat", "grid_lon"))
    return near.drop("d2")


@query(
    "J02_site_series",
    """WITH cells AS (SELECT DISTINCT zone, lon AS clon, lat AS clat FROM zones),
    p AS (SELECT site, zone, (clon - lon) * (clon - lon) + (clat - lat) * (clat - lat) AS d2, clat, clon FROM sites, cells),
    m AS (SELECT site, arg_min(zone, (d2, clat, clon)) AS zone FROM p GROUP BY site)
    SELECT m.site, date, rain_mm FROM m JOIN zone_day z ON m.zone = z.zone""",
    ("sites", "zones", "zone_day"),
)
def _(v: Views):
    cells = v.zones.select("zone", F.col("lat").alias("grid_lat"), F.col("lon").alias("grid_lon"))
    near = spatial.nearest_point(
        v.sites, "site", cells.drop("zone"), "lon", "lat", "grid_lon", "grid_lat", ("grid_lat", "grid_lon")
    )
    series = v.zone_day.join(cells, "zone")
    return near.join(series, ["grid_lat", "grid_lon"]).select("site", "date", "rain_mm")


@query(
    "J03_static_join",
    "SELECT d.zone, d.date, d.rain_mm, z.lat, z.lon, z.built_up_pct FROM zone_day d LEFT JOIN zones z ON d.zone = z.zone",
    ("zone_day", "zones"),
)
def _(v: Views):
    daily = v.zone_day.withColumn("built_up_pct", F.lit(-1.0))
    return joins.static_join(daily, v.zones.select("zone", "lat", "lon", "built_up_pct"))


@query(
    "J06_checked_join",
    "SELECT s.zone, s.date, s.anomaly_score, z.built_up_pct FROM scored s JOIN zones z ON s.zone = z.zone",
    ("scored", "zones"),
)
def _(v: Views):
    return joins.checked_join(v.scored_parts.select("zone", "date", "anomaly_score"), v.zones.select("zone", "built_up_pct"), ["zone"])


@query(
    "J07_point_in_cell",
    f"SELECT event_id, lon, lat, min(z) AS zone FROM (SELECT event_id, lon, lat FROM event_range) LEFT JOIN {_Z} ON {_RECT} GROUP BY 1, 2, 3",
    ("event_range", "zones"),
)
def _(v: Views):
    return spatial.point_in_zone(v.event_range.select("event_id", "lon", "lat"), rects(v), TILE)


@query(
    "J08_event_interval_labels",
    """WITH e AS (SELECT DISTINCT zone, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date FROM event_range)
       SELECT d.zone, d.date, CASE WHEN e.zone IS NULL THEN 0 ELSE 1 END AS flood_event_active FROM zone_day d LEFT JOIN e ON d.zone = e.zone AND d.date = e.date""",
    ("zone_day", "event_range"),
)
def _(v: Views):
    return joins.label_event_days(v.zone_day.select("zone", "date"), v.event_range)


@query(
    "J08_rows_per_event",
    """SELECT e.event_id, e.zone, count(d.date) AS rows_labelled FROM event_range e LEFT JOIN zone_day d ON d.zone = e.zone AND d.date BETWEEN e.start_date AND e.end_date GROUP BY 1, 2""",
    ("zone_day", "event_range"),
)
def _(v: Views):
    return joins.event_row_counts(v.zone_day, v.event_range).select("event_id", "zone", "rows_labelled")


@query(
    "J09_events_per_zone",
    f"""WITH p AS (SELECT event_id, min(z) AS zone FROM event_range JOIN {_Z} ON {_RECT} GROUP BY 1)
       SELECT z.zone, count(p.event_id) AS n FROM zones z LEFT JOIN p ON z.zone = p.zone GROUP BY 1""",
    ("event_range", "zones"),
)
def _(v: Views):
    return spatial.count_in_zones(v.event_range.select("event_id", "lon", "lat"), rects(v), TILE)


@query(
    "J10_event_buffer_exclusion",
    """SELECT zone, date, rain_mm FROM zone_day z WHERE NOT EXISTS (SELECT 1 FROM storm_days e WHERE e.d BETWEEN z.date - 3 AND z.date + 3)""",
    ("zone_day", "storm_days"),
)
def _(v: Views):
    from pluvia.operators.features import exclude_event_buffer

    days = joins.expand_dates(v.storm_range)
    return exclude_event_buffer(v.zone_day, days).select("zone", "date", "rain_mm")


@query(
    "J14_reference_comparison",
    """WITH b AS (SELECT date, sum(rain_mm) AS v FROM zone_day GROUP BY 1), r AS (SELECT date, v + CASE WHEN day(date) = 5 THEN 0.5 ELSE 0 END AS v FROM b WHERE month(date) <> 2)
       SELECT (SELECT count(*) FROM b JOIN r USING (date)) AS matched, (SELECT count(*) FROM b JOIN r USING (date) WHERE abs(b.v - r.v) > 1e-4) AS value_mismatches,
         greatest((SELECT count(*) FROM b), (SELECT count(*) FROM r)) - (SELECT count(*) FROM b JOIN r USING (date)) AS date_mismatches""",
    ("zone_day",),
)
def _(v: Views):
    base = v.zone_day.groupBy("date").agg(F.sum("rain_mm").alias("v"))
    off = F.when(F.dayofmonth("date") == 5, 0.5).otherwise(0.0)
    ref = base.filter(F.month("date") != 2).withColumn("v", F.col("v") + off)
    return joins.compare_series(base, ref, "v")


@query(
    "J15_keyed_lookup",
    """WITH q AS (SELECT DISTINCT CAST(ts AS DATE) - 9000 AS date, 'Z' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS zone FROM events)
       SELECT q.zone, q.date, s.risk_score, s.risk_level, s.zone IS NOT NULL AS found FROM q LEFT JOIN scored s ON q.zone = s.zone AND q.date = s.date""",
    ("scored",),
)
def _(v: Views):
    requests = v.table("events").select(F.date_sub(F.col("ts").cast("date"), 9000).alias("date"), zone_id(F.col("user_id")).alias("zone")).distinct()
    return joins.keyed_lookup(requests, v.scored.select("zone", "date", "risk_score", "risk_level"), ["zone", "date"])


# gauge chain: station -> zone -> day
_GZ = f"""gz AS (SELECT g.station, g.ts, g.event_id, g.level, m.zone FROM gauge g JOIN (SELECT station, min(z) AS zone FROM (SELECT DISTINCT station, lon, lat FROM gauge) JOIN {_Z} ON {_RECT} GROUP BY 1) m ON g.station = m.station),
    sd AS (SELECT zone, station, CAST(ts AS DATE) AS date, round_even(avg(level) * 1e3, 0) / 1e3 AS level_daily_mean_m, round_even(max(level) * 1e3, 0) / 1e3 AS level_daily_max_m, count(*) AS n_obs FROM gz GROUP BY 1, 2, 3),
    st AS (SELECT zone, CAST(count(DISTINCT station) AS INTEGER) AS cwc_stations_in_cell FROM sd GROUP BY 1),
    zg AS (SELECT sd.zone, date, round_even(avg(level_daily_mean_m) * 1e3, 0) / 1e3 AS river_level_daily_mean_m, round_even(max(level_daily_max_m) * 1e3, 0) / 1e3 AS river_level_daily_max_m, any_value(cwc_stations_in_cell) AS cwc_stations_in_cell
           FROM sd JOIN st ON sd.zone = st.zone GROUP BY 1, 2)"""


def station_days(v: Views):
    stations = v.gauge.groupBy("station").agg(F.min_by("lon", "ts").alias("lon"), F.min_by("lat", "ts").alias("lat"))
    located = spatial.point_in_zone(stations, rects(v), TILE).filter("zone IS NOT NULL").select("station", "zone")
    return stats.station_days(v.gauge.join(located, "station"))


@query("D12_station_days", f"WITH {_GZ} SELECT * FROM sd", ("gauge", "zones"))
def _(v: Views):
    return station_days(v)


@query("D13_zone_days", f"WITH {_GZ} SELECT * FROM zg", ("gauge", "zones"))
def _(v: Views):
    return stats.zone_days(station_days(v))


_HAV = "2 * 6371.0088e0 * asin(sqrt(pow(sin((radians({y}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({y})) * pow(sin((radians({x}) - radians(lon)) / 2), 2)))"
_BOX = {"min_lat": 12.0, "max_lat": 18.0, "min_lon": 68.0, "max_lon": 68.2}
_CORNERS = ", ".join(_HAV.format(x=x, y=y) for x in ("68e0", "68.2e0") for y in ("12e0", "18e0"))


@query(
    "D14_station_profile",
    f"""WITH s AS (SELECT station, arg_min(lon, (ts, event_id)) AS lon, arg_min(lat, (ts, event_id)) AS lat, count(*) AS n_records, min(ts) AS time_start, max(ts) AS time_end,
        min(level) AS level_min_m, max(level) AS level_max_m, round_even(avg(level) * 1e3, 0) / 1e3 AS level_mean_m FROM gauge GROUP BY 1),
    d AS (SELECT *, round_even(CASE WHEN lon BETWEEN 68e0 AND 68.2e0 AND lat BETWEEN 12e0 AND 18e0 THEN 0e0 ELSE least({_CORNERS}) END * 1e2, 0) / 1e2 AS distance_km FROM s)
    SELECT *, CASE WHEN distance_km <= 15 THEN 'YES' ELSE 'NO' END AS relevant FROM d""",
    ("gauge",),
)
def _(v: Views):
    return stats.station_profile(v.gauge, _BOX)


@query(
    "D15_station_summary",
    f"""WITH {_GZ}, p AS (SELECT zone, station, avg(level_daily_mean_m) AS m, max(level_daily_max_m) AS x FROM sd GROUP BY 1, 2)
    SELECT zone, count(*) AS stations, max(x) AS max_level_m, round_even(avg(m) * 1e6, 0) / 1e6 AS mean_level_m FROM p GROUP BY 1""",
    ("gauge", "zones"),
)
def _(v: Views):
    return stats.station_summary(station_days(v)).withColumn("mean_level_m", round_to(F.col("mean_level_m"), 6))


_REQ = """sp AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM gauge),
    rq AS (SELECT z.zone, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM zones z, sp)"""


@query(
    "J16_gauge_status",
    f"""WITH {_GZ}, {_REQ} SELECT rq.zone, rq.date, river_level_daily_mean_m IS NOT NULL AS available,
      CASE WHEN river_level_daily_mean_m IS NOT NULL THEN round_even(river_level_daily_mean_m * 1e2, 0) / 1e2 END AS level_mean_m,
      CASE WHEN river_level_daily_mean_m IS NOT NULL THEN round_even(river_level_daily_max_m * 1e2, 0) / 1e2 END AS level_max_m,
      CASE WHEN river_level_daily_mean_m IS NOT NULL THEN cwc_stations_in_cell END AS stations
    FROM rq LEFT JOIN zg ON rq.zone = zg.zone AND rq.date = zg.date""",
    ("gauge", "zones"),
)
def _(v: Views):
    first, last = (v.gauge.agg(f("ts").cast("date")).scalar() for f in (F.min, F.max))
    asked = v.zones.select("zone", first.alias("lo"), last.alias("hi")).select("zone", F.explode(F.sequence("lo", "hi")).alias("date"))
    return joins.gauge_status(asked, stats.zone_days(station_days(v)))


@query(
    "J18_forecast_lookup",
    """WITH l AS (SELECT zone, max(date) AS last FROM scored GROUP BY zone),
    m AS (SELECT s.zone, any_value(last) AS last, avg(anomaly_score) AS a, avg(temporal_intensity) AS t, any_value(vulnerability_score) AS v FROM scored s JOIN l ON s.zone = l.zone AND s.date >= l.last - 90 GROUP BY s.zone),
    d AS (SELECT zone, v, CAST(h AS INTEGER) AS days_ahead, CAST(last + CAST(h AS INTEGER) AS DATE) AS date, greatest(0.30e0, 1e0 - 0.04e0 * h) AS damp, CASE WHEN a = 0 THEN 40e0 ELSE a END AS a, CASE WHEN t = 0 THEN 35e0 ELSE t END AS t
          FROM m, (SELECT unnest(range(1, 31)) AS h)),
    p AS (SELECT *, CAST(printf('%.2f', a * damp) AS DOUBLE) AS fa, CAST(printf('%.2f', t * damp) AS DOUBLE) AS ft FROM d),
    f AS (SELECT *, least(50e0, CAST(printf('%.2f', 0.45e0 * fa + 0.3e0 * ft + 0.25e0 * v) AS DOUBLE)) AS fs, days_ahead % 3 = 0 AS hit FROM p),
    g AS (SELECT zone, date, CASE WHEN hit THEN CAST((days_ahead * 7) % 100 AS DOUBLE) ELSE fs END AS risk_score, CASE WHEN hit THEN 'INCREASING' ELSE 'STABLE' END AS trend, hit AS from_stored FROM f)
    SELECT *, CASE WHEN risk_score < 40 THEN 'LOW' WHEN risk_score < 60 THEN 'MODERATE' WHEN risk_score < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level FROM g""",
    ("scored",),
)
def _(v: Views):
    from pluvia.plans.forecast import forecast_lookup

    history = cut_lineage(v.scored_parts.select("zone", "date", "anomaly_score", "temporal_intensity", "vulnerability_score"))
    ahead = F.explode(F.sequence(F.lit(1), F.lit(30))).alias("days_ahead")
    requests = history.groupBy("zone").agg(F.max("date").alias("last")).select("zone", "last", ahead)
    requests = requests.select("zone", "days_ahead", F.date_add("last", F.col("days_ahead")).alias("date"))
    stored = requests.filter("days_ahead % 3 = 0").select(
        "zone", "date", ((F.col("days_ahead") * 7) % 100).cast("double").alias("risk_score"), F.lit("INCREASING").alias("trend"),
        F.lit(1.0).alias("anomaly"), F.lit(1.0).alias("temporal_rainfall"),
    )
    return forecast_lookup(requests, stored, history).select("zone", "date", "risk_score", "trend", "from_stored", "risk_level")


@query(
    "J21_same_date_spread",
    """WITH p AS (SELECT zone, arg_max(date, (anomaly_score, -date_diff('day', DATE '1970-01-01', date))) AS date FROM scored GROUP BY zone),
    t AS (SELECT date, count(*) AS triggered_by, min(zone) AS first_trigger FROM p GROUP BY date)
    SELECT s.zone, s.date, anomaly_score, triggered_by, first_trigger FROM scored s JOIN t ON s.date = t.date""",
    ("scored",),
)
def _(v: Views):
    return joins.same_date_spread(v.scored_parts, "anomaly_score")


@query(
    "J22_report_counts",
    "SELECT z.zone, count(r.event_id) AS citizen_reports FROM zones z LEFT JOIN reports r ON z.zone = r.zone GROUP BY 1",
    ("zones", "reports"),
)
def _(v: Views):
    return joins.report_counts(v.zones.select("zone"), v.reports)


@query(
    "J23_static_lookup_fallback",
    """WITH p AS (SELECT DISTINCT CAST(round_even(lat * 1e2, 0) AS BIGINT) AS la, CAST(round_even(lon * 1e2, 0) AS BIGINT) AS lo, elevation_mean_m AS e FROM zones),
    n AS (SELECT lower('Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS name, s_acctbal + 1 AS e FROM supplier)
    SELECT site, coalesce(p.e, n.e) AS elevation FROM sites s LEFT JOIN p ON CAST(round_even(s.lat * 1e2, 0) AS BIGINT) = la AND CAST(round_even(s.lon * 1e2, 0) AS BIGINT) = lo LEFT JOIN n ON lower(s.site) = n.name""",
    ("zones", "sites"),
)
def _(v: Views):
    position = v.zones.select("lat", "lon", F.col("elevation_mean_m").alias("elevation"))
    names = v.table("supplier").select(
        F.concat(F.lit(" Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"), (F.col("s_acctbal") + 1).alias("elevation")
    )
    out = joins.fallback_lookup(v.sites.withColumnRenamed("site", "name"), position, names, "elevation")
    return out.select(F.col("name").alias("site"), "elevation")


# --------------------------------------------------- set operations, filters
@query(
    "G01_concatenate_years",
    "SELECT zone, date, rain_mm, CASE WHEN year(date) >= 1998 THEN rain_mm * 2 END AS extra FROM zone_day",
    ("zone_day",),
)
def _(v: Views):
    early = v.zone_day.filter(F.year("date") < 1998)
    late = v.zone_day.filter(F.year("date") >= 1998).withColumn("extra", F.col("rain_mm") * 2)
    return early.unionByName(late, allowMissingColumns=True)


@query("G02_distinct_by_key", "SELECT DISTINCT date_trunc('day', ts)::DATE AS date, user_id, event_type FROM events")
def _(v: Views):
    e = v.table("events").select(F.col("ts").cast("date").alias("date"), "user_id", "event_type")
    return e.dropDuplicates(["date", "user_id", "event_type"])


@query(
    "G03_missing_dates",
    """WITH o AS (SELECT DISTINCT zone, date FROM zone_day WHERE rain_mm > 0), b AS (SELECT min(date) AS lo, max(date) AS hi FROM o),
    s AS (SELECT zone, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT zone FROM o), b)
    SELECT zone, date FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.zone = s.zone AND o.date = s.date)""",
    ("zone_day",),
)
def _(v: Views):
    from pluvia.operators.quality import missing_dates

    return missing_dates(v.zone_day.filter("rain_mm > 0"))


@query(
    "G04_complete_grid_check",
    """WITH o AS (SELECT DISTINCT zone, date FROM zone_day WHERE rain_mm > 0), e AS (SELECT zone, date FROM (SELECT DISTINCT zone FROM o), (SELECT DISTINCT date FROM o))
       SELECT count(*) AS expected, (SELECT count(*) FROM o) AS present, count(*) - (SELECT count(*) FROM o) AS missing FROM e""",
    ("zone_day",),
)
def _(v: Views):
    from pluvia.operators.quality import complete_grid

    return complete_grid(v.zone_day.filter("rain_mm > 0"))


@query(
    "G05_date_expansion",
    "SELECT event_id, start_date, end_date, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date FROM event_range",
    ("event_range",),
)
def _(v: Views):
    return joins.expand_dates(v.event_range.select("event_id", "start_date", "end_date"))


@query(
    "P07_coordinate_validity",
    """SELECT count(*) FILTER (lat < 8.5 OR lat > 90 OR lon < -180 OR lon > 180) AS invalid_coordinates,
       count(*) FILTER (lat < 6.5 OR lat > 38.5 OR lon < 66.5 OR lon > 68.0) AS invalid_grid FROM sites""",
    ("sites",),
)
def _(v: Views):
    from pluvia.operators.quality import outside

    return v.sites.agg(
        F.count_if(outside(F.col("lat"), 8.5, 90) | outside(F.col("lon"), -180, 180)).alias("invalid_coordinates"),
        F.count_if(outside(F.col("lat"), 6.5, 38.5) | outside(F.col("lon"), 66.5, 68.0)).alias("invalid_grid"),
    )


@query("P08_bounding_box", "SELECT site, lon, lat FROM sites WHERE lat BETWEEN 12 AND 18 AND lon BETWEEN 68 AND 68.2", ("sites",))
def _(v: Views):
    return v.sites.filter(in_box(F.col("lon"), F.col("lat"), _BOX)).select("site", "lon", "lat")
