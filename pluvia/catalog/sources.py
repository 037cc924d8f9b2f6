"""Scan, sink and store queries: S and P01. Each writes rows of the shared tables in the
file form of the source and reads them back through the library."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.catalog.base import Views, query
from pluvia.catalog.joins import _RECT, _Z, TILE, rects
from pluvia.functions.classify import hazard_flags, intensity_category
from pluvia.operators import alerts as al
from pluvia.operators import series, stats
from pluvia.session import scratch_path
from pluvia.sources import readers, sinks, stores


def _document(v: Views, name: str, doc: dict) -> str:
    path = scratch_path(v.spark, name)
    v.spark.range(1).select(F.lit(json.dumps(doc)).alias("value")).coalesce(1).write.text(path)
    return path


@query("S01_site_scan", "SELECT site, lat, lon FROM sites", ("sites",))
def _(v: Views):
    path = scratch_path(v.spark, "sites.csv")
    rows = v.sites.select(F.concat(F.lit("  "), "site", F.lit(" ")).alias("City"), F.col("lat").alias("Latitude"), F.col("lon").alias("Longitude"))
    rows.write.option("header", True).csv(path)
    return readers.read_sites(v.spark, path)


@query(
    "S02_threshold_scan",
    """SELECT zone, date, CASE WHEN rain_mm > 115.5 THEN 'Extreme' WHEN rain_mm > 64.4 THEN 'Heavy' WHEN rain_mm > 15.5 THEN 'Moderate' WHEN rain_mm > 0 THEN 'Light' ELSE 'Dry' END AS category,
       coalesce(CAST(rain_mm > 64.4 AS INTEGER), 0) AS is_heavy, coalesce(CAST(rain_mm > 115.5 AS INTEGER), 0) AS is_extreme FROM obs""",
    ("obs",),
)
def _(v: Views):
    cats = [{"name": n, "min_mm": 0.0 if lo is None else lo, "max_mm": hi} for n, lo, hi in fv.INTENSITY_CATEGORIES]
    doc = {"categories": cats, "heavy_rainfall_threshold_mm": fv.HEAVY_MM, "extreme_event_threshold_mm": fv.EXTREME_MM}
    t = readers.read_thresholds(v.spark, _document(v, "thresholds.json", doc))
    r = F.col("rain_mm")
    return v.obs.select("zone", "date", intensity_category(r, t["categories"]).alias("category"), *[c.alias(k) for k, c in hazard_flags(r, t["heavy"], t["extreme"]).items()])


@query(
    "S03_cube_scan",
    "SELECT date, lat, lon, rain_mm, CAST(year(date) AS INTEGER) AS year, CASE WHEN year(date) >= 1998 THEN 1 END AS version FROM zone_day d JOIN zones z ON d.zone = z.zone",
    ("zone_day", "zones"),
)
def _(v: Views):
    path = scratch_path(v.spark, "cube")
    rows = v.zone_day.join(v.zones.select("zone", "lat", "lon"), "zone").select("date", "lat", "lon", "rain_mm", F.year("date").alias("year"))
    sinks.write_table(rows.filter("year < 1998"), path, "year")
    sinks.write_table(rows.filter("year >= 1998").withColumn("version", F.lit(1)), path, "year", mode="append")
    return readers.read_cube(v.spark, path)


@query(
    "S04_gauge_scan",
    """SELECT 'S' || CAST(user_id AS VARCHAR) AS station, 7.9e0 + (user_id % 190) / 10e0 AS lat, 67.9e0 + (user_id % 50) / 100e0 AS lon, date_trunc('minute', ts) AS ts,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE floor(value) END AS level FROM events WHERE event_id % 23 <> 0""",
)
def _(v: Views):
    path = scratch_path(v.spark, "gauges.csv")
    e, u = F.col("event_id"), F.col("user_id")
    rows = v.table("events").select(
        F.concat(F.lit("S"), u.cast("string")).alias("Station"), F.lit("Fluß é").alias("River"),
        (F.lit(7.9) + (u % 190) / F.lit(10.0)).alias("Latitude"), (F.lit(67.9) + (u % 50) / F.lit(100.0)).alias("Longitude"),
        F.when(e % 23 == 0, "99-99-9999 00:00").otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm")).alias(readers.GAUGE_TIME),
        F.when(e % 17 == 0, "n/a").otherwise(F.floor("value").cast("double").cast("string")).alias(readers.GAUGE_LEVEL),
    )
    rows.write.options(header=True, encoding="ISO-8859-1").csv(path)
    return readers.read_gauges(v.spark, path)


def _write_events(v: Views):
    path = scratch_path(v.spark, "events.csv")
    v.event_range.select(
        "event_id", "start_date", "end_date", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.lit("Heavy rain").alias("main_cause"), F.lit(1).alias("flood")
    ).write.option("header", True).csv(path)
    return path


@query("S05_event_log_scan", "SELECT event_id, start_date, end_date, lon, lat, 'Heavy rain' AS main_cause, '1' AS flood FROM event_range", ("event_range",))
def _(v: Views):
    return readers.read_events(v.spark, _write_events(v)).orderBy("start_date", "event_id")


@query(
    "S06_registered_labels",
    f"""WITH p AS (SELECT event_id, min(z) AS z FROM (SELECT event_id, lon, lat FROM event_range) JOIN {_Z} ON {_RECT} GROUP BY 1)
    SELECT DISTINCT CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date, p.z AS zone, CAST(1 AS INTEGER) AS label, 'points' AS source_id FROM event_range e JOIN p ON e.event_id = p.event_id
    UNION ALL SELECT DISTINCT CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE), zone, CAST(0 AS INTEGER), 'zones' FROM event_range""",
    ("event_range", "zones"),
)
def _(v: Views):
    points = _write_events(v)
    zoned, bad = scratch_path(v.spark, "zoned.csv"), scratch_path(v.spark, "bad.csv")
    days = v.event_range.select("start_date", "end_date", "zone", F.lit(0).alias("y"))
    days.withColumnRenamed("zone", "Grid_ID").write.option("header", True).csv(zoned)
    days.drop("zone").write.option("header", True).csv(bad)
    span = {"start": "start_date", "end": "end_date"}
    doc = {
        "registered_sources": [
            {"source_id": "points", "file": points, "date_columns": span, "label_column": "flood"},
            {"source_id": "zones", "file": zoned, "date_columns": span, "label_column": "y"},
            {"source_id": "unplaced", "file": bad, "date_columns": span, "label_column": "y"},
            {"source_id": "missing", "file": points + ".none", "date_columns": span},
        ]
    }
    return readers.read_label_sources(v.spark, _document(v, "sources.json", doc), rects(v), TILE)[0]


@query(
    "S07_line_layer_scan",
    """WITH l AS (SELECT line_id, any_value(waterway) AS waterway, count(*) AS n FROM segments WHERE line_id % 10 <> 3 GROUP BY 1)
    SELECT 'line ' || CAST(line_id AS VARCHAR) AS name, waterway, CASE WHEN waterway IN ('drain', 'ditch') THEN 'drainage' ELSE 'waterway' END AS layer, n - 1 AS segments FROM l WHERE n > 1""",
    ("segments",),
)
def _(v: Views):
    path = scratch_path(v.spark, "lines.geojson")
    vertex = F.array_sort(F.collect_list(F.struct("seg", F.array("x1", "y1").alias("p"))))
    lines = v.segments.groupBy("line_id").agg(F.first("waterway").alias("waterway"), F.transform(vertex, lambda s: s["p"]).alias("coordinates"))
    kind = F.when(F.col("line_id") % 10 == 3, "Point").otherwise("LineString")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.concat(F.lit("line "), F.col("line_id").cast("string")).alias("name"), "waterway").alias("properties"),
        F.struct(kind.alias("type"), "coordinates").alias("geometry"),
    )
    lines.select(F.to_json(feature).alias("value")).write.text(path)
    water, drain = readers.split_line_classes(readers.read_lines(v.spark, path, newline_delimited=True))
    both = water.withColumn("layer", F.lit("waterway")).unionByName(drain.withColumn("layer", F.lit("drainage")))
    segs = readers.line_segments(both, ["name", "waterway", "layer"])
    return segs.groupBy("name", "waterway", "layer").agg(F.count(F.lit(1)).alias("segments"))


@query("S08_projected_scan", "SELECT zone, date, rainfall_7d FROM rain_features", ("rain_features",))
def _(v: Views):
    path = scratch_path(v.spark, "features")
    v.rain_features.write.parquet(path)
    return readers.read_projected(v.spark, path, ["zone", "date", "rainfall_7d"])


@query(
    "S09_table_sinks",
    "SELECT zone, CAST(year(date) AS INTEGER) AS year, sum(rain_mm) AS annual_rainfall, count(*) FILTER (rain_mm > 0) AS rainy_days FROM zone_day GROUP BY 1, 2",
    ("zone_day",),
)
def _(v: Views):
    path = scratch_path(v.spark, "yearly")
    sinks.write_table(stats.yearly_stats(v.zone_day).select("zone", "annual_rainfall", "rainy_days", "year"), path, "year")
    return v.spark.read.parquet(path).select("zone", "year", "annual_rainfall", "rainy_days")


@query(
    "S10_zone_features",
    """SELECT zone, 5 AS corners, lon - 0.125e0 AS west, lat + 0.125e0 AS north FROM zones""",
    ("zones",),
)
def _(v: Views):
    path = scratch_path(v.spark, "zones.geojson")
    sinks.write_features(sinks.zone_features(rects(v), ["zone"], "relative index"), path)
    schema = "type string, properties struct<zone string>, geometry struct<type string, coordinates array<array<array<double>>>>"
    ring = F.col("geometry.coordinates")[0]
    return v.spark.read.schema(schema).json(path).select(
        "properties.zone", F.size(ring).alias("corners"), ring[0][0].alias("west"), ring[2][1].alias("north")
    )


@query(
    "S11_latest_snapshot",
    "SELECT zone, strftime(date, '%Y-%m-%d') AS date, risk_score, risk_level, risk_trend, anomaly_score FROM scored WHERE date = (SELECT max(date) FROM scored)",
    ("scored",),
)
def _(v: Views):
    path = scratch_path(v.spark, "snapshot")
    sinks.latest_snapshot(v.scored).write.json(path)
    body = "date string, risk_score double, risk_level string, risk_trend string, components struct<anomaly_score double>"
    rows = v.spark.read.schema("zone string, payload string").json(path).select("zone", F.from_json("payload", body).alias("p"))
    return rows.select("zone", "p.date", "p.risk_score", "p.risk_level", "p.risk_trend", "p.components.anomaly_score")


def _alerts(v: Views):
    rows = v.scored.select("zone", "date", "risk_level", "risk_score")
    return al.alert_batch(rows, F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"))


@query(
    "S12_alert_store",
    """WITH t AS (SELECT zone, date, risk_level, risk_score, lag(risk_level) OVER (PARTITION BY zone ORDER BY date) AS p FROM scored)
       SELECT zone, date, risk_level, risk_score FROM t WHERE risk_level IN ('HIGH', 'CRITICAL') OR coalesce(p <> risk_level, false)
       ORDER BY date DESC, zone LIMIT 200""",
    ("scored",),
)
def _(v: Views):
    path = scratch_path(v.spark, "alerts")
    when = F.col("date").cast("timestamp")
    made = {"id_of": al.ID_OF, "made": al.alert_id()}
    stores.append_alerts(_alerts(v), path, when, stores.BY_MONTH, **made)
    stores.append_alerts(_alerts(v), path, when, stores.BY_MONTH, **made)  # a second run adds nothing
    return stores.list_alerts(v.spark, path, "public", 200, by=stores.BY_MONTH).select("zone", "date", "risk_level", "risk_score")


@query(
    "S13_preferences",
    """WITH l AS (SELECT 'u' || CAST(user_id % 40 AS VARCHAR) AS username, 'Z' || CAST(user_id % 7 AS VARCHAR) AS zone,
        coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE ['LOW', 'MODERATE', 'HIGH', 'CRITICAL'][1 + event_id % 4] END, 'LOW') AS min_level, ts AS updated_at FROM events)
       SELECT username, zone, arg_max(min_level, (updated_at, min_level)) AS min_level, max(updated_at) AS updated_at FROM l GROUP BY 1, 2""",
)
def _(v: Views):
    path = scratch_path(v.spark, "prefs")
    u, e = F.col("user_id"), F.col("event_id")
    level = F.element_at(F.array(*[F.lit(x) for x in fv.RISK_LEVELS]), (e % 4 + 1).cast("int"))
    log = v.table("events").select(
        F.concat(F.lit("u"), (u % 40).cast("string")).alias("username"), F.concat(F.lit("Z"), (u % 7).cast("string")).alias("zone"),
        F.when(e % 4 != 0, level).alias("min_level"), F.col("ts").alias("updated_at"),
    )
    stores.append_preferences(log, path, "min_level", "LOW")
    return stores.current_preferences(v.spark.read.parquet(path), "min_level")


@query(
    "S13_municipal_preferences",
    """WITH l AS (SELECT 'u' || CAST(user_id % 40 AS VARCHAR) AS username, 'Z' || CAST(user_id % 7 AS VARCHAR) AS zone,
        coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE ['ROUTINE', 'ELEVATED', 'HIGH', 'URGENT'][1 + event_id % 4] END, 'ELEVATED') AS min_priority, ts AS updated_at FROM events)
       SELECT username, zone, arg_max(min_priority, (updated_at, min_priority)) AS min_priority, max(updated_at) AS updated_at FROM l GROUP BY 1, 2""",
)
def _(v: Views):
    path = scratch_path(v.spark, "municipal-prefs")
    u, e = F.col("user_id"), F.col("event_id")
    level = F.element_at(F.array(*[F.lit(x) for x in fv.PRIORITY["order"]]), (e % 4 + 1).cast("int"))
    log = v.table("events").select(
        F.concat(F.lit("u"), (u % 40).cast("string")).alias("username"), F.concat(F.lit("Z"), (u % 7).cast("string")).alias("zone"),
        F.when(e % 5 != 0, level).alias("min_priority"), F.col("ts").alias("updated_at"),
    )
    stores.append_preferences(log, path, "min_priority", "ELEVATED")
    return stores.current_preferences(v.spark.read.parquet(path), "min_priority")


@query(
    "S12_municipal_listing",
    """WITH t AS (SELECT *, lag(risk_level) OVER (PARTITION BY zone ORDER BY date) AS p FROM scored),
    a AS (SELECT * FROM t WHERE risk_level IN ('HIGH', 'CRITICAL') OR coalesce(p <> risk_level, false)),
    d AS (SELECT max(date) AS date FROM a)
    SELECT zone, date, risk_score, anomaly_score AS anomaly, vulnerability_score AS vulnerability, 'check ' || lower(risk_level) AS first_action, CAST(2 AS INTEGER) AS n_actions,
      CASE WHEN rainfall_30d IS NOT NULL THEN rainfall_30d END AS water FROM a JOIN d USING (date) ORDER BY zone LIMIT 200""",
    ("scored",),
)
def _(v: Views):
    """Operational alerts of the last day with alerts, nested columns stored as VARIANT and decoded on reading."""
    path = scratch_path(v.spark, "municipal")
    lo, hi = F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date")
    rows = al.alert_batch(v.scored, lo, hi, ("municipal",)).select(
        "alert_id", "channel", "zone", "date", "risk_score",
        F.struct(F.col("anomaly_score").alias("anomaly"), F.col("vulnerability_score").alias("vulnerability")).alias("risk_components"),
        F.array(F.concat(F.lit("check "), F.lower("risk_level")), F.lit("report")).alias("actions"),
        F.struct(F.struct(F.col("rainfall_30d").alias("rain")).alias("water")).alias("environment"),
    )
    stores.append_alerts(stores.as_variants(rows), path, F.col("date").cast("timestamp"), stores.BY_MONTH)
    last = v.spark.read.parquet(path).agg(F.max("date")).first()[0]
    fields = {
        "anomaly": ("risk_components", "$.anomaly", "double"), "vulnerability": ("risk_components", "$.vulnerability", "double"),
        "first_action": ("actions", "$[0]", "string"), "_all": ("actions", "$", "array<string>"), "water": ("environment", "$.water.rain", "double"),
    }
    out = stores.decoded(stores.list_alerts(v.spark, path, "municipal", 200, date=last, by=stores.BY_MONTH), fields)
    return out.select("zone", "date", "risk_score", "anomaly", "vulnerability", "first_action", F.size("_all").alias("n_actions"), "water")


_OK = "report_type <> 'NOISE' AND length(trim(description)) > 0 AND zone IN (SELECT zone FROM zones)"


def _validated(v: Views):
    known = v.zones.select("zone", F.lit(True).alias("known"))
    rows = v.reports.select("zone", "report_type", "description", "ts").join(known, "zone", "left")
    return stores.validated_reports(rows, F.coalesce("known", F.lit(False)))


@query("S14_report_append", f"SELECT DISTINCT zone, report_type, description, ts, 'SUBMITTED' AS status FROM reports WHERE {_OK}", ("reports", "zones"))
def _(v: Views):
    path = scratch_path(v.spark, "reports")
    stores.append_reports(_validated(v), path)
    stores.append_reports(_validated(v), path)  # the same submissions again add nothing
    return stores.stored_reports(v.spark, path).drop("report_id")


@query(
    "S15_report_listing",
    f"SELECT zone, report_type, description, ts FROM (SELECT DISTINCT zone, report_type, description, ts FROM reports WHERE {_OK}) ORDER BY ts DESC LIMIT 50",
    ("reports", "zones"),
)
def _(v: Views):
    path = scratch_path(v.spark, "reports")
    stores.append_reports(_validated(v), path)
    return stores.list_reports(stores.stored_reports(v.spark, path)).select("zone", "report_type", "description", "ts")


@query(
    "S16_quality_report",
    """SELECT count(DISTINCT zone) AS sites, count(*) AS observations, min(date) AS first_date, max(date) AS last_date, 'PASSED' AS duplicates,
       CASE WHEN count(*) FILTER (rain_mm < 0) = 0 THEN 'PASSED' ELSE 'FAILED' END AS negatives, CASE WHEN count(*) = count(rain_mm) THEN 'PASSED' ELSE 'WARNING' END AS missing FROM obs""",
    ("obs",),
)
def _(v: Views):
    path = scratch_path(v.spark, "quality")
    sinks.write_quality_report(stats.quality_profile(v.obs), path)
    return v.spark.read.parquet(f"{path}/summary")


@query("P01_schema_projection", "SELECT date AS Date, zone AS Grid_ID, rain_mm AS Rainfall_mm FROM zone_day", ("zone_day",))
def _(v: Views):
    rows = series.category_features(v.zone_day)
    return readers.project(rows, ["date", "zone", "rain_mm"], {"date": "Date", "zone": "Grid_ID", "rain_mm": "Rainfall_mm"})
