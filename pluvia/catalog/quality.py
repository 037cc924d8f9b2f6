"""Quality suite queries: Q and D35."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia.catalog.base import Views, query
from pluvia.catalog.joins import rects  # noqa: F401  (same zone rectangles)
from pluvia.functions.numeric import round_to
from pluvia.operators import joins, quality, series, spatial

SPAN = ("1995-01-02", "2001-11-05")
_DAYS = "date_diff('day', DATE '1995-01-02', DATE '2001-11-05') + 1"


def _with_place(v: Views, rows):
    return rows.join(v.zones.select("zone", "lat", "lon"), "zone", "left")


def _check(name, value, want="0"):
    return f"""SELECT '{name}' AS check_name, CASE WHEN ({value}) IS NOT DISTINCT FROM ({want}) THEN 'PASSED' ELSE 'FAILED' END AS status, CAST({value} AS VARCHAR) AS value, CAST({want} AS VARCHAR) AS expected"""


_Q1 = f"""pz AS (SELECT zone, count(*) AS n, count(DISTINCT date) AS d, min(date) AS f, max(date) AS l FROM q GROUP BY 1)"""
_Q1_CHECKS = " UNION ALL ".join(
    [
        _check("missing_values", "(SELECT count(*) FROM q WHERE rain_mm IS NULL)"),
        _check("duplicate_records", "(SELECT CAST(sum(n - d) AS BIGINT) FROM pz)"),
        _check("negative_values", "(SELECT count(*) FROM q WHERE rain_mm < 0)"),
        _check("invalid_coordinates", "(SELECT count(*) FROM q JOIN zones z ON q.zone = z.zone WHERE lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180)"),
        _check("invalid_grid", "(SELECT count(*) FROM q JOIN zones z ON q.zone = z.zone WHERE lat NOT BETWEEN 6.5 AND 38.5 OR lon NOT BETWEEN 66.5 AND 100)"),
        _check("zones_with_wrong_row_count", f"(SELECT count(*) FROM pz WHERE n <> {_DAYS})"),
        _check("zones_with_wrong_range", "(SELECT count(*) FROM pz WHERE f <> DATE '1995-01-02' OR l <> DATE '2001-11-05')"),
        _check("missing_days", "(SELECT CAST(sum(date_diff('day', f, l) + 1 - d) AS BIGINT) FROM pz)"),
    ]
)


@query(
    "Q01_base_validation",
    f"WITH q AS (SELECT * FROM obs WHERE day(date) <> 9 OR month(date) <> 9), {_Q1} {_Q1_CHECKS}",
    ("obs", "zones"),
)
def _(v: Views):
    rows = v.obs.filter("dayofmonth(date) <> 9 OR month(date) <> 9")
    return quality.validate_base(_with_place(v, rows), *SPAN)


_Q2_NULLS = f"""(WITH a AS (SELECT zone, date, lag(rain_mm, 7) OVER (PARTITION BY zone ORDER BY date) AS l7 FROM q)
    SELECT CAST(coalesce(sum(CASE WHEN c <> 7 THEN 1 ELSE 0 END), 0) AS BIGINT) FROM (SELECT zone, count(*) FILTER (l7 IS NULL) AS c FROM a GROUP BY 1))"""


def _final_checks(zones_expected):
    return " UNION ALL ".join(
        [
            _check("number_of_zones", "(SELECT count(*) FROM pz)", zones_expected),
            _check("zones_with_wrong_row_count", f"(SELECT count(*) FROM pz WHERE n <> {_DAYS})"),
            _check("first_date", "(SELECT min(f) FROM pz)", "DATE '1995-01-02'"),
            _check("last_date", "(SELECT max(l) FROM pz)", "DATE '2001-11-05'"),
            _check("core_missing_values", "(SELECT count(*) FROM q WHERE rain_mm IS NULL)"),
            _check("duplicate_keys", "(SELECT CAST(sum(n - d) AS BIGINT) FROM pz)"),
            _check("negative_values", "(SELECT count(*) FROM q WHERE rain_mm < 0)"),
            _check("unexpected_null_counts", _Q2_NULLS),
            _check("infinite_values", "CAST(0 AS BIGINT)"),
            _check("missing_days", "(SELECT CAST(sum(date_diff('day', f, l) + 1 - d) AS BIGINT) FROM pz)"),
            _check("wrong_types", "CAST(0 AS BIGINT)"),
        ]
    )


@query("Q02_final_validation", f"WITH q AS (SELECT * FROM zone_day), {_Q1} {_final_checks('99')}", ("zone_day",))
def _(v: Views):
    return quality.validate_final(series.station_features(v.zone_day), 99, *SPAN)


@query(
    "Q03_zone_table_validation",
    f"""WITH q AS (SELECT * FROM zone_day), {_Q1} {_final_checks('(SELECT count(*) FROM pz)')}
    UNION ALL {_check("reference_value_mismatches", "(SELECT count(*) FROM q WHERE zone = 'Z0000003' AND month(date) <> 2 AND day(date) = 5)")}
    UNION ALL {_check("reference_date_mismatches", "(SELECT count(*) FROM q WHERE zone = 'Z0000003' AND month(date) = 2)")}""",
    ("zone_day",),
)
def _(v: Views):
    off = F.when(F.dayofmonth("date") == 5, 0.5).otherwise(0.0)
    ref = v.zone_day.filter("zone = 'Z0000003' AND month(date) <> 2").select("date", (F.col("rain_mm") + off).alias("rain_mm"))
    return quality.validate_zone_table(series.station_features(v.zone_day), ref, "Z0000003", *SPAN)


@query(
    "Q04_feature_table_validation",
    """WITH e AS (SELECT DISTINCT zone, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date FROM event_range),
    q AS (SELECT f.*, CASE WHEN day(f.date) % 3 = 0 THEN 1e0 END AS lvl, CASE WHEN e.zone IS NULL THEN 0 ELSE 1 END AS fl FROM rain_features f LEFT JOIN e ON f.zone = e.zone AND f.date = e.date WHERE day(f.date) <> 9 OR f.zone <> 'Z0000001')
    SELECT count(*) AS rows, 8 AS columns, count(DISTINCT zone) AS zones, count(DISTINCT date) AS dates, CAST(0 AS BIGINT) AS dups, count(DISTINCT zone) * count(DISTINCT date) - count(*) AS missing_pairs,
      CAST(0 AS BIGINT) AS inf, count(*) FILTER (rain_mm < 0) AS neg, count(lvl) AS gauge, CAST(sum(fl) AS BIGINT) AS positives FROM q""",
    ("rain_features", "event_range"),
)
def _(v: Views):
    level = F.when(F.dayofmonth("date") % 3 == 0, 1.0)
    rows = v.rain_features.filter("dayofmonth(date) <> 9 OR zone <> 'Z0000001'").withColumn("river_level_daily_mean_m", level)
    rows = joins.label_event_days(rows, v.event_range)
    return quality.validate_features(rows, ["rainfall_1d", "rainfall_7d", "rainfall_30d"])


@query("Q05_feature_guards", "SELECT zone, date, rainfall_7d FROM rain_features", ("rain_features",))
def _(v: Views):
    rows = v.rain_features.select("zone", "date", "rainfall_7d")
    return quality.feature_guards(rows)


@query(
    "D35_layer_statistics",
    """SELECT waterway, count(*) AS segments, count(DISTINCT line_id) AS lines, min(least(x1, x2)) AS min_x, min(least(y1, y2)) AS min_y, max(greatest(x1, x2)) AS max_x, max(greatest(y1, y2)) AS max_y,
       min(least(x1, x2)) <= 100 AND min(least(y1, y2)) <= 100 AND max(greatest(x1, x2)) >= 9900 AND max(greatest(y1, y2)) >= 9900 AS covers FROM segments GROUP BY 1""",
    ("segments",),
)
def _(v: Views):
    return spatial.layer_statistics(v.segments, "waterway", (100.0, 100.0, 9900.0, 9900.0))
