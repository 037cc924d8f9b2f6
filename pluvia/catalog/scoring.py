"""Index, environment, validation and response queries: P13-P17, P21-P27, J17, F07."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.catalog.base import Views, query, zone_id
from pluvia.catalog.joins import _GZ, station_days
from pluvia.functions import calendar as cal
from pluvia.functions.numeric import round_to
from pluvia.operators import rules as rl
from pluvia.operators import stats
from pluvia.plans import vulnerability as vu
from pluvia.plans import zone_response as zr

_FACTORS = fv.VULNERABILITY_FACTORS


def features(v: Views):
    clim = v.zone_day.groupBy("zone").agg(F.avg("rain_mm").alias("rainfall_climatology_mm_day"))
    return v.zones.join(clim, "zone")


def _norm_sql(source, worse):
    x = f"({source} - min({source}) OVER ()) / (max({source}) OVER () - min({source}) OVER ()) * 1e2"
    x = x if worse else f"1e2 - {x}"
    return f"round_even(({x}) * 1e2, 0) / 1e2 + 0e0"


_F_SQL = """ft AS (SELECT z.*, c.rainfall_climatology_mm_day FROM zones z JOIN (SELECT zone, avg(rain_mm) AS rainfall_climatology_mm_day FROM zone_day GROUP BY 1) c ON z.zone = c.zone)"""
_NORMS = ", ".join(f"{_norm_sql(s, w)} AS norm_{n}" for n, s, w, _, _ in _FACTORS)
_N_SQL = f"{_F_SQL}, nm AS (SELECT zone, {_NORMS} FROM ft)"


@query("P13_minmax_normalize", f"WITH {_N_SQL} SELECT * FROM nm", ("zone_day", "zones"))
def _(v: Views):
    return vu.normalized_factors(features(v))


_SCORE = "round_even((" + " + ".join(f"norm_{f[0]} * {f[3]}e0" for f in _FACTORS) + ") * 1e2, 0) / 1e2"
_CONTR = ", ".join(f"round_even(norm_{f[0]} * {f[3]}e0 * 1e2, 0) / 1e2 AS contrib_{f[0]}" for f in _FACTORS)
_I_SQL = f"""{_N_SQL}, ix AS (SELECT zone, {_SCORE} AS vulnerability_score, {_CONTR} FROM nm),
    lv AS (SELECT *, CASE WHEN vulnerability_score < 45 THEN 'LOW' WHEN vulnerability_score < 65 THEN 'MODERATE' ELSE 'HIGH' END AS vulnerability_level FROM ix)"""


@query("P14_weighted_index", f"WITH {_I_SQL} SELECT * FROM lv", ("zone_day", "zones"))
def _(v: Views):
    out = vu.vulnerability_index(features(v))
    return out.select("zone", "vulnerability_score", *[f"contrib_{f[0]}" for f in _FACTORS], "vulnerability_level")


_LONG = " UNION ALL ".join(f"SELECT zone, '{f[0]}' AS factor, contrib_{f[0]} AS points, {i} AS i, '{f[4]}' AS noun FROM lv" for i, f in enumerate(_FACTORS))


@query("P14_contributions_long", f"WITH {_I_SQL} SELECT zone, factor, points FROM ({_LONG})", ("zone_day", "zones"))
def _(v: Views):
    return vu.contributions_long(vu.vulnerability_index(features(v)))


_PHRASES = f"""lg AS ({_LONG}),
    ph AS (SELECT zone, points, i, CASE WHEN points < 5 THEN '(minor) ' ELSE '' END || noun || ' (+' || printf('%.1f', points) || ' pts)' AS phrase FROM lg),
    ex AS (SELECT zone, string_agg(phrase, '; ' ORDER BY points DESC, i) AS explanation FROM ph GROUP BY zone),
    mj AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY points DESC, i) AS rn FROM ph WHERE points >= 5),
    tp AS (SELECT zone, string_agg(phrase, '; ' ORDER BY rn) AS top_contributors FROM mj WHERE rn <= 4 GROUP BY zone)"""


@query(
    "F07_ordered_contributors",
    f"WITH {_I_SQL}, {_PHRASES} SELECT ex.zone, explanation, coalesce(top_contributors, '') AS top_contributors FROM ex LEFT JOIN tp ON ex.zone = tp.zone",
    ("zone_day", "zones"),
)
def _(v: Views):
    out = vu.vulnerability_index(features(v))
    return out.select("zone", F.array_join("explanation", "; ").alias("explanation"), "top_contributors")


_HEAT = f"""ht AS (SELECT zone, round_even((0.6e0 * ((built_up_pct - min(built_up_pct) OVER ()) / (max(built_up_pct) OVER () - min(built_up_pct) OVER ()) * 1e2)
      + 0.4e0 * (1e2 - (vegetation_pct - min(vegetation_pct) OVER ()) / (max(vegetation_pct) OVER () - min(vegetation_pct) OVER ()) * 1e2)) * 1e2, 0) / 1e2 AS heat_score FROM zones),
    hl AS (SELECT *, CASE WHEN heat_score < 40 THEN 'LOW' WHEN heat_score < 65 THEN 'MODERATE' ELSE 'HIGH' END AS heat_level FROM ht)"""


@query(
    "P15_heat_exposure",
    f"""WITH {_HEAT} SELECT hl.*, '{{"built_up_pct":' || CAST(round_even(built_up_pct * 1e2, 0) / 1e2 AS VARCHAR) || ',"vegetation_pct":' || CAST(round_even(vegetation_pct * 1e2, 0) / 1e2 AS VARCHAR) || '}}' AS heat_inputs
    FROM hl JOIN zones z ON z.zone = hl.zone""",
    ("zones",),
)
def _(v: Views):
    return vu.heat_table(v.zones)


@query(
    "P17_water_explanations",
    """WITH y AS (SELECT zone, year(date) AS y, avg(rain_mm) AS m FROM zone_day GROUP BY 1, 2), p AS (SELECT zone, y, lag(m) OVER (PARTITION BY zone ORDER BY y) AS m FROM y),
    j AS (SELECT f.zone, f.date, rainfall_30d, m, CASE WHEN rainfall_30d IS NOT NULL AND m <> 0 THEN greatest(0e0, least(1e0, 1e0 - rainfall_30d / (30e0 * m))) END AS r FROM rain_features f JOIN p ON f.zone = p.zone AND year(f.date) = p.y)
    SELECT zone, date, CASE WHEN r IS NULL THEN 'insufficient history: no prior-year baseline and/or incomplete 30-day window (left null)'
      ELSE 'rainfall_30d=' || printf('%.1f', rainfall_30d) || ' mm vs expected ' || printf('%.1f', 30e0 * m) || ' mm|' ||
        CASE WHEN r <= 0.001 THEN 'at or above climatology (surplus)' ELSE 'deficit vs own climatology (' || CAST(CAST(round_even(r * 100, 0) AS BIGINT) AS VARCHAR) || '% of expected shortfall)' END END AS explanations FROM j""",
    ("rain_features",),
)
def _(v: Views):
    from pluvia.operators.series import with_previous_year
    from pluvia.plans.environment import water_table

    return water_table(with_previous_year(v.rain_features)).select("zone", "date", F.array_join("water_explanations", "|").alias("explanations"))


# ------------------------------------------------------------- text signals
_PCTL = "CAST(floor(anomaly_score) AS INTEGER)"
_SIG = f"""'ML anomaly ' || CAST(CAST(round_even(anomaly_score, 0) AS BIGINT) AS VARCHAR) || '/100 (' || CASE WHEN {_PCTL} >= 95 THEN 'top ' || CAST(100 - {_PCTL} AS VARCHAR) || '%' ELSE 'percentile ' || CAST({_PCTL} AS VARCHAR) END || ')'
    || '|7-day rainfall percentile ' || CAST(CAST(round_even(temporal_intensity, 0) AS BIGINT) AS VARCHAR) || '/100 (vs zone history, leak-safe)'
    || '|vulnerability ' || printf('%.1f', vulnerability_score) || ' (' || vulnerability_level || ')'
    || CASE WHEN river_level_daily_mean_m IS NULL THEN '|river level unavailable (no CWC data for this cell/date)'
       ELSE '|river level ' || printf('%.2f', river_level_daily_max_m) || ' m (' || CAST(cwc_stations_in_cell AS VARCHAR) || ' station)' END"""
_RIVER = f"""{_GZ}, rv AS (SELECT s.*, river_level_daily_mean_m, river_level_daily_max_m, cwc_stations_in_cell FROM scored s LEFT JOIN zg ON zg.zone = s.zone AND zg.date = s.date)"""


def river_levels(v: Views):
    """Levels per zone and day from the gauge readings."""
    return stats.zone_days(station_days(v))


@query("P17_key_signals", f"WITH {_RIVER} SELECT zone, date, {_SIG} AS key_signals FROM rv", ("scored", "zones", "gauge"))
def _(v: Views):
    rows = v.scored.join(river_levels(v), ["zone", "date"], "left").withColumn("anomaly_percentile", F.floor("anomaly_score").cast("int"))
    return rows.select("zone", "date", F.array_join(zr.key_signals(), "|").alias("key_signals"))


@query(
    "P25_why_statements",
    """SELECT zone, date, 'Anomaly signal ' || printf('%.1f', anomaly_score) || '/100 is ' || CASE WHEN anomaly_score >= 70 THEN 'elevated' WHEN anomaly_score >= 40 THEN 'moderate' ELSE 'low' END || ' relative to this zone''s history.'
      || '|7-day rainfall intensity signal ' || printf('%.1f', temporal_intensity) || '/100 is ' || CASE WHEN temporal_intensity >= 70 THEN 'high' WHEN temporal_intensity >= 40 THEN 'moderate' ELSE 'low' END || '.'
      || '|Underlying vulnerability is ' || vulnerability_level || ' (' || printf('%.1f', vulnerability_score) || '/100); factors: flat terrain.'
      || coalesce('|Risk trend over the last 6 days: ' || risk_trend || '.', '|Trend unavailable (warm-up period at start of record).') AS why FROM scored""",
    ("scored",),
)
def _(v: Views):
    rows = v.scored.withColumn("top_contributors", F.lit("flat terrain"))
    return rows.select("zone", "date", F.array_join(zr.why_statements(), "|").alias("why"))


# -------------------------------------------------------------- validation
_REQS = """q AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'not-a-date' ELSE strftime(o_orderdate + INTERVAL 1 YEAR, '%Y-%m-%d') END AS date_text,
    'Z' || lpad(CAST(o_custkey % 120 AS VARCHAR), 7, '0') AS zone, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN '25:00' WHEN o_orderkey % 3 = 0 THEN NULL ELSE '09:' || lpad(CAST(o_orderkey % 70 AS VARCHAR), 2, '0') END AS t FROM orders)"""


def requests(v: Views):
    k = F.col("o_orderkey")
    late = F.add_months(F.col("o_orderdate").cast("date"), 12)
    return v.table("orders").select(
        k.alias("id"),
        F.when(k % 13 == 0, "not-a-date").otherwise(F.date_format(late, "yyyy-MM-dd")).alias("date_text"),
        zone_id(F.col("o_custkey") % 120).alias("zone"),
        F.when(k % 5 == 0, "").when(k % 7 == 0, "25:00").when(k % 3 != 0, F.concat(F.lit("09:"), F.lpad((k % 70).cast("string"), 2, "0"))).alias("t"),
    )


@query(
    "P22_request_validation",
    f"""WITH {_REQS}, z AS (SELECT 'Z' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS z FROM supplier)
    SELECT id, CASE WHEN z IS NULL THEN 'unknown zone' WHEN date_text = 'not-a-date' THEN 'unparseable date'
      WHEN CAST(nullif(date_text, 'not-a-date') AS DATE) NOT BETWEEN DATE '1995-01-01' AND DATE '2001-12-31' THEN 'date outside covered range' ELSE 'OK' END AS status
    FROM q LEFT JOIN z ON q.zone = z.z""",
)
def _(v: Views):
    known = v.zones.select("zone", F.lit(True).alias("known"))
    rows = requests(v).join(known, "zone", "left")
    lo, hi = F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date")
    return rows.select("id", cal.request_status(F.col("date_text"), F.coalesce("known", F.lit(False)), lo, hi).alias("status"))


@query(
    "P23_time_of_day",
    f"WITH {_REQS} SELECT id, CASE WHEN regexp_full_match(coalesce(nullif(t, ''), '14:00'), '([01][0-9]|2[0-3]):[0-5][0-9]') THEN coalesce(nullif(t, ''), '14:00') END AS time_of_day FROM q",
)
def _(v: Views):
    return requests(v).select("id", cal.time_of_day(F.col("t")).alias("time_of_day"))


@query(
    "P24_horizon_class",
    """SELECT o_orderkey AS id, CASE WHEN o_orderdate::DATE < DATE '1995-06-01' OR o_orderdate::DATE > DATE '1999-12-31' + 365 THEN 'UNAVAILABLE' WHEN o_orderdate::DATE > DATE '1999-12-31' THEN 'FORECAST' ELSE 'ANALYSIS' END AS horizon FROM orders""",
)
def _(v: Views):
    d = F.col("o_orderdate").cast("date")
    lo, hi = F.lit("1995-06-01").cast("date"), F.lit("1999-12-31").cast("date")
    return v.table("orders").select(F.col("o_orderkey").alias("id"), cal.horizon_class(d, lo, hi).alias("horizon"))


@query(
    "P27_contract_check",
    """SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 50 = 0 THEN 'grid_id' END,
       CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'risk_level' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'risk_trend' END,
       CASE WHEN o_totalprice / 4000 > 100 THEN 'risk_score' END, CASE WHEN o_custkey % 17 - 1 < 0 THEN 'citizen_reports' END], lambda x: x IS NOT NULL), ',') AS failures FROM orders""",
)
def _(v: Views):
    k = F.col("o_orderkey")
    rows = v.table("orders").select(
        k.alias("id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_orderstatus") == "O", "LOW").when(F.col("o_orderstatus") == "F", "HIGH").otherwise("P").alias("risk_level"),
        F.when(F.col("o_orderpriority") == "5-LOW", "UP").when(F.col("o_orderpriority") == "2-HIGH", "STABLE").alias("risk_trend"),
        (F.col("o_totalprice") / 4000).alias("risk_score"),
        (F.col("o_custkey") % 17 - 1).alias("citizen_reports"),
    )
    return rows.select("id", F.array_join(rl.context_failures(F.col("id") % 50 != 0), ",").alias("failures"))


# ------------------------------------------------------------ zone response
_PRIO = """CASE least(3, (CASE risk_level WHEN 'LOW' THEN 0 WHEN 'MODERATE' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END)
    + (CASE WHEN risk_trend IN ('INCREASING', 'STRONGLY_INCREASING') THEN 1 ELSE 0 END) + (CASE WHEN reports >= 4 THEN 1 ELSE 0 END))
    WHEN 0 THEN 'ROUTINE' WHEN 1 THEN 'ELEVATED' WHEN 2 THEN 'HIGH' ELSE 'URGENT' END"""
_WATER = """py AS (SELECT zone, year(date) AS y, avg(rain_mm) AS m FROM zone_day GROUP BY 1, 2),
    pm AS (SELECT zone, y, lag(m) OVER (PARTITION BY zone ORDER BY y) AS m FROM py),
    wt AS (SELECT f.zone, f.date, CASE WHEN rainfall_30d IS NOT NULL AND m <> 0 THEN round_even(greatest(0e0, least(1e0, 1e0 - rainfall_30d / (30e0 * m))) * 1e2 * 1e2, 0) / 1e2 END AS water_score
           FROM rain_features f JOIN pm ON f.zone = pm.zone AND year(f.date) = pm.y),
    rc AS (SELECT zone, count(*) AS reports FROM reports GROUP BY 1),
    zr AS (SELECT r.zone, r.date, risk_score, risk_level, risk_trend, anomaly_score, temporal_intensity, vulnerability_score, vulnerability_level, heat_score, heat_level, water_score,
           CASE WHEN water_score IS NULL THEN NULL WHEN water_score < 30 THEN 'LOW' WHEN water_score < 60 THEN 'MODERATE' ELSE 'HIGH' END AS water_level,
           river_level_daily_mean_m, river_level_daily_max_m, coalesce(reports, 0) AS reports
           FROM rv r JOIN wt ON r.zone = wt.zone AND r.date = wt.date LEFT JOIN hl ON r.zone = hl.zone LEFT JOIN rc ON r.zone = rc.zone)"""
ZR_SQL = f"{_RIVER}, {_HEAT}, {_WATER}"
ZR_VIEWS = ("scored", "zones", "reports", "gauge")


def zone_table(v: Views):
    from pluvia.operators.series import with_previous_year
    from pluvia.plans.environment import water_table
    from pluvia.plans.risk_table import score_rows

    risk = score_rows(v.signals(water_table(with_previous_year(v.rain_features)), "water_score", "water_level"))
    level = river_levels(v)
    zones = v.zones.select("zone", F.concat(F.lit("Zone "), F.substring("zone", 2, 20)).alias("zone_name"))
    return zr.zone_rows(risk, zones, vu.heat_table(v.zones), level, v.reports)


@query(
    "J17_zone_response",
    f"""WITH {ZR_SQL} SELECT date, zone, 'Zone ' || substr(zone, 2) AS zone_name, risk_score, risk_level, risk_trend, anomaly_score, vulnerability_score, {_PRIO} AS priority,
      heat_score, water_score, reports AS citizen_reports, river_level_daily_mean_m IS NOT NULL AS river_available, river_level_daily_max_m AS river_max FROM zr""",
    ZR_VIEWS,
)
def _(v: Views):
    return zone_table(v).select(
        "date", "zone", "zone_name", F.col("risk.score").alias("risk_score"), F.col("risk.level").alias("risk_level"),
        F.col("risk.trend").alias("risk_trend"), F.col("risk.components.anomaly").alias("anomaly_score"),
        F.col("vulnerability.score").alias("vulnerability_score"), "prevention.priority",
        F.col("environment.heat.score").alias("heat_score"), F.col("environment.water.score").alias("water_score"),
        F.col("citizen_reports.count").alias("citizen_reports"), F.col("river.available").alias("river_available"),
        F.col("river.level_max_m").alias("river_max"),
    )


_ADV = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in fv.ADVISORIES.items())


@query(
    "P26_public_role_view",
    f"SELECT date, zone, 'Zone ' || substr(zone, 2) AS zone_name, risk_score AS score, risk_level AS level, risk_trend AS trend, CASE risk_level {_ADV} END AS public_alert, true AS reporting_enabled FROM scored",
    ("scored",),
)
def _(v: Views):
    out = zr.role_view(zone_table(v), "PUBLIC")
    return out.select("date", "zone", "zone_name", "risk.score", "risk.level", "risk.trend", "public_alert", "reporting_enabled")


@query(
    "P26_operational_role_view",
    f"""WITH {ZR_SQL} SELECT role, date, zone, risk_score AS score, anomaly_score AS anomaly, vulnerability_level, {_PRIO} AS priority, heat_level, water_level, river_level_daily_mean_m AS level_mean_m
    FROM zr, (VALUES ('MNC'), ('DISASTER')) r(role)""",
    ZR_VIEWS,
)
def _(v: Views):
    """Both operational roles see every section."""
    rows = zone_table(v)
    views = [zr.role_view(rows, role).withColumn("role", F.lit(role)) for role in fv.ROLES if role != "PUBLIC"]
    out = views[0].unionByName(views[1])
    return out.select(
        "role", "date", "zone", "risk.score", "risk.components.anomaly", F.col("vulnerability.level").alias("vulnerability_level"), "prevention.priority",
        F.col("environment.heat.level").alias("heat_level"), F.col("environment.water.level").alias("water_level"), "river.level_mean_m",
    )


@query(
    "P26_role_access",
    """SELECT role, known, sees_components, CASE WHEN known THEN n ELSE 0 END AS rows FROM (SELECT count(*) AS n FROM scored),
    (VALUES ('PUBLIC', true, false), ('MNC', true, true), ('DISASTER', true, true), ('GUEST', false, false)) r(role, known, sees_components)""",
    ("scored",),
)
def _(v: Views):
    """What each role may read; an unknown role is refused."""
    rows, out = zone_table(v), []
    for role in (*fv.ROLES, "GUEST"):
        try:
            seen = zr.role_view(rows, role)
            out.append((role, True, "components" in seen.schema["risk"].dataType.names))
        except ValueError:
            out.append((role, False, False))
    access = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(k).alias("known"), F.lit(c).alias("sees_components")) for r, k, c in out]))
    counted = v.scored.agg(F.count(F.lit(1)).alias("n")).select("n", access.alias("a"))
    return counted.select("a.*", F.when(F.col("a.known"), F.col("n")).otherwise(0).alias("rows"))


@query(
    "feature_table",
    f"""WITH {_RIVER}, e AS (SELECT DISTINCT zone, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date FROM event_range),
    y AS (SELECT zone, year(date) AS y, avg(rain_mm) AS m, max(rain_mm) AS x FROM zone_day GROUP BY 1, 2), py AS (SELECT zone, y, lag(m) OVER w AS pm, lag(x) OVER w AS px FROM y WINDOW w AS (PARTITION BY zone ORDER BY y)),
    mm AS (SELECT zone, month(date) AS mo, year(date) AS y, avg(rain_mm) AS m FROM zone_day GROUP BY 1, 2, 3), pc AS (SELECT zone, mo, y, lag(m) OVER (PARTITION BY zone, mo ORDER BY y) AS c FROM mm)
    SELECT f.zone, f.date, f.rainfall_1d, f.rainfall_7d, f.rainfall_30d, pm AS hist_mean_prior_years_mm, px AS hist_max_prior_years_mm, c AS month_clim_mean_prior_years_mm, f.rain_mm - pm AS rainfall_anomaly_mm,
      sum(rain_mm) OVER (PARTITION BY f.zone, year(f.date), month(f.date) ORDER BY f.date) AS monthly_rainfall_to_date,
      CASE WHEN month(f.date) >= 6 THEN sum(CASE WHEN month(f.date) >= 6 THEN rain_mm END) OVER (PARTITION BY f.zone, year(f.date) ORDER BY f.date) END AS monsoon_rainfall_to_date,
      CAST(month(f.date) IN (6, 7, 8, 9) AS INTEGER) AS is_monsoon, built_up_pct, river.river_level_daily_max_m, CASE WHEN e.zone IS NULL THEN 0 ELSE 1 END AS flood_event_active
    FROM rain_features f JOIN py ON f.zone = py.zone AND year(f.date) = py.y JOIN pc ON f.zone = pc.zone AND year(f.date) = pc.y AND month(f.date) = pc.mo
    LEFT JOIN zones z ON f.zone = z.zone LEFT JOIN rv river ON f.zone = river.zone AND f.date = river.date LEFT JOIN e ON f.zone = e.zone AND f.date = e.date""",
    ("scored", "zones", "event_range", "gauge"),
)
def _(v: Views):
    from pluvia.plans.feature_table import feature_table

    level = river_levels(v)
    out = feature_table(v.zone_day, v.zones, level, v.event_range)
    return out.select(
        "zone", "date", "rainfall_1d", "rainfall_7d", "rainfall_30d", "hist_mean_prior_years_mm", "hist_max_prior_years_mm", "month_clim_mean_prior_years_mm",
        "rainfall_anomaly_mm", "monthly_rainfall_to_date", "monsoon_rainfall_to_date", "is_monsoon", "built_up_pct", "river_level_daily_max_m", "flood_event_active",
    )
