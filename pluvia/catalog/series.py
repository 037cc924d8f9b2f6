"""Queries over the daily zone series: E, P, D, F and G operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.catalog.base import Views, query
from pluvia.functions import calendar as cal
from pluvia.functions import classify as cls
from pluvia.functions.numeric import round_to
from pluvia.operators import rank, series, stats
from pluvia.operators.correlation import pair_correlations

ZW = "(PARTITION BY zone ORDER BY date"


def r9(name):
    return round_to(F.col(name), 9).alias(name)


# ------------------------------------------------------------------ windows
_LAGS = ", ".join(f"lag(rain_mm, {n}) OVER {ZW}) AS lag_{n}d" for n in (1, 2, 3, 7, 14))


@query("E01_lags", f"SELECT zone, date, rain_mm, {_LAGS} FROM zone_day", ("zone_day",))
def _(v: Views):
    return series.lags(v.zone_day)


_ROLL = ", ".join(
    f"avg(rain_mm) OVER {ZW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS rolling_{n}d, "
    f"sum(rain_mm) OVER {ZW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS accumulated_{n}d"
    for n in (3, 7, 14, 30)
)


@query("E02_shifted_rolling", f"SELECT zone, date, rain_mm, {_ROLL} FROM zone_day", ("zone_day",))
def _(v: Views):
    return series.shifted_rolling(v.zone_day)


_FULL = ", ".join(
    f"CASE WHEN count(rain_mm) OVER {ZW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN "
    f"sum(rain_mm) OVER {ZW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS rainfall_{n}d"
    for n in (3, 7, 14, 30)
)


@query("E03_complete_rolling_sum", f"SELECT zone, date, rain_mm, {_FULL} FROM obs", ("obs",))
def _(v: Views):
    return series.complete_rolling_sum(v.obs)


@query(
    "E04_dry_spell",
    f"""WITH p AS (SELECT zone, date, rain_mm, coalesce(lag(CASE WHEN rain_mm = 0 THEN 1 ELSE 0 END) OVER {ZW}), 0) AS prev FROM obs),
    r AS (SELECT *, sum(1 - prev) OVER {ZW}) AS run FROM p)
    SELECT zone, date, rain_mm, CAST(sum(prev) OVER (PARTITION BY zone, run ORDER BY date) AS INTEGER) AS consecutive_dry_days FROM r""",
    ("obs",),
)
def _(v: Views):
    return series.dry_spell(v.obs)


@query(
    "E05_group_maxima",
    """SELECT zone, date, rain_mm, max(rain_mm) OVER (PARTITION BY zone, year(date)) AS year_max,
       max(rain_mm) OVER (PARTITION BY zone, year(date), month(date)) AS month_max FROM zone_day""",
    ("zone_day",),
)
def _(v: Views):
    return series.group_maxima(v.zone_day)


@query(
    "E06_month_to_date",
    """SELECT zone, date, rain_mm, CASE WHEN rain_mm IS NOT NULL THEN sum(rain_mm) OVER (PARTITION BY zone, year(date), month(date) ORDER BY date) END
       AS monthly_rainfall_to_date FROM obs""",
    ("obs",),
)
def _(v: Views):
    return series.month_to_date(v.obs)


@query(
    "E07_season_to_date",
    """SELECT zone, date, rain_mm, CASE WHEN month(date) >= 6 AND rain_mm IS NOT NULL THEN
       sum(CASE WHEN month(date) >= 6 THEN rain_mm END) OVER (PARTITION BY zone, year(date) ORDER BY date) END AS monsoon_rainfall_to_date FROM obs""",
    ("obs",),
)
def _(v: Views):
    return series.season_to_date(v.obs)


_PREV_YEAR = """y AS (SELECT zone, CAST(year(date) AS INTEGER) AS year, avg(rain_mm) AS m, max(rain_mm) AS x FROM zone_day GROUP BY 1, 2),
    p AS (SELECT zone, year, lag(m) OVER (PARTITION BY zone ORDER BY year) AS hist_mean_prior_years_mm,
          lag(x) OVER (PARTITION BY zone ORDER BY year) AS hist_max_prior_years_mm FROM y)"""


@query("E08_previous_period", f"WITH {_PREV_YEAR} SELECT * FROM p", ("zone_day",))
def _(v: Views):
    return series.previous_year_stats(v.zone_day)


@query(
    "J04_previous_year_join",
    f"WITH {_PREV_YEAR} SELECT z.*, p.year, hist_mean_prior_years_mm, hist_max_prior_years_mm FROM zone_day z JOIN p ON z.zone = p.zone AND year(z.date) = p.year",
    ("zone_day",),
)
def _(v: Views):
    return series.with_previous_year(v.zone_day)


@query(
    "J05_previous_month_climatology",
    f"""WITH {_PREV_YEAR},
    mm AS (SELECT zone, CAST(month(date) AS INTEGER) AS month, CAST(year(date) AS INTEGER) AS year, avg(rain_mm) AS m FROM zone_day GROUP BY 1, 2, 3),
    mp AS (SELECT zone, month, year, lag(m) OVER (PARTITION BY zone, month ORDER BY year) AS month_clim_mean_prior_years_mm FROM mm)
    SELECT z.zone, z.date, z.rain_mm, mp.month, mp.year, hist_mean_prior_years_mm, hist_max_prior_years_mm, month_clim_mean_prior_years_mm,
      rain_mm - hist_mean_prior_years_mm AS rainfall_anomaly_mm
    FROM zone_day z JOIN p ON z.zone = p.zone AND year(z.date) = p.year
    JOIN mp ON z.zone = mp.zone AND month(z.date) = mp.month AND year(z.date) = mp.year""",
    ("zone_day",),
)
def _(v: Views):
    return series.with_previous_month_climatology(series.with_previous_year(v.zone_day))


@query(
    "E09_expanding_percentile",
    """SELECT a.zone, a.date, any_value(a.rainfall_7d) AS rainfall_7d,
       round_even((count(*) FILTER (coalesce(b.rainfall_7d, 0) < coalesce(a.rainfall_7d, 0))
         + (count(*) FILTER (coalesce(b.rainfall_7d, 0) = coalesce(a.rainfall_7d, 0)) + 1) / 2e0) / count(*) * 1e2 * 1e2, 0) / 1e2 AS temporal_intensity
       FROM rain_features a JOIN rain_features b ON a.zone = b.zone AND b.date <= a.date GROUP BY 1, 2""",
    ("rain_features",),
)
def _(v: Views):
    rows = v.rain_features.select("zone", "date", "rainfall_7d")
    return rank.expanding_percentile(rows, "rainfall_7d")


@query("E10_trend_delta", "SELECT zone, date, risk_score, risk_delta_3d FROM scored", ("scored",))
def _(v: Views):
    return v.scored.select("zone", "date", "risk_score", "risk_delta_3d")


@query(
    "E11_percentile_rank",
    """SELECT zone, date, rainfall_7d, p AS percentile_0_100, CAST(trunc(p) AS INTEGER) AS percentile_int FROM (
       SELECT zone, date, rainfall_7d, round_even(1e2 * (row_number() OVER (ORDER BY rainfall_7d NULLS LAST, zone, date) - 1) / (count(*) OVER () - 1) * 1e2, 0) / 1e2 AS p
       FROM rain_features)""",
    ("rain_features",),
)
def _(v: Views):
    return rank.percentile_rank(v.rain_features.select("zone", "date", "rainfall_7d"), "rainfall_7d", ["zone", "date"])


@query(
    "E12_average_rank",
    """SELECT zone, date, anomaly_score,
       CAST(floor(rank() OVER (ORDER BY anomaly_score DESC) + (count(*) OVER (PARTITION BY anomaly_score) - 1) / 2e0) AS BIGINT) AS rank_global,
       CAST(floor(rank() OVER (PARTITION BY zone ORDER BY anomaly_score DESC) + (count(*) OVER (PARTITION BY zone, anomaly_score) - 1) / 2e0) AS BIGINT) AS rank_in_zone
       FROM scored""",
    ("scored",),
)
def _(v: Views):
    rows = v.scored_parts.select("zone", "date", "anomaly_score")
    return rank.average_rank_in_zone(rank.average_rank(rows, "anomaly_score"), "anomaly_score")


@query(
    "E13_baseline_rank",
    """SELECT zone, date, rainfall_7d,
       round_even(1e2 * (row_number() OVER (ORDER BY rainfall_7d ASC NULLS LAST, zone, date) - 1) / (count(*) OVER () - 1) * 1e2, 0) / 1e2 AS baseline_percentile,
       row_number() OVER (ORDER BY rainfall_7d DESC NULLS LAST, zone, date) AS baseline_rank FROM rain_features""",
    ("rain_features",),
)
def _(v: Views):
    rows = v.rain_features.select("zone", "date", "rainfall_7d")
    return rank.baseline_rank(rows, "rainfall_7d", ["zone", "date"])


@query(
    "E14_date_gaps",
    f"""SELECT zone, date, CAST(date_diff('day', lag(date) OVER {ZW}), date) AS INTEGER) AS gap_days FROM (SELECT * FROM zone_day WHERE rain_mm > 0)""",
    ("zone_day",),
)
def _(v: Views):
    return series.date_gaps(v.zone_day.filter("rain_mm > 0").select("zone", "date"))


@query(
    "E15_stable_cell_ids",
    """SELECT lat, lon, 'CELL_' || lpad(CAST(row_number() OVER (ORDER BY lat, lon) AS VARCHAR), 8, '0') AS cell_id
       FROM (SELECT DISTINCT lat, lon FROM zones)""",
    ("zones",),
)
def _(v: Views):
    # three digits hold 999 cells; eight keep the ids sortable on a large grid
    from pluvia.operators.spatial import stable_cell_ids

    return stable_cell_ids(v.zones, "CELL_", 8)


# -------------------------------------------------------------- projections
@query(
    "P02_calendar_features",
    """SELECT zone, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
       CAST(dayofyear(date) AS INTEGER) AS day_of_year, CAST(isodow(date) AS INTEGER) AS day_of_week, CAST(weekofyear(date) AS INTEGER) AS week_of_year,
       CAST((year(date) % 4 = 0 AND year(date) % 100 <> 0) OR year(date) % 400 = 0 AS INTEGER) AS is_leap_year,
       round_even(sin(2 * pi() * month(date) / 12e0) * 1e9, 0) / 1e9 + 0e0 AS month_sin, round_even(cos(2 * pi() * month(date) / 12e0) * 1e9, 0) / 1e9 + 0e0 AS month_cos
       FROM zone_day""",
    ("zone_day",),
)
def _(v: Views):
    out = cal.calendar_features(v.zone_day.select("zone", "date"))
    return out.withColumns({c: round_to(F.col(c), 9) for c in ("month_sin", "month_cos")})


@query(
    "P03_day_cycle",
    """SELECT zone, date, round_even(sin(2 * pi() * dayofyear(date) / 365e0) * 1e9, 0) / 1e9 + 0e0 AS day_sin,
       round_even(cos(2 * pi() * dayofyear(date) / 365e0) * 1e9, 0) / 1e9 + 0e0 AS day_cos FROM zone_day""",
    ("zone_day",),
)
def _(v: Views):
    return cal.day_cycle(v.zone_day.select("zone", "date")).select("zone", "date", r9("day_sin"), r9("day_cos"))


@query(
    "P04_wet_dry_flags",
    "SELECT zone, date, CASE WHEN rain_mm > 0 THEN 1 ELSE 0 END AS rainy_day, CASE WHEN rain_mm = 0 THEN 1 ELSE 0 END AS dry_day FROM obs",
    ("obs",),
)
def _(v: Views):
    return v.obs.withColumns(cls.wet_dry_flags(F.col("rain_mm"))).drop("rain_mm")


_CATEGORY = """CASE WHEN rain_mm > 115.5 THEN 'Extreme' WHEN rain_mm > 64.4 THEN 'Heavy' WHEN rain_mm > 15.5 THEN 'Moderate'
    WHEN rain_mm > 0 THEN 'Light' ELSE 'Dry' END"""


@query("P05_intensity_category", f"SELECT zone, date, rain_mm, {_CATEGORY} AS category FROM obs", ("obs",))
def _(v: Views):
    return v.obs.withColumn("category", cls.intensity_category(F.col("rain_mm")))


@query(
    "P06_hazard_flags",
    "SELECT zone, date, coalesce(CAST(rain_mm > 64.4 AS INTEGER), 0) AS is_heavy, coalesce(CAST(rain_mm > 115.5 AS INTEGER), 0) AS is_extreme FROM obs",
    ("obs",),
)
def _(v: Views):
    return v.obs.withColumns(cls.hazard_flags(F.col("rain_mm"))).drop("rain_mm")


@query("P09_band_lookup", "SELECT zone, date, risk_score, risk_level FROM scored", ("scored",))
def _(v: Views):
    return v.scored.select("zone", "date", "risk_score", "risk_level")


@query("P10_trend_class", "SELECT zone, date, risk_delta_3d, risk_trend FROM scored", ("scored",))
def _(v: Views):
    return v.scored.select("zone", "date", "risk_delta_3d", "risk_trend")


@query("P11_weighted_risk", "SELECT zone, date, risk_score FROM scored", ("scored",))
def _(v: Views):
    s = cls.risk_score(F.col("anomaly_score"), F.col("temporal_intensity"), F.col("vulnerability_score"))
    return v.scored_parts.select("zone", "date", s.alias("risk_score"))


_P12_SQL = f"""a AS (SELECT zone, date, rain_mm, sum(rain_mm) OVER {ZW} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS acc FROM zone_day),
    k AS (SELECT a.*, CASE WHEN built_up_pct > 66 THEN 2e0 WHEN built_up_pct > 33 THEN 1e0 ELSE 0e0 END AS b,
          CASE WHEN distance_to_nearest_drainage_m > 600 THEN 2e0 WHEN distance_to_nearest_drainage_m > 300 THEN 1e0 ELSE 0e0 END AS dr
          FROM a LEFT JOIN zones ON a.zone = zones.zone),
    s AS (SELECT zone, date, CASE WHEN rain_mm > 115.5 THEN 4e0 WHEN rain_mm > 64.4 THEN 3e0 WHEN rain_mm > 15.5 THEN 1.5e0 ELSE 0e0 END
        + CASE WHEN acc > 150 THEN 3e0 WHEN acc > 100 THEN 2e0 WHEN acc > 50 THEN 1e0 ELSE 0e0 END + b + dr AS points FROM k),
    l AS (SELECT *, CASE WHEN points >= 8 THEN '🔴 HIGH' WHEN points >= 4.5 THEN '🟡 MODERATE' ELSE '🟢 LOW' END AS label FROM s)"""


def _point_risk(v: Views):
    z = v.zones.select(
        "zone",
        F.when(F.col("built_up_pct") > 66, "High").when(F.col("built_up_pct") > 33, "Moderate").otherwise("Low").alias("built_up"),
        F.when(F.col("distance_to_nearest_drainage_m") > 600, "Poor")
        .when(F.col("distance_to_nearest_drainage_m") > 300, "Moderate")
        .otherwise("Good")
        .alias("drainage"),
    )
    rows = series.shifted_rolling(v.zone_day, days=(7,)).join(z, "zone", "left")
    pts = cls.point_risk(F.col("rain_mm"), F.col("accumulated_7d"), F.col("built_up"), F.col("drainage"))
    return rows.select("zone", "date", pts.alias("points")).withColumn("label", cls.point_risk_label(F.col("points")))


@query("P12_additive_point_risk", f"WITH {_P12_SQL} SELECT * FROM l", ("zone_day", "zones"))
def _(v: Views):
    return _point_risk(v)


@query(
    "F04_top3_with_fallback",
    f"""WITH {_P12_SQL} SELECT zone, date, points, label FROM l
        WHERE label = '🔴 HIGH' OR NOT EXISTS (SELECT 1 FROM l WHERE label = '🔴 HIGH') ORDER BY points DESC, zone, date LIMIT 3""",
    ("zone_day", "zones"),
)
def _(v: Views):
    # every HIGH row scores above every other row, so the three best rows overall already
    # are the three best HIGH rows unless fewer than three are HIGH: those are cut after
    from pluvia.operators.topk import top_with_fallback

    return top_with_fallback(_point_risk(v), F.col("label") == "🔴 HIGH", "points", ["zone", "date"], 3)


@query(
    "P16_water_deficit",
    f"""WITH {_PREV_YEAR},
    j AS (SELECT f.zone, f.date, rainfall_30d, hist_mean_prior_years_mm AS m FROM rain_features f JOIN p ON f.zone = p.zone AND year(f.date) = p.year),
    q AS (SELECT *, CASE WHEN rainfall_30d IS NOT NULL AND m IS NOT NULL AND m <> 0 THEN greatest(0e0, least(1e0, 1e0 - rainfall_30d / (30e0 * m))) END AS water_deficit_ratio FROM j)
    SELECT zone, date, water_deficit_ratio, round_even(water_deficit_ratio * 1e2 * 1e2, 0) / 1e2 AS water_score,
      CASE WHEN water_deficit_ratio IS NULL THEN NULL WHEN round_even(water_deficit_ratio * 1e2 * 1e2, 0) / 1e2 < 30 THEN 'LOW'
           WHEN round_even(water_deficit_ratio * 1e2 * 1e2, 0) / 1e2 < 60 THEN 'MODERATE' ELSE 'HIGH' END AS water_level FROM q""",
    ("rain_features",),
)
def _(v: Views):
    from pluvia.plans.environment import water_table

    f = series.with_previous_year(v.rain_features)
    return water_table(f).select("zone", "date", "water_deficit_ratio", "water_score", "water_level")


@query(
    "P18_anomaly_status",
    f"""SELECT zone, date, anomaly_score, CASE WHEN anomaly_score >= 75 THEN 'HIGH ANOMALY' ELSE 'NORMAL/MODERATE ANOMALY' END AS status,
      'Anomaly|' || strftime(date, '%Y-%m-%d') || '|' || zone || '|' || CASE WHEN anomaly_score >= 75 THEN 'HIGH ANOMALY' ELSE 'NORMAL/MODERATE ANOMALY' END || '|{fv.ANOMALY_MESSAGE}|{fv.ANOMALY_DISCLAIMER}' AS message FROM scored""",
    ("scored",),
)
def _(v: Views):
    rows = v.scored_parts.withColumn("anomaly_percentile", F.floor("anomaly_score").cast("int"))
    m = cls.anomaly_message("Anomaly")
    text = F.concat_ws("|", *[m[k] for k in ("title", "date", "grid", "status", "message", "disclaimer")])
    return rows.select("zone", "date", "anomaly_score", cls.anomaly_status(F.col("anomaly_score")).alias("status"), text.alias("message"))


# -------------------------------------------------------------- aggregates
@query(
    "D01_yearly_statistics",
    """SELECT zone, CAST(year(date) AS INTEGER) AS year, sum(rain_mm) AS annual_rainfall, round_even(avg(rain_mm) * 1e4, 0) / 1e4 AS mean_daily_rainfall,
       max(rain_mm) AS max_daily_rainfall, count(*) FILTER (rain_mm > 0) AS rainy_days, count(*) FILTER (rain_mm = 0) AS dry_days FROM obs GROUP BY 1, 2""",
    ("obs",),
)
def _(v: Views):
    return stats.yearly_stats(v.obs)


@query(
    "D02_monthly_statistics",
    """SELECT zone, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, sum(rain_mm) AS monthly_rainfall,
       round_even(avg(rain_mm) * 1e4, 0) / 1e4 AS mean_daily_rainfall, max(rain_mm) AS max_daily_rainfall, count(*) FILTER (rain_mm > 0) AS rainy_days
       FROM obs GROUP BY 1, 2, 3""",
    ("obs",),
)
def _(v: Views):
    return stats.monthly_stats(v.obs)


@query(
    "D03_zone_statistics",
    f"""WITH p AS (SELECT zone, date, rain_mm, coalesce(lag(CASE WHEN rain_mm = 0 THEN 1 ELSE 0 END) OVER {ZW}), 0) AS prev FROM zone_day),
    r AS (SELECT *, sum(1 - prev) OVER {ZW}) AS run FROM p),
    s AS (SELECT *, CAST(sum(prev) OVER (PARTITION BY zone, run ORDER BY date) AS INTEGER) AS spell FROM r)
    SELECT zone, round_even(avg(rain_mm) * 1e4, 0) / 1e4 AS mean_rainfall_mm, sum(rain_mm) AS total_rainfall_mm, max(rain_mm) AS maximum_daily_rainfall_mm,
      count(*) FILTER (rain_mm > 0) AS rainy_days, count(*) FILTER (rain_mm = 0) AS dry_days, count(*) FILTER (rain_mm > 64.4) AS heavy_rainfall_days,
      count(*) FILTER (rain_mm > 115.5) AS extreme_rainfall_days, max(spell) AS longest_dry_spell FROM s GROUP BY zone""",
    ("zone_day",),
)
def _(v: Views):
    return stats.zone_stats(series.dry_spell(v.zone_day))


_D04_SQL = """SELECT zone, count(*) AS record_count, min(date) AS start_date, max(date) AS end_date, count(*) - count(rain_mm) AS missing_values,
    count(*) - count(DISTINCT date) AS duplicate_records, count(*) FILTER (rain_mm < 0) AS negative_count, count(*) FILTER (rain_mm = 0) AS zero_days,
    count(*) FILTER (rain_mm > 0) AS rainy_days, round_even(avg(rain_mm) * 1e4, 0) / 1e4 AS mean_rainfall, quantile_cont(rain_mm, 0.5) AS median_rainfall,
    round_even(stddev_samp(rain_mm) * 1e4, 0) / 1e4 AS std_rainfall, min(rain_mm) AS min_rainfall, max(rain_mm) AS max_rainfall FROM obs GROUP BY zone"""


@query("D04_quality_profile", _D04_SQL, ("obs",))
def _(v: Views):
    return stats.quality_profile(v.obs)


@query("D05_monthly_climatology", "SELECT zone, CAST(month(date) AS INTEGER) AS month, avg(rain_mm) AS mean_rain_mm FROM zone_day GROUP BY 1, 2", ("zone_day",))
def _(v: Views):
    return stats.monthly_climatology(v.zone_day)


_M12 = ", ".join(f"avg(rain_mm) FILTER (month(date) = {m}) AS m{m:02d}" for m in range(1, 13))


@query("D05_monthly_climatology_wide", f"SELECT zone, {_M12} FROM zone_day GROUP BY zone", ("zone_day",))
def _(v: Views):
    return stats.wide_by_month(v.zone_day)


@query(
    "D06_annual_ranking",
    "SELECT zone, avg(t) AS mean_annual_rain_mm FROM (SELECT zone, year(date) AS y, sum(rain_mm) AS t FROM zone_day GROUP BY 1, 2) GROUP BY zone",
    ("zone_day",),
)
def _(v: Views):
    return stats.annual_ranking(v.zone_day)


@query(
    "D07_spatial_mean_monthly",
    """SELECT year, month, round_even(sum(m) * 1e6, 0) / 1e6 AS monthly_rainfall FROM (
       SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, date, avg(rain_mm) AS m FROM zone_day GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    ("zone_day",),
)
def _(v: Views):
    return stats.spatial_mean_monthly(v.zone_day).withColumn("monthly_rainfall", round_to(F.col("monthly_rainfall"), 6))


_S12 = ", ".join(f"sum(rain_mm) FILTER (month(date) = {m}) AS m{m:02d}" for m in range(1, 13))


@query("D08_year_month_matrix", f"SELECT CAST(year(date) AS INTEGER) AS year, {_S12} FROM zone_day GROUP BY 1", ("zone_day",))
def _(v: Views):
    return stats.year_month_matrix(v.zone_day)


@query(
    "D09_correlation",
    """WITH nb AS (SELECT a.zone AS zone_a, b.zone AS zone_b FROM zones a JOIN zones b ON (b.lat = a.lat + 0.25e0 AND b.lon = a.lon) OR (b.lat = a.lat AND b.lon = a.lon + 0.25e0))
       SELECT zone_a, zone_b, round_even(corr(x.rain_mm, y.rain_mm) * 1e9, 0) / 1e9 + 0e0 AS corr
       FROM nb LEFT JOIN zone_day x ON x.zone = zone_a LEFT JOIN zone_day y ON y.zone = zone_b AND y.date = x.date GROUP BY 1, 2""",
    ("zones", "zone_day"),
)
def _(v: Views):
    cell = [F.round((F.col("lat") - 8.0) * 4).cast("int").alias("y"), F.round((F.col("lon") - 68.0) * 4).cast("int").alias("x")]
    cells = v.zones.select("zone", *cell)
    step = F.explode(F.array(F.struct(F.lit(1).alias("y"), F.lit(0).alias("x")), F.struct(F.lit(0).alias("y"), F.lit(1).alias("x")))).alias("s")
    beside = cells.select(F.col("zone").alias("zone_a"), "y", "x", step).select("zone_a", (F.col("y") + F.col("s.y")).alias("y"), (F.col("x") + F.col("s.x")).alias("x"))
    pairs = beside.join(cells.withColumnRenamed("zone", "zone_b"), ["y", "x"])
    return pair_correlations(v.zone_day, pairs).withColumn("corr", round_to(F.col("corr"), 9))


@query(
    "D10_gini",
    """WITH r AS (SELECT zone, rain_mm AS v, row_number() OVER (PARTITION BY zone ORDER BY rain_mm) AS i FROM zone_day WHERE rain_mm > 0)
       SELECT zone, round_even((2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*)) * 1e9, 0) / 1e9 + 0e0 AS gini FROM r GROUP BY zone""",
    ("zone_day",),
)
def _(v: Views):
    return rank.gini(v.zone_day).withColumn("gini", round_to(F.col("gini"), 9))


@query(
    "D11_log_histogram",
    """WITH p AS (SELECT rain_mm AS v FROM zone_day WHERE rain_mm > 0), m AS (SELECT max(v) AS hi FROM p),
    e AS (SELECT CAST(i AS INTEGER) AS bin, 0.1e0 * pow(10e0, i * (log10(hi / 0.1e0) / 49)) AS lo,
          CASE WHEN i = 48 THEN hi ELSE 0.1e0 * pow(10e0, (i + 1) * (log10(hi / 0.1e0) / 49)) END AS up, i = 48 AS last FROM range(49) r(i), m),
    c AS (SELECT bin, lo, up, count(*) AS n FROM p JOIN e ON v >= lo AND (v < up OR (last AND v = up)) GROUP BY 1, 2, 3)
    SELECT bin, n, round_even(n / ((SELECT sum(n) FROM c) * (up - lo)) * 1e9, 0) / 1e9 AS density FROM c""",
    ("zone_day",),
)
def _(v: Views):
    return stats.log_histogram(v.zone_day).withColumn("density", round_to(F.col("density"), 9))


@query(
    "D18_column_profile",
    """SELECT 'zone' AS "column", 'string' AS type, count(DISTINCT zone) AS unique_count, count(*) - count(zone) AS null_count, round_even((count(*) - count(zone)) * 1e2 / count(*) * 1e2, 0) / 1e2 AS null_pct FROM obs
       UNION ALL SELECT 'date', 'date', count(DISTINCT date), count(*) - count(date), round_even((count(*) - count(date)) * 1e2 / count(*) * 1e2, 0) / 1e2 FROM obs
       UNION ALL SELECT 'rain_mm', 'double', count(DISTINCT rain_mm), count(*) - count(rain_mm), round_even((count(*) - count(rain_mm)) * 1e2 / count(*) * 1e2, 0) / 1e2 FROM obs""",
    ("obs",),
)
def _(v: Views):
    return stats.column_profile(v.obs)


_DESC = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round_even(avg({c}) * 1e6, 0) / 1e6 AS mean, round_even(stddev_samp({c}) * 1e6, 0) / 1e6 AS std, min({c}) AS min, max({c}) AS max,
        quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75 FROM rain_features"""
    for c in ("rain_mm", "rainfall_7d", "rainfall_30d")
)


@query("D19_numeric_describe", _DESC, ("rain_features",))
def _(v: Views):
    out = stats.numeric_describe(v.rain_features, ["rain_mm", "rainfall_7d", "rainfall_30d"])
    return out.withColumns({c: round_to(F.col(c), 6) for c in ("mean", "std")})


@query(
    "D20_category_distribution",
    f"SELECT category, count(*) AS n, count(*) * 1e2 / sum(count(*)) OVER () AS pct FROM (SELECT {_CATEGORY} AS category FROM obs) GROUP BY 1",
    ("obs",),
)
def _(v: Views):
    return stats.category_distribution(series.category_features(v.obs), "category")


@query(
    "D21_missing_and_range_profile",
    """WITH m AS (SELECT 'rainfall_7d' AS "column", count(*) - count(rainfall_7d) AS missing, (count(*) - count(rainfall_7d)) * 1e2 / count(*) AS missing_pct, min(rainfall_7d) AS min, max(rainfall_7d) AS max, round_even(avg(rainfall_7d) * 1e6, 0) / 1e6 AS mean FROM rain_features
       UNION ALL SELECT 'rainfall_30d', count(*) - count(rainfall_30d), (count(*) - count(rainfall_30d)) * 1e2 / count(*), min(rainfall_30d), max(rainfall_30d), round_even(avg(rainfall_30d) * 1e6, 0) / 1e6 FROM rain_features)
       SELECT * FROM m WHERE missing > 0""",
    ("rain_features",),
)
def _(v: Views):
    f = v.rain_features.select("zone", "date", "rain_mm", "rainfall_7d", "rainfall_30d")
    counts = stats.column_counts(f)
    ranges = stats.range_profile(f, ["rain_mm", "rainfall_7d", "rainfall_30d"], counts).drop("infinite")
    return stats.missing_profile(f, counts).join(ranges, "column").withColumn("mean", round_to(F.col("mean"), 6))


@query(
    "D22_training_medians",
    """WITH m AS (SELECT quantile_cont(rainfall_7d, 0.5) FILTER (year(date) < 2000) AS a, quantile_cont(rainfall_30d, 0.5) FILTER (year(date) < 2000) AS b FROM rain_features)
       SELECT zone, date, coalesce(rainfall_7d, a) AS rainfall_7d, coalesce(rainfall_30d, b) AS rainfall_30d FROM rain_features, m""",
    ("rain_features",),
)
def _(v: Views):
    from pluvia.operators.features import impute_training_medians

    rows = v.rain_features.select("zone", "date", "rainfall_7d", "rainfall_30d")
    return impute_training_medians(rows, ["rainfall_7d", "rainfall_30d"], F.year("date") < 2000)


@query(
    "D23_spearman",
    """WITH f AS (SELECT anomaly_score AS a, rainfall_7d AS b FROM scored WHERE rainfall_7d IS NOT NULL),
    r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM f)
    SELECT count(*) AS n, round_even(corr(ra, rb) * 1e6, 0) / 1e6 + 0e0 AS spearman FROM r""",
    ("scored",),
)
def _(v: Views):
    return rank.spearman(v.scored_parts, "anomaly_score", "rainfall_7d").withColumn("spearman", round_to(F.col("spearman"), 6))


_PCT = "CAST(trunc(round_even(1e2 * (row_number() OVER (ORDER BY anomaly_score, zone, date) - 1) / (count(*) OVER () - 1) * 1e2, 0) / 1e2) AS INTEGER)"


@query(
    "D24_zone_score_summary",
    f"""WITH s AS (SELECT zone, date, anomaly_score, {_PCT} AS pct FROM scored),
    t AS (SELECT zone, string_agg(strftime(date, '%Y-%m-%d') || ' (' || CAST(CAST(round_even(anomaly_score, 0) AS INTEGER) AS VARCHAR) || ')', '; ' ORDER BY anomaly_score DESC, date) AS top_dates
          FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY anomaly_score DESC, date) AS rn FROM s) WHERE rn <= 3 GROUP BY zone)
    SELECT s.zone, count(*) AS n_rows, round_even(avg(anomaly_score) * 1e2, 0) / 1e2 AS score_mean, round_even(round_even(quantile_cont(anomaly_score, 0.95) * 1e6, 0) / 1e6 * 1e2, 0) / 1e2 AS score_p95,
      round_even(max(anomaly_score) * 1e2, 0) / 1e2 AS score_max, count(*) FILTER (pct >= 99) AS days_in_global_top1pct, any_value(top_dates) AS top_dates
    FROM s JOIN t ON s.zone = t.zone GROUP BY s.zone""",
    ("scored",),
)
def _(v: Views):
    s = rank.percentile_rank(v.scored_parts.select("zone", "date", "anomaly_score"), "anomaly_score", ["zone", "date"])
    return stats.score_summary(s, "anomaly_score", "percentile_int")


@query(
    "F06_top_dates_text",
    """SELECT zone, string_agg(strftime(date, '%Y-%m-%d') || ' (' || CAST(CAST(rain_mm AS INTEGER) AS VARCHAR) || ')', '; ' ORDER BY rain_mm DESC, date) AS top_dates
       FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY rain_mm DESC, date) AS rn FROM zone_day) WHERE rn <= 3 GROUP BY zone""",
    ("zone_day",),
)
def _(v: Views):
    from pluvia.operators.topk import top_dates_text

    return top_dates_text(v.zone_day, "rain_mm")


@query(
    "D25_trailing_mean_damped",
    """WITH l AS (SELECT zone, max(date) AS last FROM scored GROUP BY zone),
    m AS (SELECT s.zone, avg(anomaly_score) AS a, avg(temporal_intensity) AS t, any_value(vulnerability_score) AS v FROM scored s JOIN l ON s.zone = l.zone AND s.date >= l.last - 90 GROUP BY s.zone),
    d AS (SELECT zone, v, CAST(h AS INTEGER) AS days_ahead, greatest(0.30e0, 1e0 - 0.04e0 * h) AS damp,
        CASE WHEN a = 0 THEN 40e0 ELSE a END AS a, CASE WHEN t = 0 THEN 35e0 ELSE t END AS t FROM m, (VALUES (1), (10), (60)) x(h)),
    p AS (SELECT zone, days_ahead, v, CAST(printf('%.2f', a * damp) AS DOUBLE) AS anomaly, CAST(printf('%.2f', t * damp) AS DOUBLE) AS temporal_rainfall FROM d)
    SELECT zone, days_ahead, anomaly, temporal_rainfall, least(50e0, CAST(printf('%.2f', 0.45e0 * anomaly + 0.3e0 * temporal_rainfall + 0.25e0 * v) AS DOUBLE)) AS risk_score FROM p""",
    ("scored",),
)
def _(v: Views):
    from pluvia.plans.forecast import damped_climatology

    ahead = F.explode(F.array(F.lit(1), F.lit(10), F.lit(60))).alias("days_ahead")
    requests = v.scored_parts.select("zone").distinct().select("zone", ahead)
    out = damped_climatology(v.scored_parts, requests)
    return out.select("zone", "days_ahead", "anomaly", "temporal_rainfall", "risk_score")


@query(
    "D26_event_flag_hits",
    f"""WITH s AS (SELECT zone, date, anomaly_score, {_PCT} AS pct FROM scored),
    e AS (SELECT DISTINCT zone, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date FROM event_range)
    SELECT count(*) AS event_rows, count(*) FILTER (pct >= 99) AS top1pct, count(*) FILTER (pct >= 95) AS top5pct, count(*) FILTER (pct >= 90) AS top10pct
    FROM s JOIN e ON s.zone = e.zone AND s.date = e.date""",
    ("scored", "event_range"),
)
def _(v: Views):
    from pluvia.operators.joins import label_event_days

    s = rank.percentile_rank(v.scored_parts.select("zone", "date", "anomaly_score"), "anomaly_score", ["zone", "date"])
    return stats.event_flag_hits(label_event_days(s, v.event_range), "percentile_int", "flood_event_active")


@query(
    "D31_dashboard_kpis",
    """SELECT date, count(*) AS zones, count(*) FILTER (risk_level = 'HIGH') AS high, count(*) FILTER (risk_level = 'CRITICAL') AS critical,
       round_even(avg(risk_score) * 1e6, 0) / 1e6 AS mean_score, count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS active_alerts,
       arg_max(zone, (risk_score, zone)) AS top_zone FROM scored GROUP BY date""",
    ("scored",),
)
def _(v: Views):
    return stats.dashboard_kpis(v.scored).withColumn("mean_score", round_to(F.col("mean_score"), 6))


@query(
    "D33_rain_summary",
    "SELECT zone, avg(rain_mm) AS mean_rain_mm, max(rain_mm) AS max_rain_mm, arg_max(rain_mm, date) AS latest_rain_mm, max(rainfall_7d) AS max_rain_7d_mm FROM rain_features GROUP BY zone",
    ("rain_features",),
)
def _(v: Views):
    return stats.rain_summary(v.rain_features)


@query(
    "D34_group_attributes",
    """SELECT z.zone, any_value(built_up_pct) AS built_up_pct, any_value(vegetation_pct) AS vegetation_pct, avg(rain_mm) AS rainfall_climatology_mm_day
       FROM zone_day d JOIN zones z ON d.zone = z.zone GROUP BY z.zone""",
    ("zone_day", "zones"),
)
def _(v: Views):
    rows = v.zone_day.join(v.zones.select("zone", "built_up_pct", "vegetation_pct"), "zone")
    return stats.group_attributes(rows, ["built_up_pct", "vegetation_pct"])


# ------------------------------------------------------------------- top-k
@query(
    "F01_top_days_per_zone",
    "SELECT zone, date, rain_mm, rn AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY zone ORDER BY rain_mm DESC, date) AS INTEGER) AS rn FROM zone_day) WHERE rn <= 10",
    ("zone_day",),
)
def _(v: Views):
    from pluvia.operators.topk import top_per_group

    return top_per_group(v.zone_day, "zone", "rain_mm", ["date"], 10)


@query(
    "F02_top_days_with_context",
    """WITH c AS (SELECT *, max(rain_mm) OVER (PARTITION BY zone) AS zone_max, max(rain_mm) OVER (PARTITION BY zone, year(date)) AS year_max,
        max(rain_mm) OVER (PARTITION BY zone, year(date), month(date)) AS month_max,
        count(*) FILTER (rain_mm > 64.4) OVER (PARTITION BY zone, year(date)) AS heavy_days, count(*) FILTER (rain_mm > 115.5) OVER (PARTITION BY zone, year(date)) AS extreme_days,
        row_number() OVER (PARTITION BY zone ORDER BY rain_mm DESC, date) AS rn FROM zone_day)
       SELECT zone, date, rain_mm, zone_max, year_max, month_max, heavy_days, extreme_days FROM c WHERE rn <= 10""",
    ("zone_day",),
)
def _(v: Views):
    from pluvia.operators.topk import top_days_with_context

    return top_days_with_context(v.zone_day)


@query("F03_global_top_days", "SELECT zone, date, rain_mm FROM zone_day ORDER BY rain_mm DESC, zone, date LIMIT 15", ("zone_day",))
def _(v: Views):
    return v.zone_day.orderBy(F.desc("rain_mm"), "zone", "date").limit(15)


@query(
    "F05_latest_snapshot",
    "SELECT zone, date, risk_score, risk_level, risk_trend, risk_delta_3d FROM scored WHERE date = (SELECT max(date) FROM scored)",
    ("scored",),
)
def _(v: Views):
    from pluvia.operators.topk import latest_rows

    return latest_rows(v.scored.select("zone", "date", "risk_score", "risk_level", "risk_trend", "risk_delta_3d"))


@query(
    "risk_table",
    """WITH ti AS (SELECT a.zone, a.date, round_even((count(*) FILTER (coalesce(b.rainfall_7d, 0) < coalesce(a.rainfall_7d, 0))
         + (count(*) FILTER (coalesce(b.rainfall_7d, 0) = coalesce(a.rainfall_7d, 0)) + 1) / 2e0) / count(*) * 1e2 * 1e2, 0) / 1e2 AS ti
         FROM rain_features a JOIN rain_features b ON a.zone = b.zone AND b.date <= a.date GROUP BY 1, 2),
       s AS (SELECT c.zone, c.date, round_even((anomaly_score * 0.45e0 + ti * 0.3e0 + vulnerability_score * 0.25e0) * 1e2, 0) / 1e2 AS risk_score
         FROM sc_parts c JOIN ti ON c.zone = ti.zone AND c.date = ti.date)
       SELECT zone, date, risk_score, CASE WHEN risk_score < 40 THEN 'LOW' WHEN risk_score < 60 THEN 'MODERATE' WHEN risk_score < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level
       FROM s""",
    ("scored",),
)
def _(v: Views):
    from pluvia.plans.risk_table import risk_table

    return risk_table(v.scored_parts.drop("temporal_intensity")).select("zone", "date", "risk_score", "risk_level")
