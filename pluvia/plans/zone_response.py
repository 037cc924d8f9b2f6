"""Assembled zone rows and their role views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.functions.numeric import fixed_text
from pluvia.operators.rules import apply_rules, checklist


def key_signals() -> Column:
    """Text signals of a risk row (anomaly, 7-day rain, vulnerability, river)."""
    whole = lambda c: fixed_text(c, 0)
    pct = F.col("anomaly_percentile")
    rare = F.concat(F.lit("top "), (F.lit(100) - pct).cast("int").cast("string"), F.lit("%"))
    common = F.concat(F.lit("percentile "), pct.cast("int").cast("string"))
    anomaly = F.concat(F.lit("ML anomaly "), whole(F.col("anomaly_score")), F.lit("/100 ("), F.when(pct >= 95, rare).otherwise(common), F.lit(")"))
    rain = F.concat(F.lit("7-day rainfall percentile "), whole(F.col("temporal_intensity")), F.lit("/100 (vs zone history, leak-safe)"))
    vuln = F.concat(F.lit("vulnerability "), fixed_text(F.col("vulnerability_score"), 1), F.lit(" ("), F.col("vulnerability_level"), F.lit(")"))
    level = F.concat(
        F.lit("river level "), fixed_text(F.col("river_level_daily_max_m"), 2), F.lit(" m ("),
        F.col("cwc_stations_in_cell").cast("int").cast("string"), F.lit(" station)"),
    )
    known = F.col("river_level_daily_mean_m").isNotNull() & F.col("river_level_daily_max_m").isNotNull()
    river = F.when(known, level).otherwise(F.lit("river level unavailable (no CWC data for this cell/date)"))
    return F.array(anomaly, rain, vuln, river)


def why_statements() -> Column:
    """P25: one sentence per component, the joined factors, and the trend or warm-up text."""
    one = lambda c: fixed_text(F.col(c), 1)
    word = lambda c, hi: F.when(F.col(c) >= 70, hi).when(F.col(c) >= 40, "moderate").otherwise("low")
    a = F.concat(F.lit("Anomaly signal "), one("anomaly_score"), F.lit("/100 is "), word("anomaly_score", "elevated"), F.lit(" relative to this zone's history."))
    t = F.concat(F.lit("7-day rainfall intensity signal "), one("temporal_intensity"), F.lit("/100 is "), word("temporal_intensity", "high"), F.lit("."))
    v = F.concat(
        F.lit("Underlying vulnerability is "), F.col("vulnerability_level"), F.lit(" ("), one("vulnerability_score"),
        F.lit("/100); factors: "), F.col("top_contributors"), F.lit("."),
    )
    trend = F.concat(F.lit("Risk trend over the last 6 days: "), F.col("risk_trend"), F.lit("."))
    return F.array(a, t, v, F.coalesce(trend, F.lit("Trend unavailable (warm-up period at start of record).")))


def zone_rows(
    risk: DataFrame, zones: DataFrame, heat: DataFrame, gauges: DataFrame, reports: DataFrame,
    water: DataFrame | None = None, model_scores: DataFrame | None = None,
) -> DataFrame:
    """One nested row per (date, zone), for all dates at once.

    risk is joined on (zone, date) with gauges, and with water unless it already carries
    water_score and water_level, and on zone with the zone tables; a NULL trend counts as
    STABLE for the rules only.
    """
    counts = reports.groupBy("zone").agg(F.count(F.lit(1)).alias("citizen_reports"))
    if water is not None:
        risk = risk.join(water.select("zone", "date", "water_score", "water_level"), ["zone", "date"], "left")
    rows = (
        risk.join(gauges, ["zone", "date"], "left")
        .join(zones, "zone", "left")
        .join(heat.select("zone", "heat_score", "heat_level"), "zone", "left")
        .join(counts, "zone", "left")
    )
    if model_scores is not None:
        rows = rows.join(model_scores.select("zone", F.col("vulnerability_score").alias("model_score")), "zone", "left")
    else:
        rows = rows.withColumn("model_score", F.lit(None).cast("double"))
    rows = rows.withColumn("citizen_reports", F.coalesce("citizen_reports", F.lit(0)))
    shown = rows.withColumns({"_trend": F.col("risk_trend"), "risk_trend": F.coalesce("risk_trend", F.lit("STABLE"))})
    ruled = apply_rules(shown).withColumn("risk_trend", F.col("_trend")).drop("_trend")
    river = F.col("river_level_daily_mean_m").isNotNull()
    return ruled.select(
        "date", "zone", "zone_name",
        F.struct(
            F.col("risk_score").alias("score"), F.col("risk_level").alias("level"), F.col("risk_trend").alias("trend"),
            F.struct(
                F.col("anomaly_score").alias("anomaly"), F.col("temporal_intensity").alias("temporal_rainfall"),
                F.col("vulnerability_score").alias("vulnerability"),
            ).alias("components"),
        ).alias("risk"),
        F.struct(
            F.col("vulnerability_score").alias("score"), F.col("vulnerability_level").alias("level"),
            F.col("model_score").alias("model_score"),
        ).alias("vulnerability"),
        F.struct(
            "priority", "recommended_actions", checklist(F.col("priority")).alias("checklist"), "explanations", "triggered_rules"
        ).alias("prevention"),
        F.struct(
            F.struct(F.col("heat_score").alias("score"), F.col("heat_level").alias("level")).alias("heat"),
            F.struct(F.col("water_score").alias("score"), F.col("water_level").alias("level")).alias("water"),
        ).alias("environment"),
        F.struct(F.col("citizen_reports").alias("count")).alias("citizen_reports"),
        F.struct(
            river.alias("available"),
            F.when(river, F.col("river_level_daily_mean_m")).alias("level_mean_m"),
            F.when(river, F.col("river_level_daily_max_m")).alias("level_max_m"),
            F.when(river, F.col("cwc_stations_in_cell")).alias("stations"),
        ).alias("river"),
    )


def role_view(rows: DataFrame, role: str) -> DataFrame:
    """PUBLIC loses components, vulnerability, rules, river and environment and gains the advisory."""
    if role not in fv.ROLES:
        raise ValueError(f"unknown role {role!r}; expected one of {sorted(fv.ROLES)}")
    if role != "PUBLIC":
        return rows
    pairs = []
    for level, text in fv.ADVISORIES.items():
        pairs += [F.lit(level), F.lit(text)]
    return rows.select(
        "date", "zone", "zone_name",
        F.struct("risk.score", "risk.level", "risk.trend").alias("risk"),
        F.create_map(*pairs)[F.col("risk.level")].alias("public_alert"),
        F.lit(True).alias("reporting_enabled"),
    )
