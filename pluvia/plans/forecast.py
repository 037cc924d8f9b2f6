"""Forecast rows: stored ones first, damped climatology otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.functions.classify import band
from pluvia.functions.numeric import decimal_round
from pluvia.operators.stats import damped, trailing_mean


def damped_climatology(history: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(zone, days_ahead, ...) against history(zone, date, anomaly_score, temporal_intensity, vulnerability_score)."""
    base = trailing_mean(history, ["anomaly_score", "temporal_intensity"], latest=["vulnerability_score"])
    rows = requests.join(base, "zone")
    ahead = F.col("days_ahead")
    rows = rows.withColumns(
        {
            "anomaly": damped(F.col("anomaly_score"), ahead, 40.0),
            "temporal_rainfall": damped(F.col("temporal_intensity"), ahead, 35.0),
        }
    )
    w = fv.RISK_WEIGHTS
    total = w["anomaly"] * F.col("anomaly") + w["intensity"] * F.col("temporal_rainfall") + w["vulnerability"] * F.col("vulnerability_score")
    score = decimal_round(total, 2)
    return rows.withColumns({"risk_score": F.least(F.lit(50.0), score), "trend": F.lit("STABLE")}).drop(
        "anomaly_score", "temporal_intensity"
    )


def forecast_lookup(requests: DataFrame, stored: DataFrame, history: DataFrame) -> DataFrame:
    """Stored (date, zone) forecast if present, else the damped mean; the level always follows the score."""
    fallback = damped_climatology(history, requests)
    s = stored.select(
        "zone",
        "date",
        F.col("risk_score").alias("_s"),
        F.col("trend").alias("_t"),
        F.col("anomaly").alias("_a"),
        F.col("temporal_rainfall").alias("_r"),
    )
    joined = fallback.join(s, ["zone", "date"], "left")
    hit = F.col("_s").isNotNull()
    out = joined.withColumns(
        {
            "risk_score": F.when(hit, F.col("_s")).otherwise(F.col("risk_score")),
            "trend": F.when(hit, F.col("_t")).otherwise(F.col("trend")),
            "anomaly": F.when(hit, F.col("_a")).otherwise(F.col("anomaly")),
            "temporal_rainfall": F.when(hit, F.col("_r")).otherwise(F.col("temporal_rainfall")),
            "from_stored": hit,
        }
    ).drop("_s", "_t", "_a", "_r")
    return out.withColumn("risk_level", band(F.col("risk_score"), fv.RISK_BANDS))
