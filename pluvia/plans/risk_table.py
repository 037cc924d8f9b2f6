"""The (date, zone) risk table: intensity, weighted score, band, trend and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.functions.classify import band, risk_score, trend_class
from pluvia.functions.numeric import round_to
from pluvia.operators.rank import expanding_percentile
from pluvia.operators.series import trend_delta


def score_rows(parts: DataFrame) -> DataFrame:
    """Score, band, 3-day delta and trend of rows that carry the three signals."""
    score = risk_score(F.col("anomaly_score"), F.col("temporal_intensity"), F.col("vulnerability_score"))
    scored = parts.withColumn("risk_score", score)
    scored = scored.withColumn("risk_delta_3d", round_to(trend_delta(scored), 2))
    return scored.withColumns(
        {
            "risk_level": band(F.col("risk_score"), fv.RISK_BANDS),
            "risk_trend": trend_class(F.col("risk_delta_3d")),
            "vulnerability_level": band(F.col("vulnerability_score"), fv.VULNERABILITY_BANDS),
        }
    )


def risk_table(features: DataFrame) -> DataFrame:
    """Adds the zone's own expanding percentile of 7-day rain, then scores the rows."""
    return score_rows(expanding_percentile(features, "rainfall_7d"))
