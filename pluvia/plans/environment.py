"""Heat exposure and water deficit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.functions.classify import band, deficit_ratio
from pluvia.functions.numeric import fixed_text, round_to


def water_table(df: DataFrame) -> DataFrame:
    """Needs rainfall_30d and hist_mean_prior_years_mm; NULL inputs leave score and level NULL."""
    rain, mean = F.col("rainfall_30d"), F.col("hist_mean_prior_years_mm")
    ratio = F.col("water_deficit_ratio")
    pct = F.concat(F.lit("deficit vs own climatology ("), fixed_text(ratio * 100, 0), F.lit("% of expected shortfall)"))
    detail = F.when(ratio <= 0.001, F.lit("at or above climatology (surplus)")).otherwise(pct)
    head = F.concat(
        F.lit("rainfall_30d="), fixed_text(rain, 1), F.lit(" mm vs expected "), fixed_text(F.lit(30.0) * mean, 1), F.lit(" mm")
    )
    missing = F.lit("insufficient history: no prior-year baseline and/or incomplete 30-day window (left null)")
    return (
        df.withColumn("water_deficit_ratio", deficit_ratio(rain, mean))
        .withColumn("water_score", round_to(ratio * 100.0, 2))
        .withColumn("water_level", band(F.col("water_score"), fv.WATER_BANDS))
        .withColumn("water_explanations", F.when(F.col("water_score").isNull(), F.array(missing)).otherwise(F.array(head, detail)))
    )
