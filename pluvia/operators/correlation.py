"""Correlation of the series of asked pairs of zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_correlations(df: DataFrame, pairs: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """Pearson correlation of each pair (zone_a, zone_b) over the dates where both have a value.

    The series is joined to the pairs on zone and on (zone, date), so output and work grow with
    the pairs asked for. Pairs without common values or without variance get NULL.
    """
    a = df.select(F.col(zone).alias("zone_a"), F.col(date).alias("_d"), F.col(value).alias("_x"))
    b = df.select(F.col(zone).alias("zone_b"), F.col(date).alias("_d"), F.col(value).alias("_y"))
    both = pairs.select("zone_a", "zone_b").join(a, "zone_a", "left").join(b, ["zone_b", "_d"], "left")
    return both.groupBy("zone_a", "zone_b").agg(F.corr("_x", "_y").alias("corr"))
