"""The wide (date, zone) feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.operators import joins, series


def feature_table(daily: DataFrame, static: DataFrame, gauges: DataFrame, events: DataFrame) -> DataFrame:
    """Rain windows and baselines, calendar, zone attributes, gauge levels and event labels.

    daily(zone, date, rain_mm) with one row per day; everything up to the zone attributes
    runs on a single exchange by zone. static is joined on zone, gauges(zone, date, ..) and
    the expanded events(zone, start_date, end_date) on (zone, date).
    """
    f = series.complete_rolling_sum(daily)
    f = series.with_previous_month_climatology(series.with_previous_year(f))
    f = series.season_to_date(series.month_to_date(f))
    f = f.withColumns(
        {
            "rainfall_1d": F.col("rain_mm"),
            "is_monsoon": F.col("month").isin(6, 7, 8, 9).cast("int"),
            "day": F.dayofmonth("date"),
            "day_of_year": F.dayofyear("date"),
        }
    )
    f = joins.static_join(f, static).join(gauges, ["zone", "date"], "left")
    return joins.label_event_days(f, events).drop("rain_mm")
