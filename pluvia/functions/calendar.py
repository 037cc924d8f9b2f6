"""Calendar columns (P02, P03) and date validation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    d = F.col(date)
    y = F.year(d)
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    angle = F.lit(TWO_PI) * F.month(d) / F.lit(12.0)
    return df.withColumns(
        {
            "year": y,
            "month": F.month(d),
            "day": F.dayofmonth(d),
            "day_of_year": F.dayofyear(d),
            "day_of_week": F.weekday(d) + 1,
            "week_of_year": F.weekofyear(d),
            "is_leap_year": leap.cast("int"),
            "month_sin": F.sin(angle),
            "month_cos": F.cos(angle),
        }
    )


def day_cycle(df: DataFrame, date: str = "date") -> DataFrame:
    """The divisor is 365 in leap years too."""
    angle = F.lit(TWO_PI) * F.dayofyear(F.col(date)) / F.lit(365.0)
    return df.withColumns({"day_sin": F.sin(angle), "day_cos": F.cos(angle)})


def request_status(date_text: Column, zone_known: Column, first, last) -> Column:
    """OK, or the reason why a (date, zone) request is refused."""
    d = F.try_to_timestamp(date_text, F.lit("yyyy-MM-dd")).cast("date")
    return (
        F.when(~zone_known, F.lit("unknown zone"))
        .when(d.isNull(), F.lit("unparseable date"))
        .when((d < first) | (d > last), F.lit("date outside covered range"))
        .otherwise(F.lit("OK"))
    )


def time_of_day(col: Column) -> Column:
    """HH:MM (24 h), default 14:00; NULL marks an invalid time."""
    t = F.coalesce(F.nullif(col, F.lit("")), F.lit("14:00"))
    return F.when(t.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]$"), t)


def horizon_class(date: Column, first, last, horizon_days: int = 365) -> Column:
    """UNAVAILABLE before the record or past the horizon, else FORECAST / ANALYSIS."""
    return (
        F.when((date < first) | (date > F.date_add(last, horizon_days)), F.lit("UNAVAILABLE"))
        .when(date > last, F.lit("FORECAST"))
        .otherwise(F.lit("ANALYSIS"))
    )
