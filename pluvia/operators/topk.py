"""Top-k operators. `row_number() <= k` is planned with a partial limit before the shuffle,
so a zone with a third of all rows still sends only k rows per task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.functions.numeric import fixed_text


def top_per_group(df: DataFrame, group: str, value: str, ties: Sequence[str], k: int, rank: str = "rank") -> DataFrame:
    """the k largest rows of each group, numbered; ties by `ties`."""
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last(value), *ties)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_days_with_context(df: DataFrame, k: int = 10, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """the top rows with zone, year and month maxima and the year's heavy/extreme day counts.

    The zone's window comes first, so all windows keep its partitioning: a series that is dealt by
    zone is not shuffled again, and its task sizes stay. Month and year windows share one sort.
    """
    v = F.col(value)
    by_month = Window.partitionBy(zone, "_y", "_m")
    by_year = Window.partitionBy(zone, "_y")
    wide = (
        df.select(zone, date, value, F.year(date).alias("_y"), F.month(date).alias("_m"))
        .withColumn("zone_max", F.max(v).over(Window.partitionBy(zone)))
        .withColumn("month_max", F.max(v).over(by_month))
        .withColumns(
            {
                "year_max": F.max(v).over(by_year),
                "heavy_days": F.count_if(v > fv.HEAVY_MM).over(by_year),
                "extreme_days": F.count_if(v > fv.EXTREME_MM).over(by_year),
            }
        )
    )
    top = top_per_group(wide, zone, value, [date], k, "_rank")
    return top.select(zone, date, value, "zone_max", "year_max", "month_max", "heavy_days", "extreme_days")


def top_with_fallback(df: DataFrame, preferred: Column, score: str, ties: Sequence[str], k: int) -> DataFrame:
    """the k best preferred rows; with no preferred row at all, the k best rows.

    A preferred row never loses to another one in this order, so the k first rows decide it.
    """
    order = [F.desc("_pref"), F.desc(score), *ties]
    best = df.withColumn("_pref", F.coalesce(preferred, F.lit(False))).orderBy(*order).limit(k)
    seen = F.max("_pref").over(Window.partitionBy())  # k rows
    return best.withColumn("_any", seen).filter(F.col("_pref") == F.col("_any")).drop("_pref", "_any")


def latest_rows(df: DataFrame, date: str = "date", dates: DataFrame | None = None) -> DataFrame:
    """rows of the newest date; the maximum is a scalar subquery that reads the date column only.

    Column pruning stops at Python stages: give `dates`, a frame from before such a stage
    with the same dates, and the subquery does not repeat it.
    """
    source = df if dates is None else dates
    return df.filter(F.col(date) == source.agg(F.max(date)).scalar())


def top_dates_text(df: DataFrame, score: str, zone="zone", date="date", k: int = 3) -> DataFrame:
    """the k best dates per zone as one text."""
    top = top_per_group(df, zone, score, [date], k, "_rank")
    label = F.concat(
        F.date_format(date, "yyyy-MM-dd"), F.lit(" ("), fixed_text(F.col(score), 0), F.lit(")")
    )
    packed = F.array_sort(F.collect_list(F.struct("_rank", label.alias("t"))))
    return top.groupBy(zone).agg(F.array_join(F.transform(packed, lambda x: x["t"]), "; ").alias("top_dates"))
