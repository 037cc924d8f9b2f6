"""Daily series per zone: building, windows, season sums, baselines.

Scale. Raw observations may pile up on one zone, so `daily_series` first adds them up
per (zone, day) with map-side partial aggregation. After that a zone holds at most one
row per calendar day (about 45,000 rows for 125 years), which bounds every
`Window.partitionBy(zone)` below whatever the raw skew was. All windows of one zone
share one specification, so Spark plans a single exchange and sort for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.session import estimated_bytes

#: Raw bytes (by the optimizer's estimate) whose filled days go to one task, and the most tasks asked for.
TASK_BYTES = 1 << 18
MOST_TASKS = 1 << 15


def daily_series(
    raw: DataFrame, zone: str, date: str, value: Column, start=None, end=None, out: str = "rain_mm"
) -> DataFrame:
    """One row per (zone, day) from start to end; days without an observation count as 0.

    Only observed days are shuffled. Each of them is then stretched to the day before the
    zone's next one (the first back to the start, the last on to the end), so no spine of
    all days is built or joined, and the rows leave partitioned by zone for the windows
    that follow. With no start/end the span of the data is used.

    Adaptive execution would size the tasks by the shuffled days, which are few and small; the
    filled days and each sort of them are many times larger. So the number of tasks follows the
    size of the input, and what a task holds does not grow with it.
    """
    obs = raw.select(F.col(zone).alias("zone"), F.col(date).cast("date").alias("date"), value.alias("_v"))
    days = obs.groupBy("zone", "date").agg(F.sum("_v").alias("_v"))
    if start is None or end is None:
        # from the days that are added up, with their sums in use, so that both sides share one exchange and one scan
        bounds = days.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count("_v").alias("n"))).scalar()
    else:
        bounds = F.struct(F.lit(start).cast("date").alias("lo"), F.lit(end).cast("date").alias("hi"))
    w = Window.partitionBy("zone").orderBy("date")
    around = _dealt(days, obs).withColumns({"_before": F.lag("date").over(w), "_after": F.lead("date").over(w)})
    lo, hi = F.col("_bounds.lo"), F.col("_bounds.hi")
    ranged = around.withColumn("_bounds", bounds).withColumns(
        {
            "_from": F.when(F.col("_before").isNull(), lo).otherwise(F.greatest(F.col("date"), lo)),
            "_to": F.least(F.coalesce(F.date_sub("_after", 1), hi), hi),
        }
    )
    span = F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to"))
    filled = ranged.select("zone", "date", "_v", F.explode(span).alias("_day"))
    known = F.when(F.col("_day") == F.col("date"), F.coalesce("_v", F.lit(0.0))).otherwise(F.lit(0.0))
    return filled.select("zone", F.col("_day").alias("date"), known.alias(out))


def _dealt(days: DataFrame, obs: DataFrame) -> DataFrame:
    """The days by zone, in as many tasks as the rows they are made of ask for; left to Spark where their size is unknown."""
    size = estimated_bytes(obs)
    if size is None:
        return days
    least = obs.sparkSession.sparkContext.defaultParallelism
    return days.repartition(max(least, min(MOST_TASKS, -(-size // TASK_BYTES))), "zone")


def _by_zone(zone: str, date: str):
    return Window.partitionBy(zone).orderBy(date)


def lags(df: DataFrame, value="rain_mm", zone="zone", date="date", days: Sequence[int] = fv.LAG_DAYS) -> DataFrame:
    """E01."""
    w = _by_zone(zone, date)
    return df.withColumns({f"lag_{n}d": F.lag(value, n).over(w) for n in days})


def shifted_rolling(
    df: DataFrame, value="rain_mm", zone="zone", date="date", days: Sequence[int] = fv.ROLL_DAYS
) -> DataFrame:
    """Mean and sum of rows t-w..t-1, from one earlier row on."""
    w = _by_zone(zone, date)
    cols = {}
    for n in days:
        frame = w.rowsBetween(-n, -1)
        cols[f"rolling_{n}d"] = F.avg(value).over(frame)
        cols[f"accumulated_{n}d"] = F.sum(value).over(frame)
    return df.withColumns(cols)


def complete_rolling_sum(
    df: DataFrame, value="rain_mm", zone="zone", date="date", days: Sequence[int] = fv.ROLL_DAYS
) -> DataFrame:
    """Sum of rows t-w+1..t, NULL until w values exist."""
    w = _by_zone(zone, date)
    cols = {}
    for n in days:
        frame = w.rowsBetween(-(n - 1), 0)
        cols[f"rainfall_{n}d"] = F.when(F.count(value).over(frame) == n, F.sum(value).over(frame))
    return df.withColumns(cols)


def dry_spell(df: DataFrame, value="rain_mm", zone="zone", date="date", out="consecutive_dry_days") -> DataFrame:
    """Dry days in a row before t. A wet (or unknown) day ends the run."""
    w = _by_zone(zone, date)
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    row = F.row_number().over(w)
    not_dry = ~F.coalesce(F.col(value) == 0, F.lit(False))
    last_break = F.max(F.when(F.col("_not_dry"), F.col("_row"))).over(run)
    return (
        df.withColumns({"_row": row, "_not_dry": not_dry})
        .withColumn(out, (F.col("_row") - 1 - F.coalesce(last_break, F.lit(0))).cast("int"))
        .drop("_row", "_not_dry")
    )


def group_maxima(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """One shuffle on zone serves the year and the month maximum."""
    y, m = F.year(date), F.month(date)
    return df.withColumns(
        {
            "year_max": F.max(value).over(Window.partitionBy(zone, y)),
            "month_max": F.max(value).over(Window.partitionBy(zone, y, m)),
        }
    )


def month_to_date(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """Running sum of the month; a NULL day stays NULL and is skipped by the sum."""
    w = Window.partitionBy(zone, F.year(date), F.month(date)).orderBy(date)
    total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("monthly_rainfall_to_date", F.when(F.col(value).isNotNull(), total))


def season_to_date(df: DataFrame, value="rain_mm", zone="zone", date="date", first_month: int = 6) -> DataFrame:
    """Running sum from the first day of the season to year end, NULL before it."""
    in_season = F.month(date) >= first_month
    w = Window.partitionBy(zone, F.year(date)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.when(in_season, F.col(value))).over(w)
    return df.withColumn("monsoon_rainfall_to_date", F.when(in_season & F.col(value).isNotNull(), total))


def previous_year_stats(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """E08 on yearly aggregates: mean and max of the previous recorded year."""
    yearly = df.groupBy(zone, F.year(date).alias("year")).agg(F.avg(value).alias("_m"), F.max(value).alias("_x"))
    w = Window.partitionBy(zone).orderBy("year")
    return yearly.select(
        zone,
        "year",
        F.lag("_m").over(w).alias("hist_mean_prior_years_mm"),
        F.lag("_x").over(w).alias("hist_max_prior_years_mm"),
    )


def _previous_period(df: DataFrame, stats: dict[str, Column], zone: str, group: Sequence[str], period: str, date: str) -> DataFrame:
    """Aggregates of the previous recorded period, on every row of a period.

    The period's aggregate is taken over the period, handed to the next period's first row
    by a lag, and spread over that period. Each window is partitioned by the zone (and more)
    and sorted by the same keys, so rows partitioned by zone are neither shuffled nor joined.
    """
    inside = Window.partitionBy(zone, *group, period).orderBy(date)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    along = Window.partitionBy(zone, *group).orderBy(period, date)
    new_period = ~F.lag(period).over(along).eqNullSafe(F.col(period))
    out = df.withColumn("_new", new_period).withColumns({f"_own_{k}": c.over(whole) for k, c in stats.items()})
    out = out.withColumns({f"_prev_{k}": F.when(F.col("_new"), F.lag(f"_own_{k}").over(along)) for k in stats})
    out = out.withColumns({k: F.first(f"_prev_{k}").over(whole) for k in stats})
    return out.drop("_new", *[f"_own_{k}" for k in stats], *[f"_prev_{k}" for k in stats])


def with_previous_year(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """Attach the previous recorded year's mean and max."""
    stats = {"hist_mean_prior_years_mm": F.avg(value), "hist_max_prior_years_mm": F.max(value)}
    return _previous_period(df.withColumn("year", F.year(date)), stats, zone, [], "year", date)


def with_previous_month_climatology(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """Same-month mean of the previous recorded year, and the anomaly to the previous-year mean.

    Expects the columns of `with_previous_year`.
    """
    base = df.withColumns({"month": F.month(date), "year": F.year(date)})
    out = _previous_period(base, {"month_clim_mean_prior_years_mm": F.avg(value)}, zone, ["month"], "year", date)
    return out.withColumn("rainfall_anomaly_mm", F.col(value) - F.col("hist_mean_prior_years_mm"))


def trend_delta(df: DataFrame, score="risk_score", zone="zone", date="date", width: int = 3) -> Column:
    """Mean of the last `width` rows minus the mean of the `width` rows before, NULL until both are full."""
    w = _by_zone(zone, date)
    recent, before = w.rowsBetween(-(width - 1), 0), w.rowsBetween(-(2 * width - 1), -width)
    full = (F.count(score).over(recent) == width) & (F.count(score).over(before) == width)
    return F.when(full, F.avg(score).over(recent) - F.avg(score).over(before))


def date_gaps(df: DataFrame, zone="zone", date="date") -> DataFrame:
    """Days since the previous row of the zone."""
    return df.withColumn("gap_days", F.date_diff(date, F.lag(date).over(_by_zone(zone, date))))


def category_features(df: DataFrame, value="rain_mm") -> DataFrame:
    """P04, P05 and P06 in one projection."""
    from pluvia.functions.classify import hazard_flags, intensity_category, wet_dry_flags

    v = F.col(value)
    return df.withColumns({**wet_dry_flags(v), "category": intensity_category(v), **hazard_flags(v)})


def station_features(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """Calendar, flags, lags, shifted rolling windows, dry spell, classes and group maxima of a series."""
    from pluvia.functions.calendar import calendar_features

    out = dry_spell(df, value, zone, date)
    out = group_maxima(shifted_rolling(lags(out, value, zone, date), value, zone, date), value, zone, date)
    return category_features(calendar_features(out, date), value)
