"""Grouped statistics. All are algebraic aggregates, so Spark combines on the map side first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import fixed_values as fv
from pluvia.functions.numeric import decimal_round, fixed_text, is_infinite, round_to
from pluvia.session import stored


def _rainy(value):
    return F.count_if(F.col(value) > 0)


def _dry(value):
    return F.count_if(F.col(value) == 0)


def yearly_stats(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """D01."""
    return df.groupBy(zone, F.year(date).alias("year")).agg(
        round_to(F.sum(value), 2).alias("annual_rainfall"),
        round_to(F.avg(value), 4).alias("mean_daily_rainfall"),
        round_to(F.max(value), 2).alias("max_daily_rainfall"),
        _rainy(value).alias("rainy_days"),
        _dry(value).alias("dry_days"),
    )


def monthly_stats(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """D02."""
    return df.groupBy(zone, F.year(date).alias("year"), F.month(date).alias("month")).agg(
        round_to(F.sum(value), 2).alias("monthly_rainfall"),
        round_to(F.avg(value), 4).alias("mean_daily_rainfall"),
        round_to(F.max(value), 2).alias("max_daily_rainfall"),
        _rainy(value).alias("rainy_days"),
    )


def zone_stats(df: DataFrame, value="rain_mm", zone="zone", spell="consecutive_dry_days") -> DataFrame:
    """D03, over rows that carry the dry-spell column."""
    v = F.col(value)
    return df.groupBy(zone).agg(
        round_to(F.avg(v), 4).alias("mean_rainfall_mm"),
        round_to(F.sum(v), 2).alias("total_rainfall_mm"),
        round_to(F.max(v), 2).alias("maximum_daily_rainfall_mm"),
        _rainy(value).alias("rainy_days"),
        _dry(value).alias("dry_days"),
        F.count_if(v > fv.HEAVY_MM).alias("heavy_rainfall_days"),
        F.count_if(v > fv.EXTREME_MM).alias("extreme_rainfall_days"),
        F.max(spell).alias("longest_dry_spell"),
    )


def quality_profile(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """Counts by (zone, day), order statistics by (zone, value), both reduced to one row per zone.

    Neither needs a distinct or a collecting aggregate: rows are combined before each shuffle,
    and a zone has no more groups than days or distinct values.
    """
    v = F.col(value)
    missing = F.lit(0)
    for c in df.columns:
        missing = missing + F.count_if(F.col(c).isNull())
    days = df.groupBy(zone, date).agg(
        F.count(F.lit(1)).alias("_n"), missing.alias("_null"), F.count_if(v < 0).alias("_neg"), _dry(value).alias("_dry"), _rainy(value).alias("_wet")
    )
    counts = days.groupBy(zone).agg(
        F.sum("_n").alias("record_count"),
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
        F.sum("_null").alias("missing_values"),
        (F.sum("_n") - F.count(date)).alias("duplicate_records"),
        F.sum("_neg").alias("negative_count"),
        F.sum("_dry").alias("zero_days"),
        F.sum("_wet").alias("rainy_days"),
    )
    freq = df.filter(v.isNotNull()).groupBy(zone, value).agg(F.count(F.lit(1)).alias("_c"))
    whole, upto = Window.partitionBy(zone), Window.partitionBy(zone).orderBy(value)
    n, c = F.col("_n"), F.col("_c")
    ranked = freq.withColumns(
        {"_n": F.sum("_c").over(whole), "_mean": F.sum(c * v).over(whole) / F.sum("_c").over(whole), "_upto": F.sum("_c").over(upto)}
    )
    at = lambda k: F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - c <= k), v))
    middle = (at(F.floor((n - 1) / 2.0)) + at(F.ceil((n - 1) / 2.0))) / 2.0
    spread = F.sqrt(F.try_divide(F.sum(c * (v - F.col("_mean")) ** 2), F.max(n) - 1))
    values = ranked.groupBy(zone).agg(
        round_to(F.max("_mean"), 4).alias("mean_rainfall"),
        round_to(middle, 4).alias("median_rainfall"),
        round_to(spread, 4).alias("std_rainfall"),
        round_to(F.min(v), 4).alias("min_rainfall"),
        round_to(F.max(v), 4).alias("max_rainfall"),
    )
    return counts.join(values, zone, "left")


def monthly_climatology(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """D05 in long form; `wide_by_month` turns months into columns."""
    return df.groupBy(zone, F.month(date).alias("month")).agg(F.avg(value).alias("mean_rain_mm"))


def wide_by_month(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """D05 pivoted on the twelve months: the column list is fixed, so no extra job finds it."""
    return _pivot_month(df, [zone], value, date, F.avg)


def _pivot_month(df: DataFrame, keys, value, date, fn) -> DataFrame:
    months = list(range(1, 13))
    out = df.withColumn("_m", F.month(date)).groupBy(*keys).pivot("_m", months).agg(fn(value))
    return out.select(*keys, *[F.col(str(m)).alias(f"m{m:02d}") for m in months])


def annual_ranking(df: DataFrame, value="rain_mm", zone="zone", date="date") -> DataFrame:
    """Mean of the yearly totals, highest first."""
    yearly = df.groupBy(zone, F.year(date).alias("year")).agg(F.sum(value).alias("t"))
    return yearly.groupBy(zone).agg(F.avg("t").alias("mean_annual_rain_mm")).orderBy(
        F.desc("mean_annual_rain_mm"), zone
    )


def spatial_mean_monthly(df: DataFrame, value="rain_mm", date="date") -> DataFrame:
    """Daily mean over zones, then the sum per month."""
    daily = df.groupBy(date).agg(F.avg(value).alias("m"))
    return daily.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(
        F.sum("m").alias("monthly_rainfall")
    )


def year_month_matrix(df: DataFrame, value="rain_mm", date="date") -> DataFrame:
    """Monthly totals, one row per year."""
    return _pivot_month(df.withColumn("year", F.year(date)), ["year"], value, date, F.sum)


def log_histogram(df: DataFrame, value="rain_mm", low: float = 0.1, edges: int = 50) -> DataFrame:
    """Density per log-spaced bin of the positive values; the last bin holds its upper edge."""
    bins = edges - 1
    positive = df.filter(F.col(value) > 0).select(F.col(value).alias("v"))
    positive = positive.withColumn("hi", positive.agg(F.max("v")).scalar())
    step = F.nullif(F.log10(F.col("hi") / low), F.lit(0.0)) / bins
    edge = lambda i: F.lit(low) * F.pow(F.lit(10.0), i * step)
    guess = F.floor(F.log10(F.col("v") / low) / step)
    # the logarithm may land one bin off next to an edge, so the guess is checked against the edges
    fixed = F.when(F.col("v") < edge(guess), guess - 1).when(F.col("v") >= edge(guess + 1), guess + 1).otherwise(guess)
    binned = (
        positive.filter(F.col("v") >= low)
        .withColumn("bin", F.when(F.col("v") == F.col("hi"), F.lit(bins - 1)).otherwise(fixed).cast("int"))
    )
    counts = binned.groupBy("bin", "hi").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    width = edge(F.col("bin") + 1) - edge(F.col("bin"))
    return counts.select("bin", "n", (F.col("n") / (total * width)).alias("density"))


def station_days(readings: DataFrame) -> DataFrame:
    """Mean, max and row count per (zone, station, day); NULL levels count as rows."""
    return readings.groupBy("zone", "station", F.to_date("ts").alias("date")).agg(
        round_to(F.avg("level"), 3).alias("level_daily_mean_m"),
        round_to(F.max("level"), 3).alias("level_daily_max_m"),
        F.count(F.lit(1)).alias("n_obs"),
    )


def zone_days(days: DataFrame) -> DataFrame:
    """Mean of station means, max of maxes, and the zone's station count over the whole file."""
    per_day = days.groupBy("zone", "date").agg(
        round_to(F.avg("level_daily_mean_m"), 3).alias("river_level_daily_mean_m"),
        round_to(F.max("level_daily_max_m"), 3).alias("river_level_daily_max_m"),
    )
    stations = days.groupBy("zone").agg(F.count_distinct("station").cast("int").alias("cwc_stations_in_cell"))
    return per_day.join(stations, "zone", "left")


def station_profile(readings: DataFrame, box: dict[str, float], near_km: float = 15.0, corners_only: bool = True, texts: Sequence[str] = ()) -> DataFrame:
    """First position and text fields, counts, span and level statistics per station, distance to the box."""
    from pluvia.functions.geo import km_to_box

    first = lambda c: F.min_by(c, F.struct("ts", "event_id")).alias(c)
    agg = readings.groupBy("station").agg(
        first("lon"),
        first("lat"),
        *[F.min_by(F.trim(c), F.struct("ts", "event_id")).alias(c) for c in texts],
        F.count(F.lit(1)).alias("n_records"),
        F.min("ts").alias("time_start"),
        F.max("ts").alias("time_end"),
        F.min("level").alias("level_min_m"),
        F.max("level").alias("level_max_m"),
        round_to(F.avg("level"), 3).alias("level_mean_m"),
    )
    km = round_to(km_to_box(F.col("lon"), F.col("lat"), box, corners_only), 2)
    return agg.withColumn("distance_km", km).withColumn(
        "relevant", F.when(F.col("distance_km") <= near_km, "YES").otherwise("NO")
    )


def station_summary(days: DataFrame) -> DataFrame:
    """Stations, max of maxes and mean of means per zone."""
    per_station = days.groupBy("zone", "station").agg(
        F.avg("level_daily_mean_m").alias("m"), F.max("level_daily_max_m").alias("x")
    )
    return per_station.groupBy("zone").agg(
        F.count(F.lit(1)).alias("stations"), F.max("x").alias("max_level_m"), F.avg("m").alias("mean_level_m")
    )


def column_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows (column, value, number, n): how often each column holds each value, NULL included; stored.

    The table is read once and goes through one aggregation in long form, in partial sums. All profiles
    follow from these counts. `value` is the value as text, `number` as a double where it is numeric.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields if cols is None or f.name in cols}
    items = [
        F.struct(
            F.lit(c).alias("column"),
            (F.col(c).cast("string") if isinstance(kind, T.AtomicType) else F.to_json(c)).alias("value"),
            (F.col(c) if isinstance(kind, T.NumericType) else F.lit(None)).cast("double").alias("number"),
        )
        for c, kind in kinds.items()
    ]
    long = df.select(F.inline(F.array(*items)))
    return stored(long.groupBy("column", "value", "number").agg(F.count(F.lit(1)).alias("n")), "column-counts")


def column_profile(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Type, distinct values and NULLs per column, from its counts."""
    counts = column_counts(df) if counts is None else counts
    kinds = df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, type string")
    missing = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    per = counts.groupBy("column").agg(F.count("value").alias("unique_count"), missing.alias("null_count"), F.sum("n").alias("_n"))
    # an empty table has its columns, too
    none = F.lit(0).cast("bigint")
    every = kinds.join(per, "column", "left").select("column", "type", *[F.coalesce(c, none).alias(c) for c in ("unique_count", "null_count", "_n")])
    return every.withColumn("null_pct", round_to(F.try_divide(F.col("null_count") * 100.0, F.col("_n")), 2)).drop("_n")


def numeric_describe(df: DataFrame, cols: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max per column, from its counts. Runs jobs for the quartiles."""
    from pluvia.operators.rank import quantiles_of_counts

    counts = column_counts(df, cols) if counts is None else counts
    known = counts.filter(F.col("number").isNotNull() & F.col("column").isin(list(cols)))
    x, n = F.col("number"), F.col("n")
    basic = known.groupBy("column").agg(
        F.sum("n").alias("count"), (F.sum(x * n) / F.sum(n)).alias("mean"), F.min("number").alias("min"), F.max("number").alias("max")
    )
    # squares around the mean: columns x one row, so the mean is broadcast
    off = known.join(F.broadcast(basic.select("column", F.col("mean").alias("_m"))), "column")
    std = off.groupBy("column").agg(F.sqrt(F.try_divide(F.sum((x - F.col("_m")) * (x - F.col("_m")) * n), F.sum(n) - 1)).alias("std"))
    q = quantiles_of_counts(known.select("column", F.col("number").alias("v"), F.col("n").alias("_c")), (0.25, 0.5, 0.75))
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    wide = q.groupBy("column").agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))
    out = basic.join(std, "column").join(wide, "column", "left")
    # a column without values keeps its row
    names = counts.filter(F.col("column").isin(list(cols))).select("column").distinct().join(out, "column", "left")
    order = ["column", "count", "mean", "std", "min", "max", "p25", "p50", "p75"]
    return names.withColumn("count", F.coalesce("count", F.lit(0).cast("bigint"))).select(order)


def category_distribution(df: DataFrame, category: str) -> DataFrame:
    """D20."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar())


def missing_profile(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Columns with NULLs, most first."""
    counts = column_counts(df) if counts is None else counts
    missing = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    per = counts.groupBy("column").agg(missing.alias("missing"), F.sum("n").alias("_n"))
    out = per.withColumn("missing_pct", F.try_divide(F.col("missing") * 100.0, F.col("_n"))).drop("_n")
    return out.filter("missing > 0").orderBy(F.desc("missing"), "column")


def range_profile(df: DataFrame, cols: Sequence[str], counts: DataFrame | None = None) -> DataFrame:
    """Min, max, mean and infinite count per numeric column, from its counts."""
    counts = column_counts(df, cols) if counts is None else counts
    x, n = F.col("number"), F.col("n")
    rows = counts.filter(F.col("column").isin(list(cols)))
    return rows.groupBy("column").agg(
        F.min("number").alias("min"), F.max("number").alias("max"), (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean"),
        F.sum(F.when(is_infinite(x), n).otherwise(0)).alias("infinite"),
    )


def rain_summary(df: DataFrame, value="rain_mm", zone="zone", date="date", week="rainfall_7d") -> DataFrame:
    """D33 over rows that carry the 7-day sum."""
    return df.groupBy(zone).agg(
        F.avg(value).alias("mean_rain_mm"),
        F.max(value).alias("max_rain_mm"),
        F.max_by(value, date).alias("latest_rain_mm"),
        F.max(week).alias("max_rain_7d_mm"),
    )


def first_known(df: DataFrame, cols: Sequence[str], zone="zone", date="date") -> list[Column]:
    """D34 helper: first non-null value per group by date, so the result does not depend on row order."""
    return [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in cols]


def group_attributes(df: DataFrame, cols: Sequence[str], value="rain_mm", zone="zone", date="date") -> DataFrame:
    """D34."""
    return df.groupBy(zone).agg(*first_known(df, cols, zone, date), F.avg(value).alias("rainfall_climatology_mm_day"))


def trailing_mean(df: DataFrame, cols: Sequence[str], zone="zone", date="date", days: int = 90, latest: Sequence[str] = ()) -> DataFrame:
    """D25 first half: mean over dates >= the zone's last date - `days`, and the last value of the `latest` columns.

    One window and one aggregate on the same exchange; a zone's series is bounded by the calendar.
    """
    last = F.max(date).over(Window.partitionBy(zone))
    recent = df.select(zone, date, *cols, *latest, last.alias("_last")).filter(F.col(date) >= F.date_sub("_last", days))
    return recent.groupBy(zone).agg(*[F.avg(c).alias(c) for c in cols], *[F.max_by(c, date).alias(c) for c in latest])


def damped(value: Column, days_ahead: Column, when_zero: float) -> Column:
    """D25 second half: a zero mean reads as `when_zero`; at least 30 % of it remains."""
    base = F.when(value == 0, F.lit(when_zero)).otherwise(value)
    return decimal_round(base * damping(days_ahead), 2)


def damping(days_ahead: Column) -> Column:
    return F.greatest(F.lit(0.30), F.lit(1.0) - F.lit(0.04) * days_ahead)


def score_summary(df: DataFrame, score: str, pct: str, zone="zone", date="date", top: int = 3) -> DataFrame:
    """D24 with F06: counts, mean, p95, max and the best dates as text.

    row_number <= k is cut before the shuffle as well (window group limit), so only the best
    days of a zone travel; ties go to the earlier date.
    """
    day = F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit(" ("), fixed_text(F.col(score), 0), F.lit(")"))
    w = Window.partitionBy(zone).orderBy(F.desc(score), date)
    best = (
        df.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= top)
        .groupBy(zone)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", day.alias("t")))), lambda x: x.t), "; ").alias("top_dates"))
    )
    agg = df.groupBy(zone).agg(
        F.count(F.lit(1)).alias("n_rows"),
        round_to(F.avg(score), 2).alias("score_mean"),
        round_to(round_to(F.percentile(score, F.lit(0.95)), 6), 2).alias("score_p95"),
        round_to(F.max(score), 2).alias("score_max"),
        F.count_if(F.col(pct) >= 99).alias("days_in_global_top1pct"),
    )
    return agg.join(best, zone)


def event_flag_hits(df: DataFrame, pct: str, event_flag: str) -> DataFrame:
    """Event rows in the top 1, 5 and 10 percent."""
    ev = df.filter(F.col(event_flag) == 1)
    return ev.agg(
        F.count(F.lit(1)).alias("event_rows"),
        F.count_if(F.col(pct) >= 99).alias("top1pct"),
        F.count_if(F.col(pct) >= 95).alias("top5pct"),
        F.count_if(F.col(pct) >= 90).alias("top10pct"),
    )


def dashboard_kpis(df: DataFrame) -> DataFrame:
    """D31 per date."""
    return df.groupBy("date").agg(
        F.count(F.lit(1)).alias("zones"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"),
        F.avg("risk_score").alias("mean_score"),
        F.count_if(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("active_alerts"),
        F.max_by("zone", F.struct("risk_score", "zone")).alias("top_zone"),
    )
