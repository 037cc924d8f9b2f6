"""Joins and lookups that are not spatial.

Small sides are not hinted: Spark broadcasts a side only when its measured size is below
spark.sql.autoBroadcastJoinThreshold and otherwise shuffles, with AQE splitting hot keys.
Explicit hints are kept for sides with a fixed row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.session import stored


def static_join(daily: DataFrame, static: DataFrame, key: str = "zone") -> DataFrame:
    """Zone attributes onto daily rows; a clashing column of the daily side is dropped first."""
    clash = [c for c in static.columns if c in daily.columns and c != key]
    return daily.drop(*clash).join(static, key, "left")


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], one_to_one: bool = False) -> DataFrame:
    """Join that fails on duplicate right keys or unmatched left rows. Runs jobs for the checks.

    The left side is evaluated once: its join is stored, and the checks read what was stored.
    """
    if right.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"right side is not unique on {list(keys)}")
    joined = stored(left.join(right.withColumn("_found", F.lit(True)), list(keys), "left"), "checked-join")
    if one_to_one and joined.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"left side is not unique on {list(keys)}")
    if joined.filter("_found is null").limit(1).count():
        raise ValueError(f"left rows without a match on {list(keys)}")
    return joined.drop("_found")


def expand_dates(df: DataFrame, start="start_date", end="end_date", out="date") -> DataFrame:
    """One row per day of [start, end]; an end before the start gives no row."""
    days = F.when(F.col(end) >= F.col(start), F.sequence(start, end))
    return df.withColumn(out, F.explode(days))


def label_event_days(rows: DataFrame, events: DataFrame, zone="zone", date="date", flag="flood_event_active") -> DataFrame:
    """Rows of an event's zone between its start and end get 1, all others 0.

    Events are expanded to distinct (zone, day) keys, which turns the interval join into an equi-join.
    """
    days = expand_dates(events.filter(F.col(zone).isNotNull()), out=date).select(zone, date).distinct()
    marked = rows.join(days.withColumn(flag, F.lit(1)), [zone, date], "left")
    return marked.withColumn(flag, F.coalesce(flag, F.lit(0)))


def event_row_counts(rows: DataFrame, events: DataFrame, zone="zone", date="date") -> DataFrame:
    """Rows labelled by each event, 0 included."""
    hits = expand_dates(events, out=date).join(rows.select(zone, date), [zone, date]).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return events.join(hits, "event_id", "left").withColumn("rows_labelled", F.coalesce("_n", F.lit(0))).drop("_n")


def compare_series(base: DataFrame, ref: DataFrame, value: str, date="date", tolerance: float = 1e-4) -> DataFrame:
    """Matched dates, values off by more than the tolerance, dates missing on either side."""
    b = base.select(date, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    r = ref.select(date, F.col(value).alias("_r"), F.lit(1).alias("_in_r"))
    both = F.col("_in_b").isNotNull() & F.col("_in_r").isNotNull()
    return (
        b.join(r, date, "full")
        .agg(
            F.count_if(both).alias("matched"),
            F.count("_in_b").alias("_nb"),
            F.count("_in_r").alias("_nr"),
            F.count_if(both & (F.abs(F.col("_b") - F.col("_r")) > tolerance)).alias("value_mismatches"),
        )
        .select(
            "matched",
            "value_mismatches",
            (F.greatest("_nb", "_nr") - F.col("matched")).alias("date_mismatches"),
        )
    )


def keyed_lookup(requests: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table row of each request; `found` tells the requests without one."""
    marked = table.withColumn("found", F.lit(True))
    return requests.join(marked, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def gauge_status(requests: DataFrame, zone_days: DataFrame) -> DataFrame:
    """Availability, rounded levels and stations; everything NULL when there is no reading."""
    from pluvia.functions.numeric import round_to

    joined = requests.join(zone_days, ["zone", "date"], "left")
    known = F.col("river_level_daily_mean_m").isNotNull()
    return joined.select(
        *requests.columns,
        known.alias("available"),
        F.when(known, round_to(F.col("river_level_daily_mean_m"), 2)).alias("level_mean_m"),
        F.when(known, round_to(F.col("river_level_daily_max_m"), 2)).alias("level_max_m"),
        F.when(known, F.col("cwc_stations_in_cell")).alias("stations"),
    )


def same_date_spread(df: DataFrame, score: str, zone="zone", date="date") -> DataFrame:
    """Every zone's score on each zone's most anomalous day (earliest day wins ties).

    Trigger days are grouped by date first, so the join side has at most one row per date.
    """
    peak = df.groupBy(zone).agg(F.max_by(date, F.struct(F.col(score), -F.unix_date(date))).alias(date))
    triggers = peak.groupBy(date).agg(F.count(F.lit(1)).alias("triggered_by"), F.min(zone).alias("first_trigger"))
    return df.select(zone, date, score).join(triggers, date)


def report_counts(rows: DataFrame, reports: DataFrame, zone="zone") -> DataFrame:
    """Stored reports per zone, 0 without any."""
    counts = reports.groupBy(zone).agg(F.count(F.lit(1)).alias("citizen_reports"))
    return rows.join(counts, zone, "left").withColumn("citizen_reports", F.coalesce("citizen_reports", F.lit(0)))


def fallback_lookup(df: DataFrame, by_position: DataFrame, by_name: DataFrame, value: str) -> DataFrame:
    """Value by position rounded to 2 digits, else by trimmed lower-case name, else NULL."""
    from pluvia.functions.numeric import round_to

    key = lambda c: F.rint(F.col(c) * 100).cast("bigint")
    pos = by_position.select(key("lat").alias("_la"), key("lon").alias("_lo"), F.col(value).alias("_p"))
    names = by_name.select(F.lower(F.trim("name")).alias("_name"), F.col(value).alias("_v"))
    keyed = df.withColumns({"_la": key("lat"), "_lo": key("lon"), "_name": F.lower(F.trim("name"))})
    joined = keyed.join(pos, ["_la", "_lo"], "left").join(names, "_name", "left")
    return joined.withColumn(value, F.coalesce("_p", "_v")).drop("_la", "_lo", "_name", "_p", "_v")
