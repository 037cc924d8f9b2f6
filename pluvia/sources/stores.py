"""Append-only stores on Parquet: alerts, preferences and incident reports."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.functions.classify import failures
from pluvia.sources.readers import _exists

_JSON = ("risk_components", "actions", "checklist", "environment")
#: How partitions are named: by day, or by month for stores that are filled with years at a time.
BY_DAY, BY_MONTH = "'d'yyyy-MM-dd", "'m'yyyy-MM"
_DEALT = 16  # tasks that write a period of a channel at most
_NAMED = 366  # partitions named one by one when a store is pruned; more are given as a range


def _stored_periods(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame | None:
    """The stored rows of the periods that `rows` has, read from their partitions only; None without a store. Runs a job."""
    if not _exists(spark, path):
        return None
    found = [r[0] for r in rows.select("period").distinct().collect()]  # as many as the calendar has
    store = spark.read.parquet(path)
    if len(found) <= _NAMED:
        return store.filter(F.col("period").isin(found))
    known = [p for p in found if p is not None]
    return store.filter(F.col("period").between(min(known), max(known)))


def _once_each(rows: DataFrame, keys: Sequence[str] = ("alert_id",)) -> DataFrame:
    """One row per key, clustered by period and channel. A key has one period and channel, so equal keys meet in
    the exchange that the writer needs anyway; a large period is dealt to several tasks by its keys."""
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*keys), F.lit(_DEALT))).repartition("period", "channel", "_deal")
    return dealt.dropDuplicates(["period", "channel", "_deal", *(k for k in keys if k != "channel")]).drop("_deal")


def append_alerts(
    alerts: DataFrame, path: str, created_at: Column | None = None, by: str = BY_DAY, id_of: Sequence[str] = ("alert_id",), made: Column | None = None
) -> None:
    """Add the alerts whose id is not stored yet; a repeated run adds nothing.

    The store is partitioned by period and channel. An id depends on its day, so the ids of the alerts' own
    periods are all that has to be read, however long the store has grown.

    An id is a long hash that does not compress. Where it is `made` of the columns `id_of`, these tell alerts apart
    in its place, and the id is made after the last exchange. The store's files are packed by zstd, which halves ids.
    """
    spark = alerts.sparkSession
    rows = alerts.withColumn("period", F.date_format("date", by))
    if made is not None:
        rows = rows.drop("alert_id")
    before = _stored_periods(spark, path, rows)
    if before is not None:
        known = before.select(*[F.col(c).alias(f"_{c}") for c in id_of])
        rows = rows.join(known, functools.reduce(Column.__and__, [_same(c, f"_{c}", made) for c in id_of]), "left_anti")
    rows = _once_each(rows, id_of)
    if made is not None:
        rows = rows.withColumn("alert_id", made).select(*alerts.columns, "period")
    _timed(rows, created_at).write.mode("append").option("compression", "zstd").partitionBy("period", "channel").parquet(path)


def _same(a: str, b: str, made: Column | None) -> Column:
    """Ids are equal, or the columns they are made of, where an unknown value is a value, too."""
    return F.col(a) == F.col(b) if made is None else F.col(a).eqNullSafe(F.col(b))


def replace_alerts(alerts: DataFrame, path: str, created_at: Column | None = None, by: str = BY_DAY) -> None:
    """The periods and channels of these alerts are written anew, all others stay (dynamic overwrite)."""
    rows = alerts.dropDuplicates(["alert_id"]).withColumn("period", F.date_format("date", by))
    out = _stamped(rows, created_at).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("period", "channel").parquet(path)


def _timed(rows: DataFrame, created_at: Column | None) -> DataFrame:
    return rows.withColumn("created_at", created_at if created_at is not None else F.current_timestamp())


def _stamped(rows: DataFrame, created_at: Column | None) -> DataFrame:
    """With the time of writing; rows of a period are clustered, so that a task writes few files."""
    return _timed(rows, created_at).hint("rebalance", "period", "channel")


def list_alerts(spark: SparkSession, path: str, channel: str, limit: int = 50, date=None, zone: str | None = None, by: str = BY_DAY) -> DataFrame:
    """Newest first. Filters apply before the limit (date and channel to the partitions); every task sends at most `limit` rows."""
    rows = spark.read.parquet(path).filter(F.col("channel") == channel)
    if date is not None:
        day = F.lit(date).cast("date")
        rows = rows.filter((F.col("date") == day) & (F.col("period") == F.date_format(day, by)))
    if zone is not None:
        rows = rows.filter(F.col("zone") == zone)
    return rows.orderBy(F.desc("created_at"), F.desc("date"), "zone").limit(limit).drop("period")


def encode_json(df: DataFrame) -> DataFrame:
    """Nested columns of operational alerts as JSON text."""
    return df.withColumns({c: F.to_json(c) for c in _JSON if c in df.columns})


def decode_json(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.from_json(c, s) for c, s in schemas.items()})


def as_variants(df: DataFrame) -> DataFrame:
    """Nested columns of operational alerts as VARIANT, which keeps whatever fields a row brings."""
    return df.withColumns({c: F.parse_json(F.to_json(c)) for c in _JSON if c in df.columns})


def decoded(df: DataFrame, fields: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Columns from VARIANT ones, name = (column, path, type); a missing or unfit field is NULL."""
    return df.withColumns({name: F.try_variant_get(F.col(c), path, kind) for name, (c, path, kind) in fields.items()})


def append_preferences(prefs: DataFrame, path: str, setting: str, default: str) -> None:
    """Log of (username, zone, setting, updated_at); an unset value takes the default."""
    prefs.withColumn(setting, F.coalesce(setting, F.lit(default))).write.mode("append").parquet(path)


def current_preferences(log: DataFrame, setting: str) -> DataFrame:
    """Latest value per (username, zone). A partial max, so a hot user is combined before the shuffle."""
    last = F.max_by(F.struct(setting, "updated_at"), F.struct("updated_at", setting))
    return log.groupBy("username", "zone").agg(last.alias("l")).select("username", "zone", f"l.{setting}", "l.updated_at")


def validated_reports(reports: DataFrame, zone_known: Column) -> DataFrame:
    """Adds id, status, time and the list of violated rules (empty when accepted).

    Works on batch and streaming frames. The id is a hash of the content, so a replayed
    micro-batch yields the same ids.
    """
    text = F.trim("description")
    key = F.concat_ws("|", "zone", "report_type", "description", F.col("ts").cast("string"))
    return reports.withColumns(
        {
            "failures": failures(
                {
                    "unknown zone": zone_known,
                    "report type": F.col("report_type").isin(*fv.REPORT_TYPES),
                    "description required": F.length(text) > 0,
                }
            ),
            "report_id": F.concat(F.lit("CR-"), F.upper(F.substring(F.sha2(key, 256), 1, 12))),
            "status": F.lit("SUBMITTED"),
            "timeless": F.col("ts").isNull(),
            "ts": F.coalesce(F.col("ts"), F.current_timestamp().cast("timestamp_ntz")),
        }
    )


def append_reports(reports: DataFrame, path: str) -> None:
    """The accepted rows whose id is not stored yet; the same submissions again add nothing.

    The store is partitioned by day. The id covers the time, so a report is looked up in its own day;
    a submission without a time gets that of its arrival and is looked up in all days.
    """
    spark = reports.sparkSession
    accepted = reports.filter(F.size("failures") == 0).dropDuplicates(["report_id"])
    rows = accepted.select("report_id", "zone", "report_type", "description", "ts", "status", F.date_format("ts", BY_DAY).alias("period"), "timeless")
    before = _stored_periods(spark, path, rows.filter(~F.col("timeless")))
    if before is not None:
        known = before.select("report_id")
        if rows.filter("timeless").limit(1).count():
            known = known.unionByName(spark.read.parquet(path).filter("timeless").select("report_id"))
        rows = rows.join(known, "report_id", "left_anti")
    rows.hint("rebalance", "period").write.mode("append").partitionBy("period").parquet(path)


def stored_reports(spark: SparkSession, path: str) -> DataFrame:
    """The reports of the store, without its own columns."""
    return spark.read.parquet(path).drop("period", "timeless")


def list_reports(reports: DataFrame, zone: str | None = None, limit: int = 50) -> DataFrame:
    """The last `limit` rows, in arrival order."""
    rows = reports if zone is None else reports.filter(F.col("zone") == zone)
    return rows.orderBy(F.desc("ts"), F.desc("report_id")).limit(limit).orderBy("ts", "report_id")
