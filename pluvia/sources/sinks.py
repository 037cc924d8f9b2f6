"""Sinks: tables, zone features, snapshots and quality reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Rows are clustered by the partition column first, so a task writes few files per partition.

    With AQE the clustering splits a partition value that holds a large part of the rows.
    """
    out = df.hint("rebalance", partition_by) if partition_by else df
    writer = out.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def zone_features(df: DataFrame, properties: list[str], note: str) -> DataFrame:
    """One GeoJSON feature text per zone row with lo_x, lo_y, hi_x, hi_y."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(
        corner("lo_x", "lo_y"), corner("hi_x", "lo_y"), corner("hi_x", "hi_y"), corner("lo_x", "hi_y"), corner("lo_x", "lo_y")
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(*properties, F.lit(note).alias("disclaimer")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return df.select(F.to_json(feature).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    """One feature per line."""
    features.write.mode("overwrite").text(path)


def latest_snapshot(risk: DataFrame) -> DataFrame:
    """(zone, payload) of the newest date.

    The map keyed by zone stays a distributed table of key and JSON value, so its size is
    not limited by one row.
    """
    from pluvia.operators.topk import latest_rows

    payload = F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("date"), "risk_score", "risk_level", "risk_trend",
        F.struct(
            "anomaly_score", F.col("temporal_intensity").alias("temporal_rainfall_signal"), "vulnerability_score"
        ).alias("components"),
    )
    return latest_rows(risk).select("zone", F.to_json(payload, {"ignoreNullFields": "false"}).alias("payload"))


def write_quality_report(profile: DataFrame, path: str) -> None:
    """The per-site table and its one-row summary."""
    stored = f"{path}/sites"
    profile.write.mode("overwrite").parquet(stored)
    sites = profile.sparkSession.read.parquet(stored)
    quality_summary(sites).write.mode("overwrite").parquet(f"{path}/summary")


def quality_summary(profile: DataFrame) -> DataFrame:
    status = lambda c, bad: F.when(F.sum(c) == 0, "PASSED").otherwise(bad)
    return profile.agg(
        F.count(F.lit(1)).alias("sites"),
        F.sum("record_count").alias("observations"),
        F.min("start_date").alias("first_date"),
        F.max("end_date").alias("last_date"),
        status("duplicate_records", "FAILED").alias("duplicates"),
        status("negative_count", "FAILED").alias("negatives"),
        status("missing_values", "WARNING").alias("missing"),
    )


def write_card(spark: SparkSession, card: dict, path: str) -> None:
    """A model or run card as one small JSON document."""
    text = json.dumps(card, default=str, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)
