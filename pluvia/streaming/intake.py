"""Micro-batch form of the report store: the same validation on a stream of submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pluvia.sources.stores import validated_reports

SUBMISSION = "zone string, report_type string, description string, ts timestamp_ntz"


def report_intake(spark: SparkSession, incoming: str, zones: DataFrame, accepted: str, checkpoint: str, keep: str = "30 days") -> StreamingQuery:
    """Files of submissions in, accepted reports appended as Parquet; zones is a static (zone) table.

    The file sink commits each batch once, so a restart neither loses nor repeats rows. Submissions that are
    sent again within `keep` of their arrival are dropped by their id, which is kept as state that long. The
    watermark is the time of arrival, so no report is ever too late.
    """
    known = zones.select("zone", F.lit(True).alias("_known"))
    rows = spark.readStream.schema(SUBMISSION).json(incoming).join(known, "zone", "left")
    checked = validated_reports(rows, F.coalesce("_known", F.lit(False))).filter(F.size("failures") == 0)
    once = checked.withColumn("received", F.current_timestamp()).withWatermark("received", keep).dropDuplicatesWithinWatermark(["report_id"])
    out = once.select("report_id", "zone", "report_type", "description", "ts", "status")
    return (
        out.writeStream.format("parquet")
        .option("path", accepted)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
