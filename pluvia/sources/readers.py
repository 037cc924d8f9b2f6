"""Typed scans. Files are read with explicit types; nothing is inferred from the data."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import fixed_values as fv

GAUGE_TIME = "Data Acquisition Time"
GAUGE_LEVEL = "River Water Level Telemetry Hourly (meter)"


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """All columns as text, by header name; casts happen in the select, so pruning still works."""
    return spark.read.options(header=True, **options).csv(path)


def _require(df: DataFrame, cols: Sequence[str], what: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """S01."""
    raw = _csv(spark, path)
    _require(raw, ["City", "Latitude", "Longitude"], "site list")
    return raw.select(
        F.trim("City").alias("site"),
        F.col("Latitude").cast("double").alias("lat"),
        F.col("Longitude").cast("double").alias("lon"),
    )


def read_document(spark: SparkSession, path: str) -> dict:
    """A small JSON configuration document."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_thresholds(spark: SparkSession, path: str) -> dict:
    """Ordered classes (name, above, up to) and the heavy / extreme cut-offs."""
    doc = read_document(spark, path)
    classes = []
    for i, c in enumerate(doc["categories"]):
        classes.append((c["name"], None if i == 0 else c["min_mm"], c["max_mm"]))
    return {
        "categories": classes,
        "heavy": float(doc["heavy_rainfall_threshold_mm"]),
        "extreme": float(doc["extreme_event_threshold_mm"]),
    }


def read_cube(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    """Long daily rows (date, lat, lon, value) partitioned by year; years prune partitions.

    Years written with fewer columns get NULLs for the missing ones.
    """
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df if years is None else df.filter(F.col("year").isin(*years))


def read_gauges(spark: SparkSession, path: str, extra: Sequence[str] = ()) -> DataFrame:
    """A bad time drops the row, a bad level becomes NULL; only the named columns are parsed."""
    raw = _csv(spark, path, encoding="ISO-8859-1")
    _require(raw, ["Station", "Latitude", "Longitude", GAUGE_TIME, GAUGE_LEVEL], "gauge file")
    return raw.select(
        F.col("Station").alias("station"),
        F.col("Latitude").try_cast("double").alias("lat"),
        F.col("Longitude").try_cast("double").alias("lon"),
        F.try_to_timestamp(F.col(GAUGE_TIME), F.lit("dd-MM-yyyy HH:mm")).cast("timestamp_ntz").alias("ts"),
        F.col(GAUGE_LEVEL).try_cast("double").alias("level"),
        *extra,
    ).filter(F.col("ts").isNotNull())


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """S05."""
    raw = _csv(spark, path)
    _require(raw, ["event_id", "start_date", "end_date", "latitude", "longitude"], "event log")
    rest = [c for c in ("main_cause", "source", "flood") if c in raw.columns]
    return raw.select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("start_date").cast("date").alias("start_date"),
        F.col("end_date").cast("date").alias("end_date"),
        F.col("longitude").cast("double").alias("lon"),
        F.col("latitude").cast("double").alias("lat"),
        *rest,
    )


_LABELS = "date date, zone string, label int, source_id string"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_label_sources(spark: SparkSession, registry_path: str, rects: DataFrame, tile: float) -> tuple[DataFrame, list[str]]:
    """Labels of the registered files, expanded to days, and the warnings for skipped ones.

    The registry is a short configuration list; each entry adds one branch to a lazy union.
    """
    from pluvia.operators.joins import expand_dates
    from pluvia.operators.spatial import point_in_zone

    frames, warnings = [], []
    for src in read_document(spark, registry_path).get("registered_sources", []):
        if not _exists(spark, src["file"]):
            warnings.append(f"registered source missing: {src['file']}")
            continue
        raw = _csv(spark, src["file"])
        has_point = {"longitude", "latitude"} <= set(raw.columns)
        if not has_point and "Grid_ID" not in raw.columns:
            warnings.append(f"source {src['source_id']} has neither position nor zone: skipped")
            continue
        days = src["date_columns"]
        label = src.get("label_column", "flood")
        keyed = raw.select(
            F.col(days["start"]).cast("date").alias("start_date"),
            F.col(days["end"]).cast("date").alias("end_date"),
            F.col(label).cast("int").alias("label"),
            *(
                [F.col("longitude").cast("double").alias("lon"), F.col("latitude").cast("double").alias("lat")]
                if has_point
                else [F.col("Grid_ID").alias("zone")]
            ),
        )
        if has_point:
            keyed = point_in_zone(keyed, rects, tile).drop("lon", "lat")
        frames.append(
            expand_dates(keyed).select("date", "zone", "label", F.lit(src["source_id"]).alias("source_id"))
        )
    out = spark.createDataFrame([], _LABELS)
    for f in frames:
        out = out.unionByName(f)
    return out.filter(F.col("zone").isNotNull()).dropDuplicates(["date", "zone", "source_id"]), warnings


_FEATURE = T.StructType(
    [
        T.StructField("properties", T.StructType([T.StructField("name", T.StringType()), T.StructField("waterway", T.StringType())])),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ]
)
_COLLECTION = T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])


def read_lines(spark: SparkSession, path: str, newline_delimited: bool = False) -> DataFrame:
    """Rows (name, waterway, line) with line = array of [lon, lat]; other or empty geometries are dropped.

    One FeatureCollection document is one task by nature of the format; large layers come as
    one feature per line, which splits.
    """
    if newline_delimited:
        features = spark.read.schema(_FEATURE).json(path)
    else:
        doc = spark.read.schema(_COLLECTION).option("multiLine", True).json(path)
        features = doc.select(F.explode("features").alias("f")).select("f.*")
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    single = F.when(kind == "LineString", F.array(F.from_json(text, "array<array<double>>")))
    many = F.when(kind == "MultiLineString", F.from_json(text, "array<array<array<double>>>"))
    lines = features.select("properties.name", "properties.waterway", F.explode(F.coalesce(single, many)).alias("line"))
    return lines.filter(F.size("line") > 1)


def split_line_classes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(waterways, drainage)."""
    return (
        lines.filter(F.col("waterway").isin(*fv.WATERWAY_CLASSES)),
        lines.filter(F.col("waterway").isin(*fv.DRAINAGE_CLASSES)),
    )


def line_segments(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Consecutive vertex pairs of each line."""
    pairs = F.arrays_zip(
        F.slice("line", 1, F.size("line") - 1).alias("a"), F.slice("line", 2, F.size("line") - 1).alias("b")
    )
    seg = lines.select(*keep, F.posexplode(pairs).alias("seg", "p"))
    return seg.select(
        *keep, "seg",
        F.col("p.a")[0].alias("x1"), F.col("p.a")[1].alias("y1"), F.col("p.b")[0].alias("x2"), F.col("p.b")[1].alias("y2"),
    )


def read_projected(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Only the named columns of a wide Parquet table are read."""
    return spark.read.parquet(path).select(*cols)


def project(df: DataFrame, cols: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Fixed columns in a fixed order; all missing ones are reported at once."""
    _require(df, cols, "projection")
    return df.select(*[F.col(c).alias((rename or {}).get(c, c)) for c in cols])
