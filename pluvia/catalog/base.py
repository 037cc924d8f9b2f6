"""Registry and the domain views the queries read, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.operators.series import complete_rolling_sum, daily_series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query. `views` names the SQL views its oracle starts from."""

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return wrap


# One SQL text per view; later ones may use earlier ones.
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "zone_day": (
        (),
        """zd_raw AS (SELECT 'Z' || lpad(CAST(l_suppkey AS VARCHAR), 7, '0') AS zone,
                 CAST(l_shipdate AS DATE) AS date, sum(2.0 * l_quantity) AS r FROM lineitem GROUP BY 1, 2),
           zd_span AS (SELECT min(date) AS lo, max(date) AS hi FROM zd_raw),
           zd_spine AS (SELECT zone, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date
                        FROM (SELECT DISTINCT zone FROM zd_raw), zd_span),
           zone_day AS (SELECT s.zone, s.date, coalesce(r.r, 0.0) AS rain_mm
                        FROM zd_spine s LEFT JOIN zd_raw r ON s.zone = r.zone AND s.date = r.date)""",
    ),
    # the same series with unknown days: 1 in 41
    "obs": (
        ("zone_day",),
        """obs AS (SELECT zone, date, CASE WHEN (day(date) * 7 + month(date) + CAST(substr(zone, 2) AS BIGINT)) % 41 = 0
                   THEN NULL ELSE rain_mm END AS rain_mm FROM zone_day)""",
    ),
    "zones": (
        (),
        """zones AS (SELECT 'Z' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS zone,
                 8e0 + 0.25e0 * (s_suppkey % 80) AS lat, 68e0 + 0.25e0 * (s_suppkey // 80) AS lon,
                 s_acctbal AS elevation_mean_m, CAST((s_suppkey * 37) % 101 AS DOUBLE) AS built_up_pct,
                 CAST((s_suppkey * 53) % 97 AS DOUBLE) AS vegetation_pct,
                 CAST((s_suppkey * 29) % 89 AS DOUBLE) AS water_cover_pct,
                 CAST((s_suppkey * 71) % 1009 AS DOUBLE) AS distance_to_nearest_waterway_m,
                 CAST((s_suppkey * 83) % 1013 AS DOUBLE) AS distance_to_nearest_drainage_m,
                 CAST((s_suppkey * 17) % 31 AS DOUBLE) AS slope_mean_deg FROM supplier)""",
    ),
    "sites": (
        (),
        """sites AS (SELECT c_name AS site, 67.8e0 + ((c_custkey * 7919) % 1000) / 1000e0 AS lon,
                 7.8e0 + ((c_custkey * 104729) % 20200) / 1000e0 AS lat FROM customer)""",
    ),
    # readings 25 years earlier, so that they fall into the years of the rain series
    "gauge": (
        (),
        """gauge AS (SELECT 'S' || CAST(user_id AS VARCHAR) AS station, event_id,
                 date_trunc('minute', ts) - INTERVAL 9131 DAY AS ts, CASE WHEN event_id % 17 = 0 THEN NULL ELSE floor(value) END AS level,
                 67.9e0 + (user_id % 50) / 100e0 AS lon, 7.9e0 + (user_id % 190) / 10e0 AS lat
                 FROM events)""",
    ),
    "event_range": (
        (),
        """event_range AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS start_date, o_totalprice AS price,
                 CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS end_date,
                 'Z' || lpad(CAST(o_custkey % 100 AS VARCHAR), 7, '0') AS zone,
                 68e0 + 0.25e0 * ((o_custkey % 100) // 80) + ((o_orderkey % 7) - 3) / 20e0 AS lon,
                 8e0 + 0.25e0 * ((o_custkey % 100) % 80) + ((o_orderkey % 5) - 2) / 20e0 AS lat
                 FROM orders)""",
    ),
    # a sparse log for exclusion windows: one event per nation
    "storm_days": (
        (),
        """storm_days AS (SELECT DISTINCT CAST(unnest(generate_series(s, s + CAST(n_nationkey % 3 AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS d
             FROM (SELECT n_nationkey, DATE '1995-02-03' + CAST(n_nationkey * 67 AS INTEGER) AS s FROM nation))""",
    ),
    "rain_features": (
        ("zone_day",),
        """rain_features AS (SELECT zone, date, rain_mm, rain_mm AS rainfall_1d,
             CASE WHEN count(*) OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
               THEN sum(rain_mm) OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS rainfall_7d,
             CASE WHEN count(*) OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) = 30
               THEN sum(rain_mm) OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS rainfall_30d
             FROM zone_day)""",
    ),
    # a score table made of exact numbers: anomaly from the calendar, intensity from the 7-day sum
    "scored": (
        ("rain_features",),
        """sc_parts AS (SELECT zone, date, rainfall_1d, rainfall_7d, rainfall_30d,
               CAST((date_diff('day', DATE '1995-01-01', date) * 31 + CAST(substr(zone, 2) AS BIGINT) * 17) % 10001 AS DOUBLE) / 100e0 AS anomaly_score,
               least(100.0, coalesce(rainfall_7d, 0.0) / 4.0) AS temporal_intensity,
               CAST((CAST(substr(zone, 2) AS BIGINT) * 13) % 101 AS DOUBLE) AS vulnerability_score FROM rain_features),
           sc_score AS (SELECT *, round_even((anomaly_score * 0.45 + temporal_intensity * 0.3 + vulnerability_score * 0.25) * 100.0, 0) / 100e0 AS risk_score FROM sc_parts),
           sc_delta AS (SELECT *, CASE WHEN row_number() OVER z > 5 THEN
               round_even((avg(risk_score) OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
                         - avg(risk_score) OVER (PARTITION BY zone ORDER BY date ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING)) * 100.0, 0) / 100e0 + 0.0 END AS risk_delta_3d
               FROM sc_score WINDOW z AS (PARTITION BY zone ORDER BY date)),
           scored AS (SELECT *,
               CASE WHEN risk_score < 40 THEN 'LOW' WHEN risk_score < 60 THEN 'MODERATE' WHEN risk_score < 80 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
               CASE WHEN risk_delta_3d IS NULL THEN NULL WHEN risk_delta_3d >= 10 THEN 'STRONGLY_INCREASING' WHEN risk_delta_3d >= 3 THEN 'INCREASING'
                    WHEN risk_delta_3d > -3 THEN 'STABLE' ELSE 'DECREASING' END AS risk_trend,
               CASE WHEN vulnerability_score < 45 THEN 'LOW' WHEN vulnerability_score < 65 THEN 'MODERATE' ELSE 'HIGH' END AS vulnerability_level
               FROM sc_delta)""",
    ),
    "reports": (
        (),
        """reports AS (SELECT event_id, 'Z' || lpad(CAST(user_id % 100 AS VARCHAR), 7, '0') AS zone,
               ['WATERLOGGING', 'FLOODING', 'BLOCKED_DRAIN', 'OTHER', 'NOISE'][1 + event_id % 5] AS report_type,
               CASE WHEN event_id % 11 = 0 THEN '  ' ELSE props END AS description, ts FROM events)""",
    ),
    "segments": (
        (),
        """segments AS (SELECT p_partkey // 4 AS line_id, CAST(p_partkey % 4 AS INTEGER) AS seg,
               ['river', 'stream', 'canal', 'drain', 'ditch'][1 + (p_partkey // 4) % 5] AS waterway,
               ((p_partkey * 37) % 1000) * 10e0 AS x1, ((p_partkey * 91) % 997) * 10e0 AS y1,
               ((p_partkey * 37) % 1000) * 10e0 + (p_size - 25) * 12e0 AS x2, ((p_partkey * 91) % 997) * 10e0 + (p_partkey % 19 - 9) * 30e0 AS y2
               FROM part)""",
    ),
    "pixels": (
        (),
        """pixels AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS "row", CAST(o_orderkey % 100 AS INTEGER) AS col,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE floor(o_totalprice / 1000e0) END AS z,
               CAST([0, 10, 20, 30, 40, 50, 60, 80, 90, 50, 50][1 + o_custkey % 11] AS INTEGER) AS cls FROM orders)""",
    ),
    "labelled": (
        (),
        """labelled AS (SELECT l.doc_id, l.quality AS y, (d.n_chars % 1000) / 1000e0 AS p
               FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
    ),
}


def with_views(sql: str, views: tuple[str, ...]) -> str:
    seen: list[str] = []

    def need(name):
        for dep in SQL_VIEWS[name][0]:
            need(dep)
        if name not in seen:
            seen.append(name)

    for v in views:
        need(v)
    body = sql.strip()
    if not seen:
        return body
    ctes = ",\n".join(SQL_VIEWS[n][1] for n in seen)
    return f"WITH {ctes},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"


def zone_id(key):
    return F.concat(F.lit("Z"), F.lpad(key.cast("string"), 7, "0"))


def zone_number(zone="zone"):
    return F.substring(zone, 2, 20).cast("bigint")


def pick(values, index):
    """Element of a fixed list by a 0-based index column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Views:
    """Domain views over the shared tables; each attribute access builds a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def zone_day(self) -> DataFrame:
        raw = self.table("lineitem").select(zone_id(F.col("l_suppkey")).alias("zone"), "l_shipdate", "l_quantity")
        return daily_series(raw, "zone", "l_shipdate", F.lit(2.0) * F.col("l_quantity"))

    @property
    def obs(self) -> DataFrame:
        hole = (F.dayofmonth("date") * 7 + F.month("date") + zone_number()) % 41 == 0
        return self.zone_day.withColumn("rain_mm", F.when(~hole, F.col("rain_mm")))

    @property
    def zones(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            zone_id(k).alias("zone"),
            (F.lit(8.0) + F.lit(0.25) * (k % 80)).alias("lat"),
            (F.lit(68.0) + F.lit(0.25) * F.floor(k / 80)).alias("lon"),
            F.col("s_acctbal").alias("elevation_mean_m"),
            ((k * 37) % 101).cast("double").alias("built_up_pct"),
            ((k * 53) % 97).cast("double").alias("vegetation_pct"),
            ((k * 29) % 89).cast("double").alias("water_cover_pct"),
            ((k * 71) % 1009).cast("double").alias("distance_to_nearest_waterway_m"),
            ((k * 83) % 1013).cast("double").alias("distance_to_nearest_drainage_m"),
            ((k * 17) % 31).cast("double").alias("slope_mean_deg"),
        )

    @property
    def sites(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            F.col("c_name").alias("site"),
            (F.lit(67.8) + ((k * 7919) % 1000) / F.lit(1000.0)).alias("lon"),
            (F.lit(7.8) + ((k * 104729) % 20200) / F.lit(1000.0)).alias("lat"),
        )

    @property
    def gauge(self) -> DataFrame:
        u, e = F.col("user_id"), F.col("event_id")
        return self.table("events").select(
            F.concat(F.lit("S"), u.cast("string")).alias("station"),
            "event_id",
            (F.date_trunc("minute", "ts").cast("timestamp_ntz") - F.expr("INTERVAL 9131 DAYS")).alias("ts"),
            F.when(e % 17 != 0, F.floor("value").cast("double")).alias("level"),
            (F.lit(67.9) + (u % 50) / F.lit(100.0)).alias("lon"),
            (F.lit(7.9) + (u % 190) / F.lit(10.0)).alias("lat"),
        )

    @property
    def storm_range(self) -> DataFrame:
        k = F.col("n_nationkey")
        start = F.date_add(F.lit("1995-02-03").cast("date"), (k * 67).cast("int"))
        return self.table("nation").select(start.alias("start_date"), F.date_add(start, (k % 3).cast("int")).alias("end_date"))

    @property
    def event_range(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey") % 100
        start = F.col("o_orderdate").cast("date")
        return self.table("orders").select(
            k.alias("event_id"),
            F.col("o_totalprice").alias("price"),
            start.alias("start_date"),
            F.date_add(start, (k % 3).cast("int")).alias("end_date"),
            zone_id(c).alias("zone"),
            (F.lit(68.0) + F.lit(0.25) * F.floor(c / 80) + ((k % 7) - 3) / F.lit(20.0)).alias("lon"),
            (F.lit(8.0) + F.lit(0.25) * (c % 80) + ((k % 5) - 2) / F.lit(20.0)).alias("lat"),
        )

    @property
    def rain_features(self) -> DataFrame:
        return complete_rolling_sum(self.zone_day, days=(7, 30)).withColumn("rainfall_1d", F.col("rain_mm"))

    @property
    def scored_parts(self) -> DataFrame:
        return self.signals(self.rain_features)

    def signals(self, features: DataFrame, *keep: str) -> DataFrame:
        n = zone_number()
        days = F.date_diff("date", F.lit("1995-01-01").cast("date"))
        return features.select(
            *keep,
            "zone",
            "date",
            "rainfall_1d",
            "rainfall_7d",
            "rainfall_30d",
            (((days * 31 + n * 17) % 10001).cast("double") / 100.0).alias("anomaly_score"),
            F.least(F.lit(100.0), F.coalesce(F.col("rainfall_7d"), F.lit(0.0)) / 4.0).alias("temporal_intensity"),
            ((n * 13) % 101).cast("double").alias("vulnerability_score"),
        )

    @property
    def scored(self) -> DataFrame:
        from pluvia.plans.risk_table import score_rows

        return score_rows(self.scored_parts)

    @property
    def reports(self) -> DataFrame:
        e = F.col("event_id")
        return self.table("events").select(
            "event_id",
            zone_id(F.col("user_id") % 100).alias("zone"),
            pick(["WATERLOGGING", "FLOODING", "BLOCKED_DRAIN", "OTHER", "NOISE"], e % 5).alias("report_type"),
            F.when(e % 11 == 0, F.lit("  ")).otherwise(F.col("props")).alias("description"),
            "ts",
        )

    @property
    def segments(self) -> DataFrame:
        k = F.col("p_partkey")
        x1 = ((k * 37) % 1000) * F.lit(10.0)
        y1 = ((k * 91) % 997) * F.lit(10.0)
        line = F.floor(k / 4)
        return self.table("part").select(
            line.alias("line_id"),
            (k % 4).cast("int").alias("seg"),
            pick(["river", "stream", "canal", "drain", "ditch"], line % 5).alias("waterway"),
            x1.alias("x1"),
            y1.alias("y1"),
            (x1 + (F.col("p_size") - 25) * F.lit(12.0)).alias("x2"),
            (y1 + (k % 19 - 9) * F.lit(30.0)).alias("y2"),
        )

    @property
    def pixels(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            F.floor(k / 100).cast("int").alias("row"),
            (k % 100).cast("int").alias("col"),
            F.when(k % 31 != 0, F.floor(F.col("o_totalprice") / 1000.0).cast("double")).alias("z"),
            pick([0, 10, 20, 30, 40, 50, 60, 80, 90, 50, 50], F.col("o_custkey") % 11).alias("cls"),
        )

    @property
    def labelled(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "n_chars")
        return self.table("labels").join(docs, "doc_id").select(
            "doc_id", F.col("quality").alias("y"), ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("p")
        )
