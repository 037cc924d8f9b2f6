"""Alert rows for both channels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.functions.numeric import fixed_text


def _by_level(level: Column, templates: Mapping[str, Mapping], field: str, fill) -> Column:
    """Template text of the level; an unknown level reads as LOW.

    The texts are one constant map and places are filled once, after the lookup: a branch per level
    with its own replacements makes the row's method too large for the JVM to compile.
    """
    pairs = []
    for name, t in templates.items():
        pairs += [F.lit(name), fill.text(t[field])]
    texts = F.create_map(*pairs)
    found = F.coalesce(F.element_at(texts, level), fill.text(templates["LOW"][field]))
    return found if isinstance(templates["LOW"][field], list) else fill.places(found)


class _Fill:
    """Brand and authority go into the texts beforehand, zone and grid into the text of a row."""

    def __init__(self, zone: Column, grid: Column, brand: str, authority: str):
        self.zone, self.grid, self.brand, self.authority = zone, grid, brand, authority

    def text(self, value) -> Column:
        if isinstance(value, list):
            return F.array(*[F.lit(v.replace("{authority}", self.authority)) for v in value])
        return F.lit(value.replace("{brand}", self.brand))

    def places(self, text: Column) -> Column:
        return F.replace(F.replace(text, F.lit("{zone}"), self.zone), F.lit("{grid}"), self.grid)


def public_alerts(df: DataFrame, brand: str = "Flood", authority: str = "the municipal authority") -> DataFrame:
    """Rows (date, zone, zone_name, risk_level, risk_score, risk_trend, mode) to public alert rows."""
    fill = _Fill(F.col("zone_name"), F.col("zone"), brand, authority)
    text = lambda f: _by_level(F.col("risk_level"), fv.PUBLIC_TEMPLATES, f, fill)
    out = df.withColumns(
        {
            "headline": text("headline"),
            "status": text("status"),
            "simple_explanation": text("what_happening"),
            "what_to_do": text("what_to_do"),
            "tone": text("tone"),
            "trend_text": F.coalesce(F.lower("risk_trend"), F.lit("stable")),
        }
    )
    bullets = F.transform("what_to_do", lambda a: F.concat(F.lit("• "), a))
    return out.withColumn("safety_recommendation", F.array_join(bullets, "\n"))


def municipal_alerts(df: DataFrame, brand: str = "Flood") -> DataFrame:
    """Zone rows with components, prevention and environment to operational alert rows.

    A NULL water score leaves its text NULL. The scores are written by one function over their array:
    spelled out for each, exact rounding makes the row's method too large for the JVM to compile.
    """
    fill = _Fill(F.col("zone_name"), F.col("zone"), brand, "")
    text = lambda f: _by_level(F.col("risk_level"), fv.MUNICIPAL_TEMPLATES, f, fill)
    level = lambda c: F.concat(F.lit(" ("), F.col(c), F.lit(")"))
    scores = ["anomaly_score", "temporal_intensity", "vulnerability_score", "heat_score", "water_score"]
    written = lambda x: F.when(x.isNotNull(), F.concat(fixed_text(x, 1), F.lit("/100")))
    shown = df.withColumn("_texts", F.transform(F.array(*[F.col(c).cast("double") for c in scores]), written))
    score = lambda c: F.get("_texts", F.lit(scores.index(c)))
    return shown.withColumns(
        {
            "headline": text("headline"),
            "situation": text("situation"),
            "action_required": text("action_required"),
            "anomaly_text": score("anomaly_score"),
            "temporal_rainfall_text": score("temporal_intensity"),
            "vulnerability_text": score("vulnerability_score"),
            "heat_text": F.concat(score("heat_score"), level("heat_level")),
            "water_text": F.concat(score("water_score"), level("water_level")),
        }
    ).drop("_texts")


def alert_trigger(df: DataFrame, zone="zone", date="date", level="risk_level") -> DataFrame:
    """HIGH and CRITICAL always; otherwise when the level differs from the zone's previous row."""
    w = Window.partitionBy(zone).orderBy(date)
    before = F.lag(level).over(w)
    changed = F.coalesce(before != F.col(level), F.lit(False))
    return df.withColumns(
        {"previous_level": before, "should_alert": F.col(level).isin("HIGH", "CRITICAL") | changed}
    )


def alert_batch(df: DataFrame, first, last, channels=("public", "municipal")) -> DataFrame:
    """Triggered alerts of a date range, one row per (date, zone, channel), with a stable id.

    The trigger needs the day before, so the range is cut after the window; the id depends
    on the key only, which makes a repeated run write the same rows.
    """
    hits = alert_trigger(df).filter(F.col("should_alert") & F.col("date").between(first, last))
    rows = hits.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    return rows.withColumn("alert_id", alert_id())


#: The columns that an alert's id is made of.
ID_OF = ("date", "zone", "channel")


def alert_id() -> Column:
    """The id of an alert row, a hash of its date, zone and channel."""
    key = F.concat_ws("|", F.date_format("date", "yyyy-MM-dd"), "zone", "channel")
    return F.sha2(key, 256)


def batch_summary(alerts: DataFrame) -> DataFrame:
    """Rows per date and channel."""
    return alerts.groupBy("date", "channel").agg(F.count(F.lit(1)).alias("alerts"))


def risk_event_json(event: str, source: str) -> Column:
    """Outgoing risk update."""
    body = F.struct(
        F.lit(event).alias("event"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("zone").alias("grid_id"),
        F.struct(
            F.col("risk_score").alias("score"), F.col("risk_level").alias("level"), F.col("risk_trend").alias("trend")
        ).alias("risk"),
        F.struct("priority", "recommended_actions").alias("prevention"),
        F.struct(F.lit(source).alias("source")).alias("metadata"),
    )
    return F.to_json(body, {"ignoreNullFields": "false"})


def anomaly_event_json(event: str, source: str, model: str = "IsolationForest", version: str = "v1") -> Column:
    """Outgoing anomaly event; rule and hybrid sections stay null."""
    none = F.lit(None).cast("double")
    text = F.lit(None).cast("string")
    body = F.struct(
        F.lit(event).alias("event"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("zone").alias("grid_id"),
        F.struct("anomaly_score", "anomaly_percentile").alias("ml"),
        F.struct(none.alias("score"), text.alias("risk_level"), F.array().cast("array<string>").alias("recommended_actions")).alias("rule"),
        F.struct(none.alias("final_risk_score"), text.alias("risk_level")).alias("hybrid"),
        F.struct(
            F.lit(source).alias("source"), F.lit(model).alias("model"), F.lit(version).alias("model_version"), F.lit("RISK_EVENT").alias("event_type")
        ).alias("metadata"),
    )
    return F.to_json(body, {"ignoreNullFields": "false"})
