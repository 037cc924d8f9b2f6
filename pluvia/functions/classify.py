"""Bands, classes, flags and score formulas as plain Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.functions.numeric import clip, round_to


def band(score: Column, bands: Mapping[str, tuple[float, float]], strict: bool = True) -> Column:
    """Half-open lookup min <= s < max. Outside every band fails when strict; NULL stays NULL."""
    expr = F.when(score.isNull(), F.lit(None).cast("string"))
    for name, (lo, hi) in bands.items():
        expr = expr.when((score >= lo) & (score < hi), F.lit(name))
    if strict:
        return expr.otherwise(
            F.raise_error(F.concat(F.lit("score outside configured bands: "), score.cast("string")))
        )
    return expr


def trend_class(delta: Column, thresholds: Sequence[tuple[str, float]] = fv.TREND_THRESHOLDS) -> Column:
    """P10: the first two thresholds include their bound, STABLE excludes it."""
    (strong, strong_at), (rising, rising_at), (stable, stable_at), (falling, _) = thresholds
    return (
        F.when(delta.isNull(), F.lit(None).cast("string"))
        .when(delta >= strong_at, F.lit(strong))
        .when(delta >= rising_at, F.lit(rising))
        .when(delta > stable_at, F.lit(stable))
        .otherwise(F.lit(falling))
    )


def wet_dry_flags(value: Column) -> dict[str, Column]:
    """A NULL value is neither wet nor dry."""
    return {
        "rainy_day": F.when(value > 0, 1).otherwise(0),
        "dry_day": F.when(value == 0, 1).otherwise(0),
    }


def intensity_category(value: Column, categories=fv.INTENSITY_CATEGORIES) -> Column:
    """(min, max] classes; zero, NULL and negative values all read Dry."""
    dry, *rest = categories
    expr = F.when(value == 0, F.lit(dry[0]))
    for name, lo, hi in rest:
        inside = value > lo if hi is None else (value > lo) & (value <= hi)
        expr = expr.when(inside, F.lit(name))
    return expr.otherwise(F.lit(dry[0]))


def hazard_flags(value: Column, heavy: float = fv.HEAVY_MM, extreme: float = fv.EXTREME_MM) -> dict[str, Column]:
    """Strictly above the cut-off; NULL counts as 0."""
    return {
        "is_heavy": F.coalesce((value > heavy).cast("int"), F.lit(0)),
        "is_extreme": F.coalesce((value > extreme).cast("int"), F.lit(0)),
    }


def risk_score(anomaly: Column, intensity: Column, vulnerability: Column, weights=fv.RISK_WEIGHTS) -> Column:
    """P11."""
    total = anomaly * weights["anomaly"] + intensity * weights["intensity"] + vulnerability * weights["vulnerability"]
    return round_to(total, 2)


def _steps(value: Column, steps: Sequence[tuple[float, float]]) -> Column:
    expr = None
    for above, points in steps:
        hit = value > above
        expr = F.when(hit, F.lit(points)) if expr is None else expr.when(hit, F.lit(points))
    return expr.otherwise(F.lit(0.0))


def point_risk(rain: Column, rain_7d: Column, built_up: Column, drainage: Column) -> Column:
    """Additive points from day rain, 7-day sum, built-up class and drainage class."""
    built = F.when(built_up == "High", 2.0).when(built_up == "Moderate", 1.0).otherwise(0.0)
    drain = F.when(drainage == "Poor", 2.0).when(drainage == "Moderate", 1.0).otherwise(0.0)
    return _steps(rain, fv.POINT_RAIN) + _steps(rain_7d, fv.POINT_RAIN_7D) + built + drain


def point_risk_label(points: Column) -> Column:
    return (
        F.when(points >= fv.POINT_HIGH, F.lit(fv.POINT_LABELS[0]))
        .when(points >= fv.POINT_MODERATE, F.lit(fv.POINT_LABELS[1]))
        .otherwise(F.lit(fv.POINT_LABELS[2]))
    )


def deficit_ratio(rain_30d: Column, baseline_mean: Column) -> Column:
    """clip(1 - rain / (30 * previous-year mean), 0, 1); NULL when an input is NULL."""
    expected = F.lit(30.0) * baseline_mean
    return clip(F.lit(1.0) - F.try_divide(rain_30d, expected), 0.0, 1.0)


def anomaly_status(score: Column, cut: float = 75.0) -> Column:
    """P18."""
    return F.when(score >= cut, F.lit("HIGH ANOMALY")).otherwise(F.lit("NORMAL/MODERATE ANOMALY"))


def anomaly_message(title: str) -> Column:
    """Message of a row with date, zone, anomaly_score and anomaly_percentile."""
    return F.struct(
        F.lit(title).alias("title"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("zone").alias("grid"),
        F.col("anomaly_score"),
        F.col("anomaly_percentile"),
        anomaly_status(F.col("anomaly_score")).alias("status"),
        F.lit(fv.ANOMALY_MESSAGE).alias("message"),
        F.lit(fv.ANOMALY_DISCLAIMER).alias("disclaimer"),
    )


def wetness_proxy(slope_deg: Column) -> Column:
    """ln(50 / tan(max(slope, 0.15)))."""
    floor = F.when(slope_deg.isNotNull(), F.greatest(slope_deg, F.lit(0.15)))
    return round_to(F.log(F.lit(50.0) / F.tan(F.radians(floor))), 2)


def failures(checks: Mapping[str, Column]) -> Column:
    """Names of the failed constraints of a row; a NULL check counts as failed."""
    marks = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.array_compact(F.array(*marks))


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)
