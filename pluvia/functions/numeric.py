"""Numeric column helpers whose results agree with float64 array arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(col: Column, digits: int) -> Column:
    """Scale, round half to even, scale back. NULL stays NULL; -0.0 becomes 0.0."""
    scale = float(10**digits)
    return F.rint(col * F.lit(scale)) / F.lit(scale) + F.lit(0.0)


def decimal_round(col: Column, digits: int) -> Column:
    """Round the exact binary value to `digits` decimals, ties to even, as printed text does.

    Scaling alone can land on a tie that the stored value is not (11.35 is a little less
    than 11.35). The rounding error of the product is recovered exactly by splitting the
    factor (Dekker's product), and its sign settles such ties.
    """
    if digits == 0:
        return F.rint(col) + F.lit(0.0)
    scale = F.lit(float(10**digits))
    p = col * scale
    c = col * F.lit(134217729.0)
    high = c - (c - col)
    low = col - high
    error = (high * scale - p) + low * scale
    tie = p - F.floor(p) == 0.5
    whole = F.when(tie & (error > 0), F.ceil(p)).when(tie & (error < 0), F.floor(p)).otherwise(F.rint(p))
    return whole.cast("double") / scale + F.lit(0.0)


def fixed_text(col: Column, digits: int) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", decimal_round(col, digits))


def clip(col: Column, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (greatest/least alone would skip it)."""
    return F.when(col.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), col)))


def nan_to_null(col: Column) -> Column:
    """Spark orders NaN above every number, so unknowns are kept as NULL."""
    return F.when(~F.isnan(col), col)


def is_infinite(col: Column) -> Column:
    return F.abs(col.cast("double")) == F.lit(float("inf"))
