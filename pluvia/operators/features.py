"""Model feature columns, imputation and row selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.operators.rank import exact_quantiles
from pluvia.session import stored


def training_medians(df: DataFrame, cols: Sequence[str], fit: Column) -> dict[str, float]:
    """Exact median per column over the fit rows. Runs jobs; one number per column reaches the driver."""
    rows = exact_quantiles(df.filter(fit), cols, [0.5]).select("column", "value").collect()
    medians = {r["column"]: r["value"] for r in rows}
    missing = [c for c in cols if medians.get(c) is None]
    if missing:
        raise ValueError(f"no training median for {missing}")
    return medians


def impute_training_medians(df: DataFrame, cols: Sequence[str], fit: Column) -> DataFrame:
    """All rows filled with the medians of the fit rows."""
    medians = training_medians(df, cols, fit)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c])) for c in cols})


def exclude_event_buffer(df: DataFrame, event_days: DataFrame, days: int = fv.EVENT_BUFFER_DAYS, date="date") -> DataFrame:
    """Drop rows within `days` of any event date, in all zones. The date list is bounded by the calendar."""
    around = F.explode(F.sequence(F.date_sub(date, days), F.date_add(date, days)))
    buffer = event_days.select(date).distinct().select(around.alias(date)).distinct()
    return df.join(buffer, date, "left_anti")


def fit_flag(df: DataFrame, event_days: DataFrame, train: Column, days: int = fv.EVENT_BUFFER_DAYS, date="date") -> DataFrame:
    """J10 as a flag: is_fit marks training rows outside every event buffer."""
    around = F.explode(F.sequence(F.date_sub(date, days), F.date_add(date, days)))
    buffer = event_days.select(date).distinct().select(around.alias(date)).distinct().withColumn("_near", F.lit(True))
    marked = df.join(buffer, date, "left")
    return marked.withColumn("is_fit", train & F.col("_near").isNull()).drop("_near")


def prepare(df: DataFrame, event_days: DataFrame, train: Column, cols: Sequence[str]) -> DataFrame:
    """M01 with J10 and D22: fit flag, then gaps of all rows filled by the medians of the fit rows. Runs jobs.

    The flagged rows are stored: the medians and whatever is made of the rows read them, the series is built once.
    """
    marked = stored(fit_flag(df, event_days, train), "prepared")
    return impute_training_medians(marked, cols, F.col("is_fit"))


def feature_matrix(df: DataFrame) -> DataFrame:
    """Season sum NULL -> 0 before June only, gauge availability flag, forbidden columns left out."""
    level_mean, level_max = F.col("river_level_daily_mean_m"), F.col("river_level_daily_max_m")
    season = F.col("monsoon_rainfall_to_date")
    filled = F.when(season.isNull() & (F.month("date") < 6), F.lit(0.0)).otherwise(season)
    dynamic = [c for c in fv.DYNAMIC_FEATURES if c in df.columns and c != "monsoon_rainfall_to_date"]
    static = [c for c in fv.STATIC_FEATURES if c in df.columns]
    return df.select(
        "zone",
        "date",
        *dynamic,
        filled.alias("monsoon_rainfall_to_date"),
        (level_mean.isNotNull() & level_max.isNotNull()).cast("double").alias("river_level_available"),
        *static,
    )


def period(date: Column, train_to: str, eval_from: str) -> Column:
    """Training / evaluation / other by date."""
    return (
        F.when(date <= F.lit(train_to).cast("date"), "training")
        .when(date >= F.lit(eval_from).cast("date"), "evaluation")
        .otherwise("other")
    )


def chronological_split(date: Column, train_last: int, valid_last: int) -> Column:
    """Train / valid / test by year."""
    y = F.year(date)
    return F.when(y <= train_last, "train").when(y <= valid_last, "valid").otherwise("test")


def stratified_holdout(df: DataFrame, label: str, key: str, share: float = 0.25, seed: int = 42) -> DataFrame:
    """Exactly round-down(share * class size) rows of each class, chosen by a seeded hash of the key.

    Classes are few and large, so rows are not ranked inside one class task: they are placed
    once in the global order (class, hash, key) and compared with the class offset. Runs jobs.
    """
    from pluvia.operators.isolation_forest import row_hash
    from pluvia.operators.rank import global_position

    hashed = df.withColumn("_h", row_hash([key], seed))
    placed = global_position(hashed, [label, "_h", key], "_p")
    sizes = placed.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.min("_p").alias("_first"))
    # hinted, a row per class: shuffled by the class, the rows of one would be read by one task
    out = placed.join(F.broadcast(sizes), label)
    return out.withColumn("is_test", F.col("_p") - F.col("_first") < F.floor(F.col("_n") * share)).drop(
        "_h", "_p", "_n", "_first"
    )


def spatial_block_split(df: DataFrame, lon: str = "longitude") -> DataFrame:
    """West of (or on) the exact median longitude trains, east tests. Runs jobs for the median."""
    mid = exact_quantiles(df, [lon], [0.5]).select("value").scalar()
    return df.withColumn("is_train", F.col(lon) <= mid)
