"""Data-quality suites: aggregates in one pass, tidy rows (check_name, status, value, expected)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import fixed_values as fv
from pluvia.functions.numeric import is_infinite
from pluvia.session import stored


def outside(col: Column, lo: float, hi: float) -> Column:
    return (col < lo) | (col > hi)


def missing_dates(df: DataFrame, zone="zone", date="date", start=None, end=None) -> DataFrame:
    """Expected days minus present days per zone. The span defaults to the whole table's.

    The gaps are read off neighbouring days of a zone; the full spine is never built.
    """
    keys = df.select(zone, date).distinct()
    if start is None or end is None:
        lo, hi = keys.agg(F.min(date)).scalar(), keys.agg(F.max(date)).scalar()
    else:
        lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    w = Window.partitionBy(zone).orderBy(date)
    before, after = F.lag(date).over(w), F.lead(date).over(w)
    gaps = keys.withColumns(
        {
            "_a": F.when(before.isNull(), lo),
            "_b": F.when(before.isNull(), F.least(F.date_sub(date, 1), hi)),
            "_c": F.greatest(F.date_add(date, 1), lo),
            "_d": F.least(F.coalesce(F.date_sub(after, 1), hi), hi),
        }
    )
    days = lambda x, y: F.when(F.col(x) <= F.col(y), F.sequence(x, y)).otherwise(F.array().cast("array<date>"))
    return gaps.select(zone, F.explode(F.concat(days("_a", "_b"), days("_c", "_d"))).alias(date))


def complete_grid(df: DataFrame, zone="zone", date="date") -> DataFrame:
    """Distinct dates x distinct zones against the present pairs; only counts are needed, so nothing is crossed."""
    pairs = df.select(zone, date).distinct()
    n = pairs.agg(
        (F.count_distinct(zone) * F.count_distinct(date)).alias("expected"), F.count(F.lit(1)).alias("present")
    )
    return n.withColumn("missing", F.col("expected") - F.col("present"))


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def _tidy(agg: DataFrame, checks: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Each check: name, value, expected value; equal means PASSED."""
    rows = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.when(value.eqNullSafe(want), "PASSED").otherwise("FAILED").alias("status"),
            value.cast("string").alias("value"),
            want.cast("string").alias("expected"),
        )
        for name, value, want in checks
    ]
    return agg.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _per_zone(df: DataFrame, zone: str, date: str, counts: dict[str, Column]) -> DataFrame:
    """Counts per (zone, day) first, then per zone: days need no distinct aggregate and a hot zone is combined early."""
    days = df.groupBy(zone, date).agg(F.count(F.lit(1)).alias("_n"), *[c.alias(k) for k, c in counts.items()])
    return days.groupBy(zone).agg(
        F.sum("_n").alias("_rows"),
        F.count(F.lit(1)).alias("_days"),
        F.min(date).alias("_first"),
        F.max(date).alias("_last"),
        *[F.sum(k).alias(k) for k in counts],
    )


def validate_base(df: DataFrame, first: str, last: str, zone="zone", date="date", value="rain_mm") -> DataFrame:
    """Q01: NULLs, duplicates, negatives, bounds, rows per zone, range and gaps."""
    require_columns(df, [zone, date, "lat", "lon", value])
    g = fv.GRID_BOUNDS
    z = _per_zone(
        df, zone, date,
        {
            "_null": F.count_if(F.col(value).isNull() | F.col(zone).isNull() | F.col(date).isNull()),
            "_neg": F.count_if(F.col(value) < 0),
            "_coord": F.count_if(outside(F.col("lat"), -90, 90) | outside(F.col("lon"), -180, 180)),
            "_grid": F.count_if(
                outside(F.col("lat"), g["min_lat"], g["max_lat"]) | outside(F.col("lon"), g["min_lon"], g["max_lon"])
            ),
        },
    )
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    days = F.date_diff(hi, lo) + 1
    agg = z.agg(
        F.sum("_null").alias("nulls"),
        F.sum(F.col("_rows") - F.col("_days")).alias("dups"),
        F.sum("_neg").alias("neg"),
        F.sum("_coord").alias("coord"),
        F.sum("_grid").alias("grid"),
        F.count_if(F.col("_rows") != days).alias("counts"),
        F.count_if((F.col("_first") != lo) | (F.col("_last") != hi)).alias("range"),
        F.sum(F.date_diff("_last", "_first") + 1 - F.col("_days")).alias("gaps"),
    )
    zero = F.lit(0)
    names = [
        ("missing_values", "nulls"), ("duplicate_records", "dups"), ("negative_values", "neg"),
        ("invalid_coordinates", "coord"), ("invalid_grid", "grid"), ("zones_with_wrong_row_count", "counts"),
        ("zones_with_wrong_range", "range"), ("missing_days", "gaps"),
    ]
    return _tidy(agg, [(n, F.col(c), zero) for n, c in names])


def assert_passed(report: DataFrame) -> None:
    """Raises with every failed check. Runs a job over the tidy rows (one per check)."""
    failed = [f"{r['check_name']}={r['value']} (expected {r['expected']})" for r in report.filter("status = 'FAILED'").collect()]
    if failed:
        raise ValueError("validation failed: " + "; ".join(failed))


def expected_nulls(lags: Sequence[int] = fv.LAG_DAYS, rolls: Sequence[int] = fv.ROLL_DAYS) -> dict[str, int]:
    """NULLs per zone: n for lag n, 1 for a shifted rolling window."""
    out = {f"lag_{n}d": n for n in lags}
    for n in rolls:
        out[f"rolling_{n}d"] = 1
        out[f"accumulated_{n}d"] = 1
    return out


def type_mismatches(df: DataFrame, expected: dict[str, type[T.DataType]]) -> list[str]:
    """Columns whose type is not of the expected family; read from the schema, no job."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return [c for c, t in expected.items() if c in types and not isinstance(types[c], t)]


def validate_final(df: DataFrame, zones: int | None, first: str, last: str, zone="zone", date="date", value="rain_mm") -> DataFrame:
    """Q02 and Q03: ten checks on the feature table of a series build.

    With zones=None the expected NULL counts scale with the zones found.
    """
    nulls = {c: n for c, n in expected_nulls().items() if c in df.columns}
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    inf = F.count_if(F.exists(F.array(*[is_infinite(F.col(c)) for c in numeric]), lambda x: F.coalesce(x, F.lit(False))))
    z = _per_zone(
        df, zone, date,
        {
            "_null": F.count_if(F.col(value).isNull()),
            "_neg": F.count_if(F.col(value) < 0),
            "_inf": inf,
            **{f"_null_{c}": F.count_if(F.col(c).isNull()) for c in nulls},
        },
    )
    off = F.lit(0)
    for c, n in nulls.items():
        off = off + (F.col(f"_null_{c}") != n).cast("int")
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    agg = z.agg(
        F.count(F.lit(1)).alias("zones"),
        F.count_if(F.col("_rows") != F.date_diff(hi, lo) + 1).alias("counts"),
        F.min("_first").alias("first"),
        F.max("_last").alias("last"),
        F.sum("_null").alias("nulls"),
        F.sum(F.col("_rows") - F.col("_days")).alias("dups"),
        F.sum("_neg").alias("neg"),
        F.sum(off).cast("bigint").alias("feat"),
        F.sum("_inf").alias("inf"),
        F.sum(F.date_diff("_last", "_first") + 1 - F.col("_days")).alias("gaps"),
    )
    ints = (T.IntegerType, T.LongType)
    wanted = {zone: T.StringType, date: T.DateType, value: T.DoubleType, "year": ints, "month": ints, "day": ints,
              "rainy_day": ints, "dry_day": ints, "is_heavy": ints, "is_extreme": ints}
    zero = F.lit(0)
    checks = [
        ("number_of_zones", F.col("zones"), F.col("zones") if zones is None else F.lit(zones)),
        ("zones_with_wrong_row_count", F.col("counts"), zero),
        ("first_date", F.col("first"), lo),
        ("last_date", F.col("last"), hi),
        ("core_missing_values", F.col("nulls"), zero),
        ("duplicate_keys", F.col("dups"), zero),
        ("negative_values", F.col("neg"), zero),
        ("unexpected_null_counts", F.col("feat"), zero),
        ("infinite_values", F.col("inf"), zero),
        ("missing_days", F.col("gaps"), zero),
        ("wrong_types", F.lit(len(type_mismatches(df, wanted))), zero),
    ]
    return _tidy(agg, checks)


def validate_zone_table(df: DataFrame, ref: DataFrame, ref_zone: str, first: str, last: str) -> DataFrame:
    """Q03: Q02 plus the comparison of one zone with a reference series."""
    from pluvia.operators.joins import compare_series

    cmp = compare_series(df.filter(F.col("zone") == ref_zone).select("date", "rain_mm"), ref, "rain_mm")
    extra = _tidy(
        cmp,
        [("reference_value_mismatches", F.col("value_mismatches"), F.lit(0)),
         ("reference_date_mismatches", F.col("date_mismatches"), F.lit(0))],
    )
    return validate_final(df, None, first, last).unionByName(extra)


def validate_features(df: DataFrame, rain_cols: Sequence[str], zone="zone", date="date") -> DataFrame:
    """Q04: shape, duplicates, complete grid, infinities, negatives, gauge coverage and positives of the feature table."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    inf = F.count_if(F.exists(F.array(*[is_infinite(F.col(c)) for c in numeric]), lambda x: F.coalesce(x, F.lit(False))))
    neg = F.count_if(F.exists(F.array(*[F.col(c) < 0 for c in rain_cols]), lambda x: F.coalesce(x, F.lit(False))))
    # counts per (zone, day), stored: the table is evaluated once, and zones and dates are counted from them
    cells = stored(df.groupBy(zone, date).agg(
        F.count(F.lit(1)).alias("_rows"), inf.alias("_inf"), neg.alias("_neg"),
        F.count("river_level_daily_mean_m").alias("_gauge"), F.sum("flood_event_active").alias("_pos"),
    ), "feature-cells")
    z = cells.groupBy(zone).agg(*[F.sum(c).alias(c) for c in ("_rows", "_inf", "_neg", "_gauge", "_pos")], F.count(date).alias("_days"))
    dates = cells.agg(F.count_distinct(date)).scalar()
    agg = z.agg(
        F.sum("_rows").alias("rows"),
        F.sum(F.col("_rows") - F.col("_days")).alias("dups"),
        F.sum("_days").alias("pairs"),
        F.count(F.lit(1)).alias("zones"),
        F.sum("_inf").alias("inf"),
        F.sum("_neg").alias("neg"),
        F.sum("_gauge").alias("gauge"),
        F.sum("_pos").alias("pos"),
    ).withColumn("dates", dates)
    return agg.select(
        "rows", F.lit(len(df.columns)).alias("columns"), "zones", "dates", "dups",
        (F.col("zones") * F.col("dates") - F.col("pairs")).alias("missing_pairs"), "inf", "neg",
        "gauge", F.col("pos").alias("positives"),
    )


def feature_guards(df: DataFrame, forbidden: Sequence[str] = fv.FORBIDDEN_FEATURES, keys=("zone", "date"), rows: int | None = None) -> DataFrame:
    """Q05: forbidden columns absent, no infinities, no duplicate keys, fixed row count. Runs jobs.

    Returns the guarded rows, stored: they are evaluated once for the guards and whatever follows.
    """
    present = sorted(set(forbidden) & set(df.columns))
    if present:
        raise ValueError(f"forbidden features present: {present}")
    df = stored(df, "guarded-features")
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_infinite(F.col(c))).alias(c) for c in numeric]).first()
    infinite = [c for c in numeric if counts[c]]
    if infinite:
        raise ValueError(f"infinite values in {infinite}")
    if rows is not None and counts["n"] != rows:
        raise ValueError(f"unexpected row count {counts['n']}")
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"duplicate {list(keys)}")
    return df
