"""Window behaviour on small series, checked against plain loops."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pluvia.operators import quality, rank, series
from pluvia.plans.risk_table import score_rows

DAY0 = dt.date(2020, 1, 1)


def _series(spark, zones=4, days=40, seed=1, nulls=False):
    rng = random.Random(seed)
    data = []
    for z in range(zones):
        for d in range(days):
            v = float(rng.choice([0, 0, 0, 2, 5, 70, 120]))
            data.append((f"G{z}", DAY0 + dt.timedelta(d), None if nulls and rng.random() < 0.1 else v))
    rng.shuffle(data)
    return spark.createDataFrame(data, "zone string, date date, rain_mm double"), sorted(data)


def test_null_counts_of_windows(spark):
    df, _ = _series(spark)
    out = series.shifted_rolling(series.lags(df))
    for c, n in quality.expected_nulls().items():
        assert out.filter(F.col(c).isNull()).count() == 4 * n, c
    full = series.complete_rolling_sum(df)
    got = [full.filter(F.col(f"rainfall_{n}d").isNull()).count() for n in (3, 7, 14, 30)]
    assert got == [8, 24, 52, 116]


def test_dry_spell_counts_days_before(spark):
    df, data = _series(spark, nulls=True)
    got = {(r["zone"], r["date"]): r["consecutive_dry_days"] for r in series.dry_spell(df).collect()}
    run, last = 0, None
    for zone, date, v in data:
        if zone != last:
            run, last = 0, zone
        assert got[(zone, date)] == run
        run = run + 1 if v == 0 else 0


def test_trend_is_undefined_on_five_rows_per_zone(spark):
    df, _ = _series(spark)
    parts = df.select(
        "zone", "date", (F.col("rain_mm") / 2).alias("anomaly_score"), F.lit(10.0).alias("temporal_intensity"), F.lit(50.0).alias("vulnerability_score")
    )
    assert score_rows(parts).filter("risk_trend IS NULL").count() == 4 * 5


def test_expanding_percentile_uses_the_past_only(spark):
    df, data = _series(spark, zones=2, nulls=True)
    got = {(r["zone"], r["date"]): r["p"] for r in rank.expanding_percentile(df, "rain_mm", out="p").collect()}
    for zone in ("G0", "G1"):
        seen = []
        for z, date, v in data:
            if z != zone:
                continue
            v = v or 0.0
            seen.append(v)
            avg = sum(x < v for x in seen) + (sum(x == v for x in seen) + 1) / 2
            assert abs(got[(z, date)] - avg / len(seen) * 100) <= 0.0051


def test_daily_series_fills_the_span(spark):
    raw = spark.createDataFrame(
        [("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 1), 2.0), ("b", dt.date(2020, 1, 4), 5.0)], "z string, d date, v double"
    )
    out = {(r["zone"], r["date"].day): r["rain_mm"] for r in series.daily_series(raw, "z", "d", F.col("v")).collect()}
    assert len(out) == 8 and out[("a", 1)] == 3.0 and out[("b", 4)] == 5.0 and out[("b", 1)] == 0.0


def test_hot_zone_leaves_one_row_per_day(spark):
    """A zone with most raw rows shrinks to its days before any window sees it."""
    raw = spark.range(200_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("z"), (F.col("id") % 50).cast("string"))).alias("zone"),
        F.date_add(F.lit(DAY0), (F.col("id") % 30).cast("int")).alias("date"),
        F.lit(1.0).alias("v"),
    )
    out = series.daily_series(raw, "zone", "date", F.col("v"))
    assert out.groupBy("zone").count().agg(F.max("count")).first()[0] == 30
    assert out.agg(F.sum("rain_mm")).first()[0] == 200_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_quality_report_flags_faults(spark):
    df, _ = _series(spark)
    bad = df.unionByName(df.limit(1)).withColumns({"lat": F.lit(18.5), "lon": F.lit(73.75)})
    report = quality.validate_base(bad, "2020-01-01", "2020-02-09")
    status = {r["check_name"]: r["status"] for r in report.collect()}
    assert status["duplicate_records"] == "FAILED" and status["missing_days"] == "PASSED"
    import pytest

    with pytest.raises(ValueError, match="duplicate_records"):
        quality.assert_passed(report)
