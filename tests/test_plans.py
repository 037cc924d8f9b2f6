"""Plans of the main chain: few exchanges, pruned scans, limits before the shuffle."""

import os

import pytest
from pyspark.sql import functions as F

from pluvia.catalog.base import Views
from pluvia.operators import series, topk
from pluvia.plans.risk_table import risk_table

SF = os.environ.get("PLUVIA_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _exchanges(df):
    return _plan(df).count("Exchange hashpartitioning")


def test_all_windows_share_the_exchange_of_the_series(spark):
    v = Views(spark, SF)
    base = _exchanges(v.zone_day)
    assert base == 3  # one to add up (zone, day), one by zone; the span's own is the first again when it runs
    wide = series.with_previous_month_climatology(series.with_previous_year(series.complete_rolling_sum(v.zone_day)))
    wide = series.season_to_date(series.month_to_date(series.shifted_rolling(series.lags(wide))))
    assert _exchanges(wide) == base
    # the expanding rank is an Arrow stage: its output is clustered again for the trend window
    assert _exchanges(risk_table(v.scored_parts.drop("temporal_intensity"))) == base + 1


def test_series_reads_its_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    raw = spark.range(3000).selectExpr("concat('z', id % 7) AS zone", "date_add(DATE'2020-01-01', cast(id % 400 AS int)) AS date", "1.0D AS v")
    out = series.daily_series(raw.mapInArrow(counted, raw.schema), "zone", "date", F.col("v"))
    total, n = out.agg(F.sum("rain_mm"), F.count("*")).first()
    assert (total, n, reads.value) == (3000.0, 7 * 400, 3000)


def test_scan_reads_only_the_used_columns(spark):
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double,l_shipdate" in _plan(Views(spark, SF).zone_day)


def test_top_k_is_limited_before_the_shuffle(spark):
    top = topk.top_per_group(Views(spark, SF).table("lineitem"), "l_suppkey", "l_quantity", ["l_orderkey", "l_linenumber"], 3)
    assert "WindowGroupLimit" in _plan(top) and "Partial" in _plan(top)


def test_profiles_read_the_table_once(spark, monkeypatch):
    from pluvia.operators import stats

    seen = []
    keep = stats.stored
    monkeypatch.setattr(stats, "stored", lambda df, name: seen.append(_plan(df)) or keep(df, name))
    rows = Views(spark, SF).obs
    for out in (stats.column_profile(rows), stats.missing_profile(rows), stats.range_profile(rows, ["rain_mm"]), stats.numeric_describe(rows, ["rain_mm"])):
        plan = _plan(out)
        assert "Expand" not in plan and "lineitem" not in plan  # all that follows reads the stored counts
    assert len(seen) == 4 and all("Expand" not in p and "partial_count" in p for p in seen)


def test_both_ranks_take_one_order(spark, monkeypatch):
    from pluvia.operators import rank

    orders = []
    keep = rank._fixed_order
    monkeypatch.setattr(rank, "_fixed_order", lambda df, order: orders.append(order) or keep(df, order))
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0), (4, 2.0), (5, None)], "k int, v double")
    got = {r["k"]: (r["baseline_percentile"], r["baseline_rank"]) for r in rank.baseline_rank(rows, "v", ["k"]).collect()}
    assert len(orders) == 1
    assert got == {1: (0.0, 2), 4: (25.0, 3), 3: (50.0, 1), 2: (75.0, 4), 5: (100.0, 5)}


def test_tasks_of_a_series_follow_its_input(spark, monkeypatch):
    raw = spark.range(3000).selectExpr("concat('z', id % 70) AS zone", "date_add(DATE'2020-01-01', cast(id % 400 AS int)) AS date", "1.0D AS v")

    def tasks(size):
        monkeypatch.setattr(series, "TASK_BYTES", size)
        out = series.daily_series(raw, "zone", "date", F.col("v"))
        # counted after the run: adaptive execution must not put the zones together again
        held = series.complete_rolling_sum(out).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("rain_mm").alias("v")).collect()
        assert sum(r["n"] for r in held) == 70 * 400 and sum(r["v"] for r in held) == 3000.0
        return len(held)

    assert tasks(1 << 40) <= spark.sparkContext.defaultParallelism < 30 < tasks(500)
