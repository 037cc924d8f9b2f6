"""Every registered query with a SQL twin gives the twin's rows on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = os.environ.get("PLUVIA_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
MODEL_FITS = {n for n in QUERIES if n not in ORACLES}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "<null>"
    return repr(float(v)) if isinstance(v, float) else str(v)


def _table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = df.toArrow()
    want = duck.sql(ORACLES[name])
    assert sorted(got.column_names) == sorted(want.columns)
    got_rows = list(zip(*[got.column(i).to_pylist() for i in range(got.num_columns)]))
    assert _table(got.column_names, got_rows) == _table(want.columns, want.fetchall())


def test_every_operator_is_registered():
    wanted = [f"S{i:02d}" for i in range(1, 17)] + [f"P{i:02d}" for i in range(1, 28)] + [f"J{i:02d}" for i in range(1, 24)]
    wanted += [f"D{i:02d}" for i in range(1, 36)] + [f"E{i:02d}" for i in range(1, 19)] + [f"F{i:02d}" for i in range(1, 8)]
    wanted += [f"G{i:02d}" for i in range(1, 8)] + [f"Q{i:02d}" for i in range(1, 6)] + [f"R{i:02d}" for i in range(1, 12)]
    wanted += [f"M{i:02d}" for i in range(1, 12)]
    have = {n.split("_")[0] for n in QUERIES}
    assert [w for w in wanted if w not in have] == []


def test_entry_has_one_row_per_zone(spark):
    out = entry_module.entry(spark)
    assert out.count() == out.select("zone").distinct().count() > 0
