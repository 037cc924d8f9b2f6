"""Rule scenarios, priorities, stores and the streaming intake."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.operators import alerts as al
from pluvia.operators import metrics
from pluvia.operators import rules as rl
from pluvia.sources import stores
from pluvia.streaming.intake import report_intake

CTX = "date date, zone string, risk_score double, risk_level string, risk_trend string, citizen_reports int"
D = dt.date(2024, 7, 15)


def _ctx(rows, *cases):
    return rows(CTX, *[(D, "z", s, lvl, t, n) for s, lvl, t, n in cases])


LADDER = ["ROUTINE", "ELEVATED", "HIGH", "URGENT"]
LEVELS = [(10.0, "LOW"), (45.0, "MODERATE"), (72.0, "HIGH"), (95.0, "CRITICAL")]
TRENDS = ["STABLE", "INCREASING", "STRONGLY_INCREASING"]
COUNTS = [0, 1, 3, 8]


def test_every_combination(rows):
    """Without trend or reports a level has its own rung; neither trend nor reports ever lower it."""
    cases = [(s, level, t, n) for s, level in LEVELS for t in TRENDS for n in COUNTS]
    got = {}
    for r in rl.apply_rules(_ctx(rows, *cases)).collect():
        got[r["risk_level"], r["risk_trend"], r["citizen_reports"]] = LADDER.index(r["priority"])
        assert len(r["triggered_rules"]) == len(r["recommended_actions"]) == len(r["explanations"])
        assert len(set(r["triggered_rules"])) == len(r["triggered_rules"])
    assert len(got) == len(cases)
    for rung, (_, level) in enumerate(LEVELS):
        assert got[level, "STABLE", 0] == rung
        for t in TRENDS:
            for n, more in zip(COUNTS, COUNTS[1:]):
                assert got[level, t, n] <= got[level, t, more]
            assert got[level, t, 0] >= rung


def test_null_and_absent_fields(rows):
    df = _ctx(rows, (50.0, "MODERATE", None, 0), (10.0, "LOW", None, 0))
    fired = [r["triggered_rules"] for r in rl.apply_rules(df, fv.DEMO_RULES).collect()]
    assert [[t["rule_id"] for t in f] for f in fired] == [["RULE_DEMO_MONITOR_MODERATE"], ["RULE_DEMO_ROUTINE_LOW"]]
    assert rl.skipped_predicates(df.schema, fv.DEMO_RULES) == ["RULE_DEMO_HEAVY_RAIN_AWARENESS:environmental_context.rainfall_1d"]


def test_fired_counts(rows):
    """Counts are those of the rules applied to every row, and no condition is judged again below the counts."""
    some = [(10.0, "LOW", None, 0), (20.0, "LOW", None, 0), (95.0, "CRITICAL", "INCREASING", 4), (45.0, None, None, None), (45.0, None, None, None)]
    df = _ctx(rows, *some, *[(s, level, t, n) for s, level in LEVELS for t in TRENDS + [None] for n in COUNTS])
    want = {}
    for r in rl.apply_rules(df).collect():
        for t in r["triggered_rules"]:
            want[t["rule_id"]] = want.get(t["rule_id"], 0) + 1
    out = rl.fired_counts(df)
    assert dict(map(tuple, out.collect())) == want
    assert rl.fired_counts(_ctx(rows, (45.0, None, None, None))).collect() == []


def test_rule_definitions_judge_counts_not_rows(spark, tmp_path):
    """R01's conditions stand in the plan once, above the counts of equal rows."""
    import __spark_entry__ as entry

    day = F.expr("timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(CAST(id AS INT))")
    items = spark.range(40).select((F.col("id") % 2 + 1).alias("l_suppkey"), day.alias("l_shipdate"), F.lit(30.0).alias("l_quantity"))
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = entry.queries()["R01_rule_definitions"](spark, str(tmp_path))
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    judged = [k for k, line in enumerate(lines) if "RULE_LOW_ROUTINE_MONITOR" in line]
    counted = [k for k, line in enumerate(lines) if "Aggregate [risk_level" in line]
    assert len(judged) == len(counted) == 1 and judged <= counted, lines
    assert {r["rule_id"] for r in out.collect()} >= {"RULE_CITIZEN_REPORTS_VERIFY"}


def test_any_condition_reads_or(rows):
    rule = {"rule_id": "R", "action": "a", "explanation": "e",
            "condition": {"any": [{"field": "risk_level", "op": "==", "value": "LOW"}, {"field": "citizen_reports", "op": ">", "value": 3}]}}
    r = rl.apply_rules(_ctx(rows, (50.0, "HIGH", None, 4)), [rule]).first()
    assert r["triggered_rules"][0]["condition"] == "IF risk_level == 'LOW' OR citizen_reports > 3"
    with pytest.raises(ValueError, match="missing"):
        rl.apply_rules(_ctx(rows, (1.0, "LOW", None, 0)), [{"rule_id": "x"}])


def test_events_keep_nulls(rows):
    df = rl.apply_rules(_ctx(rows, (50.5, "MODERATE", None, 0)))
    doc = json.loads(df.select(al.risk_event_json("e", "s").alias("j")).first()["j"])
    assert doc["risk"] == {"score": 50.5, "level": "MODERATE", "trend": None} and doc["date"] == "2024-07-15"
    ml = df.withColumns({"anomaly_score": F.lit(80.0), "anomaly_percentile": F.lit(80)})
    doc = json.loads(ml.select(al.anomaly_event_json("e", "s").alias("j")).first()["j"])
    assert doc["rule"] == {"score": None, "risk_level": None, "recommended_actions": []}
    assert doc["hybrid"] == {"final_risk_score": None, "risk_level": None}


def test_trigger(rows):
    data = [(dt.date(2024, 1, i + 1), "z", lvl) for i, lvl in enumerate(["LOW", "LOW", "MODERATE", "MODERATE", "HIGH", "HIGH", "LOW"])]
    out = al.alert_trigger(rows("date date, zone string, risk_level string", *data)).orderBy("date")
    assert [r["should_alert"] for r in out.collect()] == [False, False, True, False, True, True, True]


def test_alert_store_is_idempotent(spark, rows, tmp_path):
    data = [(dt.date(2024, 1, i + 1), f"z{i % 3}", "HIGH") for i in range(9)]
    batch = al.alert_batch(rows("date date, zone string, risk_level string", *data), F.lit(dt.date(2024, 1, 1)), F.lit(dt.date(2024, 1, 31)))
    path = str(tmp_path / "alerts")
    stores.append_alerts(batch, path)
    stores.append_alerts(batch, path)
    assert spark.read.parquet(path).count() == 18
    newest = stores.list_alerts(spark, path, "public", 3, zone="z0").collect()
    assert [r["date"].day for r in newest] == [7, 4, 1] and {r["channel"] for r in newest} == {"public"}
    assert stores.list_alerts(spark, path, "municipal", 50, date=dt.date(2024, 1, 2)).count() == 1


def test_latest_preference_wins(rows):
    ts = lambda h: dt.datetime(2024, 1, 1, h)
    log = rows("username string, zone string, min_level string, updated_at timestamp_ntz", ("u", "a", "LOW", ts(1)), ("u", "a", "HIGH", ts(3)), ("u", "a", "MODERATE", ts(2)))
    assert [r["min_level"] for r in stores.current_preferences(log, "min_level").collect()] == ["HIGH"]


def test_stream_intake_equals_batch(spark, rows, tmp_path):
    data = [
        ("a", "FLOODING", "water on road", dt.datetime(2024, 1, 1)), ("b", "FLOODING", "x", dt.datetime(2024, 1, 2)),
        ("a", "NOISE", "x", dt.datetime(2024, 1, 3)), ("a", "OTHER", "  ", dt.datetime(2024, 1, 4)), ("a", "OTHER", "y", None),
    ]
    reports = rows("zone string, report_type string, description string, ts timestamp_ntz", *data)
    zones = rows("zone string", ("a",))
    reports.write.json(str(tmp_path / "in"))
    q = report_intake(spark, str(tmp_path / "in"), zones, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    known = zones.withColumn("k", F.lit(True))
    checked = stores.validated_reports(reports.join(known, "zone", "left"), F.coalesce("k", F.lit(False)))
    want = checked.filter(F.size("failures") == 0)
    assert sorted(r["report_id"] for r in got.collect()) == sorted(r["report_id"] for r in want.collect())
    assert got.count() == 2 and got.filter("ts IS NULL").count() == 0
    reasons = {r["description"]: r["failures"] for r in checked.collect()}
    assert reasons["  "] == ["description required"]


def test_label_gate(rows):
    few = rows("date date, zone string, label int", *[(dt.date(2015, 7, i + 1), "z4", 1) for i in range(5)])
    r = metrics.label_gate(few).first()
    assert not r["passed"] and len(r["reasons"]) == 4
    many = [(dt.date(2015 + i % 4, 7, 1 + i % 20), f"z{i % 4}", 1) for i in range(40)]
    assert metrics.label_gate(rows("date date, zone string, label int", *many)).first()["passed"]
    assert metrics.label_gate(few.filter("label = 0")).first()["positives"] == 0


def test_alert_texts_fit_a_compiled_method(spark, capsys):
    """The JVM never compiles a method of 8000 bytes or more; it would be interpreted for every row."""
    import re

    level = F.element_at(F.array(*[F.lit(x) for x in ("LOW", "HIGH", None, "ODD")]), (F.col("id") % 4 + 1).cast("int"))
    score = F.when(F.col("id") % 3 > 0, F.col("id") / 8)
    rows = spark.range(12).select(
        "id", level.alias("risk_level"), F.lit("Zone 1").alias("zone_name"), F.concat(F.lit("Z"), "id").alias("zone"),
        *[score.alias(c) for c in ("anomaly_score", "temporal_intensity", "vulnerability_score", "heat_score", "water_score")],
        *[F.lit("LOW").alias(c) for c in ("heat_level", "water_level")],
    )
    out = al.municipal_alerts(rows)
    got = {r["id"]: r for r in out.collect()}
    assert got[0]["heat_text"] is None and got[0]["water_text"] is None and got[0]["anomaly_text"] is None
    assert got[10]["heat_text"] == "1.2/100 (LOW)" and got[10]["anomaly_text"] == "1.2/100"
    assert got[2]["situation"] == got[3]["situation"] == got[0]["situation"] != got[1]["situation"]
    out.explain("codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
