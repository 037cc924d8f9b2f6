"""Rule and alert queries: R."""

from __future__ import annotations

from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.catalog.base import Views, query
from pluvia.catalog.scoring import _PRIO, ZR_SQL, ZR_VIEWS
from pluvia.operators import alerts as al
from pluvia.operators import rules as rl

# the rule table in SQL: conditions by hand, so the compiler is checked against something else
_COND = {
    "RULE_LOW_ROUTINE_MONITOR": "risk_level = 'LOW'",
    "RULE_MOD_INCREASED_MONITORING": "risk_level = 'MODERATE'",
    "RULE_MOD_PREPARE_RESOURCES_RISING": "risk_level = 'MODERATE' AND coalesce(risk_trend IN ('INCREASING', 'STRONGLY_INCREASING'), false)",
    "RULE_HIGH_INSPECT_DRAINAGE": "risk_level = 'HIGH'",
    "RULE_HIGH_DEPLOY_RESOURCES": "risk_level = 'HIGH'",
    "RULE_HIGH_ADVISORY": "risk_level = 'HIGH'",
    "RULE_HIGH_MONITOR_VULNERABLE_AREAS": "risk_level = 'HIGH'",
    "RULE_CRIT_IMMEDIATE_RESPONSE": "risk_level = 'CRITICAL'",
    "RULE_CRIT_EMERGENCY_RESOURCES": "risk_level = 'CRITICAL'",
    "RULE_CRIT_NOTIFY_DISASTER_MGMT": "risk_level = 'CRITICAL'",
    "RULE_CRIT_URGENT_ADVISORY": "risk_level = 'CRITICAL'",
    "RULE_CRIT_CONTINUOUS_MONITORING": "risk_level = 'CRITICAL'",
    "RULE_TREND_ESCALATION_RISING": "risk_level IN ('HIGH', 'CRITICAL') AND coalesce(risk_trend IN ('INCREASING', 'STRONGLY_INCREASING'), false)",
    "RULE_TREND_DECREASING_DOWNGRADE_WATCH": "coalesce(risk_trend = 'DECREASING', false) AND risk_level <> 'CRITICAL'",
    "RULE_CITIZEN_REPORTS_VERIFY": "reports >= 1",
    "RULE_CITIZEN_REPORTS_CLUSTER_ESCALATE": "reports >= 4",
}
_CTX = """cx AS (SELECT s.zone, s.date, risk_score, risk_level, risk_trend, rainfall_1d, CAST((day(date) * 3 + CAST(substr(s.zone, 2) AS BIGINT)) % 6 AS BIGINT) AS reports FROM scored s)"""


def context(v: Views):
    n = F.substring("zone", 2, 20).cast("bigint")
    return v.scored.select(
        "zone", "date", "risk_score", "risk_level", "risk_trend",
        ((F.dayofmonth("date") * 3 + n) % 6).alias("citizen_reports"),
        F.struct("rainfall_1d").alias("environmental_context"),
    )


def _joined(items):
    return "array_to_string(list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL), '|')"


def _quote(text):
    return "'" + text.replace("'", "''") + "'"


@query(
    "R01_rule_definitions",
    f"""WITH {_CTX}, f AS (SELECT unnest([{", ".join(f"CASE WHEN {_COND[r['rule_id']]} THEN '{r['rule_id']}' END" for r in fv.RULES)}]) AS rule_id FROM cx)
    SELECT rule_id, count(*) AS fired FROM f WHERE rule_id IS NOT NULL GROUP BY 1""",
    ("scored",),
)
def _(v: Views):
    # written as JSON by Spark and read back through the loader, so the file form is exercised
    from pluvia.session import scratch_path

    path = scratch_path(v.spark, "rules.json")
    import json

    doc = json.dumps({"rules": fv.RULES})
    v.spark.range(1).select(F.lit(doc).alias("value")).coalesce(1).write.text(path)
    return rl.fired_counts(context(v), rl.load_rules(v.spark, path))


_DEMO = [
    "CASE WHEN risk_level IN ('HIGH', 'CRITICAL') AND coalesce(risk_trend IN ('INCREASING', 'STRONGLY_INCREASING'), false) THEN 'RULE_DEMO_ESCALATE_HIGH_RISING' END",
    "CASE WHEN risk_level = 'MODERATE' AND (risk_trend IS NULL OR risk_trend = 'STABLE') THEN 'RULE_DEMO_MONITOR_MODERATE' END",
    "CASE WHEN risk_level = 'LOW' AND (risk_trend IS NULL OR risk_trend NOT IN ('INCREASING', 'STRONGLY_INCREASING')) THEN 'RULE_DEMO_ROUTINE_LOW' END",
    "CASE WHEN rainfall_1d >= 75 THEN 'RULE_DEMO_HEAVY_RAIN_AWARENESS' END",
]


@query("R02_predicates", f"WITH {_CTX} SELECT zone, date, {_joined(_DEMO)} AS rules FROM cx", ("scored",))
def _(v: Views):
    out = rl.apply_rules(context(v), fv.DEMO_RULES)
    return out.select("zone", "date", F.array_join("triggered_rules.rule_id", "|").alias("rules"))


_ACT = [f"CASE WHEN {_COND[r['rule_id']]} THEN {_quote(r['action'])} END" for r in fv.RULES]
_EXP = [f"CASE WHEN {_COND[r['rule_id']]} THEN {_quote(r['rule_id'] + ': ' + rl.render(r['condition']) + ' -> ' + r['explanation'])} END" for r in fv.RULES]


@query("R03_rule_application", f"WITH {_CTX} SELECT zone, date, {_joined(_ACT)} AS actions, {_joined(_EXP)} AS explanations, {_PRIO} AS priority FROM cx", ("scored",))
def _(v: Views):
    out = rl.apply_rules(context(v))
    return out.select(
        "zone", "date", F.array_join("recommended_actions", "|").alias("actions"), F.array_join("explanations", "|").alias("explanations"), "priority"
    )


@query(
    "R04_context_validation",
    f"""WITH {_CTX}, z AS (SELECT zone AS z FROM zones WHERE zone < 'Z0000090')
    SELECT zone, date, array_to_string(list_filter([CASE WHEN z IS NULL THEN 'grid_id' END, CASE WHEN NOT (risk_score BETWEEN 0 AND 100) THEN 'risk_score' END,
      CASE WHEN reports - 1 < 0 THEN 'citizen_reports' END], lambda x: x IS NOT NULL), ',') AS failures FROM cx LEFT JOIN z ON cx.zone = z.z""",
    ("scored", "zones"),
)
def _(v: Views):
    known = v.zones.filter("zone < 'Z0000090'").select("zone", F.lit(True).alias("known"))
    rows = context(v).withColumn("citizen_reports", F.col("citizen_reports") - 1).join(known, "zone", "left")
    return rows.select("zone", "date", F.array_join(rl.context_failures(F.coalesce("known", F.lit(False))), ",").alias("failures"))


@query("R05_priority_ladder", f"WITH {_CTX} SELECT zone, date, {_PRIO} AS priority FROM cx", ("scored",))
def _(v: Views):
    p = rl.priority(F.col("risk_level"), F.col("risk_trend"), F.col("citizen_reports"))
    return context(v).select("zone", "date", p.alias("priority"))


_LISTS = " ".join(f"WHEN '{k}' THEN {_quote('|'.join(t))}" for k, t in fv.CHECKLISTS.items())


@query("R06_checklists", f"WITH {_CTX} SELECT zone, date, CASE {_PRIO} {_LISTS} END AS checklist FROM cx", ("scored",))
def _(v: Views):
    p = rl.priority(F.col("risk_level"), F.col("risk_trend"), F.col("citizen_reports"))
    return context(v).select("zone", "date", F.array_join(rl.checklist(p), "|").alias("checklist"))


def _tmpl(templates, field, fill=lambda x: _quote(x)):
    cases = " ".join(f"WHEN '{k}' THEN {fill(t[field])}" for k, t in templates.items())
    return f"CASE risk_level {cases} END"


_HEAD = lambda x: "replace(replace(" + _quote(x.replace("{brand}", "Flood")) + ", '{zone}', 'Zone ' || substr(zone, 2)), '{grid}', zone)"
_BUL = lambda xs: _quote("\n".join("• " + x.replace("{authority}", "the municipal authority") for x in xs))


def _named(df):
    return df.withColumn("zone_name", F.concat(F.lit("Zone "), F.substring("zone", 2, 20)))


@query(
    "R07_public_alert_rows",
    f"""SELECT zone, date, risk_level, risk_score, {_tmpl(fv.PUBLIC_TEMPLATES, 'headline', _HEAD)} AS headline, {_tmpl(fv.PUBLIC_TEMPLATES, 'status')} AS status,
      {_tmpl(fv.PUBLIC_TEMPLATES, 'what_happening')} AS simple_explanation, {_tmpl(fv.PUBLIC_TEMPLATES, 'what_to_do', _BUL)} AS safety_recommendation,
      {_tmpl(fv.PUBLIC_TEMPLATES, 'tone')} AS tone, coalesce(lower(risk_trend), 'stable') AS trend_text FROM scored""",
    ("scored",),
)
def _(v: Views):
    rows = _named(v.scored.select("zone", "date", "risk_level", "risk_score", "risk_trend"))
    return al.public_alerts(rows).select(
        "zone", "date", "risk_level", "risk_score", "headline", "status", "simple_explanation", "safety_recommendation", "tone", "trend_text"
    )


def _st(c, lvl=None):
    t = f"printf('%.1f', {c}) || '/100'"
    t = f"{t} || ' (' || {lvl} || ')'" if lvl else t
    return f"CASE WHEN {c} IS NOT NULL THEN {t} END"


@query(
    "R08_municipal_alert_rows",
    f"""WITH {ZR_SQL} SELECT zone, date, {_tmpl(fv.MUNICIPAL_TEMPLATES, 'headline', _HEAD)} AS headline, {_tmpl(fv.MUNICIPAL_TEMPLATES, 'situation')} AS situation,
      {_tmpl(fv.MUNICIPAL_TEMPLATES, 'action_required')} AS action_required, {_PRIO} AS priority, {_st('anomaly_score')} AS anomaly_text, {_st('temporal_intensity')} AS temporal_rainfall_text,
      {_st('vulnerability_score')} AS vulnerability_text, {_st('heat_score', 'heat_level')} AS heat_text, {_st('water_score', 'water_level')} AS water_text FROM zr""",
    ZR_VIEWS,
)
def _(v: Views):
    from pluvia.catalog.scoring import zone_table

    z = zone_table(v)
    flat = z.select(
        "date", "zone", "zone_name", F.col("risk.level").alias("risk_level"), F.col("risk.components.anomaly").alias("anomaly_score"),
        F.col("risk.components.temporal_rainfall").alias("temporal_intensity"), F.col("vulnerability.score").alias("vulnerability_score"),
        F.col("environment.heat.score").alias("heat_score"), F.col("environment.heat.level").alias("heat_level"),
        F.col("environment.water.score").alias("water_score"), F.col("environment.water.level").alias("water_level"), "prevention.priority",
    )
    return al.municipal_alerts(flat).select(
        "zone", "date", "headline", "situation", "action_required", "priority", "anomaly_text", "temporal_rainfall_text", "vulnerability_text", "heat_text", "water_text"
    )


_TRIG = """tg AS (SELECT zone, date, risk_level, lag(risk_level) OVER (PARTITION BY zone ORDER BY date) AS previous_level FROM scored),
    sa AS (SELECT *, risk_level IN ('HIGH', 'CRITICAL') OR coalesce(previous_level <> risk_level, false) AS should_alert FROM tg)"""


@query("R09_alert_trigger", f"WITH {_TRIG} SELECT * FROM sa", ("scored",))
def _(v: Views):
    return al.alert_trigger(v.scored.select("zone", "date", "risk_level"))


@query(
    "R10_alert_batch",
    f"""WITH {_TRIG} SELECT zone, date, risk_level, channel, sha256(strftime(date, '%Y-%m-%d') || '|' || zone || '|' || channel) AS alert_id
    FROM sa, (VALUES ('public'), ('municipal')) c(channel) WHERE should_alert AND date BETWEEN DATE '1998-06-01' AND DATE '1998-09-30'""",
    ("scored",),
)
def _(v: Views):
    rows = v.scored.select("zone", "date", "risk_level")
    lo, hi = F.lit("1998-06-01").cast("date"), F.lit("1998-09-30").cast("date")
    return al.alert_batch(rows, lo, hi).select("zone", "date", "risk_level", "channel", "alert_id")


@query(
    "R10_alert_counts",
    f"WITH {_TRIG} SELECT date, channel, count(*) AS alerts FROM sa, (VALUES ('public'), ('municipal')) c(channel) WHERE should_alert GROUP BY 1, 2",
    ("scored",),
)
def _(v: Views):
    rows = v.scored.select("zone", "date", "risk_level")
    return al.batch_summary(al.alert_batch(rows, F.lit("1900-01-01").cast("date"), F.lit("2100-01-01").cast("date")))


@query(
    "R11_risk_event_json",
    """SELECT zone, date, risk_score AS score, 'flood_risk.updated|' || strftime(date, '%Y-%m-%d') || '|' || zone || '|' || risk_level || '|' || coalesce(risk_trend, 'null') || '|ROUTINE|x|pluvia' AS fields FROM scored""",
    ("scored",),
)
def _(v: Views):
    # the payload is read back, since number formatting in JSON differs between engines
    rows = v.scored.withColumns({"priority": F.lit("ROUTINE"), "recommended_actions": F.array(F.lit("x"))})
    shape = (
        "event string, date string, grid_id string, risk struct<score double, level string, trend string>, "
        "prevention struct<priority string, recommended_actions array<string>>, metadata struct<source string>"
    )
    p = rows.select("zone", "date", F.from_json(al.risk_event_json("flood_risk.updated", "pluvia"), shape).alias("p"))
    fields = F.concat_ws(
        "|", "p.event", "p.date", "p.grid_id", "p.risk.level", F.coalesce("p.risk.trend", F.lit("null")), "p.prevention.priority",
        F.array_join("p.prevention.recommended_actions", ","), "p.metadata.source",
    )
    return p.select("zone", "date", F.col("p.risk.score").alias("score"), fields.alias("fields"))


@query(
    "R11_anomaly_event_json",
    """SELECT zone, date, anomaly_score AS score, CAST(floor(anomaly_score) AS INTEGER) AS percentile, 'anomaly.detected|' || strftime(date, '%Y-%m-%d') || '|' || zone || '|null|0|null|IsolationForest|v1|RISK_EVENT' AS fields FROM scored""",
    ("scored",),
)
def _(v: Views):
    rows = v.scored_parts.withColumn("anomaly_percentile", F.floor("anomaly_score").cast("int"))
    shape = (
        "event string, date string, grid_id string, ml struct<anomaly_score double, anomaly_percentile int>, "
        "rule struct<score double, risk_level string, recommended_actions array<string>>, hybrid struct<final_risk_score double, risk_level string>, "
        "metadata struct<model string, model_version string, event_type string>"
    )
    p = rows.select("zone", "date", F.from_json(al.anomaly_event_json("anomaly.detected", "pluvia"), shape).alias("p"))
    fields = F.concat_ws(
        "|", "p.event", "p.date", "p.grid_id", F.coalesce(F.col("p.rule.score").cast("string"), F.lit("null")),
        F.size("p.rule.recommended_actions").cast("string"), F.coalesce("p.hybrid.risk_level", F.lit("null")),
        "p.metadata.model", "p.metadata.model_version", "p.metadata.event_type",
    )
    return p.select("zone", "date", F.col("p.ml.anomaly_score").alias("score"), F.col("p.ml.anomaly_percentile").alias("percentile"), fields.alias("fields"))
