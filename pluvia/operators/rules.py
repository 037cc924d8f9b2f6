"""Declarative rules compiled to Columns (R01-R05): no row loop, no user function."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import fixed_values as fv
from pluvia.functions.classify import failures

_REQUIRED = ("rule_id", "condition", "action", "explanation")


def load_rules(spark: SparkSession, path: str) -> list[dict]:
    """Rules from a JSON document. A rule file is configuration: one small record on the driver."""
    text = spark.read.text(path, wholetext=True).first()[0]
    rules = json.loads(text).get("rules", [])
    check_rules(rules)
    return rules


def check_rules(rules: Sequence[Mapping]) -> None:
    for r in rules:
        missing = [k for k in _REQUIRED if k not in r]
        if missing:
            raise ValueError(f"malformed rule {r.get('rule_id')}: missing {missing}")
        if not isinstance(r["condition"], Mapping) or not r["condition"]:
            raise ValueError(f"rule {r['rule_id']}: condition must be a non-empty object")


def has_field(schema: T.StructType, dotted: str) -> bool:
    node: T.DataType = schema
    for part in dotted.split("."):
        if not isinstance(node, T.StructType) or part not in node.fieldNames():
            return False
        node = node[part].dataType
    return True


def _member(value: Column, options: Sequence) -> Column:
    """Null-safe membership: NULL is a member only if the list names it."""
    out = F.lit(False)
    for o in options:
        out = out | value.eqNullSafe(F.lit(o))
    return out


def predicate(schema: T.StructType, p: Mapping) -> Column:
    """Always true or false. An absent field is false; NULL never satisfies an order comparison."""
    if not has_field(schema, p["field"]):
        return F.lit(False)
    value, op, want = F.col(p["field"]), p["op"], p["value"]
    if op == "in":
        return _member(value, want)
    if op == "not_in":
        return ~_member(value, want)
    if op == "==":
        return value.eqNullSafe(F.lit(want))
    if op == "!=":
        return ~value.eqNullSafe(F.lit(want))
    compare = {">=": value >= want, "<=": value <= want, ">": value > want, "<": value < want}[op]
    return F.coalesce(compare, F.lit(False))


def _predicates(condition: Mapping) -> tuple[list[Mapping], str]:
    if "all" in condition:
        return list(condition["all"]), "AND"
    if "any" in condition:
        return list(condition["any"]), "OR"
    return [condition], "AND"


def condition(schema: T.StructType, cond: Mapping) -> Column:
    preds, word = _predicates(cond)
    out = F.lit(word == "AND")
    for p in preds:
        one = predicate(schema, p)
        out = (out & one) if word == "AND" else (out | one)
    return out


def render(cond: Mapping) -> str:
    """Text of a condition; an any-of list reads OR."""
    preds, word = _predicates(cond)
    return f" {word} ".join(f"{p['field']} {p['op']} {p['value']!r}" for p in preds)


def skipped_predicates(schema: T.StructType, rules: Sequence[Mapping]) -> list[str]:
    """rule:field pairs whose field the rows do not carry. Known from the schema alone."""
    out = set()
    for r in rules:
        for p in _predicates(r["condition"])[0]:
            if not has_field(schema, p["field"]):
                out.add(f"{r['rule_id']}:{p['field']}")
    return sorted(out)


def context_failures(zone_known: Column, reports: str = "citizen_reports") -> Column:
    """Names of the violated context constraints of a row."""
    trend = F.col("risk_trend")
    return failures(
        {
            "date": F.col("date").isNotNull(),
            "grid_id": zone_known,
            "risk_level": F.col("risk_level").isin(*fv.RISK_LEVELS),
            "risk_trend": trend.isNull() | trend.isin(*fv.TRENDS),
            "risk_score": F.col("risk_score").between(0, 100),
            "citizen_reports": F.col(reports) >= 0,
        }
    )


def priority(level: Column, trend: Column, reports: Column, ladder: Mapping = fv.PRIORITY) -> Column:
    """Base step of the level plus trend and report steps, capped at the last step."""
    order = ladder["order"]
    base, bonus = F.lit(0), F.lit(0)
    for name, step in ladder["base_by_level"].items():
        base = F.when(level == name, F.lit(order.index(step))).otherwise(base)
    for name, step in ladder["trend_bonus_steps"].items():
        bonus = F.when(trend == name, F.lit(step)).otherwise(bonus)
    extra = F.when(reports >= ladder["report_threshold"], ladder["report_bonus_steps"]).otherwise(0)
    rank = F.least(base + bonus + extra, F.lit(len(order) - 1))
    return F.element_at(F.array(*[F.lit(o) for o in order]), rank + 1)


def apply_rules(df: DataFrame, rules: Sequence[Mapping] = fv.RULES, ladder: Mapping = fv.PRIORITY) -> DataFrame:
    """All matching rules of a row in file order, plus the priority.

    Rows carry risk_level, risk_trend, citizen_reports and whatever fields the rules name.
    """
    check_rules(rules)
    hits = []
    for r in rules:
        text = render(r["condition"])
        item = F.struct(
            F.lit(r["rule_id"]).alias("rule_id"),
            F.lit(f"IF {text}").alias("condition"),
            F.lit(r["action"]).alias("action"),
            F.lit(r["explanation"]).alias("explanation"),
        )
        hits.append(F.when(condition(df.schema, r["condition"]), item))
    fired = F.array_compact(F.array(*hits))
    say = lambda t: F.concat(t["rule_id"], F.lit(": "), F.substr(t["condition"], F.lit(4)), F.lit(" -> "), t["explanation"])
    return df.withColumn("triggered_rules", fired).withColumns(
        {
            "recommended_actions": F.col("triggered_rules.action"),
            "explanations": F.transform("triggered_rules", say),
            "priority": priority(F.col("risk_level"), F.col("risk_trend"), F.col("citizen_reports"), ladder),
            "rules_source": F.lit("rule_based"),
        }
    )


def fired_counts(df: DataFrame, rules: Sequence[Mapping] = fv.RULES) -> DataFrame:
    """(rule_id, fired) how many rows match each rule that matches any.

    Whether a rule matches depends on the fields it names only, so rows are counted by those fields first and the
    rules are applied to each different combination.
    """
    check_rules(rules)
    named = {p["field"].split(".")[0] for r in rules for p in _predicates(r["condition"])[0]} | {"risk_level", "risk_trend", "citizen_reports"}
    alike = df.groupBy(*[c for c in df.columns if c in named]).agg(F.count(F.lit(1)).alias("_rows"))
    # the outer form: for the inner one the optimizer adds a filter that judges every row below the counts
    fired = apply_rules(alike, rules).select("_rows", F.explode_outer("triggered_rules.rule_id").alias("rule_id"))
    return fired.filter("rule_id IS NOT NULL").groupBy("rule_id").agg(F.sum("_rows").alias("fired"))


def checklist(prio: Column, lists: Mapping[str, Sequence[str]] = fv.CHECKLISTS) -> Column:
    """Tasks of a priority."""
    pairs = []
    for name, tasks in lists.items():
        pairs += [F.lit(name), F.array(*[F.lit(t) for t in tasks])]
    return F.create_map(*pairs)[prio]
