"""Scores, verdicts, rules and watchlists as column expressions and equi-joins."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.contracts import DEFAULT_THRESHOLD, RULE_ACTIONS, RULE_FIELDS, RULE_OPS, Rule

COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}
RULE_CHUNK = 200


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def heuristic_score(device_shift: Column, amount: Column) -> Column:
    return F.when((device_shift == 1) | (amount > 2000), F.lit(0.85)).otherwise(F.lit(0.05))


def verdict(score: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return F.when(score >= threshold, "FRAUD").when(score >= threshold * 0.5, "SUSPICIOUS").otherwise("SAFE")


def lifted(label: Column) -> Column:
    """One step up."""
    return F.when(label == "SAFE", "SUSPICIOUS").otherwise("FRAUD")


# ---------------------------------------------------------------- rules

def predicate(conditions, columns: list[str]) -> Column:
    """All conditions hold. A missing or null field counts as 0, no conditions or an unknown comparison never match."""
    def one(field, op, value):
        if op not in COMPARE:
            return F.lit(False)
        left = F.coalesce(F.col(field).cast("double"), F.lit(0.0)) if field in columns else F.lit(0.0)
        return COMPARE[op](left, F.lit(float(value)))
    return reduce(operator.and_, (one(*c) for c in conditions)) if conditions else F.lit(False)


def triggered(df: DataFrame, rules) -> Column:
    """Array of (id, name, action) of the rules that match the row."""
    hits = [F.when(predicate(r.conditions, df.columns),
                   F.struct(F.lit(r.id).alias("id"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action")))
            for r in rules]
    if not hits:
        return F.array().cast("array<struct<id:string,name:string,action:string>>")
    return F.array_compact(F.array(*hits))


def rule_hits(df: DataFrame, rules, keep: list[str]) -> DataFrame:
    """One row per (row, matching rule). Rules are compiled in chunks, so any number of them fits generated code."""
    rules = list(rules)
    chunks = [rules[i:i + RULE_CHUNK] for i in range(0, len(rules), RULE_CHUNK)] or [[]]
    parts = [df.select(*keep, F.inline(triggered(df, chunk))) for chunk in chunks]
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed({"id": "rule_id", "name": "rule_name", "action": "rule_action"})


def validate_rules(rules: DataFrame) -> DataFrame:
    """``rejected_because`` per rule draft; null means valid."""
    fields, ops = F.array(*[F.lit(f) for f in RULE_FIELDS]), F.array(*[F.lit(o) for o in RULE_OPS])
    reason = (
        F.when(F.size("conditions") == 0, "no conditions")
        .when(F.exists("conditions", lambda c: ~F.array_contains(fields, c["field"])), "unknown field")
        .when(F.exists("conditions", lambda c: ~F.array_contains(ops, c["op"])), "unknown comparison")
        .when(~F.col("action").isin(*RULE_ACTIONS), "unknown action"))
    return rules.withColumn("rejected_because", reason)


# ---------------------------------------------------------------- watchlist

def match_watchlist(df: DataFrame, watchlist: DataFrame, legacy_merchant_match: bool = False) -> DataFrame:
    """``watch`` = (id, kind, reason) of the matching entry with the smallest id, or null.

    One equi-join per kind instead of an OR. Entries are reduced to one per value first, so no join multiplies rows;
    Spark broadcasts a side only when its measured size allows, and splits skewed keys otherwise.
    """
    first = watchlist.groupBy("kind", "value").agg(F.min(F.struct("id", "kind", "reason")).alias("hit"))
    columns = {"entity": "entity_id", "device": "device_id", "merchant": "entity_id" if legacy_merchant_match else "merchant_id"}
    for kind, column in columns.items():
        side = first.where(F.col("kind") == kind).select(F.col("value").alias(f"_{kind}"), F.col("hit").alias(f"_hit_{kind}"))
        df = df.join(side, F.col(column) == F.col(f"_{kind}"), "left").drop(f"_{kind}")
    hits = [f"_hit_{kind}" for kind in columns]
    return df.withColumn("watch", F.array_min(F.array_compact(F.array(*hits)))).drop(*hits)


# ---------------------------------------------------------------- the decision

def decide(df: DataFrame, rules, watchlist: DataFrame | None = None, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Adds ``risk_label`` and ``rules_triggered`` (names) to scored rows.

    The threshold gives a verdict, an escalating rule lifts it one step, a watchlist hit makes it FRAUD at 0.99 or
    more. Rules see the score before that override. ``rules`` are compiled into the plan, or a table of any number of rules.
    """
    if watchlist is not None:
        df = match_watchlist(df, watchlist)
    else:
        df = df.withColumn("watch", F.lit(None).cast("struct<id:string,kind:string,reason:string>"))
    label = verdict(F.col("risk_score"), threshold)
    if isinstance(rules, DataFrame):
        from riskloom.operators import rule_index
        df = rule_index.triggered(df, rules, fields=("name",), acted=("escalate", "_escalates"))
        names, escalates, helpers = F.col("_rules"), F.col("_escalates"), ("_rules", "_escalates")
    else:
        df = df.withColumn("_rules", triggered(df, rules))
        names, escalates, helpers = F.transform("_rules", lambda r: r["name"]), F.exists("_rules", lambda r: r["action"] == "escalate"), ("_rules",)
    watched = F.col("watch").isNotNull()
    return df.withColumns({
        "risk_label": F.when(watched, "FRAUD").when(escalates, lifted(label)).otherwise(label),
        "rules_triggered": F.when(watched, F.array_append(names, F.concat(F.lit("Watchlist:"), F.col("watch.kind")))).otherwise(names),
        "risk_score": F.when(watched, F.greatest("risk_score", F.lit(0.99))).otherwise(F.col("risk_score")),
    }).drop(*helpers)


def rule_hit_counts(decided: DataFrame) -> DataFrame:
    return decided.select(F.explode("rules_triggered").alias("rule_name")).groupBy("rule_name").agg(F.count(F.lit(1)).alias("hits"))


def score_bulk(rows: DataFrame, rules, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Heuristic score, verdict and matching rule names for uploaded rows; rules do not change the label here."""
    scored = rows.withColumn("risk_score", heuristic_score(F.col("device_shift"), F.col("amount")))
    return scored.select(
        "transaction_id", "entity_id", F.round("amount", 2).alias("amount"), F.round("risk_score", 4).alias("risk_score"),
        verdict(F.col("risk_score"), threshold).alias("risk_label"),
        F.transform(triggered(scored, rules), lambda r: r["name"]).alias("rules_triggered"))


def backtest(alerts: DataFrame, latest_feedback: DataFrame, drafts) -> DataFrame:
    """Replay draft rules over all alerts in one pass: matches, outcomes and precision on labelled alerts per rule.

    The amount of a stored alert is its ``sum_amount_1h``.
    """
    drafts = list(drafts)
    rows = alerts.withColumn("amount", F.col("sum_amount_1h")).join(
        latest_feedback.select(F.col("alert_id").alias("id"), F.col("label").alias("_label")), "id", "left")
    flags = {f"_m{i}": predicate(r.conditions, rows.columns) for i, r in enumerate(drafts)}
    rows = rows.select(*{"risk_label", "_label"}, *[p.alias(n) for n, p in flags.items()])
    outcomes = {"matched": F.lit(True), "matched_fraud": F.col("risk_label") == "FRAUD", "matched_safe": F.col("risk_label") == "SAFE",
                "confirmed_fraud": F.col("_label") == "confirmed_fraud", "false_positive": F.col("_label") == "false_positive"}
    sums = rows.agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if(F.col(flag) & cond).alias(f"{flag}_{name}") for flag in flags for name, cond in outcomes.items()])
    per_rule = [F.struct(F.lit(r.name).alias("rule_name"), F.col("_n").alias("total_scanned"),
                         *[F.col(f"_m{i}_{name}").alias(name) for name in outcomes]) for i, r in enumerate(drafts)]
    out = sums.select(F.inline(F.array(*per_rule)))
    labelled = F.nullif(F.col("confirmed_fraud") + F.col("false_positive"), F.lit(0))
    return out.withColumns({
        "match_rate": F.coalesce(F.round(F.col("matched") / F.nullif(F.col("total_scanned"), F.lit(0)) * 100, 2), F.lit(0.0)),
        "precision_on_labelled": F.round(F.col("confirmed_fraud") / labelled, 3)})


def backtest_samples(alerts: DataFrame, draft: Rule, k: int = 8) -> DataFrame:
    """The newest ``k`` alerts that a draft rule matches."""
    rows = alerts.withColumn("amount", F.col("sum_amount_1h"))
    matched = rows.where(predicate(draft.conditions, rows.columns)).orderBy(F.desc("created_at"), "id").limit(k)
    return matched.select("transaction_id", "entity_id", "risk_label", F.round("risk_score", 3).alias("risk_score"))
