"""Recording rules as documents: what they read, matchers, vector operations and labels, in an order that follows from them.

A rule is {"record": name, "labels": {...}, "value": expression}. An expression is one of
    {"series": name, "eq": {...}, "ne": {...}, "drop": [...]}    current values of a metric or of earlier rules, without some labels
    {"or": [a, b, ...]}                                          all of a, and of b what has label sets that a lacks
    {"minus": [a, b], "on": [...]}                               one-to-one, series without a partner vanish
    {"times": [many, one], "on": [...], "carry": [...], "scale": x}   many-to-one with labels of the one side; one times x
    {"unless": [a, b], "on": [...]}                              a without a partner in b
    {"at_least": x, "of": a}  {"scaled": x, "of": a}
Rules of one name add up by label set, the earlier first.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.labels import labels_of, select_series
from meterlake.operators.vector import group_left, vec_binop, vec_unless


def read_rules(spark: SparkSession, pattern: str) -> list[dict]:
    """The rules of all files that match a pattern, one JSON document a line, by file and line; configuration, so a few rows."""
    lines = spark.read.text(pattern).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"), "value").where("trim(value) <> ''")
    rules = [json.loads(r.value) for r in lines.orderBy("file", "line").collect()]
    if bad := [r.get("record") for r in rules if not {"record", "value"} <= r.keys()]:
        raise ValueError(f"rules without a name or a value: {bad}")
    return rules


def reads(expression) -> set[str]:
    """Names of the series that an expression reads."""
    if isinstance(expression, dict):
        own = {expression["series"]} if "series" in expression else set()
        return own.union(*(reads(v) for k, v in expression.items() if k in ("or", "minus", "times", "unless", "of")))
    return set().union(*map(reads, expression)) if isinstance(expression, list) else set()


def in_order(rules: list[dict]) -> list[str]:
    """Names of the rules, each after those that its rules read; a circle is an error."""
    needs = {r["record"]: set() for r in rules}
    for r in rules:
        needs[r["record"]] |= reads(r["value"]) & needs.keys()
    out: list[str] = []
    while needs:
        ready = [name for name, before in needs.items() if before <= set(out)]
        if not ready:
            raise ValueError(f"rules read each other: {', '.join(sorted(needs))}")
        out += ready
        needs = {k: v for k, v in needs.items() if k not in ready}
    return out


def first_of(arms: list[DataFrame]) -> DataFrame:
    """For each label set the value of the first arm that has it: one aggregation over all arms, whose plans appear once."""
    labels = list(dict.fromkeys(c for a in arms for c in labels_of(a)))
    full = lambda a: a.withColumns({c: F.lit(None).cast("string") for c in labels if c not in a.columns})
    every = reduce(DataFrame.union, [full(a).select(*labels, "value", F.lit(n).alias("_arm")) for n, a in enumerate(arms)])
    return every.groupBy(*labels).agg(F.min_by("value", "_arm").alias("value"))


def _value(e: dict, known: dict[str, DataFrame], samples: DataFrame) -> DataFrame:
    of = lambda x: _value(x, known, samples)
    if "series" in e:
        rows = known[e["series"]] if e["series"] in known else select_series(samples, e["series"]).drop("metric", "ts")
        return select_series(rows, eq=e.get("eq"), ne=e.get("ne")).drop(*e.get("drop", ()))
    if "or" in e:
        return first_of([of(x) for x in e["or"]])
    if "minus" in e:
        return vec_binop(*map(of, e["minus"]), e["on"], lambda a, b: a - b)
    if "times" in e:
        many, one = map(of, e["times"])
        return group_left(many, one, e["on"], e["carry"], lambda a, b: a * (b * F.lit(float(e.get("scale", 1)))))
    if "unless" in e:
        return vec_unless(*map(of, e["unless"]), e["on"])
    if "at_least" in e:
        return of(e["of"]).withColumn("value", F.greatest(F.lit(float(e["at_least"])), F.col("value")))
    if "scaled" in e:
        return of(e["of"]).withColumn("value", F.col("value") * F.lit(float(e["scaled"])))
    raise ValueError(f"unknown expression: {sorted(e)}")


def evaluate(rules: list[dict], samples: DataFrame, cards: dict[str, DataFrame] | None = None, record: Callable[[str, DataFrame], DataFrame] = lambda name, table: table) -> dict[str, DataFrame]:
    """The series (labels..., value) of each rule over current values (metric, labels..., value) and ``cards``, series by name.

    ``record`` may store a rule's series and return what it stored; rules that read them then start from there.
    """
    known = dict(cards or {})
    for name in in_order(rules):
        every = []
        for r in (r for r in rules if r["record"] == name):
            rows = _value(r["value"], known, samples).where(F.col("value").isNotNull())
            every.append(rows.withColumns({k: F.lit(v) for k, v in r.get("labels", {}).items()}))
        known[name] = record(name, first_of(every))
    return {r["record"]: known[r["record"]] for r in rules}


def accounting_rules() -> list[dict]:
    """The accounting rules as documents: usage by class of turn and request counters, cost, and what has no price."""
    turn, request, usage = "ai_agent_turn_token_usage_sum", "ai_agent_request_token_usage_total", "ai_agent_token_usage_total"
    labels = ["ai_agent_provider", "ai_agent_product", "agent_role", "model_id", "model_family", "evidence_class", "service_namespace"]
    more = [*labels, "skill_id", "mcp_server_name", "mcp_tool_name"]
    rate, card = ["ai_agent_provider", "model_id", "usage_class"], "ai_agent_token_price_usd_per_million"
    carry = ["currency", "rate_card_version", "rate_card_source", "pricing_scope"]

    def of(metric: str, kind: str) -> dict:
        return {"series": metric, "eq": {"token_type": kind}, "ne": {"model_id": "", "agent_role": ""}, "drop": ["token_type"]}

    def part(kind: str) -> dict:
        return {"or": [of(turn, kind), {"scaled": 0, "of": of(turn, "input")}]}

    rest = {"minus": [{"minus": [of(turn, "input"), part("cached_input")], "on": more}, part("cache_write_input")], "on": more}
    plain = {"input_cached": "cached_input", "input_cache_write": "cache_write_input", "output": "output"}
    values = [("input_uncached", {"or": [of(turn, "non_cached_input"), {"at_least": 0, "of": rest}]})] + [(c, of(turn, k)) for c, k in plain.items()]
    values += [("input_uncached", of(request, "input"))] + [(c, of(request, k)) for c, k in plain.items()]
    cost = {"times": [{"series": usage}, {"series": card}], "on": rate, "carry": carry, "scale": 1e-6}
    return [
        {"record": "ai_agent_estimated_cost_usd_total", "labels": {"cost_source": "estimated_api_list_price"}, "value": cost},
        {"record": "ai_agent_unpriced_api_token_usage_total", "labels": {"estimate_scope": "api_usd"}, "value": {"unless": [{"series": usage}, {"series": card}], "on": rate}},
        *({"record": usage, "labels": {"usage_class": c, "accounting_schema": "v2"}, "value": v} for c, v in values),
    ]
