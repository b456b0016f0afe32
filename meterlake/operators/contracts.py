"""Document contracts: conformance of context events, feedback bundles, and the report over named checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a context event: path -> (kind, argument). A field with "!" must be there if its object is.
EVENT_FIELDS = {
    "schema_version!": ("enum", ["1.0"]),
    "occurred_at!": ("time", None),
    "environment.profile!": ("enum", ["core", "evaluation", "corporate-redacted"]),
    "environment.deployment": ("length", 64),
    "environment.user_pseudonym": ("pattern", "^[A-Za-z0-9._:-]{8,128}$"),
    "environment.pseudonym_key_version": ("length", 32),
    "framework.name!": ("length", 128),
    "framework.version!": ("length", 64),
    "framework.commit_hash": ("pattern", "^[0-9a-fA-F]{7,64}$"),
    "framework.rule_set_hash": ("pattern", "^[0-9a-fA-F]{16,128}$"),
    "workflow.id_hash": ("pattern", "^[0-9a-fA-F]{16,128}$"),
    "workflow.type!": ("length", 64),
    "workflow.stage!": ("length", 64),
    "task.id_hash": ("pattern", "^[0-9a-fA-F]{16,128}$"),
    "task.type": ("length", 64),
    "task.complexity": ("enum", ["small", "medium", "large", "unknown"]),
    "operation.type!": ("enum", ["model", "tool", "validation", "wait", "git", "review", "handoff", "workflow"]),
    "operation.state!": ("enum", ["active", "wait", "blocked", "paused", "sleep", "resumed", "completed"]),
    "operation.outcome!": ("enum", ["success", "passed", "failed", "blocked-by-environment", "skipped", "not-applicable", "deferred", "unknown"]),
    "operation.evidence_class!": ("enum", ["repository-record", "git-fact", "provider-readback", "conversation-observation", "derived-interval", "manual-annotation"]),
    "operation.duration_ms": ("count", None),
    "ai.tool_category": ("length", 64),
    "ai.model_family": ("length", 128),
    "ai.token_usage.input": ("count", None),
    "ai.token_usage.cached_input": ("count", None),
    "ai.token_usage.output": ("count", None),
    "ai.token_usage.reasoning": ("count", None),
    "ai.token_usage.cache_write": ("count", None),
    "ai.cost.value!": ("amount", None),
    "ai.cost.unit!": ("enum", ["credits", "USD", "internal_unit", "unknown"]),
    "ai.cost.source!": ("enum", ["official", "vendor_reported", "estimated", "allocated", "unknown"]),
    "ai.cost.rate_card_version": ("length", 64),
    "ai.cost.attribution_confidence!": ("enum", ["exact", "bounded", "proportional", "manual", "unattributed"]),
    "context.manifest_hash": ("pattern", "^[0-9a-fA-F]{16,128}$"),
    "context.loaded_files": ("count", None),
    "context.loaded_bytes": ("count", None),
    "context.estimated_tokens": ("count", None),
    "validation.type": ("length", 64),
    "validation.tier": ("length", 32),
    "validation.fingerprint_hash": ("pattern", "^[0-9a-fA-F]{16,128}$"),
    "validation.reused": ("enum", ["true", "false"]),
    "validation.invalidation_reason": ("length", 64),
    "rule.id": ("length", 128),
    "rule.state": ("enum", ["declared", "loaded", "evaluated", "triggered", "affected_action"]),
    "privacy.content_captured!": ("enum", ["false"]),
    "privacy.policy_profile!": ("enum", ["personal-minimized", "corporate-allowlist"]),
}
REQUIRED_OBJECTS = ("environment", "framework", "workflow", "operation", "privacy")


def _holds(value: Column, kind: str, argument) -> Column:
    if kind == "enum":
        return value.isin(*argument)
    if kind == "pattern":
        return value.rlike(argument)
    if kind == "length":
        return F.length(value) <= argument
    if kind == "count":
        return value.rlike(r"^\d+$")
    if kind == "amount":
        return F.coalesce(value.try_cast("double") >= 0, F.lit(False))
    return F.try_to_timestamp(value).isNotNull() & value.contains("T")


def event_violations(events: DataFrame, column: str = "event") -> DataFrame:
    """``events`` with ``violations``: paths of a JSON text that are missing, wrong or unknown; ``$`` if it is no object.

    Objects are closed: a key that isn't listed is a violation. The document is parsed once for all paths.
    """
    doc = F.try_parse_json(column)
    at = lambda path: F.try_variant_get("_doc", f"$.{path}", "string")
    tests: list[Column] = [F.when(F.col("_doc").isNull() | ~F.schema_of_variant("_doc").startswith("OBJECT"), "$")]
    objects: dict[str, list[str]] = {"": []}
    for path, (kind, argument) in EVENT_FIELDS.items():
        name, needed = path.rstrip("!"), path.endswith("!")
        *parents, key = name.split(".")
        for k in range(len(parents)):
            objects.setdefault(".".join(parents[: k + 1]), [])
            inside = objects[".".join(parents[:k])]
            inside += [parents[k]] if parents[k] not in inside else []
        objects[".".join(parents)].append(key)
        value = at(name)
        bad = value.isNotNull() & ~_holds(value, kind, argument)
        if needed:
            there = F.lit(True) if not parents or parents == parents[:1] and parents[0] in REQUIRED_OBJECTS else at(".".join(parents)).isNotNull()
            bad = bad | (there & value.isNull())
        tests.append(F.when(bad, name))
    for path, keys in objects.items():
        seen = F.json_object_keys(at(path) if path else F.col(column))
        unknown = F.array_except(seen, F.array(*map(F.lit, keys)))
        tests.append(F.when(F.size(unknown) > 0, F.concat(F.lit(f"{path}." if path else ""), F.element_at(unknown, 1))))
    return events.withColumn("_doc", doc).withColumn("violations", F.array_compact(F.array(*tests))).drop("_doc")


def feedback_bundle(metrics: DataFrame, framework_version: str) -> DataFrame:
    """One JSON document of (name, value) scalars, keys in order; the corporate profile is the only one that exports it."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value"))))
    doc = F.struct(F.lit("1.0").alias("schema_version"), F.lit("corporate-redacted").alias("environment_profile"), F.lit(framework_version).alias("framework_version"), entries.alias("metrics"))
    return metrics.groupBy().agg(F.to_json(doc).alias("bundle"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, failures, passed) of named checks, each a table of failures."""
    rows = [failed.groupBy().agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("name"), "failures", (F.col("failures") == 0).alias("passed")) for name, failed in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


#: Prefixes of the metrics of each contract.
CONTRACTS = {"native": ("codex_", "claude_code_", "antigravity_"), "ai_agent": ("ai_agent_",), "ai_context": ("ai_context_",)}


def contracts_of(metrics) -> list[str]:
    """Which of the metric contracts some metrics belong to: a query must stay within one of them."""
    return sorted(name for name, prefixes in CONTRACTS.items() if any(m.startswith(prefixes) for m in metrics))
