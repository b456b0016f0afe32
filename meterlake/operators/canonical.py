"""Canonical vocabulary: resource defaults, provider of a service, copies of native metrics, ordered attribute rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.labels import differs
from meterlake.operators.privacy_names import CONTENT_SIZE_METRICS
from meterlake.sources.otlp import text_of, typed
from meterlake.sources.schemas import ATTRIBUTES

# Profile and environment that each deployment profile writes on every resource.
PROFILE_VALUES = {"core": ("core", "personal-local"), "evaluation": ("evaluation", "personal-local"), "corporate": ("corporate-redacted", "corporate-local")}
UNKNOWN_SERVICE = "unknown-ai-client"

# Service name -> provider, product, surface.
SERVICES = {
    "codex-app-server": ("openai", "codex", "app-server"),
    "claude-code": ("anthropic", "claude-code", "cli"),
    "claude-code-desktop": ("anthropic", "claude-code", "desktop"),
}

# Native metric -> canonical metric.
COPIES = {
    "claude_code.token.usage": "ai_agent.request.token_usage.total",
    "codex.turn.token_usage": "ai_agent.turn.token_usage",
    "codex.turn.e2e_duration_ms": "ai_agent.turn.duration_ms",
    "codex.turn.ttft.duration_ms": "ai_agent.turn.ttft.duration_ms",
    "codex.turn.ttfm.duration_ms": "ai_agent.turn.ttfm.duration_ms",
    "codex.tool.call": "ai_agent.tool.call",
    "codex.tool.call.duration_ms": "ai_agent.tool.call.duration_ms",
    "codex.mcp.call": "ai_agent.mcp.call",
    "codex.mcp.call.duration_ms": "ai_agent.mcp.call.duration_ms",
    "codex.responses_api_inference_time.duration_ms": "ai_agent.api.inference.duration_ms",
    "codex.responses_api_overhead.duration_ms": "ai_agent.api.overhead.duration_ms",
    "codex.task.compact": "ai_agent.compaction",
    "codex.skill.injected": "ai_agent.skill.injection",
    "codex.thread.started": "ai_agent.thread.started",
    "antigravity_session_tokens": "ai_agent.observed.session_tokens",
    "antigravity_context_tokens": "ai_agent.observed.context_tokens",
    "antigravity_context_used_ratio": "ai_agent.observed.context_used_ratio",
    "antigravity_quota_remaining_ratio": "ai_agent.observed.quota_remaining_ratio",
    "antigravity_background_task_count": "ai_agent.observed.background_task_count",
    "antigravity_artifact_count": "ai_agent.observed.artifact_count",
    "antigravity_context_exceeds_200k": "ai_agent.observed.context_exceeds_200k",
    "antigravity_pending_input_count": "ai_agent.observed.pending_input_count",
    "antigravity_tool_confirmation_pending": "ai_agent.observed.tool_confirmation_pending",
}
REQUEST_METRIC = "ai_agent.request.token_usage.total"
ROLES = ("primary", "approval_reviewer", "subagent", "unknown")
#: Raw keys that canonical metrics lose once the canonical keys are derived from them.
RAW_KEYS = ("model", "tool", "tool_name", "skill", "skill.name", "mcp_server.name", "mcp_tool.name", "query_source")


def texts_of(values: dict[str, Column]) -> Column:
    """A typed bag of the texts of ``values`` that aren't null; arrays of one or none are joined, as a filter's argument would be
    interpreted for each row."""
    entry = lambda key, value: F.array(F.struct(F.lit(key).alias("key"), typed(value).alias("value")))
    given = [F.when(value.isNotNull(), entry(key, value)).otherwise(F.array().cast(ATTRIBUTES)) for key, value in values.items()]
    return F.map_from_entries(F.flatten(F.array(*given)))


def upsert_all(df: DataFrame, column: str, values: dict[str, Column]) -> DataFrame:
    """``df`` whose bag ``column`` has the texts of ``values`` set; null values leave their keys as they are.

    The new texts are a column of their own first: inside the test of a key they would be computed for each key.
    """
    merged = F.map_concat(F.map_filter(column, lambda k, _: ~F.map_contains_key("_new", k)), "_new")
    return df.withColumn("_new", texts_of(values)).withColumn(column, merged).drop("_new")


def upsert(df: DataFrame, column: str, key: str, value: Column) -> DataFrame:
    """``df`` whose bag ``column`` has ``key`` set to a text; a null value leaves the bag as it is."""
    return upsert_all(df, column, {key: value})


def text(bag: Column, key: str) -> Column:
    return text_of(bag[key])


def normalise_resource(df: DataFrame, profile: str = "core") -> DataFrame:
    """Profile and environment are written over; a missing service name gets a default."""
    value, environment = PROFILE_VALUES[profile]
    service = F.when(text(F.col("resource"), "service.name").isNull(), F.lit(UNKNOWN_SERVICE))
    fixed = {"ai_context.environment.profile": F.lit(value), "ai_observability.profile": F.lit(value), "deployment.environment.name": F.lit(environment)}
    return upsert_all(df, "resource", fixed | {"service.name": service})


def derive_provider(df: DataFrame) -> DataFrame:
    """Provider, product and surface of known services; others get none."""
    known = F.create_map(*(x for name, values in SERVICES.items() for x in (F.lit(name), F.array(*map(F.lit, values)))))
    rows = df.withColumn("_of", known[text(F.col("resource"), "service.name")])
    return upsert_all(rows, "resource", {key: F.get("_of", F.lit(at)) for at, key in enumerate(("ai_agent.provider", "ai_agent.product", "ai_agent.surface"))}).drop("_of")


def with_copies(points: DataFrame, copies=COPIES) -> DataFrame:
    """The points, and a canonical copy of each point of a mapped metric; kind, unit and temporality stay.

    Not idempotent: copies are added. The mapping is a constant map, so nothing is joined.
    """
    pairs = F.create_map(*(F.lit(x) for pair in copies.items() for x in pair))
    both = F.array_compact(F.array(F.col("metric"), pairs[F.col("metric")]))
    return points.withColumn("metric", F.explode(both))


def canonical_attributes(points: DataFrame, corporate: bool = False) -> DataFrame:
    """Derived keys of canonical data points, by rules in a fixed order: each rule sees what earlier ones have set.

    Values are computed as columns first and then written to the bag once.
    """
    read = ("model", "type", "query_source", "model_family", "model_id", "agent_role", "operation", "evidence_class", "token_type", "skill.name", "skill_id", "mcp_server.name", "mcp_server_name", "mcp_tool.name", "mcp_tool_name", "tool", "tool_category")
    column = {key: f"_{at}" for at, key in enumerate(read)}
    a = lambda key: F.col(column[key])
    name, starts = F.col("metric"), lambda prefix: F.coalesce(F.col("metric").startswith(prefix), F.lit(False))
    is_request, is_own = F.coalesce(name == REQUEST_METRIC, F.lit(False)), starts("ai_agent.")
    prompt, response = (F.coalesce(name == m, F.lit(False)) for m in CONTENT_SIZE_METRICS)
    drops = [(is_own, RAW_KEYS), (is_request, ("skill_id",)) if corporate else (~(prompt | response), ("content_scope", "measurement_method"))]
    kept = lambda k, _: ~reduce(Column.__or__, (test & k.isin(*keys) for test, keys in drops))
    # what the rules read is a column each: they would repeat its expression, and the role's would double with each rule
    wide = points.withColumn("_texts", F.transform_values(F.map_filter("attributes", lambda k, _: k.isin(*read)), lambda _, v: text_of(v)))
    wide = wide.withColumns({c: F.col("_texts")[key] for key, c in column.items()} | {
        "_server": F.coalesce(text(F.col("resource"), "service.name") == "codex-app-server", F.lit(False)), "_request": is_request, "_own": is_own, "_bag": F.map_filter("attributes", kept),
    }).drop("_texts")
    request, own, model, kind, source = F.col("_request"), F.col("_own"), a("model"), a("type"), a("query_source")
    wide = wide.withColumns({
        "_newer": F.coalesce((model == "gpt-5.6") | model.startswith("gpt-5.6-"), F.lit(False)),
        "_role": F.when(request, F.when(source == "main", "primary").when(source == "subagent", "subagent").otherwise("unknown")).otherwise(a("agent_role")),
    })
    server, new_model, role = F.col("_server"), F.col("_newer"), F.col("_role")

    family = F.when(request, F.when(model.startswith("claude-opus-"), "claude-opus").when(model.startswith("claude-sonnet-"), "claude-sonnet").when(model.startswith("claude-haiku-"), "claude-haiku").otherwise("claude")).otherwise(a("model_family"))
    family = F.when(own & new_model, "gpt-5.6").when(own & server, "unmapped").otherwise(family)

    model_id = F.when(own & model.isin("gpt-5.6-sol", "gpt-5.6-terra", "gpt-5.6-luna"), model).when(request | (own & server), "unmapped").otherwise(a("model_id"))

    other_role = differs(role, ROLES[0]) & differs(role, ROLES[1]) & differs(role, ROLES[2]) & differs(role, ROLES[3])
    wide = wide.withColumn("_role", F.when(own & (model == "codex-auto-review"), "approval_reviewer").when(own & other_role, "unknown").otherwise(role))
    role = F.when(own & server & (role == "unknown") & new_model, "primary").otherwise(role)

    operation = F.when(request, "request").otherwise(a("operation"))
    for prefix, value in (("turn", "turn"), ("tool", "tool"), ("mcp", "mcp"), ("api", "api")):
        operation = F.when(starts(f"ai_agent.{prefix}."), value).otherwise(operation)
    evidence = F.when(starts("ai_agent.observed."), "observed").when(request | (own & server), "provider-reported").otherwise(a("evidence_class"))

    token = F.when(request & kind.isin("input", "output"), kind).when(request & (kind == "cacheRead"), "cached_input").when(request & (kind == "cacheCreation"), "cache_write_input").otherwise(a("token_type"))
    skill = F.when(request, F.lit(None) if corporate else F.coalesce(a("skill.name"), F.lit("none"))).otherwise(a("skill_id"))
    mcp_server = F.when(request, F.coalesce(a("mcp_server.name"), F.lit("none"))).otherwise(a("mcp_server_name"))
    mcp_tool = F.when(request, F.coalesce(a("mcp_tool.name"), F.lit("none"))).otherwise(a("mcp_tool_name"))
    tool = a("tool")
    category = F.when(starts("ai_agent.tool."), F.when(tool.rlike(r"^[a-z0-9_]+\."), "connector").when(tool == "apply_patch", "editor").when(tool.isin("exec", "exec_command"), "execution")).otherwise(None)
    category = F.coalesce(category, a("tool_category"))

    derived = {"model_family": family, "model_id": model_id, "agent_role": role, "operation": operation, "evidence_class": evidence, "token_type": token, "skill_id": skill, "mcp_server_name": mcp_server, "mcp_tool_name": mcp_tool, "tool_category": category}
    if not corporate:
        derived |= {"content_scope": F.when(prompt, "user_prompt").when(response, "hook_tool_response"), "measurement_method": F.when(prompt | response, "utf8_bytes")}
    # only canonical metrics get derived keys; native ones keep what they came with
    given = F.filter(F.array(*(F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")) for key, value in derived.items())), lambda e: own & e["value"].isNotNull())
    wide = wide.withColumn("_new", F.map_from_entries(F.transform(given, lambda e: F.struct(e["key"].alias("key"), typed(e["value"]).alias("value")))))
    merged = F.map_concat(F.map_filter("_bag", lambda k, _: ~F.map_contains_key("_new", k)), "_new")
    return wide.withColumn("attributes", merged).select(points.columns)


def canonicalise(df: DataFrame, signal: str, profile: str = "core") -> DataFrame:
    """Middle stage: provider of the resource; for points also copies and derived keys."""
    out = derive_provider(df)
    return canonical_attributes(with_copies(out), profile == "corporate") if signal == "points" else out
