"""Golden OTLP documents through the three profiles, down to accounting."""

import json

import pytest
from pyspark.sql import functions as F

from meterlake.operators import accounting as A
from meterlake.operators import checks, samples
from meterlake.operators.canonical import COPIES, text
from meterlake.operators.privacy import initial
from meterlake.plans.pipelines import evaluation_spans, process
from meterlake.sources import otlp
from meterlake.sources.schemas import envelope

SENTINEL = "SECRET-SENTINEL"
NOW = 1_700_000_000_000_000_000


def attrs(**kv):
    out = []
    for k, v in kv.items():
        kind = "boolValue" if isinstance(v, bool) else "intValue" if isinstance(v, int) else "stringValue"
        out.append({"key": k.replace("__", "."), "value": {kind: str(v) if kind == "intValue" else v}})
    return out


def histogram(name, value, **kv):
    point = {"timeUnixNano": "{{TIME_UNIX_NANO}}", "count": "1", "sum": value, "bucketCounts": ["0", "1", "0"], "explicitBounds": [256.0, 20000.0], "attributes": attrs(**kv)}
    return {"name": name, "unit": "{token}", "description": "text", "histogram": {"aggregationTemporality": 1, "dataPoints": [point]}}


def counter(name, value, **kv):
    point = {"timeUnixNano": "{{TIME_UNIX_NANO}}", "asInt": str(value), "attributes": attrs(**kv)}
    return {"name": name, "unit": "{token}", "sum": {"aggregationTemporality": 1, "isMonotonic": True, "dataPoints": [point]}}


def metrics(service, namespace, items, **resource):
    return {"resourceMetrics": [{"resource": {"attributes": attrs(service__name=service, service__namespace=namespace, **resource)}, "scopeMetrics": [{"scope": {"name": "s", "attributes": attrs(token="x")}, "metrics": items}]}]}


TOKENS = {"input": 10000, "cached_input": 6000, "cache_write_input": 1000, "output": 2000, "reasoning_output": 500, "total": 12000}
REVIEW = {"input": 8000, "cached_input": 6000, "output": 1000, "total": 9000}
SUBAGENT = {"input": 2000, "cached_input": 1000, "output": 500, "total": 2500}
DOCS = [
    metrics("codex-app-server", "cost-fixture", [histogram("codex.turn.token_usage", v, token_type=k, model="gpt-5.6-sol", conversation__id=SENTINEL) for k, v in TOKENS.items()]),
    metrics(
        "codex-app-server", "role-fixture",
        [histogram("codex.turn.token_usage", v, token_type=k, model="codex-auto-review") for k, v in REVIEW.items()]
        + [histogram("codex.turn.token_usage", v, token_type=k, model="gpt-5.6-terra", agent_role="subagent") for k, v in SUBAGENT.items()],
    ),
    metrics(
        "claude-code", "claude",
        [counter("claude_code.token.usage", v, type=k, model="claude-sonnet-4", query_source="main", **{"skill.name": "reviewer", "mcp_server.name": "custom", "mcp_tool.name": "custom"}) for k, v in (("input", 2400), ("cacheRead", 1600), ("cacheCreation", 400), ("output", 320))],
        user__email=SENTINEL,
    ),
    metrics("codex-app-server", "tools", [counter("codex.tool.call", 1, tool="apply_patch", call_id=SENTINEL, arguments=SENTINEL), counter("ai_agent.observed.user_prompt.bytes", 9)]),
]

LABELS = [*A.REQUEST_LABELS, "token_type", "tool_category", "operation"]


def flat(spark, signal, docs):
    texts = spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")
    return otlp.render_fixture(texts, signal, NOW)


def usage(spark, profile):
    points = process(otlp.points(flat(spark, "metrics", DOCS)), "points", profile)
    points = spark.createDataFrame(points.collect(), points.schema)
    rows = samples.to_samples(samples.reaggregate(samples.to_long(points)), LABELS)
    return points, spark.createDataFrame(rows.collect(), rows.schema)


def by_class(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return {r.usage_class: r.value for r in df.collect()}


@pytest.mark.parametrize("profile", ["core", "evaluation", "corporate"])
def test_accounting_golden_numbers(spark, profile):
    points, rows = usage(spark, profile)
    current = rows.select("metric", *LABELS, "value")
    used = A.token_usage(current)
    usd, credits = A.rate_card(spark), A.rate_card(spark, A.CREDITS_PER_MILLION)
    assert (usd.count(), credits.count()) == (12, 9)
    sol = used.where("service_namespace = 'cost-fixture'")
    assert by_class(sol) == {"input_uncached": 3000, "input_cached": 6000, "input_cache_write": 1000, "output": 2000}
    assert {r.agent_role for r in sol.collect()} == {"primary"}
    rules = A.recording_rules(current, usd, credits)
    own = lambda name: rules[name].where("service_namespace = 'cost-fixture'")
    assert own("ai_agent_estimated_cost_usd_total").agg(F.sum("value")).first()[0] == pytest.approx(0.08425)
    assert own("ai_agent_estimated_credit_usage_total").agg(F.sum("value")).first()[0] == pytest.approx(1.95)
    assert by_class(own("ai_agent_unpriced_credit_token_usage_total")) == {"input_cache_write": 1000}
    reviewer = used.where("agent_role = 'approval_reviewer'")
    assert by_class(reviewer) == {"input_uncached": 2000, "input_cached": 6000, "output": 1000}
    assert {r.model_id for r in reviewer.collect()} == {"unmapped"}
    assert rules["ai_agent_estimated_cost_usd_total"].where("agent_role = 'approval_reviewer'").count() == 0
    assert used.where("agent_role = 'subagent' and model_id = 'gpt-5.6-terra'").count() == 3
    claude = used.where("ai_agent_provider = 'anthropic'")
    assert by_class(claude) == {"input_uncached": 2400, "input_cached": 1600, "input_cache_write": 400, "output": 320}
    labels = {(r.agent_role, r.model_family, r.model_id, r.skill_id, r.mcp_server_name) for r in claude.collect()}
    assert labels == {("primary", "claude-sonnet", "unmapped", *((None, None) if profile == "corporate" else ("reviewer", "custom")))}
    # priced and unpriced are disjoint and together all usage
    assert rules["ai_agent_estimated_cost_usd_total"].count() + rules["ai_agent_unpriced_api_token_usage_total"].count() == used.count()


@pytest.mark.parametrize("profile", ["core", "evaluation", "corporate"])
def test_metrics_lose_sensitive_labels(spark, profile):
    points, rows = usage(spark, profile)
    assert checks.containing(points, [SENTINEL]).count() == 0
    assert checks.containing(rows, [SENTINEL]).count() == 0
    assert checks.forbidden_keys(points, "attributes", ["conversation.id", "call_id", "model", "arguments"]).where("key <> 'model'").count() == 0
    tool = rows.where("metric = 'ai_agent_tool_call'").first()
    assert (tool.tool_category, tool.operation) == ("editor", "tool")
    sizes = points.where("metric = 'ai_agent.observed.user_prompt.bytes'").collect()
    assert len(sizes) == (0 if profile == "corporate" else 1)
    if sizes:
        assert sizes[0].attributes["content_scope"].stringValue == "user_prompt"
    raw = points.where("metric = 'codex.turn.token_usage'").agg(F.sum("value")).first()[0]
    copied = points.where("metric = 'ai_agent.turn.token_usage'").agg(F.sum("value")).first()[0]
    assert raw == copied


def test_copies_are_additive_and_minimising_is_idempotent(spark):
    points = otlp.points(flat(spark, "metrics", DOCS))
    once = initial(points, "points")
    assert once.collect() == initial(once, "points").collect()
    assert len(COPIES) == 23


def log_doc(**kv):
    record = {"timeUnixNano": "{{TIME_UNIX_NANO}}", "severityText": "INFO", "body": {"stringValue": SENTINEL}, "attributes": attrs(**kv)}
    return {"resourceLogs": [{"resource": {"attributes": attrs(service__name="codex-app-server", user__email=SENTINEL)}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [record]}]}]}


@pytest.mark.parametrize("profile,left", [("core", {"event_name", "session.id"}), ("corporate", set())])
def test_logs(spark, profile, left):
    out = process(otlp.logs(flat(spark, "logs", [log_doc(event_name="codex.tool_result", tool_name="x", arguments=SENTINEL, **{"session.id": "p"})])), "logs", profile)
    row = out.first()
    assert row.body == "AI telemetry metadata event"
    assert set(row.attributes) - {"tool_name"} == left if profile == "core" else set(row.attributes) == left
    assert checks.containing(out, [SENTINEL]).count() == 0
    assert row.time_ns == NOW


def span_doc(trace, kind="CHAIN", opt=None, header=None):
    span = {"traceId": trace * 32, "spanId": trace * 16, "name": "n", "kind": 1, "startTimeUnixNano": "{{START_TIME_UNIX_NANO}}", "endTimeUnixNano": "{{END_TIME_UNIX_NANO}}", "attributes": attrs(**({"openinference.span.kind": kind} if kind else {}), **{"tool.name": SENTINEL}), "status": {"code": 2, "message": SENTINEL}, "events": [{"timeUnixNano": "{{TIME_UNIX_NANO}}", "name": "e", "attributes": attrs(content=SENTINEL)}]}
    resource = attrs(service__name="x", **({"ai_context.export.phoenix": opt} if opt is not None else {}))
    return {"resourceSpans": [{"resource": {"attributes": resource}, "scopeSpans": [{"scope": {"name": "s"}, "spans": [span]}]}], "headers": {"x-ai-observability-phoenix": header} if header else None}


def test_routing_to_the_evaluation_store(spark):
    docs = [span_doc("2", opt=True), span_doc("3", opt=False), span_doc("5"), span_doc("6", header="true"), span_doc("8", header="false"), span_doc("9", kind=None)]
    spans = otlp.spans(flat(spark, "traces", docs))
    out = evaluation_spans(spans)
    assert sorted(r.trace_id[0] for r in out.collect()) == ["2", "5", "6"]
    assert checks.containing(out, [SENTINEL]).count() == 0
    assert out.where(text(F.col("attributes"), "ai_observability.routing.phoenix").isNotNull()).count() == 0
    assert (out.first().end_ns - out.first().start_ns) == 50_000_000


def test_corporate_spans_are_renamed(spark):
    out = process(otlp.spans(flat(spark, "traces", [span_doc("1")])), "spans", "corporate").first()
    assert (out.name, out.status_message, out.trace_state, out.events[0].name) == ("AI telemetry operation", "", "", "AI telemetry event")


def test_unknown_profile_and_broken_document_fail(spark):
    with pytest.raises(ValueError):
        process(otlp.spans(flat(spark, "traces", [span_doc("1")])), "spans", "none")
    with pytest.raises(Exception):
        otlp.render_fixture(spark.createDataFrame([("{",)], "value string"), "logs", NOW).collect()


def test_missing_service_gets_a_default_and_envelopes_read_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"resourceLogs": [{"resource": {"attributes": []}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "1", "attributes": []}]}]}]}))
    out = process(otlp.logs(otlp.read_envelopes(spark, str(tmp_path), "logs")), "logs").first()
    assert out.resource["service.name"].stringValue == "unknown-ai-client"
    assert "resourceLogs" in envelope("logs")


def test_delta_points_become_running_totals(spark):
    docs = [metrics("x", "n", [histogram("h", v, k="a")]) for v in (5, 7)]
    for n, d in enumerate(docs):
        d["resourceMetrics"][0]["scopeMetrics"][0]["metrics"][0]["histogram"]["dataPoints"][0]["timeUnixNano"] = str(NOW + n * 10**9)
    rows = samples.to_samples(samples.reaggregate(samples.to_long(otlp.points(flat(spark, "metrics", docs)))), ["k", "service_name"]).collect()
    got = sorted((r.metric, r.le or "", r.ts.second, r.value) for r in rows)
    second = NOW // 10**9 % 60
    assert [g for g in got if g[0] == "h_sum"] == [("h_sum", "", second, 5.0), ("h_sum", "", second + 1, 12.0)]
    assert [g[1:] for g in got if g[0] == "h_bucket"] == [("+Inf", second, 1.0), ("+Inf", second + 1, 2.0), ("20000", second, 1.0), ("20000", second + 1, 2.0), ("256", second, 0.0), ("256", second + 1, 0.0)]
    assert {(r.k, r.service_name) for r in rows} == {("a", "x")}
