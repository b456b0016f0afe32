"""OTLP documents over the events table: the attributes of each signal as SQL that both engines evaluate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.rows import spread
from meterlake.plans.views import table
from meterlake.sources import otlp
from meterlake.sources.scratch import scratch_path

#: Attributes of resources, scopes, data points, log records, spans and span events; null: the event lacks it.
RESOURCE = {
    "service.name": "case event_id % 4 when 0 then 'codex-app-server' when 1 then 'claude-code' when 2 then 'other-client' end",
    "service.namespace": "case when event_id % 3 = 0 then 'live' end",
    "user.email": "concat('u', cast(user_id as varchar(20)), '@mail.example')",
    "host.name": "'h1'",
    "custom.key": "event_type",
}
SCOPE = {"token": "'x'", "library.kind": "event_type"}
POINT = {
    "model": "case event_id % 5 when 0 then 'gpt-5.6-sol' when 1 then 'claude-opus-4' when 2 then 'codex-auto-review' when 3 then 'gpt-5.6-x' end",
    "type": "case event_id % 6 when 0 then 'input' when 1 then 'output' when 2 then 'cacheRead' when 3 then 'cacheCreation' when 4 then 'other' end",
    "query_source": "case event_id % 3 when 0 then 'main' when 1 then 'subagent' end",
    "agent_role": "case event_id % 11 when 0 then 'primary' when 1 then 'weird' when 2 then 'subagent' end",
    "tool": "case event_id % 8 when 0 then 'apply_patch' when 1 then 'exec' when 2 then 'fs.read' when 3 then 'other' end",
    "skill.name": "case when event_id % 2 = 0 then 'reviewer' end",
    "mcp_server.name": "case when event_id % 5 = 1 then 'srv' end",
    "conversation.id": "cast(event_id as varchar(20))",
    "content_scope": "'given'",
    "token_type": "case when event_id % 9 = 0 then 'input' end",
    "status": "event_type",
    "unlisted": "'z'",
}
RECORD = {
    "event.name": "concat('codex.', event_type)",
    "session.id": "cast(user_id as varchar(20))",
    "tool_name": "case when event_id % 2 = 0 then 'Bash' end",
    "prompt": "event_type",
    "prompt.text": "event_type",
    "arguments": "case when event_id % 3 = 0 then 'a' end",
    "gen_ai.usage.input_tokens": "cast(user_id as varchar(20))",
    "duration_ms": "cast(event_id % 100 as varchar(20))",
    "success": "case when value > 20 then 'true' else 'false' end",
    "url.full": "'http://x/y'",
    "custom.key": "event_type",
}
SPAN = RECORD | {"openinference.span.kind": "case when event_id % 5 <> 0 then 'CHAIN' end", "output.value": "'o'"}
SPAN_EVENT = {"content": "'c'", "note": "event_type", "branch": "'b'", "prompt.content": "'p'"}
#: Boolean attribute of the resources of spans, and a request header.
OPT_OUT = "case event_id % 6 when 0 then false when 1 then true end"
HEADER = "case event_id % 7 when 0 then 'false' when 1 then 'true' end"

METRIC = (
    "case event_id % 7 when 0 then 'codex.turn.token_usage' when 1 then 'claude_code.token.usage' when 2 then 'codex.tool.call' when 3 then 'codex.mcp.call.duration_ms' "
    "when 4 then 'ai_agent.observed.user_prompt.bytes' when 5 then 'ai_agent.observed.mcp_tool_response.bytes' else 'other.metric' end"
)
#: Instruments by event: gauge, sum of whole numbers, histogram with these bounds.
KIND = "case event_id % 3 when 0 then 'gauge' when 1 then 'sum' else 'histogram' end"
BOUNDS = (20, 100)


def _attributes(values: dict[str, str], **bools: str) -> Column:
    def one(key: str, text: Column, flag: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.struct(text.alias("stringValue"), flag.alias("boolValue")).alias("value"))

    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    every = [one(k, F.expr(v).cast("string"), no) for k, v in values.items()] + [one(k, none, F.expr(v)) for k, v in bools.items()]
    # arrays of one or none joined, as a filter's argument would be interpreted for each row
    nothing = F.array().cast("array<struct<key:string,value:struct<stringValue:string,boolValue:boolean>>>")
    given = [F.when(F.expr(v).isNotNull(), F.array(entry)).otherwise(nothing) for v, entry in zip([*values.values(), *bools.values()], every)]
    return F.flatten(F.array(*given))


def _document(events: DataFrame, outer: str, inner: str, records: str, record: Column, **bools: str) -> DataFrame:
    """(value string): one JSON document an event."""
    scope = F.struct(F.lit("s").alias("name"), _attributes(SCOPE).alias("attributes"))
    scopes = F.array(F.struct(scope.alias("scope"), F.array(record).alias(records)))
    resource = F.struct(_attributes(RESOURCE, **bools).alias("attributes"))
    headers = F.map_filter(F.create_map(F.lit("x-ai-observability-phoenix"), F.expr(HEADER)), lambda _, v: v.isNotNull())
    return events.select(F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), scopes.alias(inner))).alias(outer), headers.alias("headers"))).alias("value"))


def time_ns() -> Column:
    return (F.col("event_id") * 1000).cast("string")


def points(spark: SparkSession, sf_dir: str, ns: Column | None = None, temporality: int = 2) -> DataFrame:
    """Data points of all instruments, parsed from documents."""
    at = F.struct((time_ns() if ns is None else ns).alias("timeUnixNano"), _attributes(POINT).alias("attributes"))
    kind, none = F.expr(KIND), F.lit(None)
    gauge = F.when(kind == "gauge", F.struct(F.array(F.struct("at.*", F.col("value").alias("asDouble"))).alias("dataPoints")))
    total = F.when(kind == "sum", F.struct(F.lit(temporality).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic"), F.array(F.struct("at.*", F.col("value").cast("bigint").cast("string").alias("asInt"))).alias("dataPoints")))
    cell = F.size(F.filter(F.array(*map(F.lit, BOUNDS)), lambda b: b < F.col("value")))
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(BOUNDS))), lambda i: F.when(i == cell, "1").otherwise("0"))
    point = F.struct("at.*", F.lit("1").alias("count"), F.col("value").alias("sum"), counts.alias("bucketCounts"), F.array(*(F.lit(float(b)) for b in BOUNDS)).alias("explicitBounds"))
    histogram = F.when(kind == "histogram", F.struct(F.lit(temporality).alias("aggregationTemporality"), F.array(point).alias("dataPoints")))
    metric = F.struct(F.expr(METRIC).alias("name"), F.lit("about").alias("description"), F.lit("{u}").alias("unit"), gauge.alias("gauge"), total.alias("sum"), histogram.alias("histogram"), none.cast("string").alias("_"))
    events = spread(table(spark, sf_dir, "events")).withColumn("at", at)
    return otlp.points(otlp.render_fixture(_document(events, "resourceMetrics", "scopeMetrics", "metrics", metric), "metrics", 0))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records, from documents that are written as JSON lines and read back as files."""
    record = F.struct(time_ns().alias("timeUnixNano"), F.lit("INFO").alias("severityText"), F.struct(F.col("event_type").alias("stringValue")).alias("body"), _attributes(RECORD).alias("attributes"))
    folder = scratch_path(spark, "logs")
    _document(spread(table(spark, sf_dir, "events")), "resourceLogs", "scopeLogs", "logRecords", record).write.option("compression", "lz4").text(folder)
    return otlp.logs(otlp.read_envelopes(spark, folder, "logs"))


def _span_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = time_ns(), (F.col("event_id") * 1000 + 500).cast("string")
    event = F.struct(start.alias("timeUnixNano"), F.lit("e").alias("name"), _attributes(SPAN_EVENT).alias("attributes"))
    status = F.struct(F.when(F.col("value") > 20, 2).otherwise(1).alias("code"), F.col("event_type").alias("message"))
    span = F.struct(
        F.md5(F.col("event_id").cast("string")).alias("traceId"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 16).alias("spanId"), F.lit("st").alias("traceState"), F.col("event_type").alias("name"), F.lit(1).alias("kind"),
        start.alias("startTimeUnixNano"), end.alias("endTimeUnixNano"), _attributes(SPAN).alias("attributes"), F.array(event).alias("events"), status.alias("status"),
    )
    return _document(spread(table(spark, sf_dir, "events")), "resourceSpans", "scopeSpans", "spans", span, **{"ai_context.export.phoenix": OPT_OUT})


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with one event each, parsed from documents."""
    return otlp.spans(otlp.render_fixture(_span_documents(spark, sf_dir), "traces", 0))


def span_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of ``spans`` as a stream of document files."""
    folder = scratch_path(spark, "span-documents")
    _span_documents(spark, sf_dir).write.option("compression", "lz4").text(folder)
    return otlp.spans(otlp.read_envelopes(spark, folder, "traces", streaming=True))


def listed(bag: str) -> Column:
    """A bag as text: key=value by key, comma-joined."""
    entries = F.transform(F.map_entries(bag), lambda e: F.concat(e["key"], F.lit("="), otlp.text_of(e["value"])))
    return F.array_join(F.sort_array(entries), ",")


def hook_lines(conversations: DataFrame) -> DataFrame:
    """Hook events as JSON lines over conversations, stored or a stream: a user turn opens a turn, an assistant turn uses a tool and stops it;
    every line is followed by one that no reader may choke on."""
    c = conversations.where("role in ('user', 'assistant')")
    ns = (F.col("conv_id") * 3600 + F.col("turn") * 60).cast("bigint") * 1_000_000_000
    own = [F.col("conv_id").cast("string").alias("session_id"), F.lit("t").alias("turn_id"), F.lit("gpt-5.6-sol").alias("model")]
    tool = F.element_at(F.array(*map(F.lit, ("Bash", "apply_patch", "mcp__files__read"))), (F.col("turn") % 3 + 1).cast("int"))
    used, reply = F.concat(F.lit("u"), F.col("turn").cast("string")), F.to_json(F.struct(F.col("turn").alias("b"), F.length("text").alias("a")))
    none = F.lit(None).cast("string")

    def event(name: str, at: Column, tool_use: Column = none, tool_name: Column = none, prompt: Column = none, response: Column = none) -> Column:
        return F.to_json(F.struct(F.lit(name).alias("hook_event_name"), *own, tool_use.alias("tool_use_id"), tool_name.alias("tool_name"), prompt.alias("prompt"), response.alias("tool_response"), at.alias("time_ns")))

    user = F.array(event("UserPromptSubmit", ns, prompt=F.col("text")), F.lit("[1]"))
    assistant = F.array(event("PreToolUse", ns - 3_000_000_000, used, tool), event("PostToolUse", ns - 1_000_000_000, used, tool, response=reply), event("Stop", ns), event("Notification", ns), F.lit("{"))
    return c.select(F.explode(F.when(F.col("role") == "user", user).otherwise(assistant)).alias("value"))


def snapshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status-line snapshots as JSON lines over events."""
    e = table(spark, sf_dir, "events")
    usage = F.struct((F.col("event_id") % 1000).alias("input_tokens"), (F.col("user_id") % 50).alias("output_tokens"), F.lit(0).alias("cache_creation_input_tokens"), F.lit(7).alias("cache_read_input_tokens"))
    window = F.struct((F.col("event_id") * 3).alias("total_input_tokens"), F.col("event_id").alias("total_output_tokens"), (F.col("value") - 10).alias("used_percentage"), usage.alias("current_usage"))
    quota = F.create_map(F.lit("weekly"), F.struct((F.col("event_id") % 4 / 2).alias("remaining_fraction")))
    snapshot = F.struct(
        F.col("user_id").cast("string").alias("session_id"), F.struct(F.when(F.col("event_id") % 3 != 0, "gemini").alias("id"), F.lit("Gemini/1").alias("display_name")).alias("model"), window.alias("context_window"), quota.alias("quota"),
        F.col("event_type").alias("agent_state"), (F.col("event_id") % 5 - 2).alias("task_count"), (F.col("value") > 200).alias("exceeds_200k_tokens"), F.lit(30).alias("terminal_width"), (F.col("event_id") * 1000).alias("time_ns"),
    )
    return e.select(F.to_json(snapshot).alias("value"))


