"""Registered queries of the privacy profiles: documents of each signal through every stage, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.rows import fields_once
from meterlake.operators import samples, sessions, status_line
from meterlake.operators.canonical import text
from meterlake.plans import envelopes as E
from meterlake.plans.pipelines import evaluation_spans, process
from meterlake.plans.views import table
from meterlake.sources import otlp
from meterlake.sources.schemas import STATUS_LINE
from meterlake.sources.scratch import scratch_path
from meterlake.streaming import carried, jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PROFILES = ("core", "evaluation", "corporate")


def _points(profile: str):
    def run(spark, d):
        out = process(E.points(spark, d), "points", profile)
        return out.select("time_ns", "metric", "kind", F.round("value", 6).alias("value"), E.listed("resource").alias("resource"), E.listed("scope.attributes").alias("scope"), E.listed("attributes").alias("attributes"), "description")

    return run


def _logs(profile: str):
    def run(spark, d):
        out = process(E.logs(spark, d), "logs", profile)
        return out.select("time_ns", "severity", "body", E.listed("resource").alias("resource"), E.listed("scope.attributes").alias("scope"), E.listed("attributes").alias("attributes"))

    return run


def _span_columns(out: DataFrame) -> DataFrame:
    event = F.get("events", F.lit(0))
    return out.withColumn("_event", event["attributes"]).select(
        F.col("start_ns").alias("time_ns"), "trace_id", "name", (F.col("end_ns") - F.col("start_ns")).alias("duration_ns"), "status_code", "status_message", "trace_state",
        event["name"].alias("event_name"), E.listed("_event").alias("event"), E.listed("resource").alias("resource"), E.listed("scope.attributes").alias("scope"), E.listed("attributes").alias("attributes"),
    )


def _spans(profile: str):
    return lambda spark, d: _span_columns(process(E.spans(spark, d), "spans", profile))


for _profile in PROFILES:
    QUERIES[f"prc_points_{_profile}"] = _points(_profile)
    QUERIES[f"prc_logs_{_profile}"] = _logs(_profile)
    QUERIES[f"prc_spans_{_profile}"] = _spans(_profile)

QUERIES["flt04_evaluation_branch"] = lambda spark, d: _span_columns(evaluation_spans(E.spans(spark, d)))

#: Labels that the samples of ``trx06_trx08_samples`` show; all others still tell series apart.
SHOWN = ("service_name", "status", "operation", "token_type")


def trx06(spark: SparkSession, d: str) -> DataFrame:
    """Delta points of the core profile to samples: names, labels, points that became one series, buckets, running totals."""
    at = (F.col("event_id") % 40 * 1_000_000_000).cast("string")
    rows = samples.to_samples(samples.reaggregate(samples.to_long(process(E.points(spark, d, at, samples.DELTA), "points"))), list(SHOWN))
    return rows.groupBy("metric", *SHOWN, "le", F.unix_micros("ts").alias("us")).agg(F.round(F.sum("value"), 4).alias("value"), F.count(F.lit(1)).alias("series"))


QUERIES["trx06_trx08_samples"] = trx06


def map14(spark: SparkSession, d: str) -> DataFrame:
    """Typed values by key: what a missing attribute, a text and a false flag count as in the routing rules."""
    s = E.spans(spark, d)
    flag = F.col("resource")["ai_context.export.phoenix"]["boolValue"].cast("string")
    return s.groupBy(text(F.col("resource"), "service.name").alias("service"), flag.alias("flag"), F.col("headers")["x-ai-observability-phoenix"].alias("header")).agg(F.count(F.lit(1)).alias("n"))


QUERIES["map14_typed_values"] = map14


def hooks(spark: SparkSession, d: str) -> DataFrame:
    return otlp.hook_events(E.hook_lines(table(spark, d, "conversations")))


def prc04(spark: SparkSession, d: str) -> DataFrame:
    """Hook lines to turn and tool spans; lines that aren't events, or of unknown events, drop out."""
    return sessions.turn_spans(hooks(spark, d)).select("session_id", "name", "span_kind", "tool_category", "model", "start_ns", "end_ns")


def stm02(spark: SparkSession, d: str) -> DataFrame:
    """Streaming: turns and tools from hook lines, by keyed state."""
    events = otlp.hook_events(E.hook_lines(jobs.read_table_stream(spark, d, "conversations")))
    folder = scratch_path(spark, "tools")
    carried.turn_stream(events, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/ends").select("session_id", "name", "tool_use_id", "start_ns", "end_ns")


def flt09(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of prompts and of the replies of one listed tool."""
    sized = sessions.content_sizes(hooks(spark, d), "size-only", "core", ("user-prompt", "mcp-tool-response"), {"mcp__files__read": "files"})
    return sized.groupBy("metric", "tool_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


#: SQL of the events of the other hook protocol over events; both engines use it.
HOOKS = {
    "event": "case event_type when 'view' then 'PreInvocation' when 'click' then 'PostInvocation' when 'error' then 'Stop' when 'purchase' then 'PostToolUse' else 'Notification' end",
    "conversation_id": "cast(user_id as varchar(20))",
    "model": "case event_id % 4 when 0 then 'gemini' when 1 then 'unknown' end",
    "invocation_num": "event_id % 2",
    "initial_steps": "case when event_id % 3 <> 0 then event_id % 5 end",
    "step_idx": "case when event_id % 7 <> 0 then event_id % 9 end",
    "operation": "case event_id % 3 when 0 then 'file-operation' when 1 then 'search-operation' else 'dancing' end",
    "execution_num": "user_id % 6",
    "termination_reason": "case when value > 20 then 'error' when event_id % 3 <> 0 then 'done' end",
    "error": "case user_id % 3 when 0 then 'boom' when 1 then ' ' end",
    "fully_idle": "case when event_id % 5 <> 0 then event_id % 2 = 0 end",
    "time_ns": "event_id * 1000000",
}


def hook_protocol(rows: DataFrame) -> DataFrame:
    return sessions.hook_columns(rows.selectExpr(*(f"{e} as {k}" for k, e in HOOKS.items())))


def prc05(spark: SparkSession, d: str) -> DataFrame:
    """Invocations and executions of the other hook protocol over events: views open, clicks close, errors stop."""
    spans = sessions.invocation_spans(hook_protocol(table(spark, d, "events")))
    return spans.select("conversation_id", "name", "model", "start_ns", "end_ns", "duration_ms", "success")


def prc05_logs(spark: SparkSession, d: str) -> DataFrame:
    """A log for each invocation's start and end, each tool's end and each stop."""
    return sessions.lifecycle_logs(hook_protocol(table(spark, d, "events")))


def prc05_stream(spark: SparkSession, d: str) -> DataFrame:
    """Streaming: the spans of ``prc05``, batch by batch."""
    folder = scratch_path(spark, "hooks")
    carried.hook_stream(hook_protocol(jobs.read_table_stream(spark, d, "events")), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/spans").select("conversation_id", "name", "model", "start_ns", "end_ns", "duration_ms", "success")


def prc05_log_stream(spark: SparkSession, d: str) -> DataFrame:
    """Streaming: the logs of ``prc05_logs``, batch by batch."""
    folder = scratch_path(spark, "hooks")
    carried.hook_stream(hook_protocol(jobs.read_table_stream(spark, d, "events")), folder).awaitTermination()
    return spark.read.parquet(f"{folder}/logs").drop("batch")


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    return status_line.safe_snapshot(E.snapshot_lines(spark, d).select(fields_once(F.from_json("value", STATUS_LINE))))


def trx11(spark: SparkSession, d: str) -> DataFrame:
    """Gauges of status-line snapshots."""
    g = status_line.gauges(snapshots(spark, d))
    return g.groupBy("metric", "model_family", "token_type", "state", "type").agg(F.round(F.sum("value"), 4).alias("value"), F.count(F.lit(1)).alias("n"))


def map18(spark: SparkSession, d: str) -> DataFrame:
    """Safe columns and the terminal line of each snapshot."""
    s = snapshots(spark, d)
    return s.select("time_ns", "session", "model", "agent_state", "execution_mode", "total_input", F.round("used_percentage", 4).alias("used_percentage"), "task_count", "exceeds_200k_tokens", status_line.status_text(s).alias("line"))


def steady(snapshots: DataFrame) -> DataFrame:
    """Snapshots that often show the same as the one before: counts of the session alone, few states; times in seconds."""
    zero, session = F.lit(0).cast("bigint"), F.col("session").cast("bigint")
    return snapshots.withColumns({
        "time_ns": F.col("time_ns") * 1_000_000, "total_input": session * 3, "total_output": session, "input": zero, "output": zero, "task_count": zero,
        "agent_state": F.when(F.col("agent_state").isin("click", "view"), "busy").otherwise("idle"), "model": F.lit("gemini"), "used_percentage": F.when(F.col("used_percentage") > 20, 20.5).otherwise(0.0),
        "quota": F.create_map(F.lit("weekly"), F.lit(0.9378), F.lit("daily"), F.when(F.col("exceeds_200k_tokens"), 0.0).otherwise(1.0)),
    })


def prc06(spark: SparkSession, d: str) -> DataFrame:
    """The log rows of snapshots that are sent: changed by their fingerprint, or a thousand seconds after the last one sent."""
    return status_line.status_logs(status_line.sent_snapshots(steady(snapshots(spark, d)), 1_000_000_000_000))


def prc06_gauges(spark: SparkSession, d: str) -> DataFrame:
    """The gauges of the snapshots that are sent."""
    g = status_line.gauges(status_line.sent_snapshots(steady(snapshots(spark, d)), 1_000_000_000_000))
    return g.groupBy("session", "metric", "token_type", "state", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


QUERIES |= {
    "prc04_hook_spans": prc04,
    "stm02_tool_stream": stm02,
    "flt09_content_sizes": flt09,
    "prc05_invocations": prc05,
    "prc05_lifecycle_logs": prc05_logs,
    "prc05_hook_stream": prc05_stream,
    "prc05_log_stream": prc05_log_stream,
    "trx11_status_gauges": trx11,
    "map18_safe_snapshots": map18,
    "prc06_sent_snapshots": prc06,
    "prc06_sent_gauges": prc06_gauges,
}
