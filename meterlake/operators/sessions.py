"""Lifecycle hooks to spans: pairing of start and end events, turns and tools, content sizes. Batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions import text as T


def _id(prefix: str, *keys: str) -> Column:
    """A digest of the keys that is the same in every run, so that a replay gives the same spans."""
    return F.sha2(F.concat_ws(":", F.lit(prefix), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), 256)


def turn_spans(events: DataFrame) -> DataFrame:
    """Spans of hook events (hook_event_name, session_id, turn_id, tool_use_id, tool_name, model, time_ns).

    A turn runs from its last UserPromptSubmit before Stop to Stop (span of kind AGENT); a tool from its PreToolUse to
    its PostToolUse (kind TOOL), child of the turn. A missing start counts as one nanosecond before the end. The ends
    only make spans; starts without an end make none. A tool's category is that of its start, or of its end.
    One shuffle by turn: starts are carried forward to ends by windows.
    """
    turn = ["session_id", "turn_id"]
    ordered = Window.partitionBy(*turn).orderBy("time_ns").rowsBetween(Window.unboundedPreceding, 0)
    of_turn = lambda name, value: F.last(F.when(F.col("hook_event_name") == name, value), ignorenulls=True)
    tool = Window.partitionBy(*turn, "tool_use_id").orderBy("time_ns").rowsBetween(Window.unboundedPreceding, -1)
    start = F.struct(F.col("time_ns").alias("ns"), F.col("model").alias("model"), T.hook_tool_category(F.col("tool_name")).alias("category"))
    e = events.withColumn("tool_use_id", F.coalesce("tool_use_id", F.lit("unknown-tool")))
    e = e.withColumn("_turn", of_turn("UserPromptSubmit", F.struct(F.col("time_ns").alias("ns"), "model")).over(ordered))
    e = e.withColumn("_tool", F.last(F.when(F.col("hook_event_name") == "PreToolUse", start), ignorenulls=True).over(tool))
    ends = e.where(F.col("hook_event_name").isin("PostToolUse", "Stop"))
    is_tool = F.col("hook_event_name") == "PostToolUse"
    category = F.coalesce("_tool.category", T.hook_tool_category(F.col("tool_name")))
    begin = F.coalesce(F.when(is_tool, F.col("_tool.ns")).otherwise(F.col("_turn.ns")), F.col("time_ns") - 1)
    model = T.safe_text(F.coalesce("model", F.when(is_tool, F.col("_tool.model")), F.col("_turn.model")), refuse=T.HOOK_TEXT, length=T.HOOK_CHARS)
    turn_span = F.substring(_id("span", *turn), 1, 16)
    return ends.select(
        *turn, F.substring(_id("trace", *turn), 1, 32).alias("trace_id"),
        F.when(is_tool, F.substring(_id("tool", *turn, "tool_use_id"), 1, 16)).otherwise(turn_span).alias("span_id"),
        F.when(is_tool, turn_span).alias("parent_span_id"),
        F.when(is_tool, F.concat(F.lit("codex.tool."), category)).otherwise(F.lit("codex.agent.turn")).alias("name"),
        F.when(is_tool, "TOOL").otherwise("AGENT").alias("span_kind"), F.when(is_tool, category).alias("tool_category"), model.alias("model"),
        begin.alias("start_ns"), F.greatest(F.col("time_ns"), begin + 1).alias("end_ns"),
    )


def content_sizes(events: DataFrame, mode: str, profile: str, scopes: tuple[str, ...], tools: dict[str, str] | None = None) -> DataFrame:
    """Byte sizes as one-value histograms: (session_id, turn_id, metric, tool_id, bytes, bucket_counts).

    Only in mode "size-only", never in a corporate profile, only for the chosen scopes, and responses only of tools in
    the exact allow list ``tools`` (name -> logical id). Rows that don't qualify are filtered before a payload is read.
    """
    if mode != "size-only" or profile.startswith("corporate"):
        return events.limit(0).select("session_id", "turn_id", F.lit("").alias("metric"), F.lit("").alias("tool_id"), F.lit(0).cast("bigint").alias("bytes"), F.array().cast("array<bigint>").alias("bucket_counts"))
    allowed = {k: v for k, v in (tools or {}).items() if v}
    ids = F.create_map(*(F.lit(x) for pair in (allowed or {"": ""}).items() for x in pair))
    prompt = (F.col("hook_event_name") == "UserPromptSubmit") & F.lit("user-prompt" in scopes) & F.col("prompt").isNotNull()
    reply = (F.col("hook_event_name") == "PostToolUse") & F.lit("mcp-tool-response" in scopes) & F.col("tool_name").isin(*allowed) & F.col("tool_response").isNotNull()
    own = events.where(prompt | reply)
    size = F.when(F.col("hook_event_name") == "UserPromptSubmit", T.utf8_size(F.col("prompt"))).otherwise(T.utf8_size(T.canonical_json(F.col("tool_response"))))
    metric = F.when(F.col("hook_event_name") == "UserPromptSubmit", "ai_agent.observed.user_prompt.bytes").otherwise("ai_agent.observed.mcp_tool_response.bytes")
    sized = own.select("session_id", "turn_id", metric.alias("metric"), F.when(F.col("hook_event_name") == "PostToolUse", ids[F.col("tool_name")]).alias("tool_id"), size.alias("bytes"))
    return sized.withColumn("bucket_counts", T.one_hot(F.col("bytes")))


#: Columns of the events of the other hook protocol; those that a source lacks are null.
HOOK_COLUMNS = {
    "event": "string", "conversation_id": "string", "model": "string", "invocation_num": "bigint", "initial_steps": "bigint", "step_idx": "bigint", "operation": "string",
    "execution_num": "bigint", "termination_reason": "string", "error": "string", "fully_idle": "boolean", "time_ns": "bigint",
}


def hook_columns(events: DataFrame) -> DataFrame:
    """``events`` with exactly the columns of the protocol."""
    return events.select(*((F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in HOOK_COLUMNS.items()))


def hook_steps(events: DataFrame) -> DataFrame:
    """``events`` with what is known at each: ``_first`` (first event since the previous Stop), ``_open`` (start of the open invocation of
    its number), ``_model`` (last one named so far), and what later events need of it.

    A conversation's state is its first-seen time and a map of open invocations by number, both gone with Stop; here they are
    windows over the run between two Stops, so one shuffle by conversation sorts the events and holds no map.
    """
    conversation = Window.partitionBy("conversation_id")
    order = ["time_ns", "event", "invocation_num"]
    seen = conversation.orderBy(*order)
    is_stop = F.when(F.col("event") == "Stop", 1).otherwise(0)
    e = events.withColumn("_run", F.coalesce(F.sum(is_stop).over(seen.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = Window.partitionBy("conversation_id", "_run")
    invocation = Window.partitionBy("conversation_id", "_run", "invocation_num", F.col("event").isin("PreInvocation", "PostInvocation")).orderBy(*order)
    named = F.nullif(T.safe_text(F.col("model")), F.lit("unknown"))
    pre = F.lag(F.struct("event", "time_ns")).over(invocation)
    return e.withColumns({
        "_first": F.min("time_ns").over(run), "_open": F.when(pre["event"] == "PreInvocation", pre["time_ns"]), "_nth": F.row_number().over(run.orderBy(*order)),
        "_later": F.lead("event").over(invocation), "_model": F.coalesce(F.last(named, ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, 0)), F.lit("unknown")),
        "_runs": F.sum(is_stop).over(conversation), "_named": named.isNotNull() & (F.coalesce(F.count(named).over(seen.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)) == 0),
    })


def still_needed() -> Column:
    """Which of ``hook_steps`` later events need: the first of the running execution, open invocations, the last that names a model."""
    running = F.col("_run") == F.col("_runs")
    return running & ((F.col("_nth") == 1) | ((F.col("event") == "PreInvocation") & F.col("_later").isNull())) | F.col("_named")


def _ended() -> tuple[Column, Column, Column]:
    """(is a Stop, start, failed) of a step that ends something."""
    stop = F.col("event") == "Stop"
    failed = stop & ((T.safe_text(F.col("termination_reason")) == "error") | T.present(F.col("error")))
    return stop, F.when(stop, F.col("_first")).otherwise(F.coalesce("_open", F.col("time_ns"))), failed


def spans_of_steps(steps: DataFrame) -> DataFrame:
    ends = steps.where(F.col("event").isin("PostInvocation", "Stop"))
    stop, start, failed = _ended()
    number = F.coalesce(F.when(stop, F.col("execution_num")).otherwise(F.col("invocation_num")), F.lit(0)).cast("string")
    suffix = F.concat_ws(":", F.when(stop, "execution").otherwise("invocation"), number, start.cast("string"))
    key = F.sha2(F.col("conversation_id"), 256)
    return ends.select(
        "conversation_id", T.trace_id(key, suffix).alias("trace_id"), T.span_id(key, suffix).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"),
        F.when(stop, "antigravity.agent.execution").otherwise("antigravity.agent.invocation").alias("name"), F.col("_model").alias("model"), start.alias("start_ns"), F.greatest(F.col("time_ns"), start + 1).alias("end_ns"),
        T.duration_ms(start, F.col("time_ns")).alias("duration_ms"), (~failed).alias("success"),
    )


def logs_of_steps(steps: DataFrame) -> DataFrame:
    kind = F.col("event")
    own = steps.where(kind.isin("PreInvocation", "PostInvocation", "PostToolUse", "Stop"))
    stop, start, stop_failed = _ended()
    tool, invocation = kind == "PostToolUse", kind.isin("PreInvocation", "PostInvocation")
    failed = stop_failed | (tool & T.present(F.col("error")))
    of = lambda pre, post, used, stopped: F.when(kind == "PreInvocation", pre).when(kind == "PostInvocation", post).when(tool, used).otherwise(stopped)
    reason = T.safe_text(F.col("termination_reason"))
    ended = F.col("event").isin("PostInvocation", "Stop")
    return own.select(
        "conversation_id", "time_ns", of("antigravity.invocation.started", "antigravity.invocation.completed", "antigravity.tool.completed", "antigravity.execution.stopped").alias("event_name"),
        F.when(failed, "ERROR").otherwise("INFO").alias("severity"), of("model_invocation", "model_invocation", "tool_use", "agent_execution").alias("operation"),
        of("pre_invocation", "post_invocation", "post_tool_use", "stop").alias("stage"),
        of(F.lit("started"), F.lit("completed"), F.lit("completed"), F.when(F.coalesce("fully_idle", F.lit(False)), "idle").otherwise("background_active")).alias("state"),
        F.when(kind == "PostInvocation", "success").when(tool, F.when(failed, "error").otherwise("success")).when(stop, reason).alias("outcome"),
        F.when(tool, F.when(failed, "tool_error").otherwise("none")).when(stop, F.when(failed, "system_error").otherwise("none")).alias("error_category"),
        F.when(ended, T.duration_ms(start, F.col("time_ns"))).alias("duration_ms"), F.when(ended | tool, ~failed).alias("success"),
        F.when(invocation, F.coalesce("invocation_num", F.lit(0))).when(stop, F.coalesce("execution_num", F.lit(0))).alias("number"), F.when(invocation, F.coalesce("initial_steps", F.lit(0))).alias("initial_steps"),
        F.when(tool, T.listed_category(F.col("operation"))).alias("tool_category"), F.when(tool, F.coalesce("step_idx", F.lit(0))).alias("step_index"), F.when(stop, F.coalesce("fully_idle", F.lit(False))).alias("fully_idle"), F.col("_model").alias("model"),
    )


def invocation_spans(events: DataFrame) -> DataFrame:
    """Spans of the other hook protocol (columns: ``HOOK_COLUMNS``).

    PostInvocation closes the PreInvocation of the same number (missing, or closed before: zero length); Stop closes the execution
    that began with the first event after the previous Stop. Each span is a trace of its own, with ids from its keys. The
    protocol doesn't report the start of a tool, so tools have logs but no spans.
    """
    return spans_of_steps(hook_steps(hook_columns(events)))


def lifecycle_logs(events: DataFrame) -> DataFrame:
    """A log for each event of the other hook protocol: invocation started and completed, tool completed, execution stopped.

    Errors count only as failed or not; their text goes nowhere. A model that an event doesn't name is the last one named in
    its conversation.
    """
    return logs_of_steps(hook_steps(hook_columns(events)))


def turn_steps(events: DataFrame) -> DataFrame:
    """Events of turns with the starts that are open at each: ``_turn`` (last prompt since the previous Stop), ``_tool`` (start of its own
    tool), and what later events need."""
    turn, order = ["session_id", "turn_id"], ["time_ns", "hook_event_name", "tool_use_id"]
    seen = Window.partitionBy(*turn).orderBy(*order)
    kind = F.col("hook_event_name")
    e = events.withColumn("tool_use_id", F.coalesce("tool_use_id", F.lit("unknown-tool")))
    stops = F.when(kind == "Stop", 1).otherwise(0)
    e = e.withColumns({"_run": F.coalesce(F.sum(stops).over(seen.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_runs": F.sum(stops).over(Window.partitionBy(*turn))})
    run = Window.partitionBy(*turn, "_run").orderBy(*order)
    tool = Window.partitionBy(*turn, "_run", "tool_use_id", kind.isin("PreToolUse", "PostToolUse")).orderBy(*order)
    before, prompt = F.lag(F.struct("hook_event_name", "time_ns")).over(tool), F.when(kind == "UserPromptSubmit", F.col("time_ns"))
    return e.withColumns({
        "_turn": F.last(prompt, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1)), "_tool": F.when(before["hook_event_name"] == "PreToolUse", before["time_ns"]),
        "_later": F.lead("hook_event_name").over(tool), "_prompts": F.count(prompt).over(run.rowsBetween(1, Window.unboundedFollowing)),
    })


def turn_still_open() -> Column:
    """Which of ``turn_steps`` later events need: the last prompt and the starts of open tools since the last Stop."""
    kind = F.col("hook_event_name")
    return (F.col("_run") == F.col("_runs")) & (((kind == "UserPromptSubmit") & (F.col("_prompts") == 0)) | ((kind == "PreToolUse") & F.col("_later").isNull()))


def ends_of_turns(steps: DataFrame) -> DataFrame:
    """(session_id, turn_id, tool_use_id, name, start_ns, end_ns) of each end; a missing start counts as one nanosecond before it."""
    ends, stop = steps.where(F.col("hook_event_name").isin("PostToolUse", "Stop")), F.col("hook_event_name") == "Stop"
    start = F.coalesce(F.when(stop, F.col("_turn")).otherwise(F.col("_tool")), F.col("time_ns") - 1)
    return ends.select("session_id", "turn_id", F.when(~stop, F.col("tool_use_id")).alias("tool_use_id"), F.when(stop, "turn").otherwise("tool").alias("name"), start.alias("start_ns"), F.greatest(F.col("time_ns"), start + 1).alias("end_ns"))
