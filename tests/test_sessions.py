import json
import random

import pandas as pd
from pyspark.sql import functions as F

from meterlake.operators import sessions, sinks, status_line, traces
from meterlake.sources.otlp import hook_events
from meterlake.sources.schemas import STATUS_LINE
from meterlake.streaming import carried, jobs

HOOKS = [
    {"hook_event_name": "UserPromptSubmit", "session_id": "s", "turn_id": "t", "model": "gpt-5.6-sol", "prompt": "né", "time_ns": 1_000},
    {"hook_event_name": "PreToolUse", "session_id": "s", "turn_id": "t", "tool_use_id": "u", "tool_name": "Bash", "time_ns": 2_000},
    {"hook_event_name": "PostToolUse", "session_id": "s", "turn_id": "t", "tool_use_id": "u", "tool_name": "mcp__a", "tool_response": '{"b":1,"a":2}', "time_ns": 5_000},
    {"hook_event_name": "Stop", "session_id": "s", "turn_id": "t", "time_ns": 9_000},
    {"hook_event_name": "Stop", "session_id": "other", "turn_id": "t", "time_ns": 9_000},
    {"hook_event_name": "Notification", "session_id": "s", "turn_id": "t", "time_ns": 9_500},
]


def lines(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows] + [("[1]",), ("{",)], "value string")


def test_turns_and_tools(spark):
    spans = {(r.session_id, r.span_kind): r for r in sessions.turn_spans(hook_events(lines(spark, HOOKS))).collect()}
    assert len(spans) == 3
    turn, tool = spans["s", "AGENT"], spans["s", "TOOL"]
    assert (turn.start_ns, turn.end_ns, tool.start_ns, tool.end_ns) == (1000, 9000, 2000, 5000)
    assert tool.trace_id == turn.trace_id and tool.parent_span_id == turn.span_id and turn.parent_span_id is None
    assert (tool.name, tool.tool_category, turn.model) == ("codex.tool.execution", "execution", "gpt-5.6-sol")
    assert (spans["other", "AGENT"].start_ns, spans["other", "AGENT"].model) == (8999, "unknown")


def test_content_sizes_need_mode_scope_and_allow_list(spark):
    events = hook_events(lines(spark, HOOKS))
    both = ("user-prompt", "mcp-tool-response")
    got = {r.metric.split(".")[2]: (r.tool_id, r.bytes) for r in sessions.content_sizes(events, "size-only", "core", both, {"mcp__a": "files"}).collect()}
    assert got == {"user_prompt": (None, 3), "mcp_tool_response": ("files", len('{"a":2,"b":1}'))}
    assert sessions.content_sizes(events, "size-only", "core", both, {"mcp__b": "x"}).count() == 1
    assert sessions.content_sizes(events, "size-only", "corporate-redacted", both, {"mcp__a": "files"}).count() == 0
    assert sessions.content_sizes(events, "metadata-only", "core", both).count() == 0


def test_invocations(spark):
    rows = [("PreInvocation", "c", 1, None, 1_000_000, None, None), ("PostInvocation", "c", 1, None, 4_000_000, None, None), ("Stop", "c", None, 1, 9_000_000, "error", None), ("PostInvocation", "c", 2, None, 11_000_000, None, None)]
    df = spark.createDataFrame(rows, "event string, conversation_id string, invocation_num int, execution_num int, time_ns bigint, termination_reason string, error string")
    got = sorted((r.name.split(".")[2], r.duration_ms, r.success) for r in sessions.invocation_spans(df).collect())
    assert got == [("execution", 8, False), ("invocation", 0, True), ("invocation", 3, True)]


SNAPSHOT = {
    "session_id": "s", "model": {"id": "gemini"}, "context_window": {"total_input_tokens": 88244, "total_output_tokens": 61074, "used_percentage": 14.24, "current_usage": {"input_tokens": 63382, "output_tokens": 346, "cache_creation_input_tokens": 0, "cache_read_input_tokens": 20857}},
    "quota": {"gemini-weekly": {"remaining_fraction": 0.9378}}, "agent_state": "idle", "task_count": -3, "terminal_width": 20,
}


def snapshots(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").select(F.from_json("value", STATUS_LINE).alias("x")).select("x.*")


def test_status_line(spark):
    safe = status_line.safe_snapshot(snapshots(spark, [SNAPSHOT | {"time_ns": 1}, SNAPSHOT | {"time_ns": 2}, SNAPSHOT | {"time_ns": 3, "agent_state": "busy"}]))
    g = status_line.gauges(safe.where("time_ns = 1"))
    got = {(r.metric, r.token_type or r.type): r.value for r in g.collect()}
    assert g.select("metric").distinct().count() == 9
    assert got["antigravity_session_tokens", "input"] + got["antigravity_session_tokens", "output"] == 149318
    assert got["antigravity_context_used_ratio", None] == 0.1424 and got["antigravity_quota_remaining_ratio", "gemini-weekly"] == 0.9378
    assert got["antigravity_background_task_count", None] == 0 and got["antigravity_context_tokens", "cache_read"] == 20857
    assert len(safe.select(status_line.status_text(safe).alias("t")).first().t) == 19
    marks = safe.select("session", "time_ns", status_line.fingerprint(safe).alias("fingerprint"))
    assert sorted(r.time_ns for r in status_line.emitted(marks, ["session"]).collect()) == [1, 3]


def test_rows_that_are_sent_keep_their_columns_across_batches(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.randrange(60) * 10**9, rnd.choice("xy")) for _ in range(80)]
    rows = sorted(set(rows)) + [("c", 5 * 10**9, "x")]
    want, now = [], None
    for key, time, mark in rows:
        if now is None or key != now[0] or mark != now[1] or time - now[2] >= 4 * 10**9:
            want.append((key, mark, time, {key: time}))
            last = time
        now = key, mark, last
    table = spark.createDataFrame([(*r, {r[0]: r[1]}) for r in rows], "k string, time_ns bigint, fingerprint string, bag map<string,bigint>")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, "3")
    try:
        sent = [tuple(r) for r in status_line.emitted(table, ["k"], 4 * 10**9).collect()]
        ends = status_line.passed(table.withColumn("sent_ns", F.lit(None).cast("bigint")), ["k"], 4 * 10**9).where("last").collect()
    finally:
        spark.conf.unset(setting)
    assert sorted(sent, key=str) == sorted(want, key=str)
    assert sorted((r.k, r.time_ns, r.bag[r.k], r.sent_ns) for r in ends) == [(k, t, t, max(w[2] for w in want if w[0] == k)) for k, t in sorted({r[0]: r[1] for r in rows}.items())]


def test_snapshots_without_a_time_are_not_sent(spark):
    safe = status_line.safe_snapshot(snapshots(spark, [SNAPSHOT, SNAPSHOT, SNAPSHOT | {"time_ns": 2}, SNAPSHOT | {"time_ns": 2}, SNAPSHOT | {"time_ns": 3}]))
    assert [r.time_ns for r in status_line.sent_snapshots(safe).collect()] == [2]


def test_streams_equal_batches(spark, tmp_path):
    for n, part in enumerate((HOOKS[:2], HOOKS[2:5])):
        (tmp_path / "hooks").mkdir(exist_ok=True)
        (tmp_path / "hooks" / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
    raw = spark.readStream.text(str(tmp_path / "hooks"))
    carried.turn_stream(hook_events(raw), str(tmp_path / "out")).awaitTermination(120)
    streamed = sorted((r.session_id, r.name, r.start_ns, r.end_ns) for r in spark.read.parquet(str(tmp_path / "out" / "ends")).collect())
    batch = sessions.turn_spans(hook_events(lines(spark, HOOKS)))
    assert streamed == sorted((r.session_id, "tool" if r.span_kind == "TOOL" else "turn", r.start_ns, r.end_ns) for r in batch.collect())


def test_running_totals_emission_and_windows_as_streams(spark, tmp_path):
    rows = [{"k": "a", "time_ns": t * 10**9, "value": 1.0, "fingerprint": f, "event_name": "e", "ts": f"2024-01-01T00:00:{t:02d}Z"} for t, f in ((1, "x"), (2, "x"), (3, "y"), (4, "x"), (59, "x"))]
    src = tmp_path / "in"
    src.mkdir()
    (src / "0.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "k string, time_ns bigint, value double, fingerprint string, event_name string, ts timestamp"
    read = lambda: spark.readStream.schema(schema).json(str(src))

    def run(name, table):
        jobs.append_stream(table, str(tmp_path / name), str(tmp_path / f"{name}-check")).awaitTermination(120)
        return spark.read.parquet(str(tmp_path / name))

    jobs.running_totals(read(), ["k"], str(tmp_path / "totals")).awaitTermination(120)
    totals = spark.read.parquet(str(tmp_path / "totals" / "out"))
    assert sorted(r.value for r in totals.collect()) == [1, 2, 3, 4, 5]
    carried.emitted_stream(read().select("k", "time_ns", "fingerprint"), "k", str(tmp_path / "sent"), 30 * 10**9).awaitTermination(120)
    sent = spark.read.parquet(str(tmp_path / "sent" / "sent"))
    batch = status_line.emitted(spark.read.schema(schema).json(str(src)), ["k"], 30 * 10**9)
    assert sorted(r.time_ns for r in sent.collect()) == sorted(r.time_ns for r in batch.collect()) == [t * 10**9 for t in (1, 3, 4, 59)]
    seen = []
    jobs.rules_by_batch(read(), lambda df, n: seen.append(df.count()), str(tmp_path / "rules")).awaitTermination(120)
    assert sum(seen) == 5
    assert run("unique", jobs.unique_events(read(), "fingerprint")).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"metric": ["m"], "ts": pd.to_datetime(["2024-01-02"]), "value": [1.0]}))
    sinks.fan_out(df, [lambda t: sinks.write_samples(t, str(tmp_path / "a")), lambda t: sinks.capture(t, str(tmp_path / "b"))])
    assert sinks.expire(spark, str(tmp_path / "a"), "2024-01-01").count() == 1
    assert sinks.expire(spark, str(tmp_path / "a"), "2024-01-03").count() == 0
    assert sinks.safe_columns(df.withColumnRenamed("value", "a.b")).columns == ["metric", "ts", "a_b"]


def test_trace_id_in_line(spark):
    line = "x trace_id=" + "A" * 32
    assert spark.range(1).select(traces.trace_id_in(F.lit(line)).alias("t")).first().t == "a" * 32
