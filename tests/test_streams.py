"""Streams in many small batches against their batch forms: series tables, carried rows, windows, ends of series."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from meterlake.operators import accounting as A
from meterlake.operators import sessions, status_line
from meterlake.streaming import carried, delivery, jobs
from meterlake.streaming.series import SeriesTable

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
KEY = {"job": "string", "host": "string"}
SAMPLES = "job string, host string, ts timestamp, value double"


def in_files(spark, folder, batches, schema):
    """A stream that takes one file a batch, in order."""
    folder.mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/tmp{n}")
        part = next(p for p in os.listdir(f"{folder}/tmp{n}") if p.endswith(".parquet"))
        (folder / "in").mkdir(exist_ok=True)
        os.rename(f"{folder}/tmp{n}/{part}", f"{folder}/in/{n:03d}.parquet")
        os.utime(f"{folder}/in/{n:03d}.parquet", (10**9 + n, 10**9 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def random_samples(rng, n):
    return [(rng.choice(["a", "b", None]), rng.choice(["x", "y", "z"]), T0 + timedelta(seconds=rng.randint(0, 500)), rng.choice([None, 1.0, 2.0, 3.5])) for _ in range(n)]


@pytest.mark.parametrize("fold", ["last", "sum"])
def test_series_table_equals_brute_force_and_reads_no_more_in_later_batches(spark, tmp_path, fold):
    rng, batches, read = random.Random(1), [], []
    table = SeriesTable(spark, str(tmp_path / "s"), KEY, fold, compact_every=4)
    for n in range(11):
        batches.append(random_samples(rng, 30))
        for _ in range(2 if n in (3, 6) else 1):  # a batch that is repeated replaces its first attempt
            read.append(table.before(n).count())
            live = {(r.job, r.host): r.value for r in table.merge(spark.createDataFrame(batches[-1], SAMPLES), n).collect()}
        want = {}
        for k, rows in enumerate(batches):
            for job, host, ts, value in rows:
                old = want.get((job, host))
                if fold == "sum":
                    want[job, host] = (0, value if old is None or old[1] is None else old[1] + (value or 0.0))
                elif old is None or (ts, k, value is not None, value or 0) > old[0]:
                    want[job, host] = ((ts, k, value is not None, value or 0), value)
        assert live == {k: v for k, (_, v) in want.items() if v is not None}
    assert max(read) <= 9 * 4 and max(read[-4:]) <= 9 * 4  # nine series, a full table and three changelogs at most
    assert sorted(os.listdir(tmp_path / "s" / "full")) == ["batch=3", "batch=7"]
    assert len(os.listdir(tmp_path / "s" / "changes")) <= 8


def test_series_table_drops_what_ended_long_ago(spark, tmp_path):
    table = SeriesTable(spark, str(tmp_path / "s"), KEY, compact_every=2, keep="100 seconds")
    row = lambda job, at, value: (job, "x", T0 + timedelta(seconds=at), value)
    table.merge(spark.createDataFrame([row("old", 0, 1.0), row("ended", 150, None), row("new", 200, 2.0)], SAMPLES), 0)
    assert [r.job for r in table.merge(spark.createDataFrame([row("ended", 140, 5.0)], SAMPLES), 1).collect()] == ["new"]
    assert sorted(r.job for r in table.before(2).collect()) == ["ended", "new"]  # a late sample must not bring it back
    with pytest.raises(ValueError):
        SeriesTable(spark, str(tmp_path / "s"), KEY, "mean")


def test_rules_by_batch_over_series(spark, tmp_path):
    rng = random.Random(2)
    labels = {"metric": "ai_agent_turn_token_usage_sum", "ai_agent_provider": "openai", "ai_agent_product": "codex", "model_family": "gpt", "evidence_class": "provider-reported", "service_namespace": "live"}
    rows = [[(rng.choice(["primary", "subagent"]), rng.choice(["gpt-5.6-sol", "other"]), rng.choice(["input", "cached_input", "output"]), T0, float(rng.randint(1, 9))) for _ in range(20)] for _ in range(5)]
    schema = "agent_role string, model_id string, token_type string, ts timestamp, value double"
    key = ["agent_role", "model_id", "token_type"]
    current = lambda series: series.withColumns({k: F.lit(v) for k, v in labels.items()})
    stream = in_files(spark, tmp_path / "src", rows, schema)
    jobs.recording_rules(stream, key, lambda s: {"usage": A.token_usage(current(s))}, str(tmp_path / "rules"), "sum", compact_every=2).awaitTermination(300)
    got = jobs.newest_batch(spark, str(tmp_path / "rules" / "rules" / "usage"))
    summed = spark.createDataFrame([r for b in rows for r in b], schema).groupBy(*key).agg(F.sum("value").alias("value"))
    pick = lambda df: sorted((r.agent_role, r.model_id, r.usage_class, r.value) for r in df.collect())
    assert pick(got) == pick(A.token_usage(current(summed)))
    assert len(os.listdir(tmp_path / "rules" / "rules" / "usage")) == 5


HOOKS = "event string, conversation_id string, model string, invocation_num bigint, initial_steps bigint, step_idx bigint, operation string, execution_num bigint, termination_reason string, error string, fully_idle boolean, time_ns bigint"


def random_hooks(rng, n):
    kinds = ["PreInvocation", "PreInvocation", "PostInvocation", "PostInvocation", "PostToolUse", "Stop", "Other"]
    return [
        (rng.choice(kinds), rng.choice("cde"), rng.choice([None, "m1", "m 2", "unknown", ""]), rng.choice([None, 0, 1, 2]), rng.choice([None, 3]), rng.choice([None, 4]), rng.choice([None, "dancing", "file-operation"]),
         rng.choice([None, 7]), rng.choice([None, "error", "done"]), rng.choice([None, " ", "boom"]), rng.choice([None, True, False]), k * 1_000_000)
        for k in range(n)
    ]


def plain_hooks(rows):
    """The protocol as a state machine: a first-seen time, open invocations by number, the model named last."""
    state, spans, logs = {}, [], []
    for event, c, model, number, _, _, _, execution, reason, error, _, now in rows:
        s = state.setdefault(c, {"open": {}, "model": "unknown"})
        s.setdefault("first", now)
        named = model or "unknown"
        s["model"] = named if named != "unknown" else s["model"]
        start, bad = now, False
        if event == "PreInvocation":
            s["open"][number] = now
        elif event == "PostInvocation":
            start = s["open"].pop(number, now)
            spans.append((c, "antigravity.agent.invocation", s["model"], start, max(now, start + 1), True))
        elif event == "PostToolUse":
            bad = error == "boom"
        elif event == "Stop":
            start, bad = s["first"], reason == "error" or error == "boom"
            spans.append((c, "antigravity.agent.execution", s["model"], start, max(now, start + 1), not bad))
        if event != "Other":
            logs.append((c, now, "ERROR" if bad else "INFO", (now - start) // 10**6 if event in ("PostInvocation", "Stop") else None, s["model"]))
        if event == "Stop":
            del s["first"]
            s["open"] = {}
    return sorted(spans), sorted(logs)


def test_hook_protocol_in_batches_equals_a_state_machine(spark, tmp_path):
    rows = random_hooks(random.Random(4), 240)
    spans, logs = plain_hooks(rows)
    span = lambda df: sorted((r.conversation_id, r.name, r.model, r.start_ns, r.end_ns, r.success) for r in df.collect())
    log = lambda df: sorted((r.conversation_id, r.time_ns, r.severity, r.duration_ms, r.model) for r in df.collect())
    whole = spark.createDataFrame(rows, HOOKS)
    assert span(sessions.invocation_spans(whole)) == spans and log(sessions.lifecycle_logs(whole)) == logs
    few = whole.select("event", "conversation_id", "time_ns")  # columns that a source lacks are null
    assert sessions.lifecycle_logs(few).count() == len(logs)
    cuts = [0, 1, 3, 40, 41, 120, 200, 240]
    folder = str(tmp_path / "out")
    carried.hook_stream(in_files(spark, tmp_path / "src", [rows[a:b] for a, b in zip(cuts, cuts[1:])], HOOKS), folder).awaitTermination(600)
    assert span(spark.read.parquet(f"{folder}/spans")) == spans and log(spark.read.parquet(f"{folder}/logs")) == logs
    assert spark.read.parquet(f"{folder}/carried/batch=6").count() <= 3 * (2 + 4)
    assert len(os.listdir(f"{folder}/carried")) == 2


TURNS = "session_id string, turn_id string, tool_use_id string, hook_event_name string, time_ns bigint"


def test_turns_in_batches_equal_a_state_machine(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("st"), "t", rng.choice([None, "u1", "u2"]), rng.choice(["UserPromptSubmit", "PreToolUse", "PreToolUse", "PostToolUse", "PostToolUse", "Stop"]), k * 10) for k in range(150)]
    state, want = {}, []
    for s, t, tool, kind, now in rows:
        own, name = state.setdefault(s, {}), tool or "unknown-tool"
        if kind == "UserPromptSubmit":
            own["turn"] = now
        elif kind == "PreToolUse":
            own[name, 0] = now
        elif kind == "PostToolUse":
            want.append((s, name, "tool", own.pop((name, 0), now - 1), now))
        else:
            want.append((s, "", "turn", own.get("turn", now - 1), now))
            state[s] = {}
    cuts = [0, 2, 50, 51, 110, 150]
    folder = str(tmp_path / "out")
    carried.turn_stream(in_files(spark, tmp_path / "src", [rows[a:b] for a, b in zip(cuts, cuts[1:])], TURNS), folder).awaitTermination(600)
    assert sorted((r.session_id, r.tool_use_id or "", r.name, r.start_ns, r.end_ns) for r in spark.read.parquet(f"{folder}/ends").collect()) == sorted(want)


def test_emission_in_batches_equals_one_pass(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("kl"), k * 10**9, rng.choice("ab" if k % 40 < 20 else "a")) for k in range(200)]
    whole = spark.createDataFrame(rows, "k string, time_ns bigint, fingerprint string")
    want, state = [], {}
    for k, now, mark in rows:
        before, last = state.get(k, (None, None))
        if last is None or mark != before or now - last >= 7 * 10**9:
            want.append((k, mark, now))
            last = now
        state[k] = (mark, last)
    pick = lambda df: sorted((r.k, r.fingerprint, r.time_ns) for r in df.collect())
    assert pick(status_line.emitted(whole, ["k"], 7 * 10**9)) == sorted(want)
    cuts = [0, 1, 60, 61, 62, 150, 200]
    stream = in_files(spark, tmp_path / "src", [rows[a:b] for a, b in zip(cuts, cuts[1:])], "k string, time_ns bigint, fingerprint string")
    carried.emitted_stream(stream, "k", str(tmp_path / "out"), 7 * 10**9).awaitTermination(600)
    assert pick(spark.read.parquet(str(tmp_path / "out" / "sent"))) == sorted(want)


def test_sliding_windows_and_series_ends_in_batches(spark, tmp_path):
    """Rows behind the watermark that held for the batch before theirs are left out of all windows and series."""
    schema = "k string, ts timestamp, value double"
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    batches = [[("a", at(0), 1.0), ("b", at(5), 2.0), ("a", at(12), 3.0)], [("a", at(70), 4.0), ("b", at(31), 5.0)], [("a", at(200), 6.0)], [("b", at(201), 7.0)], [("b", at(1), 9.0), ("c", at(600), 8.0)]]

    def run(name, table):
        jobs.append_stream(table, str(tmp_path / name), str(tmp_path / f"{name}-c")).awaitTermination(600)
        return spark.read.parquet(str(tmp_path / name)).collect()

    stream = in_files(spark, tmp_path / "src", batches, schema)
    taken = [r for b in batches for r in b if r != ("b", at(1), 9.0)]
    got = Counter({(r.k, r.ts.replace(tzinfo=timezone.utc)): r.value for r in run("slide", jobs.events_by_sliding_window(stream, "60 minutes", "20 minutes", "45 minutes", "k"))})
    want = Counter((k, at(20 * (int((ts - T0).total_seconds()) // 1200 + 1 + n))) for k, ts, _ in taken for n in range(3))
    assert got == Counter({x: n for x, n in want.items() if x[1] <= at(600 - 45)})
    ends = sorted((r.k, (r["first"].replace(tzinfo=timezone.utc) - T0).total_seconds() / 60, (r["last"].replace(tzinfo=timezone.utc) - T0).total_seconds() / 60, r.value, r.n) for r in run("ends", jobs.series_ends(stream, ["k"], "30 minutes", "45 minutes")))
    assert ends == [("a", 0, 12, 3.0, 2), ("a", 70, 70, 4.0, 1), ("a", 200, 200, 6.0, 1), ("b", 5, 31, 5.0, 2), ("b", 201, 201, 7.0, 1)]


# --- delivery and stores ----------------------------------------------------------------------------------------------


def flaky(folder, failures):
    """A destination that fails so many times for each chunk, then keeps it under its name."""
    os.makedirs(folder, exist_ok=True)

    def send(name, chunk):
        tries = f"{folder}/{name}.tries"
        with open(tries, "a") as f:
            f.write("x")
        if os.path.getsize(tries) <= failures[chunk.column("where")[0].as_py()]:
            raise TimeoutError(name)
        with open(f"{folder}/{name}.ids", "w") as f:
            f.write(" ".join(map(str, chunk.column("n").to_pylist())))

    return send


def received(folder):
    return sorted(int(x) for name in os.listdir(folder) if name.endswith(".ids") for x in open(f"{folder}/{name}").read().split())


def test_flaky_destinations_lose_nothing_within_the_deadline(spark, tmp_path):
    rows = [(n, ["up", "slow", None, "down"][n % 4], "x" * (n % 50)) for n in range(1000)]
    df = spark.createDataFrame(rows, "n long, where string, text string").repartition(3)
    folder = str(tmp_path / "sink")
    out = delivery.deliver(df, flaky(folder, {"up": 0, "slow": 2, None: 1, "down": 10**6}), "where", "b0", queue=40, first_pause=0.001, deadline=0.3).collect()
    assert received(folder) == [n for n, where, _ in rows if where != "down"]
    assert all(r.n <= 40 and (r.sent, r.attempts, r.error) == {"up": (True, 1, None), "slow": (True, 3, None), None: (True, 2, None)}.get(r["where"], (False, r.attempts, "TimeoutError")) for r in out)
    assert sum(r.n for r in out if not r.sent) == 250 and len({r.chunk for r in out}) == len(out)
    tiny = delivery.deliver(df.where("where = 'up'").coalesce(1), flaky(folder + "2", {"up": 0}), "where", queue_bytes=600).collect()
    assert sum(r.n for r in tiny) == 250 and max(r.n for r in tiny) < 40  # bytes bound a queue as well
    assert delivery.deliver(df.limit(0), flaky(folder, {}), "where").count() == 0


def test_a_repeated_batch_delivers_under_the_same_names(spark, tmp_path):
    schema = "n long, where string"
    batches = [[(n, "up") for n in range(30)], [(n, "down") for n in range(30, 50)]]
    stream = in_files(spark, tmp_path / "src", batches, schema)
    out = str(tmp_path / "out")
    delivery.delivering_stream(stream, flaky(str(tmp_path / "sink"), {"up": 1, "down": 99}), "where", out, queue=7, first_pause=0.001, deadline=0.01).awaitTermination(300)
    assert {tuple(r) for r in delivery.delivery_report(spark, out, "where").select("where", "delivered", "dropped").collect()} == {("up", 30, 0), ("down", 0, 20)}
    names = sorted(r.chunk for r in spark.read.parquet(f"{out}/deliveries").collect())
    again = delivery.deliver(spark.createDataFrame(batches[0], schema).coalesce(1), flaky(str(tmp_path / "sink"), {"up": 0}), "where", "0", queue=7)
    assert sorted(r.chunk for r in again.collect()) == [n for n in names if n.startswith("0-")]
    assert received(str(tmp_path / "sink")) == list(range(30))  # chunks of one name replace each other


def test_a_failed_store_is_repeated_without_doubling_the_others(spark, tmp_path):
    schema = "n long, where string"
    batches = [[(n, "a") for n in range(5)], [(n, "b") for n in range(5, 12)], [(n, "c") for n in range(12, 15)]]
    stream = in_files(spark, tmp_path / "src", batches, schema)
    out, broken, written = str(tmp_path / "out"), [True], []

    def first(t):
        written.append(t.agg(F.min("n")).first()[0])
        return t

    def second(t):
        if t.where("where = 'b'").count() and broken:
            broken.clear()
            return t.select(F.raise_error(F.lit("the second store is down")).alias("n"), "where")
        return t.where("n % 2 = 0")

    with pytest.raises(Exception, match="second store"):
        delivery.fan_out_stream(stream, {"first": first, "second": second}, out).awaitTermination(300)
    delivery.fan_out_stream(stream, {"first": first, "second": second}, out).awaitTermination(300)
    assert sorted(r.n for r in spark.read.parquet(f"{out}/first").collect()) == list(range(15))
    assert sorted(r.n for r in spark.read.parquet(f"{out}/second").collect()) == list(range(0, 15, 2))
    assert written == [0, 5, 12]  # the store that had batch 1 wasn't written again
