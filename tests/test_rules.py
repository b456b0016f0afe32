"""Rules as documents, checks of compositions, summaries of growth, safe snapshots."""

import hashlib
import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from meterlake.functions import timeseries as ts
from meterlake.operators import accounting as A
from meterlake.operators import compositions, contracts, rules, samples, smoke, status_line
from meterlake.plans.pipelines import STAGES

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
LABELS = ["ai_agent_provider", "ai_agent_product", "agent_role", "model_id", "model_family", "evidence_class", "service_namespace", "skill_id", "mcp_server_name", "mcp_tool_name"]


def test_rule_files_equal_the_built_in_rules(spark, tmp_path):
    rng, rows = random.Random(1), {}
    for _ in range(300):
        turn = rng.random() < 0.6
        own = ["openai" if turn else "anthropic", "codex", rng.choice(["primary", "", None]), rng.choice(["gpt-5.6-sol", "unmapped", ""]), "gpt", "e", rng.choice([None, "live"]), *((None,) * 3 if turn else (rng.choice(["none", "s"]), "m", "t"))]
        kind = rng.choice(["input", "cached_input", "cache_write_input", "output", "total", "reasoning_output", "non_cached_input"])
        rows["ai_agent_turn_token_usage_sum" if turn else "ai_agent_request_token_usage_total", *own, kind] = float(rng.randint(0, 50))
    current = spark.createDataFrame([(*k, v) for k, v in rows.items()], ", ".join(f"{c} string" for c in ["metric", *LABELS, "token_type"]) + ", value double")
    docs = rules.accounting_rules()
    for n, part in enumerate((docs[:3], docs[3:])):
        (tmp_path / f"{n}.jsonl").write_text("\n".join(map(json.dumps, part)) + "\n\n")
    read = rules.read_rules(spark, f"{tmp_path}/*.jsonl")
    assert read == docs and rules.in_order(read)[0] == "ai_agent_token_usage_total"
    card = A.rate_card(spark)
    found = rules.evaluate(read, current, {"ai_agent_token_price_usd_per_million": card})
    want = A.recording_rules(current, card, A.rate_card(spark, A.CREDITS_PER_MILLION, unit="credit"))
    for name, table in found.items():
        pick = lambda df: sorted((*(str(r[c]) for c in LABELS), r.usage_class, round(r.value, 9)) for r in df.collect())
        assert pick(table) == pick(want[name]) and table.count() > 3, name


def test_faulty_rule_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"record": "x"}')
    with pytest.raises(ValueError, match="without a name or a value"):
        rules.read_rules(spark, f"{tmp_path}/*.jsonl")
    circle = [{"record": "a", "value": {"series": "b"}}, {"record": "b", "value": {"scaled": 2, "of": {"series": "a"}}}]
    with pytest.raises(ValueError, match="read each other"):
        rules.in_order(circle)
    current = spark.createDataFrame([("m", "x", 1.0)], "metric string, job string, value double")
    with pytest.raises(ValueError, match="unknown expression"):
        rules.evaluate([{"record": "a", "value": {"topk": 1}}], current)
    assert rules.evaluate([{"record": "a", "value": {"or": [{"series": "none"}, {"series": "m"}]}, "labels": {"k": "v"}}], current)["a"].collect() == [("x", "v", 1.0)]


def test_composition_faults_of_altered_graphs(spark):
    names = [stage for stage, *_ in compositions.EVALUATION["logs"]]
    assert names[:4] == list(STAGES)  # the policy is what the engine runs
    right = spark.range(1).select(F.lit("a").alias("config"), F.inline(compositions.cells()))
    assert compositions.composition_faults(right, compositions.EVALUATION, "config").count() == 0

    def faults(alter):
        graph = {p: alter(p, list(stages)) for p, stages in compositions.EVALUATION.items()}
        df = spark.range(1).select(F.lit("a").alias("config"), F.inline(compositions.cells(graph)))
        return {(r.pipeline, r.stage, r.fault) for r in compositions.composition_faults(df, compositions.EVALUATION, "config").collect()}

    assert faults(lambda p, s: [s[1], s[0], *s[2:]] if p == "logs" else s) == {("logs", "normalise", "out of order")}
    assert faults(lambda p, s: [x for x in s if x[1] != "delete"]) == {("traces/evaluation", "routing clean-up", "missing stage"), ("traces/evaluation", "routing", "key left behind")}
    assert faults(lambda p, s: [*s, ("spy", "process", "")] if p == "metrics" else s) == {("metrics", "spy", "unknown stage"), ("metrics", "spy", "stage behind an export")}
    gone = faults(lambda p, s: [] if p == "logs" else s)
    assert gone == {("logs", stage, "missing stage") for stage in names}


def test_contracts_of_panels(spark):
    rows = [("x", "p", "codex_a"), ("x", "p", "claude_code_b"), ("x", "q", "codex_a"), ("x", "q", "ai_agent_c"), ("y", "r", "nothing")]
    out = compositions.mixed_contracts(spark.createDataFrame(rows, "config string, panel string, metric string"), contracts.CONTRACTS, "config")
    assert sorted(map(tuple, out.collect())) == [("x", "q", "ai_agent,native"), ("y", "r", "none")]


def plain_increase(points, begin, end):
    """Growth within (begin, end] and its stretching, sample by sample."""
    own = [(t, v) for t, v in sorted(points) if begin < t <= end]
    if len(own) < 2:
        return None
    grown = sum(b if b < a else b - a for (_, a), (_, b) in zip(own, own[1:]))
    span, mean = own[-1][0] - own[0][0], (own[-1][0] - own[0][0]) / (len(own) - 1)
    near = lambda gap: gap if gap < 1.1 * mean else mean / 2
    head, tail = near(own[0][0] - begin), near(end - own[-1][0])
    head = min(head, span * own[0][1] / grown) if grown > 0 and own[0][1] >= 0 else head
    return grown * (span + head + tail) / span


@pytest.mark.parametrize("slices", [1, 7, 128, 100_000])
def test_summaries_of_any_width_merge_to_the_same_growth(spark, slices):
    rng, series = random.Random(slices), {}
    for job in "abc":
        value = 0.0
        for t in sorted(rng.sample(range(1, 1000), {"a": 200, "b": 3, "c": 1}[job])):
            value = rng.choice([value + rng.randint(0, 9), value + 1, float(rng.randint(0, 3))])
            series.setdefault(job, []).append((t, value))
    df = spark.createDataFrame([(j, T0 + timedelta(seconds=t), v) for j, own in series.items() for t, v in own], "job string, ts timestamp, value double")
    got = {r.job: r.value for r in ts.increase(df, T0 + timedelta(seconds=900), "800 seconds", slices=slices).collect()}
    want = {j: g for j, own in series.items() if (g := plain_increase(own, 100, 900)) is not None}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("step, length, steps", [(60, 60, 1), (60, 180, 3), (60, 150, 3), (50, 20, 1), (60, 90, 2)])
def test_grids_of_any_range_equal_single_ranges(spark, step, length, steps):
    rng, value, own = random.Random(step + length), 0.0, []
    for t in sorted(rng.sample(range(1, 700), 160)):
        value = rng.choice([value + 2, value + 5, 1.0])
        own.append((t, value))
    df = spark.createDataFrame([("a", T0 + timedelta(seconds=t), v) for t, v in own], "job string, ts timestamp, value double")
    grid = ts.increase_on_grid(df, T0 + timedelta(seconds=100), T0 + timedelta(seconds=100 + 8 * step), f"{step} seconds", length=f"{length} seconds", steps=steps)
    got = {int((r.ts.replace(tzinfo=timezone.utc) - T0).total_seconds()): r.value for r in grid.collect()}
    want = {e: g for n in range(1, 9) for e in [100 + n * step] if (g := plain_increase(own, e - length, e)) is not None}
    assert got == pytest.approx(want)


def test_cells_of_unequal_bounds_are_not_added(spark):
    schema = "metric string, labels map<string,string>, series string, kind string, temporality int, time_ns bigint, ts timestamp, value double, count bigint, bucket_counts array<bigint>, bounds array<double>"
    row = lambda counts, bounds: ("h", {"k": "a"}, "s", "histogram", 1, 10**9, T0, 1.0, sum(counts), counts, bounds)
    out = samples.reaggregate(spark.createDataFrame([row([1, 2], [5.0]), row([3, 4], [5.0]), row([5, 6], [7.0])], schema))
    assert sorted((r.bounds, r.bucket_counts, r["count"]) for r in out.collect()) == [([5.0], [4, 6], 10), ([7.0], [5, 6], 11)]


def test_fingerprint_is_the_digest_of_sorted_json(spark):
    base = {"agent_state": "busy", "artifact_count": 0, "execution_mode": "plan", "exceeds_200k_tokens": False, "model": "gemini", "pending_input_count": 1, "task_count": 2, "tool_confirmation_pending": True, "total_input": 88244, "total_output": 61074}
    usage, cases = {"cache_creation": 0, "cache_read": 20857, "input": 63382, "output": 346}, [(14.24, {"weekly": 0.9378, "daily": 0.0}), (0.0, {}), (100.0, {"a": 1.0, "B": 0.123456})]
    rows = [(*base.values(), *usage.values(), used, quota, "s", n, 80) for n, (used, quota) in enumerate(cases)]
    kinds = ["string", "bigint", "string", "boolean", "string", "bigint", "bigint", "boolean", "bigint", "bigint"]
    schema = ", ".join([*(f"{k} {t}" for k, t in zip(base, kinds)), *(f"{k} bigint" for k in usage), "used_percentage double, quota map<string,double>, session string, time_ns bigint, terminal_width bigint"])
    df = spark.createDataFrame(rows, schema)
    got = {r.time_ns: r.mark for r in df.select("time_ns", status_line.fingerprint(df).alias("mark")).collect()}
    for n, (used, quota) in enumerate(cases):
        text = json.dumps(base | {"current": usage, "used_percentage": used, "quota": quota}, sort_keys=True, separators=(",", ":"))
        assert got[n] == hashlib.sha256(text.encode()).hexdigest()
    twice = df.union(df.withColumn("time_ns", F.col("time_ns") + 100))
    assert status_line.sent_snapshots(twice.where("time_ns in (0, 100)"), 10**12).count() == 1


def test_smoke_checks(spark):
    traces = lambda *ids: spark.createDataFrame([(i,) for i in ids], "trace_id string")
    expected = spark.createDataFrame([("1", "a", True), ("2", "a", True), ("1", "b", False), ("2", "b", False), ("3", "b", True)], "trace_id string, store string, expected boolean")
    assert sorted(map(tuple, smoke.route_faults(expected, {"a": traces("1", "1", "9"), "b": traces("2", "3")}).collect())) == [("2", "a", "missing"), ("2", "b", "unexpected")]
    full = dict.fromkeys([*smoke.CANONICAL, *smoke.ATTRIBUTION], "x")
    points = spark.createDataFrame([(1, full), (2, {k: v for k, v in full.items() if k not in ("model_id", "skill_id")})], "n int, attributes map<string,string>")
    faults = lambda corporate: sorted((r.n, r.fault) for r in smoke.label_faults(points, corporate).collect())
    assert faults(False) == [(2, "model_id is missing"), (2, "skill_id was lost")]
    assert faults(True) == [(1, "mcp_server_name was kept"), (1, "mcp_tool_name was kept"), (1, "skill_id was kept"), (2, "mcp_server_name was kept"), (2, "mcp_tool_name was kept"), (2, "model_id is missing")]
    report = smoke.smoke_report({"good": traces(), "bad": traces("1", "2")}, "core", F.lit("s"), F.lit("e"), {"later": "no"}).first().report
    assert json.loads(report) == {"schema_version": "1.0", "mode": "core", "started_at": "s", "completed_at": "e", "checks": [{"name": "bad", "status": "FAIL", "detail": "2 failures"}, {"name": "good", "status": "PASS", "detail": "0 failures"}, {"name": "later", "status": "SKIP", "detail": "no"}]}
