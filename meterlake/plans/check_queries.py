"""Registered queries of checks, sinks, streams and text functions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import text as T
from meterlake.functions import timeseries as ts
from meterlake.operators import accounting as A
from meterlake.operators import checks, compositions, contracts, privacy, rules, samples, sinks, smoke
from meterlake.operators.canonical import COPIES, typed
from meterlake.operators.traces import evaluation_branch
from meterlake.plans import catalog as C
from meterlake.plans import envelopes as E
from meterlake.plans import views as W
from meterlake.plans.pipelines import evaluation_spans, process
from meterlake.sources import config, otlp
from meterlake.sources.scratch import scratch_path, stored
from meterlake.streaming import delivery, jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    return W.table(spark, d, "events")


# --- documents and golden numbers -----------------------------------------------------------------------------------

#: A context event with parts that vary by event: SQL of its text, for both engines.
CONTEXT_EVENT = """case when event_id % 11 = 0 then '[1]' when event_id % 13 = 0 then '{' else concat(
    '{"schema_version":"1.0","occurred_at":"2024-01-02T03:04:05Z","environment":{"profile":"core"},"framework":{"name":"f","version":"1"},"workflow":{"type":"t"',
    case when event_id % 5 = 0 then '' else ',"stage":"s"' end, '},"operation":{"type":"', case when event_id % 3 = 1 then 'dance' else 'tool' end,
    '","state":"active","outcome":"success","evidence_class":"git-fact","duration_ms":', cast(user_id as varchar(20)), '},"privacy":{"content_captured":false,"policy_profile":"personal-minimized"}',
    case when event_id % 7 = 0 then ',"prompt":"p"' else '' end, '}') end"""


@query("jsn01_event_conformance")
def jsn01(spark, d):
    found = contracts.event_violations(events(spark, d).select("event_id", F.expr(CONTEXT_EVENT).alias("event")))
    return found.select("event_id", F.when(F.get("violations", F.lit(0)) == "$", "$").otherwise(F.array_join("violations", ",")).alias("violations"))


# Token counts of the golden turns, by namespace.
GOLDEN = {
    "cost-fixture": ("gpt-5.6-sol", None, {"input": 10000, "cached_input": 6000, "cache_write_input": 1000, "output": 2000, "reasoning_output": 500, "total": 12000}),
    "role-fixture": ("codex-auto-review", None, {"input": 8000, "cached_input": 6000, "output": 1000, "total": 9000}),
    "agent-fixture": ("gpt-5.6-terra", "subagent", {"input": 2000, "cached_input": 1000, "output": 500, "total": 2500}),
}


@query("sm02_sm08_golden_numbers")
def sm02(spark, d):
    """The golden turns of each nation, as often as its region's number plus one, as documents through the core profile, to
    samples, to usage, cost, credits and what has no price."""
    cells = [(ns, model, role, kind, float(n)) for ns, (model, role, tokens) in GOLDEN.items() for kind, n in tokens.items()]
    golden = F.array(*(F.struct(*(F.lit(x).cast("double" if name == "n" else "string").alias(name) for name, x in zip(("ns", "model", "role", "kind", "n"), cell))) for cell in cells))
    turns = W.table(spark, d, "nation").select("n_nationkey", (F.col("n_regionkey") + 1).cast("double").alias("times"), F.inline(golden))
    turns = turns.select(F.concat_ws("-", F.lit("nation"), F.col("n_nationkey").cast("string"), "ns").alias("ns"), "model", "role", "kind", (F.col("n") * F.col("times")).alias("n"))
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), F.struct(value.alias("stringValue")).alias("value"))
    given = lambda *pairs: F.filter(F.array(*pairs), lambda a: a["value"]["stringValue"].isNotNull())
    point = F.struct(F.lit("1000").alias("timeUnixNano"), F.lit("1").alias("count"), F.col("n").alias("sum"), F.array(F.lit("1")).alias("bucketCounts"), given(pair("model", F.col("model")), pair("agent_role", F.col("role")), pair("token_type", F.col("kind"))).alias("attributes"))
    metric = F.struct(F.lit("codex.turn.token_usage").alias("name"), F.struct(F.lit(1).alias("aggregationTemporality"), F.array(point).alias("dataPoints")).alias("histogram"))
    resource = F.struct(given(pair("service.name", F.lit("codex-app-server")), pair("service.namespace", F.col("ns"))).alias("attributes"))
    document = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(metric).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics")))
    points = process(otlp.points(otlp.render_fixture(turns.select(document.alias("value")), "metrics", 0)), "points")
    current, path = samples.to_samples(samples.reaggregate(samples.to_long(points)), [*A.REQUEST_LABELS, "token_type"]), scratch_path(spark, "golden")
    current.write.parquet(path)  # read by every rule
    current = spark.read.schema(current.schema).parquet(path)
    recorded = A.recording_rules(current, A.rate_card(spark), A.rate_card(spark, A.CREDITS_PER_MILLION, unit="credit"))
    names = ("ai_agent_token_usage_total", "ai_agent_estimated_cost_usd_total", "ai_agent_estimated_credit_usage_total", "ai_agent_unpriced_api_token_usage_total", "ai_agent_unpriced_credit_token_usage_total")
    each = [recorded[n].select(F.lit(n).alias("rule"), "service_namespace", "agent_role", "model_id", "usage_class", F.round("value", 9).alias("value")) for n in names]
    out = each[0]
    for table in each[1:]:
        out = out.union(table)
    return out


@query("chk02_forbidden_keys")
def chk02(spark, d):
    """Keys that must not be stored, as they came and as each profile leaves them."""
    raw, names = stored(E.logs(spark, d), "parsed-logs"), ["prompt", "prompt.text", "arguments", "url.full"]
    stages = {"raw": raw, "core": process(raw, "logs"), "corporate": process(raw, "logs", "corporate")}
    every = [checks.forbidden_keys(t, "attributes", names).select(F.lit(stage).alias("stage"), "key", "n") for stage, t in stages.items()]
    return every[0].union(every[1]).union(every[2])


@query("sm12_stored_logs_report")
def sm12(spark, d):
    """Bodies are constant and no address is left: after the core profile; before it nearly every record fails."""
    raw = E.logs(spark, d)
    done = process(raw, "logs")
    body = "AI telemetry metadata event"
    return contracts.report({
        "raw bodies": checks.not_constant(raw, "body", body), "bodies": checks.not_constant(done, "body", body),
        "raw addresses": checks.containing(raw.select("resource"), ["@mail.example"]), "addresses": checks.containing(done.select("resource", "attributes", "body"), ["@mail.example"]),
    })


@query("sm11_gauge_pairs")
def sm11(spark, d):
    """Native gauges without an equal observed copy: those of one metric are given another value, of one no copy."""
    names = F.array(*(F.lit(n) for n in ("antigravity_session_tokens", "antigravity_artifact_count", "antigravity_pending_input_count")))
    native = events(spark, d).select(F.element_at(names, (F.col("event_id") % 3 + 1).cast("int")).alias("metric"), F.col("event_type").alias("state"), "value").groupBy("metric", "state").agg(F.max("value").alias("value"))
    copies = native.withColumn("metric", F.create_map(*(F.lit(x) for pair in COPIES.items() for x in pair))[F.col("metric")])
    copies = copies.where(~F.col("metric").endswith("pending_input_count")).withColumn("value", F.when(F.col("metric").endswith("artifact_count"), F.col("value") + 1).otherwise(F.col("value")))
    return checks.unpaired(native.unionByName(copies), COPIES, ["state"])


@query("chk12_rubric_faults")
def chk12(spark, d):
    """A rubric read from a document, with a fault for each region but one."""
    label = F.array(F.struct(F.lit("good").alias("label"), F.lit(1.0).alias("score")))
    r = W.table(spark, d, "region").select(
        F.when(F.col("r_regionkey") == 0, "other").otherwise(F.concat(F.lit("check "), F.col("r_regionkey").cast("string"))).alias("name"), F.when(F.col("r_regionkey") == 1, "NUMBER").otherwise("CATEGORICAL").alias("type"),
        F.when(F.col("r_regionkey") == 2, F.array().cast("array<struct<label:string,score:double>>")).when(F.col("r_regionkey") == 3, F.concat(label, label)).otherwise(label).alias("labels"),
    )
    path = scratch_path(spark, "rubric")
    r.write.json(path)
    return checks.rubric_faults(config.read_rubric(spark, path), [f"check {n}" for n in range(1, 9)])


@query("src20_rate_files")
def src20(spark, d):
    """Rate cards, made of the part table and stored by model, read from files by a pattern."""
    path = scratch_path(spark, "rates")
    card = W.part_card(spark, d)
    card.write.partitionBy("model_id").json(path)
    return config.read_rates(spark, f"{path}/*/*.json", path).select("ai_agent_provider", "model_id", "usage_class", "currency", "rate_card_version", "value")


@query("src20_rule_files")
def src20_rules(spark, d):
    """The accounting rules as documents in two files, read by a pattern and evaluated over the token counters."""
    folder = scratch_path(spark, "rule-files")
    docs = spark.createDataFrame([(n % 2, json.dumps(r)) for n, r in enumerate(rules.accounting_rules())], "file int, value string")
    docs.coalesce(1).write.partitionBy("file").text(folder)

    def stored(name: str, table: DataFrame) -> DataFrame:
        path = scratch_path(spark, "series")
        table.write.parquet(path)
        return spark.read.schema(table.schema).parquet(path)

    current = stored("current", W.current_tokens(spark, d))
    found = rules.evaluate(rules.read_rules(spark, f"{folder}/*/*.txt"), current, {"ai_agent_token_price_usd_per_million": W.prices(spark)}, stored)
    columns = [*W.TOKEN_LABELS, *W.REQUEST_ONLY, "usage_class", "accounting_schema"]
    each = [table.select(F.lit(name).alias("rule"), *columns, F.round("value", 9).alias("value")) for name, table in found.items()]
    return each[0].union(each[1]).union(each[2])


@query("sm13_route_presence")
def sm13(spark, d):
    """Traces that the two stores should have and lack, or the other way round: every 97th is expected where it doesn't belong."""
    raw = E.spans(spark, d)
    chosen = F.expr(f"event_id % 5 <> 0 and coalesce({E.OPT_OUT}, true) and coalesce({E.HEADER}, 'true') <> 'false'")
    routes = events(spark, d).select("event_id", F.md5(F.col("event_id").cast("string")).alias("trace_id"), F.inline(F.array(F.struct(F.lit("traces").alias("store"), F.lit(True).alias("due")), F.struct(F.lit("evaluation").alias("store"), chosen.alias("due")))))
    expected = routes.select("trace_id", "store", F.when(F.col("event_id") % 97 == 0, ~F.col("due")).otherwise(F.col("due")).alias("expected"))
    return smoke.route_faults(expected, {"traces": process(raw, "spans", "evaluation"), "evaluation": evaluation_spans(raw)})


@query("sm10_request_labels")
def sm10(spark, d):
    """Labels of the canonical request counters by mode, and faults: attribution stays in core and goes in the corporate profile."""
    raw, each = stored(E.points(spark, d), "parsed-points"), []
    for mode in ("core", "corporate"):
        own = process(raw, "points", mode).where("metric = 'ai_agent.request.token_usage.total'")
        given = own.select(F.explode(F.map_keys("attributes")).alias("label")).where(F.col("label").isin(*smoke.CANONICAL, *smoke.ATTRIBUTION))
        faults = smoke.label_faults(own, mode == "corporate").select(F.col("fault").alias("label"))
        each.append(given.union(faults).groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "label", "n"))
    return each[0].union(each[1])


@query("snk07_smoke_report")
def snk07_smoke(spark, d):
    """The report of a run as one document, with mode and times; the times are those of the first and last event."""
    e, docs = events(spark, d), W.table(spark, d, "documents")
    times = e.agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("a"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("b"))
    found = smoke.smoke_report({"parts": checks.duplicates(W.table(spark, d, "part"), ["p_partkey"]), "languages": checks.outside_domain(docs, {"lang": ["en", "fr"]})}, "core", F.lit("{a}"), F.lit("{b}"), {"evaluation": "not in this mode"})
    return times.join(found).select(F.replace(F.replace("report", F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b")).alias("report"))


@query("src05_template_times")
def src05(spark, d):
    """Span documents whose times are placeholders: all become one frozen time, starts 50 ms before it."""
    document = F.concat(
        F.lit('{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"'), F.col("event_id").cast("string"), F.lit('","name":"'), F.col("event_type"), F.lit('","startTimeUnixNano":"'),
        F.when(F.col("event_id") % 2 == 0, "{{START_TIME_UNIX_NANO}}").otherwise("{{TIME_UNIX_NANO}}"), F.lit('","endTimeUnixNano":"{{END_TIME_UNIX_NANO}}"}]}]}]}'),
    )
    spans = otlp.spans(otlp.render_fixture(events(spark, d).select(document.alias("value")), "traces", 1_700_000_000_000_000_000))
    return spans.select("trace_id", "name", "start_ns", "end_ns")


#: What is done to the graph of the evaluation profile in each nation, by its key: SQL of the position and of the row, for both engines.
ALTERED = {
    "position": "case when n_nationkey % 9 = 1 and pipeline = 'logs' and stage = 'initial' then 7 when n_nationkey % 9 = 2 and stage = 'routing clean-up' then 9 else position end",
    "stage": "case when n_nationkey % 9 = 3 and pipeline = 'metrics' and stage = 'final' then 'finish' when n_nationkey % 9 = 4 and pipeline = 'traces' and stage = 'final' then 'initial' else stage end",
    "kind": "case when n_nationkey % 9 = 5 and stage = 'log store' then 'process' else kind end",
    "detail": "case when n_nationkey % 9 = 6 and stage = 'routed' then 'never' when n_nationkey % 9 = 7 and stage = 'routing clean-up' then 'other.key' else detail end",
}


@query("chk17_composition_faults")
def chk17(spark, d):
    """Faults of a composition for each nation, altered in another way for each remainder of its key."""
    rows = W.table(spark, d, "nation").select("n_nationkey", F.inline(compositions.cells()))
    graphs = rows.where("not (n_nationkey % 9 = 8 and stage = 'canonicalise')").select("n_nationkey", "pipeline", *(F.expr(e).cast("int" if k == "position" else "string").alias(k) for k, e in ALTERED.items()))
    return compositions.composition_faults(graphs, compositions.EVALUATION, "n_nationkey")


@query("chk08_mixed_contracts")
def chk08(spark, d):
    """Panels of each region that read metrics of several contracts: one of the catalogue's panels also reads a native one, another none."""
    panels = F.array(*(F.struct(F.lit(name).alias("panel"), F.lit(p.metric).alias("metric")) for name, p in sorted(C.PANELS.items())))
    rows = W.table(spark, d, "region").select("r_regionkey", F.inline(panels))
    also = F.when((F.col("r_regionkey") == 1) & (F.col("panel") == "cu02"), F.array("metric", F.lit("codex_tool_call"))).when((F.col("r_regionkey") == 2) & (F.col("panel") == "cu06"), F.array(F.lit("other_metric"))).otherwise(F.array("metric"))
    return compositions.mixed_contracts(rows.select("r_regionkey", "panel", F.explode(also).alias("metric")), contracts.CONTRACTS | {"health": ("up", "otelcol_")}, "r_regionkey")


# --- backlog checks -------------------------------------------------------------------------------------------------


def sessions_of(spark, d) -> DataFrame:
    """Work of sessions over events: edits, validations, waits and sub-agents."""
    kind = F.when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "view", "validation").when(F.col("event_type") == "signup", "wait").when(F.col("event_type") == "error", "failure").otherwise("subagent")
    return events(spark, d).select("event_id", F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("session"), kind.alias("kind"), "ts", "value")


@query("chk16_late_preflight")
def late(spark, d):
    return checks.late_first(sessions_of(spark, d), "session", "validation", "edit")


@query("chk16_unattributed_waits")
def waits(spark, d):
    rows = sessions_of(spark, d).withColumn("reason", F.when(F.col("value") > 50, "review"))
    return checks.without_reason(rows, "wait", "reason").select("event_id", "session")


@query("chk16_context_budget")
def budget(spark, d):
    rows = sessions_of(spark, d)
    return checks.over_budget(rows, ["session"], F.col("value"), 500.0).select("session", F.round("total", 6).alias("total"))


@query("chk16_subagent_overlap")
def overlap(spark, d):
    rows = sessions_of(spark, d).where("kind = 'subagent'").withColumn("end_ts", F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 20)))
    return checks.overlapping(rows, ["session"], "ts", "end_ts").select("event_id", "session")


@query("chk16_untruthful_outcomes")
def untruthful(spark, d):
    rows = sessions_of(spark, d)
    return checks.contradicted(rows.where("kind = 'validation' and value > 30"), rows.where("kind = 'failure'"), "session").select("event_id", "session")


# --- text functions -------------------------------------------------------------------------------------------------


@query("map03_delete_where")
def map03(spark, d):
    keys = F.array(*(F.lit(k) for k in ("model", "tool", "status")))
    bag = F.map_from_arrays(keys, F.transform(keys, lambda k: typed(k)))
    rows = events(spark, d).select("event_id", privacy.delete_key_where(bag, "model", F.col("event_id") % 2 == 0).alias("attributes"))
    return rows.select("event_id", F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("keys"))


@query("agg13_last_not_null")
def agg13(spark, d):
    rows = events(spark, d).select("event_type", "ts", F.when(F.col("user_id") % 2 == 0, F.col("value")).alias("value"))
    return ts.last_not_null(rows, ["event_type"])


@query("flt08_flt11_text_tests")
def flt08(spark, d):
    e = events(spark, d)
    word = F.element_at(F.array(*map(F.lit, ("1", " Yes", "off", "TRUE", "", "0", "on"))), (F.col("event_id") % 7 + 1).cast("int"))
    host = F.element_at(F.array(*map(F.lit, ("http://localhost:4318/v1", "https://127.0.0.1/x", "http://example.com", "http://[::1]:80", "ftp://localhost"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.groupBy(word.alias("word"), host.alias("url")).agg(F.first(T.is_true(word)).alias("truthy"), F.first(T.is_loopback(host)).alias("loopback"))


@query("str14_str15_ids")
def str14(spark, d):
    p = W.table(spark, d, "pages").select("page_id", F.concat(F.lit("id="), "url").alias("pair"), F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, "!").otherwise("")).alias("id"), F.substring(F.md5("url"), 1, 16).alias("span"))
    key, value = T.key_value(F.col("pair"))
    return p.select("page_id", key.alias("key"), value.alias("value"), T.is_logical_id(F.col("id")).alias("logical"), T.is_hex_id(F.col("span"), 16).alias("hex16"), T.is_hex_id(F.col("span"), 32).alias("hex32"))


@query("cnd02_cnd03_outcomes")
def cnd02(spark, d):
    e = events(spark, d)
    category = F.element_at(F.array(*map(F.lit, ("file-operation", "search-operation", "dancing"))), (F.col("event_id") % 3 + 1).cast("int"))
    error = F.element_at(F.array(F.lit("boom"), F.lit(" "), F.lit(None).cast("string")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.groupBy(T.listed_category(category).alias("category"), T.outcome(error).alias("outcome"), T.error_category(error).alias("error")).agg(F.count(F.lit(1)).alias("n"))


# --- sinks and streams ----------------------------------------------------------------------------------------------


@query("snk01_snk04_samples_fan_out")
def snk01(spark, d):
    """Samples to two sinks at once: partitioned Parquet, of which retention keeps a part, and lines of JSON."""
    rows = events(spark, d).select(F.concat(F.lit("m_"), "event_type").alias("metric"), "ts", "value")
    stored, lines = scratch_path(spark, "samples"), scratch_path(spark, "lines")
    sinks.fan_out(rows, [lambda t: sinks.write_samples(t, stored), lambda t: sinks.capture(t, lines)])
    kept = sinks.expire(spark, stored, "2024-01-15").select(F.lit("kept").alias("sink"), "metric", "value")
    every = spark.read.schema("metric string, value double").json(lines).select(F.lit("lines").alias("sink"), "metric", "value")
    return kept.union(every).groupBy("sink", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("snk02_logs_by_stream")
def snk02(spark, d):
    path = scratch_path(spark, "log-store")
    sinks.write_logs(process(E.logs(spark, d), "logs"), path)
    own = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("service_name", "service_namespace")]  # an empty folder label reads as null
    return spark.read.parquet(path).groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.max("time_ns").alias("newest"))


@query("snk03_spans_by_date")
def snk03(spark, d):
    path = scratch_path(spark, "trace-store")
    sinks.write_spans(process(E.spans(spark, d), "spans"), path)
    return spark.read.parquet(path).groupBy(F.col("date").cast("string").alias("date"), "status_code").agg(F.count(F.lit(1)).alias("n"))


def _sent_to(name: str, chunk) -> None:
    """A destination as the delivery queries have it: that of errors is down."""
    if chunk.column("event_type")[0].as_py() == "error":
        raise ConnectionError(name)


@query("stm08_counted_drops")
def stm08(spark, d):
    """Streaming: events to a destination for each type; what can't be delivered until the deadline is dropped and counted."""
    folder = scratch_path(spark, "deliveries")
    rows = jobs.read_table_stream(spark, d, "events").select("event_id", "event_type", "value")
    delivery.delivering_stream(rows, _sent_to, "event_type", folder, queue=1024, first_pause=0.01, deadline=0.03).awaitTermination()
    return delivery.delivery_report(spark, folder, "event_type").select("event_type", "delivered", "dropped", (F.col("retried") > 0).alias("retried"))


@query("snk04_evaluation_stores")
def snk04(spark, d):
    """Streaming: spans of documents to the trace store and, those that qualify, to the evaluation store, committed batch by batch."""
    folder = scratch_path(spark, "span-stores")
    spans = process(E.span_stream(spark, d), "spans", "evaluation")  # once for both stores
    sinks_ = {"traces": lambda t: t, "evaluation": evaluation_branch}
    delivery.fan_out_stream(spans, sinks_, folder).awaitTermination()
    each = [spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("store"), F.col("name").alias("span"), "status_code") for name in sinks_]
    return each[0].union(each[1]).groupBy("store", "span", "status_code").agg(F.count(F.lit(1)).alias("n"))


@query("src08_scrapes")
def src08(spark, d):
    """Scraped samples as files of JSON lines, taken up by a stream and stored."""
    path = scratch_path(spark, "scrapes")
    events(spark, d).select(F.lit("up").alias("metric"), F.col("event_type").alias("instance"), "ts", F.when(F.col("value") > 20, 1.0).otherwise(0.0).alias("value")).write.json(path)
    stored = jobs.run_available(jobs.scrapes(spark, path, "metric string, instance string, ts timestamp, value double"))
    return stored.groupBy("metric", "instance").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("up"))


@query("stm05_windows")
def stm05(spark, d):
    """Streaming: events by day; only windows that the watermark has closed are given out."""
    rows = jobs.read_table_stream(spark, d, "events").select(F.col("event_type").alias("event_name"), F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.run_available(jobs.events_by_window(rows, "1 day", late="48 hours"))
    return out.select("event_name", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query("stm05_sliding_windows")
def stm05_sliding(spark, d):
    """Streaming: events of the last six hours, every hour; overlapping windows share the hours' counts."""
    rows = jobs.read_table_stream(spark, d, "events").select(F.col("event_type").alias("event_name"), F.col("ts").cast("timestamp").alias("ts"))
    out = jobs.run_available(jobs.events_by_sliding_window(rows, "6 hours", "1 hour", late="48 hours"))
    return out.select("event_name", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")


@query("tsf11_series_ends")
def tsf11_ends(spark, d):
    """Streaming: a user's series ends half an hour after its last event, and starts anew with the next."""
    rows = jobs.read_table_stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = jobs.run_available(jobs.series_ends(rows, ["user_id"], "30 minutes"))
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("first", "last")), "value", "n")


@query("stm11_unique_events")
def stm11(spark, d):
    """Streaming: every event sent twice counts once."""
    rows = jobs.read_table_stream(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    out = jobs.run_available(jobs.unique_events(rows, "event_id", "30 days"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
