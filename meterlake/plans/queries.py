"""Registered queries: each operator of the catalogue over the generic tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import text as T
from meterlake.functions import timeseries as ts
from meterlake.functions.labels import choice, label_value_test, select_series, without_fixtures
from meterlake.operators import accounting as A
from meterlake.operators import canonical, checks, contracts, logs as L, privacy, privacy_names, samples, sessions, status_line, traces, vector as V
from meterlake.operators.canonical import typed
from meterlake.plans import catalog as C
from meterlake.plans import check_queries, privacy_queries
from meterlake.plans import views as W
from meterlake.sources.scratch import scratch_path
from meterlake.streaming import carried, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to six places (exact costs: nine), so that the order of additions doesn't show; times as they stand in the
    session's zone."""
    plain = {"double": lambda c: F.round(c, places), "timestamp": lambda c: F.col(c).cast("timestamp_ntz")}
    return df.select(*(plain.get(t, F.col)(c).alias(c) for c, t in df.dtypes))


# --- recording rules and accounting -------------------------------------------------------------------------------


@query("priced_usage_by_model_and_class")
def priced_usage(spark, d):
    """Estimated cost by model and class: accounting, rate join, sum."""
    cost = A.estimated(A.token_usage(W.current_tokens(spark, d)), W.prices(spark))
    return rounded(V.sum_by(without_fixtures(cost), ["model_id", "usage_class", "rate_card_version"]), 9)


@query("rr01_price_card")
def rr01(spark, d):
    """A card of the part table's brands and sizes."""
    return W.part_card(spark, d)


@query("rr02_credit_card")
def rr02(spark, d):
    return W.part_card(spark, d, credits=True)


@query("rr03_rr06_token_usage")
def rr03(spark, d):
    return rounded(A.token_usage(W.current_tokens(spark, d)))


@query("rr07_estimated_cost")
def rr07(spark, d):
    return rounded(A.estimated(A.token_usage(W.current_tokens(spark, d)), W.prices(spark)), 9)


@query("rr08_estimated_credits")
def rr08(spark, d):
    return rounded(A.estimated(A.one_product(A.token_usage(W.current_tokens(spark, d))), W.prices(spark, True), "credit_source", "estimated_public_codex_rate_card"), 9)


@query("rr09_unpriced_usage")
def rr09(spark, d):
    return rounded(A.unpriced(A.token_usage(W.current_tokens(spark, d)), W.prices(spark)))


@query("rr10_unpriced_credit_usage")
def rr10(spark, d):
    return rounded(A.unpriced(A.one_product(A.token_usage(W.current_tokens(spark, d))), W.prices(spark, True), "codex_credits"))


# --- usage panels over recorded series ----------------------------------------------------------------------------


def usage_panel(name: str, samples: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark, d):
        return rounded(C.panel(name, samples(spark, d), W.ORDERS_END, W.ORDERS_RANGE, lookback="3650 days"))

    return run


for _name in ("cu01", "ar03", "ar10", "un02"):
    QUERIES[f"{_name}_usage"] = usage_panel(_name, W.usage_samples)
for _name in ("cu02", "cu06", "ar05", "un03"):
    QUERIES[f"{_name}_cost"] = usage_panel(_name, W.cost_samples)
for _name in ("ar06", "un07"):
    QUERIES[f"{_name}_credits"] = usage_panel(_name, lambda spark, d: W.cost_samples(spark, d, True))
for _name in ("ar02", "un04"):
    QUERIES[f"{_name}_reviews"] = usage_panel(_name, W.turn_samples)


@query("cu08_prices")
def cu08(spark, d):
    card = W.part_card(spark, d).withColumns({"metric": F.lit("ai_agent_token_price_usd_per_million"), "ts": F.lit(W.ORDERS_END).cast("timestamp")})
    return rounded(C.panel("cu08", card, W.ORDERS_END, W.ORDERS_RANGE))


def current_usage(spark, d) -> DataFrame:
    """Usage of the one product now, without fixtures."""
    return without_fixtures(A.one_product(A.token_usage(W.current_tokens(spark, d))))


@query("cu03_priced_coverage")
def cu03(spark, d):
    return rounded(C.priced_coverage(current_usage(spark, d), W.prices(spark)))


@query("cu04_cache_ratio")
def cu04(spark, d):
    return rounded(C.cache_ratio(current_usage(spark, d)))


@query("cu07_unpriced_last")
def cu07(spark, d):
    rows = without_fixtures(select_series(W.usage_samples(spark, d), eq=C.PX))
    return rounded(C.unpriced_last(rows, W.prices(spark), W.ORDERS_END, W.ORDERS_RANGE))


def unpriced_panel(name: str, credits: bool, product: bool = True) -> Query:
    def run(spark, d):
        usage = A.token_usage(W.current_tokens(spark, d))
        out = A.unpriced(A.one_product(usage) if credits else usage, W.prices(spark, credits)).withColumns({"metric": F.lit(C.PANELS[name].metric), "ts": F.lit(W.ORDERS_END).cast("timestamp")})
        return rounded(C.panel(name, out, W.ORDERS_END, W.ORDERS_RANGE))

    return run


QUERIES["ar12_unpriced_api"] = unpriced_panel("ar12", False)
QUERIES["ar13_unpriced_credits"] = unpriced_panel("ar13", True)
QUERIES["un08_unpriced_credits"] = unpriced_panel("un08", True)


def grown_usage(spark, d, **eq) -> DataFrame:
    return ts.increase(without_fixtures(select_series(W.usage_samples(spark, d), eq=C.PX | eq)), W.ORDERS_END, W.ORDERS_RANGE)


@query("ar01_freshness")
def ar01(spark, d):
    rows = without_fixtures(select_series(W.turn_samples(spark, d), eq=C.PX | C.AR | {"token_type": "total"}))
    return rounded(ts.freshness(rows, "2001-08-02 00:00:00"))


@query("un01_freshness")
def un01(spark, d):
    return rounded(ts.freshness(without_fixtures(W.turn_samples(spark, d)), "2001-08-02 00:00:00"))


@query("ar04_reviewer_share")
def ar04(spark, d):
    return rounded(C.share(grown_usage(spark, d), F.col("agent_role") == "approval_reviewer"))


@query("ar07_tokens_per_review")
def ar07(spark, d):
    return rounded(C.per_review(QUERIES["ar03_usage"](spark, d), QUERIES["ar02_reviews"](spark, d)))


@query("ar08_reviewer_cached_ratio")
def ar08(spark, d):
    return rounded(C.share(grown_usage(spark, d, **C.AR), F.col("usage_class") == "input_cached"))


@query("ar09_exact_model_coverage")
def ar09(spark, d):
    return rounded(C.share(grown_usage(spark, d, **C.AR), F.col("model_id") != "unmapped"))


@query("un05_priced_coverage")
def un05(spark, d):
    return rounded(C.priced_coverage(without_fixtures(A.token_usage(W.current_tokens(spark, d))), W.prices(spark)))


@query("un06_cache_ratio")
def un06(spark, d):
    return rounded(C.cache_ratio(without_fixtures(A.token_usage(W.current_tokens(spark, d)))))


@query("ar11_token_rate_grid")
def ar11(spark, d):
    return rounded(C.panel("ar11", W.usage_samples(spark, d), W.ORDERS_END, W.ORDERS_RANGE, start=W.ORDERS_START, step="73 days"))


@query("cu19_model_values")
def cu19(spark, d):
    return L.label_values(W.usage_samples(spark, d), "model_id")


# --- panels over event counters -----------------------------------------------------------------------------------

#: Panel -> (labels over events, increment, filter) of its counter.
COUNTERS: dict[str, tuple[dict[str, str], str, str]] = {
    "cu05": ({"model": "concat('m', cast(user_id % 4 as varchar(9)))", "token_type": "event_type"}, "value", "true"),
    "cu11": ({"tool": "event_type", "success": "case when value > 20 then 'true' else 'false' end"}, "1", "true"),
    "cu12": ({"status": "event_type"}, "case when user_id % 2 = 0 then 1 else 0 end", "true"),
    "cu13": ({"status": "event_type"}, "1", "event_type = 'error'"),
    "cu16": ({"type": "event_type", "manual": "case when user_id % 2 = 0 then 'true' else 'false' end"}, "1", "true"),
    "cu17": ({"source": "event_type", "service_namespace": "case when user_id % 5 = 0 then 'probe-fixture' end"}, "1", "true"),
    "cu18": ({"source": "concat('s', cast(user_id % 3 as varchar(9)))"}, "1", "true"),
    "ca01": ({"ai_agent_provider": "'anthropic'", "ai_agent_product": "'claude-code'", "token_type": "event_type"}, "value", "true"),
    "ca02": ({"ai_agent_provider": "'anthropic'", "ai_agent_product": "'claude-code'", "token_type": "event_type", "skill_id": "case when user_id % 2 = 0 then 'none' else concat('k', cast(user_id % 3 as varchar(9))) end"}, "value", "true"),
    "ca03": ({"ai_agent_provider": "'anthropic'", "ai_agent_product": "'claude-code'", "token_type": "event_type", "mcp_server_name": "case when user_id % 2 = 0 then 'none' else 'srv' end", "mcp_tool_name": "concat('t', cast(user_id % 3 as varchar(9)))"}, "value", "true"),
    "ca04": ({"ai_agent_product": "'codex'", "content_scope": "'hook_tool_response'", "measurement_method": "'utf8_bytes'"}, "value * 10", "true"),
    "ca05": ({"ai_agent_product": "'codex'", "content_scope": "'hook_tool_response'", "measurement_method": "'utf8_bytes'"}, "1", "true"),
    "ch02": ({"receiver": "event_type", "transport": "case when user_id % 2 = 0 then 'grpc' else 'http' end"}, "1", "true"),
    "ch03": ({"receiver": "event_type", "transport": "case when user_id % 3 = 0 then 'grpc' else 'http' end"}, "value", "true"),
    "ch04": ({"receiver": "event_type", "transport": "case when user_id % 5 = 0 then 'grpc' else 'http' end"}, "1", "true"),
    "un09": ({"service_name": "concat('svc', cast(user_id % 3 as varchar(9)))"}, "value", "true"),
    "un10": ({"service_name": "concat('svc', cast(user_id % 3 as varchar(9)))"}, "1", "true"),
}


def counter_panel(name: str) -> Query:
    labels, inc, where = COUNTERS[name]

    def run(spark, d):
        return rounded(C.panel(name, W.counter(spark, d, C.PANELS[name].metric, labels, inc, where), W.EVENTS_END, W.EVENTS_RANGE))

    return run


for _name in COUNTERS:
    QUERIES[f"{_name}_{C.PANELS[_name].shape}"] = counter_panel(_name)

COMPACTION = {"ai_agent_product": "case when user_id % 2 = 0 then 'codex' else 'claude-code' end"}


@query("ca06_compaction_grid")
def ca06(spark, d):
    rows = W.counter(spark, d, "ai_agent_compaction", COMPACTION)
    return rounded(C.panel("ca06", rows, W.EVENTS_END, W.EVENTS_RANGE, start=W.EVENTS_START, step="1 day"))


HIST = {"model": "event_type"}
for _name in ("cu09", "cu10", "cu14", "cu15"):
    QUERIES[f"{_name}_p95"] = (lambda name: lambda spark, d: rounded(C.panel(name, W.buckets(spark, d, C.PANELS[name].metric, HIST), W.EVENTS_END, W.EVENTS_RANGE)))(_name)

#: Panel -> (labels over events, value, look-back) of its gauge.
GAUGES: dict[str, tuple[dict[str, str], str]] = {
    "ag01": ({"tool": "'antigravity'", "token_type": "event_type", "model_family": "concat('f', cast(user_id % 2 as varchar(9)))", "session": "cast(user_id as varchar(20))"}, "value * 100"),
    "ag02": ({"tool": "'antigravity'", "token_type": "event_type", "model_family": "concat('f', cast(user_id % 3 as varchar(9)))", "session": "cast(user_id as varchar(20))"}, "value * 10"),
    "ag03": ({"tool": "'antigravity'", "session": "cast(user_id as varchar(20))"}, "value / 500"),
    "ag04": ({"tool": "'antigravity'", "type": "event_type", "session": "cast(user_id as varchar(20))"}, "1 - value / 500"),
    "ag05": ({"tool": "'antigravity'", "state": "event_type"}, "user_id % 9"),
    "ag06": ({"tool": "'antigravity'", "session": "cast(user_id as varchar(20))"}, "user_id % 17"),
    "ag07": ({"tool": "'antigravity'", "session": "cast(user_id as varchar(20))"}, "case when value > 200 then 1 else 0 end"),
    "ag08": ({"tool": "'antigravity'", "session": "cast(user_id as varchar(20))"}, "user_id % 5"),
    "ag09": ({"tool": "'antigravity'", "session": "cast(user_id as varchar(20))"}, "user_id % 2"),
    "ch01": ({"job": "case when user_id % 4 = 0 then 'other' else concat('otel-collector-', event_type) end"}, "case when event_id % 97 = 0 then 0 else 1 end"),
    "ch06": ({"job": "'otel-collector-internal'", "instance": "event_type"}, "value * 1024"),
}
GAUGE_LOOKBACK = "2 days"
for _name, (_labels, _value) in GAUGES.items():
    QUERIES[f"{_name}_gauge"] = (
        lambda name, labels, value: lambda spark, d: rounded(C.panel(name, W.gauge(spark, d, C.PANELS[name].metric, labels, value), W.EVENTS_END, W.EVENTS_RANGE, lookback=GAUGE_LOOKBACK))
    )(_name, _labels, _value)

#: The three counters of failed sends: filters over events that give some exporters several.
FAILED = {C.FAILED_SENDS[0]: "event_type in ('error', 'click')", C.FAILED_SENDS[1]: "event_type in ('error', 'view')", C.FAILED_SENDS[2]: "event_type in ('signup', 'view')"}


@query("ch05_failed_sends")
def ch05(spark, d):
    rows = [W.counter(spark, d, m, {"exporter": "event_type"}, "1", where) for m, where in FAILED.items()]
    return rounded(C.failed_sends(rows[0].unionByName(rows[1]).unionByName(rows[2]), W.EVENTS_END, W.EVENTS_RANGE))


# --- time series functions ----------------------------------------------------------------------------------------

BY_TYPE = {"event_type": "event_type"}


def by_type(spark, d) -> DataFrame:
    return W.counter(spark, d, "events_total", BY_TYPE, "value")


@query("tsf01_increase")
def tsf01(spark, d):
    return rounded(ts.increase(by_type(spark, d), W.EVENTS_END, W.EVENTS_RANGE).drop("metric"))


@query("tsf02_rate")
def tsf02(spark, d):
    return rounded(ts.rate(by_type(spark, d), W.EVENTS_END, W.EVENTS_RANGE).drop("metric"))


@query("agg09_last_over_time")
def agg09(spark, d):
    return rounded(ts.last_over_time(by_type(spark, d), W.EVENTS_END, W.EVENTS_RANGE).drop("metric"))


@query("agg10_max_over_time")
def agg10(spark, d):
    return rounded(ts.max_over_time(by_type(spark, d), W.EVENTS_END, W.EVENTS_RANGE).drop("metric"))


@query("src10_instant")
def src10(spark, d):
    return rounded(ts.instant(by_type(spark, d), W.EVENTS_END, "6 hours").drop("metric"))


@query("src12_series")
def src12(spark, d):
    return W.usage_samples(spark, d).select(*W.TOKEN_LABELS, "usage_class").distinct()


@query("tsf02_increase_grid")
def tsf02_grid(spark, d):
    return rounded(ts.increase_on_grid(by_type(spark, d), W.EVENTS_START, W.EVENTS_END, "12 hours").drop("metric"))


@query("tsf02_overlapping_grid")
def tsf02_overlapping(spark, d):
    """Growth over two days before each half day: ranges that overlap."""
    grid = ts.increase_on_grid(by_type(spark, d), W.EVENTS_START, W.EVENTS_END, "12 hours", length="2 days", steps=4)
    return rounded(grid.drop("metric"))


@query("tsf11_not_expired")
def tsf11(spark, d):
    rows = W.counter(spark, d, "m", {"user": "cast(user_id as varchar(20))"})
    return ts.not_expired(rows.where(F.col("ts") <= F.lit(W.EVENTS_END).cast("timestamp")), W.EVENTS_END, "6 hours").groupBy("user").agg(F.count(F.lit(1)).alias("n"))


@query("trx07_histogram_buckets")
def trx07(spark, d):
    return W.buckets(spark, d, "m", HIST).groupBy("model", "le").agg(F.max("value").alias("value"))


@query("trx08_running_total")
def trx08(spark, d):
    return rounded(W.recorded_usage(spark, d).groupBy("model_id", "usage_class").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("samples")))


# --- vector algebra -----------------------------------------------------------------------------------------------


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two vectors by nation and segment that overlap in part."""
    c = W.table(spark, d, "customer")
    nation = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("string"))
    left, right = c.where("c_acctbal >= 0"), c.where("c_mktsegment <> 'BUILDING' or c_acctbal < -500")
    to = lambda rows: rows.groupBy(nation.alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return to(left), to(right)


@query("set01_or")
def set01(spark, d):
    return V.vec_or(*sides(spark, d))


@query("set02_unless")
def set02(spark, d):
    return V.vec_unless(*sides(spark, d), ["nation", "segment"])


@query("set03_and")
def set03(spark, d):
    return V.vec_and(*sides(spark, d), ["nation", "segment"])


@query("join05_subtract")
def join05(spark, d):
    return V.vec_binop(*sides(spark, d), ["nation", "segment"], lambda a, b: a - b)


@query("join01_group_left")
def join01(spark, d):
    many, one = sides(spark, d)
    rate = V.sum_by(one, ["segment"]).withColumn("version", F.lit("v1"))
    return V.group_left(many, rate, ["segment"], ["version"], lambda a, b: a * b)


@query("join12_reconcile")
def join12(spark, d):
    lines = W.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").cast("double").alias("value"), "l_linenumber")
    raw = V.sum_by(lines, ["l_returnflag"])
    return V.reconcile(raw, V.sum_by(lines.where("l_returnflag <> 'A' or l_linenumber < 7"), ["l_returnflag"]), ["l_returnflag"])


@query("agg16_missing_values")
def agg16(spark, d):
    out = checks.missing_values(W.table(spark, d, "events"), "event_type", ["click", "error", "purchase", "refund"])
    return out.select(F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"))


@query("agg04_agg05_max_min")
def agg04(spark, d):
    v = W.table(spark, d, "events").select("event_type", "value")
    return V.max_by_labels(v, ["event_type"]).join(v.groupBy("event_type").agg(F.min("value").alias("least")), "event_type")


# --- logs ---------------------------------------------------------------------------------------------------------

SERVICES = "svc[01]"


def count_query(**values) -> Query:
    return lambda spark, d: L.event_count(W.logs(spark, d), SERVICES, W.EVENTS_END, W.EVENTS_RANGE, **values)


QUERIES |= {
    "ac01_named_events": count_query(event_name=None),
    "ac02_user_prompts": count_query(event_name="codex.user_prompt"),
    "ac03_tool_decisions": count_query(event_name="codex.tool_decision"),
    "ac04_failed_tool_results": count_query(event_name="codex.tool_result", success="false"),
    "ac05_api_requests": count_query(event_name="codex.api_request"),
    "ac06_sandbox_outcomes": count_query(event_name="codex.sandbox_outcome"),
}


@query("ac07_events_over_time")
def ac07(spark, d):
    return rounded(L.events_over_time(W.logs(spark, d), SERVICES, W.EVENTS_START, W.EVENTS_END, "1 day"))


@query("ac08_latest_traces")
def ac08(spark, d):
    return traces.latest_traces(W.spans(spark, d), "1-URGENT|2-HIGH", start_ns=W.TRACES_START_NS, end_ns=W.TRACES_END_NS)


@query("src17_evaluation_spans_by_trace")
def src17(spark, d):
    return traces.evaluation_by_id(W.spans(spark, d).where("success is not null"), "32").select("span_id", "name", "start_ns")


def listing(**values) -> Query:
    return lambda spark, d: L.newest(L.having(L.stream(W.logs(spark, d), SERVICES), **values), W.EVENTS_START, W.EVENTS_END).select("event_id", "service_name", "event_name", "success", "trace_id")


QUERIES |= {"ac09_prompt_events": listing(event_name="codex.user_prompt"), "ac10_failed_events": listing(success="false"), "ac11_trace_linked_events": listing(trace_id=None), "src14_newest_logs": listing()}


@query("ac12_service_values")
def ac12(spark, d):
    return L.label_values(W.logs(spark, d), "service_name")


@query("ag10_lifecycle_logs")
def ag10(spark, d):
    rows = L.stream(W.logs(spark, d), "svc(-cli|1)?", ".+-fixture")
    return L.newest(rows, W.EVENTS_START, W.EVENTS_END).select("event_id", "event_name")


@query("flt02_choice")
def flt02(spark, d):
    rows = W.logs(spark, d)
    return rows.where(label_value_test(rows, "service_name", choice(["svc0", "svc2"]))).groupBy("service_name").agg(F.count(F.lit(1)).alias("n"))


@query("flt10_recent_logs")
def flt10(spark, d):
    return ts.recent_enough(W.logs(spark, d), W.EVENTS_END).groupBy("event_name").agg(F.count(F.lit(1)).alias("n"))


@query("join08_trace_id_in_line")
def join08(spark, d):
    lines = W.logs(spark, d).select("event_id", F.concat_ws(" ", F.lit("handled"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("traceid="), "trace_id")).otherwise(F.concat(F.lit("trace_id: "), F.upper("trace_id")))).alias("line"))
    return lines.select("event_id", traces.trace_id_in(F.col("line")).alias("trace_id")).where("trace_id is not null")


@query("join09_logs_of_spans")
def join09(spark, d):
    rows = W.logs(spark, d).where("trace_id is not null").select("event_id", "trace_id", "ts")
    spans = W.logs(spark, d).where("trace_id is not null").groupBy("trace_id").agg(F.min("ts").alias("first")).select("trace_id", F.col("trace_id").alias("span_id"), F.expr("first + interval 1 day").alias("start_ts"), F.expr("first + interval 9 days").alias("end_ts"))
    return traces.logs_of_traces(rows, spans).select("event_id", "trace_id", "span_id")


# --- traces -------------------------------------------------------------------------------------------------------


@query("src15_trace_by_id")
def src15(spark, d):
    return traces.by_id(W.spans(spark, d), "32").select("span_id", "parent_span_id", "name", "start_ns", "end_ns")


@query("join10_parents")
def join10(spark, d):
    return traces.with_parent(W.spans(spark, d)).groupBy("name", "parent_name").agg(F.count(F.lit(1)).alias("n"))


@query("ta01_trace_table")
def ta01(spark, d):
    return traces.trace_table(W.spans(spark, d))


@query("ta02_longest_child")
def ta02(spark, d):
    return traces.longest_child(W.spans(spark, d))


@query("ta03_repeated_siblings")
def ta03(spark, d):
    return traces.repeated_siblings(W.spans(spark, d))


@query("ta04_error_spans")
def ta04(spark, d):
    return traces.error_spans(W.spans(spark, d))


@query("ta05_ta06_coverage")
def ta05(spark, d):
    return traces.uncovered(W.spans(spark, d))


@query("ta07_status")
def ta07(spark, d):
    return W.spans(spark, d).groupBy(traces.status_text(F.col("status_code")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("tsf09_durations")
def tsf09(spark, d):
    return W.spans(spark, d).groupBy("name").agg(F.sum(T.duration_ms(F.col("start_ns"), F.col("end_ns"))).alias("ms"))


# --- hooks and status line ----------------------------------------------------------------------------------------


@query("prc04_turn_spans")
def prc04(spark, d):
    return sessions.turn_spans(W.prompts(spark, d)).select("session_id", "name", "span_kind", "start_ns", "end_ns")


@query("str08_prompt_sizes")
def str08(spark, d):
    sized = sessions.content_sizes(W.prompts(spark, d), "size-only", "core", ("user-prompt",))
    return sized.select(F.posexplode("bucket_counts").alias("bucket", "hit")).groupBy("bucket").agg(F.sum("hit").alias("value"))


@query("tsf10_change_or_heartbeat")
def tsf10(spark, d):
    rows = W.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.when(F.col("value") > 15, "high").otherwise("low").alias("fingerprint"), (F.unix_micros("ts") * 1000).alias("time_ns"))
    return status_line.emitted(rows, ["session"], 86_400_000_000_000)


# --- privacy, text, checks ----------------------------------------------------------------------------------------

#: Attribute names that the privacy queries try.
TRIED_KEYS = ("event.name", "prompt", "prompt.text", "gen_ai.usage.input_tokens", "gen_ai.response.model", "tool", "tool.name", "tool_name", "user.email", "conversation.id", "session.id", "model", "token_type", "url.path", "http.url", "duration_ms", "success", "ai_agent.operation", "output.value", "api_key", "arguments", "repository.name", "branch", "secret", "mcp.server")


def bags(spark, d) -> DataFrame:
    """Events with an attribute bag: a third of them carry each third of the tried keys."""
    keys = F.array(*map(F.lit, TRIED_KEYS))
    own = F.filter(keys, lambda k, i: i % 3 == F.col("event_id") % 3)
    return W.table(spark, d, "events").select("event_id", F.map_from_arrays(own, F.transform(own, lambda k: typed(k))).alias("attributes"))


def kept_keys(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.array_join(F.array_sort(F.map_keys("attributes")), ",").alias("keys"))


#: Query -> what it does to a bag, and in the oracle which of the keys stay.
BAG_QUERIES = {
    "map01_delete_record_keys": (lambda b: privacy.delete_matching_keys(b, privacy_names.INITIAL_RECORD), ("pattern", privacy_names.INITIAL_RECORD)),
    "map01_delete_resource_keys": (lambda b: privacy.delete_matching_keys(b, privacy_names.INITIAL_RESOURCE), ("pattern", privacy_names.INITIAL_RESOURCE)),
    "map01_delete_metric_keys": (lambda b: privacy.delete_matching_keys(b, privacy_names.INITIAL_METRIC), ("pattern", privacy_names.INITIAL_METRIC)),
    "map01_delete_final_keys": (lambda b: privacy.delete_matching_keys(b, privacy_names.FINAL), ("pattern", privacy_names.FINAL)),
    "map02_delete_named_keys": (lambda b: privacy.delete_keys(b, privacy_names.FINAL_KEYS), ("drop", privacy_names.FINAL_KEYS)),
    "map04_keep_point_keys": (lambda b: privacy.keep_keys(b, privacy_names.POINT_KEYS), ("keep", privacy_names.POINT_KEYS)),
    "map04_keep_corporate_keys": (lambda b: privacy.keep_keys(b, privacy_names.CORPORATE_RECORD_KEYS), ("keep", privacy_names.CORPORATE_RECORD_KEYS)),
}
for _name, (_change, _) in BAG_QUERIES.items():
    QUERIES[_name] = (lambda change: lambda spark, d: kept_keys(bags(spark, d).withColumn("attributes", change(F.col("attributes")))))(_change)


@query("str01_str02_safe_text")
def str01(spark, d):
    p = W.table(spark, d, "pages")
    return p.select("page_id", T.safe_text(F.col("url")).alias("status_text"), T.safe_text(F.col("url"), refuse=T.HOOK_TEXT, length=T.HOOK_CHARS).alias("hook_text"))


@query("str04_sha256")
def str04(spark, d):
    return W.table(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("digest"), T.trace_id(F.col("url"), F.lit("t")).alias("trace_id"), T.span_id(F.col("url"), F.lit("t")).alias("span_id"))


@query("str05_pseudonym")
def str05(spark, d):
    return W.table(spark, d, "pages").select("page_id", T.pseudonym(F.col("url"), b"local key").alias("pseudonym"))


@query("str08_utf8_size")
def str08_size(spark, d):
    return W.table(spark, d, "conversations").select("conv_id", "turn", T.utf8_size(F.col("text")).alias("bytes"))


@query("str09_canonical_json")
def str09(spark, d):
    return W.table(spark, d, "events").select("event_id", T.canonical_json(F.col("props")).alias("json"))


@query("str12_url_base")
def str12(spark, d):
    return W.table(spark, d, "pages").select("page_id", T.url_base(F.concat(F.lit("http://localhost:4318/v1/"), F.element_at(F.array(F.lit("logs"), F.lit("traces/"), F.lit("other")), (F.col("page_id") % 3 + 1).cast("int")))).alias("base"))


@query("trx09_one_hot")
def trx09(spark, d):
    hot = T.one_hot(F.col("value"), (50, 100, 200, 400))
    return W.table(spark, d, "events").select(F.posexplode(hot).alias("bucket", "hit")).groupBy("bucket").agg(F.sum("hit").alias("n"))


@query("trx12_clamp")
def trx12(spark, d):
    return rounded(W.table(spark, d, "events").groupBy("event_type").agg(F.sum(T.clamp((F.col("value") * 100).cast("bigint"), 500, 10000).cast("double")).alias("value")))


@query("cnd01_tool_category")
def cnd01(spark, d):
    tool = F.element_at(F.array(*map(F.lit, ("Bash", "apply_patch", "Agent", "wait_agent", "mcp__files__read", "Read"))), (F.col("event_id") % 6 + 1).cast("int"))
    return W.table(spark, d, "events").groupBy(T.hook_tool_category(tool).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("cnd04_thresholds")
def cnd04(spark, d):
    return W.table(spark, d, "events").groupBy(T.thresholds(F.col("value"), [(50, "warn"), (200, "bad")], "good").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("chk01_sentinels")
def chk01(spark, d):
    return checks.containing(W.table(spark, d, "documents").select("doc_id", "text"), ["@mail", "Apache License"]).select("doc_id")


@query("chk13_duplicate_keys")
def chk13(spark, d):
    return checks.duplicates(W.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("agg17_cardinality")
def agg17(spark, d):
    return checks.cardinality(W.table(spark, d, "part"), ["p_brand"], 12)


@query("chk11_domains")
def chk11(spark, d):
    out = checks.outside_domain(W.table(spark, d, "documents").select("doc_id", "lang", "source"), {"lang": ["en", "fr"], "source": [f"src{n}" for n in range(10)]}, ("lang",))
    return out.select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("join13_annotation_diff")
def join13(spark, d):
    labels = W.table(spark, d, "labels")
    score = F.when(F.col("toxic") == 1, 0.5).otherwise(F.col("quality").cast("double"))
    want = labels.where("quality = 1 or toxic = 0").select("doc_id", F.col("quality").cast("string").alias("label"), F.col("quality").cast("double").alias("score"))
    have = labels.where("quality = 1 or toxic = 1").select("doc_id", F.col("quality").cast("string").alias("label"), score.alias("score"))
    return checks.config_diff(want, have, ["doc_id"], ["label", "score"])


@query("chk16_repeats_within")
def chk16(spark, d):
    return checks.repeats_within(W.table(spark, d, "events"), ["user_id", "event_type"], "1 hour").select("event_id", "user_id", "event_type")


@query("snk07_check_report")
def snk07(spark, d):
    lines, parts, docs = (W.table(spark, d, t) for t in ("lineitem", "part", "documents"))
    return contracts.report({
        "duplicate line numbers": checks.duplicates(lines, ["l_orderkey", "l_linenumber"]),
        "duplicate parts": checks.duplicates(parts, ["p_partkey"]),
        "languages": checks.outside_domain(docs, {"lang": ["en", "fr", "de", "es"]}),
    })


@query("snk09_feedback_bundle")
def snk09(spark, d):
    metrics = W.table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return contracts.feedback_bundle(metrics, "1.0")


@query("set04_additive_copy")
def set04(spark, d):
    native = W.table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, ("codex.tool.call", "codex.mcp.call", "other.metric"))), (F.col("event_id") % 3 + 1).cast("int")).alias("metric"), "value")
    return rounded(canonical.with_copies(native).groupBy("metric").agg(F.count(F.lit(1)).alias("n")))


@query("trx05_safe_names")
def trx05(spark, d):
    return W.table(spark, d, "pages").select("page_id", samples.safe_name(F.col("url")).alias("name"))


@query("stm09_running_totals")
def stm09(spark, d):
    """Streaming: event counters, batch by batch, everything available in one run."""
    rows = jobs.read_table_stream(spark, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"), (F.col("value") * 100).cast("bigint").alias("value"))
    folder = scratch_path(spark, "totals")
    jobs.running_totals(rows, ["event_type"], folder).awaitTermination()
    totals = spark.read.parquet(f"{folder}/out")
    return totals.groupBy("event_type").agg(F.max("value").cast("bigint").alias("total"), F.count(F.lit(1)).alias("n"))


@query("stm07_rules_by_batch")
def stm07(spark, d):
    """Streaming: the accounting rules, evaluated after each batch of lines over the current value of each series."""
    orders = W.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    lines = jobs.read_table_stream(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").cast("bigint").alias("tokens"))
    kind = F.when(F.col("l_linenumber") % 3 == 0, "cached_input").when(F.col("l_linenumber") % 3 == 1, "input").otherwise("output")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    samples = joined.select(F.expr(W.TOKEN_LABELS["agent_role"]).alias("agent_role"), F.when(F.col("l_returnflag") == "R", "gpt-5.6-sol").otherwise("other").alias("model_id"), kind.alias("token_type"), F.timestamp_seconds(F.lit(0)).alias("ts"), F.col("tokens").alias("value"))

    def evaluate(series):
        fixed = {"metric": "ai_agent_turn_token_usage_sum", "ai_agent_provider": "openai", "ai_agent_product": "codex", "model_family": "gpt", "evidence_class": "provider-reported", "service_namespace": "live"}
        current = series.withColumns({k: F.lit(v) for k, v in fixed.items()})
        rules = A.recording_rules(current, A.rate_card(spark), A.rate_card(spark, A.CREDITS_PER_MILLION, unit="credit"))
        return {name: rules[name] for name in ("ai_agent_estimated_cost_usd_total", "ai_agent_unpriced_api_token_usage_total")}

    folder = scratch_path(spark, "rules")
    jobs.recording_rules(samples, ["agent_role", "model_id", "token_type"], evaluate, folder, fold="sum").awaitTermination()
    out = [jobs.newest_batch(spark, f"{folder}/rules/{name}").select(F.lit(name).alias("rule"), "agent_role", "model_id", "usage_class", "value") for name in ("ai_agent_estimated_cost_usd_total", "ai_agent_unpriced_api_token_usage_total")]
    return rounded(out[0].union(out[1]), 9)


@query("stm10_change_or_heartbeat")
def stm10(spark, d):
    """Streaming twin of the change-or-heartbeat rule."""
    rows = jobs.read_table_stream(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), F.when(F.col("value") > 15, "high").otherwise("low").alias("fingerprint"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"))
    folder = scratch_path(spark, "sent")
    carried.emitted_stream(rows, "session", folder, 86_400_000_000_000).awaitTermination()
    return spark.read.parquet(f"{folder}/sent").select("session", "fingerprint", "time_ns")


@query("stm02_turn_stream")
def stm02(spark, d):
    """Streaming twin of the turn sessioniser."""
    c = jobs.read_table_stream(spark, d, "conversations").where("role in ('user', 'assistant')")
    events = c.select(
        F.when(F.col("role") == "user", "UserPromptSubmit").otherwise("Stop").alias("hook_event_name"), F.concat_ws("/", "conv_id", F.call_function("div", F.col("turn"), F.lit(2))).alias("session_id"), F.lit("t").alias("turn_id"),
        F.lit(None).cast("string").alias("tool_use_id"), (F.col("conv_id") * 3600 + F.col("turn") * 60).cast("bigint").alias("time_ns"),
    )
    folder = scratch_path(spark, "turns")
    carried.turn_stream(events, folder).awaitTermination()
    return spark.read.parquet(f"{folder}/ends").select("session_id", "name", "start_ns", "end_ns")


QUERIES |= privacy_queries.QUERIES | check_queries.QUERIES
