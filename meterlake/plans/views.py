"""Samples, logs and spans over the generic tables (orders, lineitem, part, events, conversations), for the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.operators import accounting as A
from meterlake.operators.samples import running_sum

#: Pinned evaluation times and ranges: of the event tables and of the order tables.
EVENTS_START, EVENTS_END, EVENTS_RANGE = "2024-01-10 00:00:00", "2024-01-30 00:00:00", "10 days"
ORDERS_START, ORDERS_END, ORDERS_RANGE = "2000-08-01 00:00:00", "2001-08-01 00:00:00", "365 days"
#: Range of the trace search, in nanoseconds.
TRACES_START_NS, TRACES_END_NS = 946_684_800_000_000_000, 1_009_843_200_000_000_000  # 2000-01-01 and 2002-01-01
#: A counter restarts when it passes this.
RESET = 5000

#: SQL of the labels of token counters over lineitem, orders and part; the engines share it with the oracle.
TOKEN_LABELS = {
    "ai_agent_provider": "case when l_returnflag = 'R' then 'anthropic' else 'openai' end",
    "ai_agent_product": "case when l_returnflag = 'R' then 'claude-code' else 'codex' end",
    "agent_role": "case o_orderpriority when '1-URGENT' then 'primary' when '2-HIGH' then 'approval_reviewer' when '3-MEDIUM' then 'subagent' else 'unknown' end",
    "model_id": "case when p_brand in ('Brand#1', 'Brand#2') then 'unmapped' else p_brand end",
    "model_family": "substr(p_brand, 1, 7)",
    "evidence_class": "'provider-reported'",
    "service_namespace": "case when o_custkey % 10 = 0 then 'synthetic-cost-fixture' when o_custkey % 3 = 0 then 'live' end",
}
REQUEST_ONLY = {
    "skill_id": "case when l_linestatus = 'F' then 'none' else concat('skill', cast(l_suppkey % 2 as varchar(9))) end",
    "mcp_server_name": "case when l_suppkey % 3 = 0 then 'none' else 'server' end",
    "mcp_tool_name": "case when l_suppkey % 3 = 0 then 'none' else concat('tool', cast(l_suppkey % 3 as varchar(9))) end",
}
TOKEN_TYPE = (
    "case l_linenumber when 1 then 'cached_input' when 2 then 'cache_write_input' when 3 then 'output' when 5 then 'total' when 6 then 'reasoning_output' "
    "when 7 then case when p_brand in ('Brand#11', 'Brand#12') then 'non_cached_input' else 'input' end else 'input' end"
)
USAGE_CLASS = "case l_linenumber % 4 when 0 then 'input_uncached' when 1 then 'input_cached' when 2 then 'input_cache_write' else 'output' end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A generic table; times without a zone are read as times of the session's zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its order and part; only the columns that the views read."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("tokens"), "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])


def current_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current values of the turn counters (codex) and request counters (claude), by labels and token type."""
    lines = order_lines(spark, sf_dir)
    request = F.col("l_returnflag") == "R"
    metric = F.when(request, "ai_agent_request_token_usage_total").otherwise("ai_agent_turn_token_usage_sum")
    labels = [F.expr(e).alias(k) for k, e in TOKEN_LABELS.items()] + [F.when(request, F.expr(e)).alias(k) for k, e in REQUEST_ONLY.items()]
    rows = lines.select(metric.alias("metric"), *labels, F.expr(TOKEN_TYPE).alias("token_type"), "tokens")
    return rows.groupBy("metric", *TOKEN_LABELS, *REQUEST_ONLY, "token_type").agg(F.sum("tokens").cast("double").alias("value"))


def recorded_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage series recorded once a day: running totals by labels and usage class."""
    lines = order_lines(spark, sf_dir)
    labels = [F.expr(e).alias(k) for k, e in TOKEN_LABELS.items()]
    daily = lines.select(*labels, F.expr(USAGE_CLASS).alias("usage_class"), F.col("o_orderdate").alias("ts"), "tokens").groupBy(*TOKEN_LABELS, "usage_class", "ts").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("c"))
    running = Window.partitionBy(*TOKEN_LABELS, "usage_class").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(*TOKEN_LABELS, "usage_class", "ts", F.sum("t").over(running).cast("double").alias("value"), F.sum("c").over(running).cast("double").alias("turns"), F.lit("v2").alias("accounting_schema"))


def usage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded_usage(spark, sf_dir).drop("turns").withColumn("metric", F.lit("ai_agent_token_usage_total"))


def turn_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recorded_usage(spark, sf_dir)
    return rows.drop("value", "accounting_schema").withColumnsRenamed({"turns": "value", "usage_class": "class"}).withColumns({"token_type": F.when(F.col("class") == "output", "total").otherwise("input"), "metric": F.lit("ai_agent_turn_token_usage_count")})


#: Factors of the usage classes in rate cards over the part table; the credit card has no cache-write class.
CLASS_FACTORS = {"input_uncached": 5.0, "input_cached": 0.5, "input_cache_write": 6.25, "output": 30.0}
CREDIT_FACTORS = {"input_uncached": 125.0, "input_cached": 12.5, "output": 750.0}


def part_card(spark: SparkSession, sf_dir: str, credits: bool = False) -> DataFrame:
    """A rate card made of the part table: a brand is a model, its smallest size the base of its rates."""
    models = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model_id")).agg(F.min("p_size").cast("double").alias("base"))
    return A.rate_card_of(models, CREDIT_FACTORS if credits else CLASS_FACTORS, unit="credit" if credits else "USD")


def prices(spark: SparkSession, credits: bool = False) -> DataFrame:
    """Rates for some brands only (others stay unpriced); the credits card has no cache-write class."""
    classes = {"input_uncached": 5.0, "input_cached": 0.5, "input_cache_write": 6.25, "output": 30.0}
    if credits:
        classes = {k: 25.0 * v for k, v in classes.items() if k != "input_cache_write"}
    return A.rate_card(spark, {f"Brand#{n}": classes for n in range(3, 15)}, unit="credit" if credits else "USD")


def cost_samples(spark: SparkSession, sf_dir: str, credits: bool = False) -> DataFrame:
    """Recorded cost or credit series: every recorded usage sample times its rate."""
    usage = usage_samples(spark, sf_dir)
    if credits:
        return A.estimated(A.one_product(usage), prices(spark, True), "credit_source", "estimated_public_codex_rate_card").withColumn("metric", F.lit("ai_agent_estimated_credit_usage_total"))
    return A.estimated(usage, prices(spark)).withColumn("metric", F.lit("ai_agent_estimated_cost_usd_total"))


def counter(spark: SparkSession, sf_dir: str, metric: str, labels: dict[str, str], inc: str = "1", where: str = "true") -> DataFrame:
    """Counter samples over events: a running total of ``inc`` by labels, which restarts when it passes RESET."""
    rows = table(spark, sf_dir, "events").where(where).selectExpr("ts", "event_id", *(f"{e} as {k}" for k, e in labels.items()), f"cast({inc} as bigint) as _inc")
    total = running_sum(rows, list(labels), ["ts", "event_id"], "_inc", F.to_date("ts"), "_sum")
    return total.select(F.lit(metric).alias("metric"), *labels, "ts", (F.col("_sum") % RESET).cast("double").alias("value"))


def gauge(spark: SparkSession, sf_dir: str, metric: str, labels: dict[str, str], value: str, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, "events").where(where).selectExpr(f"'{metric}' as metric", *(f"{e} as {k}" for k, e in labels.items()), "ts", f"cast({value} as double) as value")


#: Upper bounds of the histogram over event values.
BOUNDS = (50, 100, 200, 400)


def buckets(spark: SparkSession, sf_dir: str, metric: str, labels: dict[str, str]) -> DataFrame:
    """Cumulative bucket counters over event values: each event raises every bucket whose bound isn't below its value."""
    rows = table(spark, sf_dir, "events").selectExpr("ts", "event_id", *(f"{e} as {k}" for k, e in labels.items()), "value")
    les = F.array(*(F.struct(F.lit(str(b)).alias("le"), (F.col("value") <= b).cast("bigint").alias("hit")) for b in BOUNDS), F.struct(F.lit("+Inf").alias("le"), F.lit(1).cast("bigint").alias("hit")))
    each = rows.select("ts", "event_id", *labels, F.inline(les))
    total = running_sum(each, [*labels, "le"], ["ts", "event_id"], "hit", F.to_date("ts"), "_sum")
    return total.select(F.lit(metric).alias("metric"), *labels, "le", "ts", F.col("_sum").cast("double").alias("value"))


#: SQL of the columns of the log view over events.
LOG_COLUMNS = {
    "event_id": "event_id",
    "ts": "ts",
    "service_name": "concat('svc', cast(user_id % 3 as varchar(9)))",
    "service_namespace": "case when user_id % 7 = 0 then 'probe-fixture' end",
    "event_name": "case when event_id % 11 = 0 then null when event_type = 'click' then 'codex.user_prompt' when event_type = 'view' then 'codex.tool_decision' "
    "when event_type = 'purchase' then 'codex.api_request' when event_type = 'signup' then 'codex.sandbox_outcome' else 'codex.tool_result' end",
    "success": "case when value > 20 then 'true' else 'false' end",
    "trace_id": "case when event_id % 5 = 0 then md5(cast(user_id as varchar(20))) end",
}


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{e} as {k}" for k, e in LOG_COLUMNS.items()))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces of two levels: an order is the root, its line items are children; times from the dates, in nanoseconds.

    Lines that repeat a number within an order are made unique by their part.
    """
    ns = lambda c: F.unix_micros(c) * 1000
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("ship"), F.min("l_returnflag").alias("flag"), F.min("l_suppkey").alias("supp"))
    key = F.col("o_orderkey").cast("string")
    day = F.expr("interval 1 day")
    root = o.select(
        key.alias("trace_id"), key.alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.concat(F.lit("order "), "o_orderstatus").alias("name"),
        ns(F.col("o_orderdate")).alias("start_ns"), ns(F.col("o_orderdate") + F.expr("interval 90 days")).alias("end_ns"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(0).alias("status_code"), F.lit(None).cast("boolean").alias("success"), F.col("o_orderpriority").alias("service_name"),
    )
    begin = F.greatest("ship", "o_orderdate")
    child = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        key.alias("trace_id"), F.concat_ws("-", key, F.col("l_linenumber").cast("string")).alias("span_id"), key.alias("parent_span_id"), F.concat(F.lit("line "), "flag").alias("name"),
        ns(begin).alias("start_ns"), ns(begin + day * (F.col("supp") % 9 + 1)).alias("end_ns"),
        F.when(F.col("flag") == "R", 2).otherwise(0).alias("status_code"), (F.col("supp") % 4 != 0).alias("success"), F.col("o_orderpriority").alias("service_name"),
    )
    return root.unionByName(child)


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hook events over conversations: a user turn opens a turn, the assistant turn after it stops it."""
    c = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    ns = (F.col("conv_id") * 3600 + F.col("turn") * 60).cast("bigint") * 1_000_000_000
    return c.select(
        F.when(F.col("role") == "user", "UserPromptSubmit").otherwise("Stop").alias("hook_event_name"), F.col("conv_id").cast("string").alias("session_id"), F.lit("t").alias("turn_id"),
        F.lit(None).cast("string").alias("tool_use_id"), F.lit(None).cast("string").alias("tool_name"), F.lit("gpt-5.6-sol").alias("model"), F.when(F.col("role") == "user", F.col("text")).alias("prompt"),
        F.lit(None).cast("string").alias("tool_response"), ns.alias("time_ns"),
    )
