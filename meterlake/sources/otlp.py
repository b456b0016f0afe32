"""Ingest: OTLP JSON, hook events and metric samples become flat DataFrames; everything here is narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.rows import fields_once
from meterlake.sources.schemas import HOOK_EVENT, envelope

SUPPORTED_HOOKS = ("UserPromptSubmit", "PreToolUse", "PostToolUse", "Stop")


def read_envelopes(spark: SparkSession, path: str, signal: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """OTLP JSON documents of one signal under ``path``, one a line, batch or stream, with the declared schema."""
    if streaming:
        reader = spark.readStream.schema(envelope(signal))
        return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)
    return spark.read.schema(envelope(signal)).json(path)


def render_fixture(texts: DataFrame, signal: str, now_ns: int) -> DataFrame:
    """Envelopes from templated documents (column ``value``): time placeholders become one frozen time, then the JSON is parsed.

    ``{{START_TIME_UNIX_NANO}}`` lies 50 ms before ``now_ns``. A document that isn't JSON raises an error.
    """
    text = F.replace("value", F.lit("{{TIME_UNIX_NANO}}"), F.lit(str(now_ns)))
    text = F.replace(text, F.lit("{{START_TIME_UNIX_NANO}}"), F.lit(str(now_ns - 50_000_000)))
    text = F.replace(text, F.lit("{{END_TIME_UNIX_NANO}}"), F.lit(str(now_ns)))
    text = F.when(F.col("value").contains("TIME_UNIX_NANO}}"), text).otherwise(F.col("value"))
    return texts.select(fields_once(F.from_json(text, envelope(signal), {"mode": "FAILFAST"})))


def bag(attributes: str | Column) -> Column:
    """map<string, any_value> of an attribute list; null: an empty map. A repeated key keeps its last value."""
    a = F.col(attributes) if isinstance(attributes, str) else attributes
    kind = "struct<stringValue:string,intValue:string,boolValue:boolean,doubleValue:double>"
    last = F.filter(a, lambda x, i: F.array_position(F.transform(F.slice(F.reverse(a), 1, F.size(a) - i - 1), lambda y: y["key"]), x["key"]) == 0)
    repeated = F.size(F.array_distinct(a["key"])) < F.size(a)
    return F.coalesce(F.map_from_entries(F.when(repeated, last).otherwise(a)), F.expr(f"cast(map() as map<string,{kind}>)"))


def text_of(value: Column) -> Column:
    """A typed attribute value as text; booleans as true and false."""
    return F.coalesce(value["stringValue"], value["intValue"], value["boolValue"].cast("string"), value["doubleValue"].cast("string"))


def typed(value: Column) -> Column:
    """A typed attribute value from a text column; null stays null."""
    none = F.lit(None)
    return F.when(value.isNotNull(), F.struct(value.cast("string").alias("stringValue"), none.cast("string").alias("intValue"), none.cast("boolean").alias("boolValue"), none.cast("double").alias("doubleValue")))


def time_of(ns: Column) -> Column:
    """Timestamp of nanoseconds; keep the nanoseconds beside it, as timestamps hold microseconds."""
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))


def _flat(envelopes: DataFrame, outer: str, inner: str, records: str) -> DataFrame:
    headers = F.col("headers") if "headers" in envelopes.columns else F.lit(None).cast("map<string,string>")
    by_resource = envelopes.select(headers.alias("headers"), F.explode(outer).alias("r"))
    by_scope = by_resource.select("headers", bag(F.col("r.resource.attributes")).alias("resource"), F.explode(f"r.{inner}").alias("s"))
    scope = F.named_struct(F.lit("name"), F.col("s.scope.name"), F.lit("version"), F.col("s.scope.version"), F.lit("attributes"), bag(F.col("s.scope.attributes")))
    return by_scope.select("headers", "resource", scope.alias("scope"), F.explode(f"s.{records}").alias("x"))


def logs(envelopes: DataFrame) -> DataFrame:
    """One row a log record: headers, resource, scope, time_ns, ts, severity, body, attributes."""
    ns = F.col("x.timeUnixNano").cast("bigint")
    return _flat(envelopes, "resourceLogs", "scopeLogs", "logRecords").select(
        "headers", "resource", "scope", ns.alias("time_ns"), time_of(ns).alias("ts"), F.col("x.severityText").alias("severity"),
        F.col("x.body.stringValue").alias("body"), bag(F.col("x.attributes")).alias("attributes"),
    )


def spans(envelopes: DataFrame) -> DataFrame:
    """One row a span: identity, name, times, attributes, status and nested events."""
    event = lambda e: F.named_struct(F.lit("time_ns"), e["timeUnixNano"].cast("bigint"), F.lit("name"), e["name"], F.lit("attributes"), bag(e["attributes"]))
    start, end = F.col("x.startTimeUnixNano").cast("bigint"), F.col("x.endTimeUnixNano").cast("bigint")
    return _flat(envelopes, "resourceSpans", "scopeSpans", "spans").select(
        "headers", "resource", "scope", F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"),
        F.nullif("x.parentSpanId", F.lit("")).alias("parent_span_id"), F.col("x.traceState").alias("trace_state"), F.col("x.name").alias("name"), F.col("x.kind").alias("kind"),
        start.alias("start_ns"), end.alias("end_ns"), time_of(start).alias("ts"), bag(F.col("x.attributes")).alias("attributes"),
        F.coalesce(F.transform("x.events", event), F.array()).alias("events"),
        F.col("x.status.code").alias("status_code"), F.col("x.status.message").alias("status_message"),
    )


def points(envelopes: DataFrame) -> DataFrame:
    """One row a data point of every instrument: kind gauge, sum or histogram; whole numbers stay exact in value_int."""
    none = lambda t: F.lit(None).cast(t)

    def cells(kind: str, temporality: Column, monotonic: Column, value, value_int, count, counts, bounds) -> Column:
        cell = lambda p: F.struct(
            F.lit(kind).alias("kind"), temporality.alias("temporality"), monotonic.alias("is_monotonic"), p["timeUnixNano"].cast("bigint").alias("time_ns"), value(p).alias("value"), value_int(p).alias("value_int"),
            count(p).alias("count"), counts(p).alias("bucket_counts"), bounds(p).alias("bounds"), p["attributes"].alias("a"),
        )
        return F.coalesce(F.transform(f"x.{kind}.dataPoints", cell), F.array())

    def numbers(kind: str, temporality: Column, monotonic: Column) -> Column:
        value = lambda p: F.coalesce(p["asInt"].cast("double"), p["asDouble"])
        return cells(kind, temporality, monotonic, value, lambda p: p["asInt"].cast("bigint"), lambda _: none("bigint"), lambda _: none("array<bigint>"), lambda _: none("array<double>"))

    h = cells(
        "histogram", F.col("x.histogram.aggregationTemporality"), F.lit(True), lambda p: p["sum"], lambda _: none("bigint"), lambda p: p["count"].cast("bigint"),
        lambda p: p["bucketCounts"].cast("array<bigint>"), lambda p: p["explicitBounds"],
    )
    every = F.concat(numbers("gauge", none("int"), none("boolean")), numbers("sum", F.col("x.sum.aggregationTemporality"), F.col("x.sum.isMonotonic")), h)
    # one pass over the documents: a union of the three instruments would parse each of them three times
    rows = _flat(envelopes, "resourceMetrics", "scopeMetrics", "metrics").select("headers", "resource", "scope", F.col("x.name").alias("metric"), F.col("x.unit").alias("unit"), F.col("x.description").alias("description"), F.inline(every))
    return rows.withColumn("attributes", bag("a")).drop("a").withColumn("ts", time_of(F.col("time_ns")))


def hook_events(lines: DataFrame, supported: tuple[str, ...] = SUPPORTED_HOOKS) -> DataFrame:
    """Hook events from JSON lines (column ``value``): text that isn't an object has no event name, and only the
    ``supported`` names pass, so it is left out without an error."""
    parsed = lines.select(fields_once(F.from_json("value", HOOK_EVENT, {"mode": "PERMISSIVE"})))
    return parsed.where(F.col("hook_event_name").isin(*supported))
