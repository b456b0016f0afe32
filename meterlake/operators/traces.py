"""Traces: routing to the evaluation store, listings, correlation with logs, and analyses of the span tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.labels import anchored
from meterlake.functions.rows import computed
from meterlake.operators.canonical import text
from meterlake.operators.privacy import delete_keys

# Keys of the routing rules and the request header that opts out.
ROUTE_KEY, OPT_OUT_KEY, KIND_KEY, ROUTE_HEADER = "ai_observability.routing.phoenix", "ai_context.export.phoenix", "openinference.span.kind", "x-ai-observability-phoenix"
DERIVED_TRACE_ID = r"(?:trace_id|traceid)[=:]\s*([0-9a-fA-F]{32})"


def evaluation_branch(spans: DataFrame) -> DataFrame:
    """Spans that go to the evaluation store: they have a span kind, their resource doesn't opt out by a boolean false,
    and neither does the request by the header text "false" (missing: "true"). The routing key is removed again.

    The rows are ``computed`` first: tests pushed below the stages of the profile would repeat all their expressions.
    """
    rows = computed(spans)
    route = F.coalesce(F.col("headers")[ROUTE_HEADER], F.lit("true"))
    opted_out = F.coalesce(F.col("resource")[OPT_OUT_KEY]["boolValue"] == F.lit(False), F.lit(False))
    return rows.where(text(F.col("attributes"), KIND_KEY).isNotNull() & ~opted_out & (route != "false")).withColumn("attributes", delete_keys(F.col("attributes"), [ROUTE_KEY]))


def by_id(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.where(F.col("trace_id") == trace_id)


def evaluation_by_id(spans: DataFrame, trace_id: str, limit: int = 100) -> DataFrame:
    """Spans of a trace in the table of the evaluation branch, at most ``limit``, by time."""
    return by_id(spans, trace_id).orderBy("start_ns", "span_id").limit(limit)


def within(spans: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Spans that begin in [start, end); the filter reaches a scan that has ``start_ns``."""
    return spans.where((F.col("start_ns") >= start_ns) & (F.col("start_ns") < end_ns))


def latest_traces(spans: DataFrame, service: str, limit: int = 50, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """The newest traces with a span of a matching service: (trace_id, root_name, start_ns, duration_ns).

    With a range only spans that begin in it are read and count, as a trace search has it.
    """
    root = F.col("parent_span_id").isNull()
    spans = within(spans, start_ns, end_ns) if start_ns is not None else spans
    found = spans.groupBy("trace_id").agg(
        F.max(anchored(F.coalesce("service_name", F.lit("")), service).cast("int")).alias("_hit"), F.min_by(F.when(root, F.col("name")), F.when(root, F.col("start_ns"))).alias("root_name"),
        F.min("start_ns").alias("start_ns"), (F.max("end_ns") - F.min("start_ns")).alias("duration_ns"),
    )
    return found.where("_hit = 1").drop("_hit").orderBy(F.desc("start_ns"), "trace_id").limit(limit)


def logs_of_traces(logs: DataFrame, spans: DataFrame, before: str = "1 minute", after: str = "1 minute") -> DataFrame:
    """Interval join: log rows with the span's trace_id between its start less ``before`` and its end plus ``after``."""
    s = spans.select("trace_id", "span_id", (F.col("start_ts") - F.expr(f"interval {before}")).alias("_from"), (F.col("end_ts") + F.expr(f"interval {after}")).alias("_to"))
    return logs.join(s, "trace_id").where((F.col("ts") >= F.col("_from")) & (F.col("ts") <= F.col("_to"))).drop("_from", "_to")


def trace_id_in(line: Column) -> Column:
    """The trace id that a log line names, or null."""
    return F.nullif(F.lower(F.regexp_extract(line, DERIVED_TRACE_ID, 1)), F.lit(""))


def with_parent(spans: DataFrame) -> DataFrame:
    """Each span with its parent's name and times (null for roots and orphans)."""
    p = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("name").alias("parent_name"), F.col("start_ns").alias("parent_start_ns"), F.col("end_ns").alias("parent_end_ns"))
    return spans.join(p, ["trace_id", "parent_span_id"], "left")


def trace_table(spans: DataFrame) -> DataFrame:
    """(trace_id, start_ns, root_name, duration_ns, status_code, span_count) of each trace; the root has no parent."""
    root = F.col("parent_span_id").isNull()
    of_root = lambda c: F.min_by(F.when(root, F.col(c)), F.when(root, F.struct("start_ns", "span_id")))
    return spans.groupBy("trace_id").agg(
        F.min("start_ns").alias("start_ns"), of_root("name").alias("root_name"), (of_root("end_ns") - of_root("start_ns")).alias("duration_ns"), of_root("status_code").alias("status_code"), F.count(F.lit(1)).alias("span_count"),
    )


def _children(spans: DataFrame) -> DataFrame:
    roots = spans.where("parent_span_id is null").select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("start_ns").alias("root_start"), F.col("end_ns").alias("root_end"))
    return spans.join(roots, ["trace_id", "parent_span_id"])


def longest_child(spans: DataFrame) -> DataFrame:
    """The root's longest child of each trace: where the time is, not the cause. Ties: the smaller span id."""
    length = F.col("end_ns") - F.col("start_ns")
    best = F.min(F.struct((-length).alias("_d"), "span_id", "name"))
    return _children(spans).groupBy("trace_id").agg(best.alias("x")).select("trace_id", F.col("x.name").alias("name"), (-F.col("x._d")).alias("duration_ns"))


def repeated_siblings(spans: DataFrame) -> DataFrame:
    """Same-named children of one parent: suspected repeats."""
    return spans.where("parent_span_id is not null").groupBy("trace_id", "parent_span_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def status_text(code: Column) -> Column:
    """Three values: unset says neither passed nor failed."""
    return F.when(code == 1, "ok").when(code == 2, "error").otherwise("unset")


def error_spans(spans: DataFrame) -> DataFrame:
    """Failed spans, and whether the parent went on after them."""
    joined = with_parent(spans.withColumn("failed", (F.coalesce("status_code", F.lit(0)) == 2) | F.coalesce(~F.col("success"), F.lit(False))))
    return joined.where("failed").select("trace_id", "span_id", "name", F.coalesce(F.col("parent_end_ns") > F.col("end_ns"), F.lit(False)).alias("parent_continued"))


def uncovered(spans: DataFrame) -> DataFrame:
    """(trace_id, root_ns, covered_ns, summed_ns, gap_ns, overlapping): how much of the root its children cover.

    Children's intervals are cut to the root and united by a running maximum of their ends; ``summed_ns`` is larger
    than ``covered_ns`` where they overlap, so it must not be read as elapsed time.
    """
    start, end = F.greatest("start_ns", "root_start"), F.least("end_ns", "root_end")
    c = _children(spans).select("trace_id", "root_start", "root_end", "span_id", start.alias("a"), end.alias("b")).where("b > a")
    before = Window.partitionBy("trace_id").orderBy("a", "span_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("b").over(before), F.col("root_start"))
    new = F.greatest(F.lit(0).cast("bigint"), F.col("b") - F.greatest(F.col("a"), F.col("seen")))
    per = c.withColumn("seen", seen).groupBy("trace_id", "root_start", "root_end").agg(F.sum(new).alias("covered_ns"), F.sum(F.col("b") - F.col("a")).alias("summed_ns"))
    return per.select("trace_id", (F.col("root_end") - F.col("root_start")).alias("root_ns"), "covered_ns", "summed_ns", (F.col("root_end") - F.col("root_start") - F.col("covered_ns")).alias("gap_ns"), (F.col("summed_ns") > F.col("covered_ns")).alias("overlapping"))
