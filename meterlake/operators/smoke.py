"""The smoke suite's reports: presence of traces by route, labels of request counters by mode, one document of all checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels that the corporate profile removes from request counters, and those that every canonical series has.
ATTRIBUTION = ("skill_id", "mcp_server_name", "mcp_tool_name")
CANONICAL = ("agent_role", "model_family", "model_id", "evidence_class")


def route_faults(expected: DataFrame, stores: dict[str, DataFrame]) -> DataFrame:
    """(trace_id, store, fault) of traces (trace_id, store, expected boolean) that a store lacks or shouldn't have; each store is a
    table with ``trace_id``. Traces of which nothing is expected are ignored.

    The join is a merge: a store's size, when it is parsed from documents, is estimated far too small, so its ids would be broadcast.
    """
    there = reduce(DataFrame.union, [t.select(F.col("trace_id").alias("_trace"), F.lit(name).alias("_store")) for name, t in stores.items()]).distinct()
    both = expected.join(there.hint("merge"), (F.col("trace_id") == F.col("_trace")) & (F.col("store") == F.col("_store")), "left")
    fault = F.when(F.col("expected") & F.col("_trace").isNull(), "missing").when(~F.col("expected") & F.col("_trace").isNotNull(), "unexpected")
    return both.select("trace_id", "store", fault.alias("fault")).where("fault is not null")


def label_faults(points: DataFrame, corporate: bool) -> DataFrame:
    """``points`` (attributes) of request counters with ``fault``: a canonical label is missing, attribution that the corporate
    mode must remove is there, or, in other modes, isn't."""
    has = lambda key: F.map_contains_key("attributes", F.lit(key))
    missing = [F.when(~has(k), F.lit(f"{k} is missing")) for k in CANONICAL]
    kept = [F.when(has(k), F.lit(f"{k} was kept")) for k in ATTRIBUTION] if corporate else [F.when(~has(k), F.lit(f"{k} was lost")) for k in ATTRIBUTION]
    return points.withColumn("fault", F.explode(F.array_compact(F.array(*missing, *kept))))


def smoke_report(checks: dict[str, DataFrame], mode: str, started: Column, completed: Column, skipped: dict[str, str] | None = None) -> DataFrame:
    """One JSON document (column ``report``): mode, times and, for each named table of failures, its status and number of failures.

    ``skipped`` names checks that weren't made, with the reason. Each check is counted by one aggregation; the document has one entry a check.
    """
    done = [t.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("status"), F.concat(F.col("n").cast("string"), F.lit(" failures")).alias("detail")) for name, t in checks.items()]
    left = [t for name, reason in (skipped or {}).items() for t in [done[0].select(F.lit(name).alias("name"), F.lit("SKIP").alias("status"), F.lit(reason).alias("detail"))]]
    every = reduce(DataFrame.union, done + left)
    entries = F.sort_array(F.collect_list(F.struct("name", "status", "detail")))
    head = [F.lit("1.0").alias("schema_version"), F.lit(mode).alias("mode"), started.alias("started_at"), completed.alias("completed_at")]
    return every.groupBy().agg(entries.alias("checks")).select(F.to_json(F.struct(*head, "checks")).alias("report"))
