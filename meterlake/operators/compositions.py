"""Checks of pipeline compositions: graphs of named stages, as tables, against the policy that they must follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.operators.traces import KIND_KEY, OPT_OUT_KEY, ROUTE_HEADER, ROUTE_KEY

#: A stage of a graph: kind is process, filter (detail: the condition that drops), upsert or delete (detail: the key) or export.
GRAPH = "pipeline string, position int, stage string, kind string, detail string"

_PRIVACY = [("normalise", "process", ""), ("initial", "process", ""), ("canonicalise", "process", ""), ("final", "process", "")]
#: The evaluation profile: all signals are redacted in the same order; its second branch routes spans and forgets how.
EVALUATION = {
    "logs": [*_PRIVACY, ("log store", "export", "")],
    "metrics": [*_PRIVACY, ("sample store", "export", "")],
    "traces": [*_PRIVACY, ("trace store", "export", "")],
    "traces/evaluation": [
        *_PRIVACY, ("has a span kind", "filter", f"{KIND_KEY} is missing"), ("routing", "upsert", f"{ROUTE_KEY} from {ROUTE_HEADER} or true"),
        ("routed", "filter", f"{OPT_OUT_KEY} is false or {ROUTE_KEY} is false"), ("routing clean-up", "delete", ROUTE_KEY), ("evaluation store", "export", ""),
    ],
}


def cells(pipelines: dict[str, list[tuple[str, str, str]]] = EVALUATION) -> Column:
    """Pipelines as an array of stages, one struct (``GRAPH``) each."""
    rows = [(p, n, *stage) for p, stages in pipelines.items() for n, stage in enumerate(stages)]
    named = [x.split(" ") for x in GRAPH.split(", ")]
    return F.array(*(F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, named))) for row in rows))


def composition_faults(graphs: DataFrame, policy: dict[str, list[tuple[str, str, str]]], config: str) -> DataFrame:
    """(config, pipeline, stage, fault) of graphs (config, ``GRAPH``) that don't follow ``policy``.

    missing stage, unknown stage, repeated stage; out of order: a stage that must come earlier than one before it; changed kind,
    changed detail (a condition or key); key left behind: an upserted key that no later stage deletes; nothing exported; stage
    behind an export.
    """
    due = {(p, stage[0]): (n, *stage[1:]) for p, stages in policy.items() for n, stage in enumerate(stages)}
    places = F.create_map(*(x for (p, s), (n, kind, detail) in due.items() for x in (F.lit(f"{p}/{s}"), F.struct(F.lit(n).alias("due"), F.lit(kind).alias("kind"), F.lit(detail).alias("detail")))))
    known = graphs.withColumn("_want", places[F.concat_ws("/", "pipeline", "stage")]).withColumns({"_due": F.col("_want.due"), "_kind": F.col("_want.kind"), "_detail": F.col("_want.detail")})
    every = Window.partitionBy(config, "pipeline")
    ahead = F.max("_due").over(every.orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    behind = F.max(F.when(F.col("kind") == "export", 1)).over(every.orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    key = F.substring_index("detail", " ", 1)
    cleaned = F.array_contains(F.collect_set(F.when(F.col("kind") == "delete", key)).over(every.orderBy("position").rowsBetween(1, Window.unboundedFollowing)), key)
    own = known.withColumns({"_ahead": ahead, "_behind": behind, "_cleaned": cleaned, "_n": F.count(F.lit(1)).over(Window.partitionBy(config, "pipeline", "stage"))})
    named = lambda test, fault: F.when(test, fault)
    faults = F.array_compact(F.array(
        named(F.col("_due").isNull(), "unknown stage"), named(F.col("_n") > 1, "repeated stage"), named(F.col("_due") < F.col("_ahead"), "out of order"), named(F.col("kind") != F.col("_kind"), "changed kind"),
        named((F.col("kind") == F.col("_kind")) & (F.col("detail") != F.col("_detail")), "changed detail"), named((F.col("kind") == "upsert") & ~F.col("_cleaned"), "key left behind"), named(F.col("_behind") == 1, "stage behind an export"),
    ))
    found = own.select(config, "pipeline", "stage", F.explode(faults).alias("fault"))
    seen = graphs.groupBy(config).agg(F.collect_set(F.concat_ws("/", "pipeline", "stage")).alias("_seen"))
    names = F.array(*(F.struct(F.lit(p).alias("pipeline"), F.lit(s).alias("stage")) for p, s in due))
    absent = F.filter(names, lambda x: ~F.array_contains("_seen", F.concat_ws("/", x["pipeline"], x["stage"])))
    missing = seen.select(config, F.inline(absent), F.lit("missing stage").alias("fault"))
    exported = graphs.groupBy(config, "pipeline").agg(F.sum(F.when(F.col("kind") == "export", 1).otherwise(0)).alias("_x")).where("_x = 0")
    nowhere = exported.select(config, "pipeline", F.lit(None).cast("string").alias("stage"), F.lit("nothing exported").alias("fault"))
    return found.union(missing).union(nowhere)


def mixed_contracts(queries: DataFrame, contracts: dict[str, tuple[str, ...]], config: str) -> DataFrame:
    """(config, panel, contracts) of panels (config, panel, metric) whose metrics belong to several contracts, or to none."""
    name = F.coalesce(*(F.when(F.greatest(F.lit(False), *(F.startswith(F.col("metric"), F.lit(p)) for p in prefixes)), F.lit(c)) for c, prefixes in contracts.items()), F.lit("none"))
    by = queries.groupBy(config, "panel").agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("contracts"))
    return by.where(F.col("contracts").contains(",") | (F.col("contracts") == "none"))
