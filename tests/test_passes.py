"""How often rows are computed: documents are parsed once, and what follows a costly stage doesn't repeat it."""

import os
import random
import re

import pytest

from meterlake.operators import privacy, privacy_names, samples
from meterlake.plans import envelopes as E
from meterlake.plans import check_queries, privacy_queries, queries
from meterlake.plans.pipelines import evaluation_spans, process

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


def times(spark, df, what: str) -> int:
    """How often a pattern stands in the optimised plan."""
    key = "spark.sql.maxToStringFields"
    before = spark.conf.get(key, "25")
    spark.conf.set(key, "100000")
    try:
        return len(re.findall(what, df._jdf.queryExecution().optimizedPlan().toString()))
    finally:
        spark.conf.set(key, before)


def test_routing_does_not_repeat_the_stages_before_it(spark):
    spans = E.spans(spark, TABLES)
    branch = evaluation_spans(spans)
    assert times(spark, branch, "RLIKE") == times(spark, process(spans, "spans", "evaluation"), "RLIKE")
    assert times(spark, branch, "from_json") == 1


def test_route_presence_computes_each_store_once(spark):
    faults = queries.QUERIES["sm13_route_presence"](spark, TABLES)
    assert times(spark, faults, "from_json") == 2  # one a store
    assert times(spark, faults, "RLIKE") <= times(spark, evaluation_spans(E.spans(spark, TABLES)), "RLIKE")


def test_ids_of_stores_are_not_broadcast(spark):
    faults = queries.QUERIES["sm13_route_presence"](spark, TABLES)
    plan = faults._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_points_become_samples_in_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    long = samples.to_long(process(E.points(spark, TABLES, temporality=samples.DELTA), "points")).drop("ts")
    n = long.count()
    schema = long.schema
    out = samples.to_samples(long.mapInArrow(count, schema).selectExpr("*", "timestamp_micros(time_ns div 1000) as ts"), ["status"])
    assert {r.metric.rsplit("_", 1)[-1] for r in out.where("metric like 'ai_agent_turn_token_usage%'").select("metric").distinct().collect()} >= {"bucket", "sum", "count"}
    assert seen.value == n


@pytest.mark.parametrize("name", ["prc_points_core", "prc_points_evaluation", "prc_points_corporate", "prc_spans_core", "prc_spans_evaluation", "prc_spans_corporate", "prc06_sent_snapshots", "prc06_sent_gauges"])
def test_documents_are_parsed_once(spark, name):
    df = privacy_queries.QUERIES[name](spark, TABLES)
    assert times(spark, df, "from_json") <= (2 if name.startswith("prc06") else 1)


@pytest.mark.parametrize("name", ["prc06_sent_gauges", "prc06_sent_snapshots"])
def test_snapshots_that_are_sent_need_no_join(spark, name):
    df = privacy_queries.QUERIES[name](spark, TABLES)
    assert times(spark, df, "Join ") == 0  # sizes of parsed rows are estimated far too small, so a join would broadcast them
    assert times(spark, df, "from_json") == 1


def test_file_of_one_row_group_is_dealt_over_the_cores(spark):
    assert queries.QUERIES["prc_points_core"](spark, TABLES).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert E.spans(spark, TABLES).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert E.logs(spark, TABLES).rdd.getNumPartitions() > 1


def test_rules_of_points_stay_short(spark):
    assert times(spark, process(E.points(spark, TABLES), "points"), "approval_reviewer") <= 6


def test_quick_patterns_match_the_same_keys():
    patterns = [v for v in vars(privacy_names).values() if isinstance(v, str) and v.startswith("(?i)")]
    rnd = random.Random(1)
    words = sorted(set(re.findall(r"[a-z]+", " ".join(patterns)))) + ["x", "msg"]
    keys = ["", "\n"] + [rnd.choice(["", "_", "."]) + "".join(rnd.choice(words) + rnd.choice(["", "s", ".", "_", "-", "X"]) for _ in range(rnd.randint(1, 4))) for _ in range(5000)]
    for pattern in patterns:
        assert privacy.quick(pattern) != pattern
        assert [k for k in keys if re.search(pattern, k)] == [k for k in keys if re.search(privacy.quick(pattern), k)]
    assert privacy.quick(".*") == ".*" and privacy.quick("(?i)(a)|(b)") == "(?i)(a)|(b)"


@pytest.mark.parametrize("name", ["sm10_request_labels", "chk02_forbidden_keys"])
def test_rows_read_more_than_once_are_parsed_once(spark, name):
    df = queries.QUERIES[name](spark, TABLES)
    assert times(spark, df, "from_json") == 0  # the stored rows are read
    assert times(spark, df, "Relation .* json") == 0


def test_stores_share_the_processed_spans(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(check_queries, "process", lambda *a: calls.append(a) or process(*a))
    monkeypatch.setattr(check_queries, "evaluation_spans", lambda t: calls.append(t) or evaluation_spans(t))
    assert check_queries.QUERIES["snk04_evaluation_stores"](spark, TABLES).count() > 0
    assert len(calls) == 1
