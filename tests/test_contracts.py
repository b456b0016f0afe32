import json

from meterlake.operators import contracts as K
from meterlake.operators.checks import order_faults
from meterlake.plans import catalog as C

GOOD = {
    "schema_version": "1.0", "occurred_at": "2024-01-02T03:04:05Z", "environment": {"profile": "core"}, "framework": {"name": "f", "version": "1"},
    "workflow": {"type": "t", "stage": "s"}, "operation": {"type": "tool", "state": "active", "outcome": "success", "evidence_class": "git-fact", "duration_ms": 5},
    "ai": {"token_usage": {"input": 3}}, "privacy": {"content_captured": False, "policy_profile": "personal-minimized"},
}


def changed(**paths):
    doc = json.loads(json.dumps(GOOD))
    for path, value in paths.items():
        at = doc
        *parents, key = path.split("__")
        for p in parents:
            at = at.setdefault(p, {})
        if value is None:
            at.pop(key)
        else:
            at[key] = value
    return json.dumps(doc)


def test_event_conformance(spark):
    cases = [
        (json.dumps(GOOD), []),
        (changed(operation__type="dance"), ["operation.type"]),
        (changed(operation__duration_ms=-1), ["operation.duration_ms"]),
        (changed(workflow__stage=None), ["workflow.stage"]),
        (changed(privacy__content_captured=True), ["privacy.content_captured"]),
        (changed(ai__cost={"value": 1, "unit": "USD", "source": "official"}), ["ai.cost.attribution_confidence"]),
        (changed(prompt="text"), ["prompt"]),
        (changed(environment__user_pseudonym="a@b"), ["environment.user_pseudonym"]),
        ("[1]", None),
        ("{", None),
    ]
    out = K.event_violations(spark.createDataFrame([(n, c[0]) for n, c in enumerate(cases)], "n int, event string")).collect()
    for row in out:
        want = cases[row.n][1]
        assert row.violations == want if want is not None else row.violations[0] == "$", (row.n, row.violations)


def test_feedback_bundle_and_report(spark):
    metrics = spark.createDataFrame([("b", 2), ("a", 1)], "name string, value int")
    assert json.loads(K.feedback_bundle(metrics, "1").first().bundle) == {"schema_version": "1.0", "environment_profile": "corporate-redacted", "framework_version": "1", "metrics": {"a": 1, "b": 2}}
    got = {r.name: (r.failures, r.passed) for r in K.report({"x": metrics, "y": metrics.limit(0)}).collect()}
    assert got == {"x": (2, False), "y": (0, True)}


def test_panels_stay_within_one_contract():
    for name, p in C.PANELS.items():
        assert len(K.contracts_of([p.metric])) <= 1, name
    assert K.contracts_of(["codex_tool_call", "ai_agent_tool_call"]) == ["ai_agent", "native"]


def test_stage_order():
    want = ("a", "b", "c")
    assert order_faults(["a", "b", "c"], want) == []
    assert order_faults(["b", "a", "c"], want) == ["a", "b"] and order_faults(["a", "c", "d"], want) == ["b", "d"]
