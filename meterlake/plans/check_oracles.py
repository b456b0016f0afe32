"""DuckDB SQL for the queries of checks, sinks, streams and text functions."""

from __future__ import annotations

from meterlake.operators import accounting as A
from meterlake.plans import envelopes as E
from meterlake.plans.privacy_oracles import q
from meterlake.plans.views import CLASS_FACTORS

_KIND = "case event_type when 'click' then 'edit' when 'view' then 'validation' when 'signup' then 'wait' when 'error' then 'failure' else 'subagent' end"
_WORK = f"with w as (select event_id, concat_ws('/', cast(user_id as varchar), strftime(ts, '%Y-%m-%d')) as session, {_KIND} as kind, ts, value from events)"
_RAW = "with r as (select *, " + ", ".join(f"{E.RECORD[k]} as {c}" for k, c in (("prompt", "p"), ("prompt.text", "t"), ("arguments", "a"), ("url.full", "u"))) + " from events)"
_USAGE = [
    ("cost-fixture", "primary", "gpt-5.6-sol", {"input_uncached": 3000, "input_cached": 6000, "input_cache_write": 1000, "output": 2000}),
    ("role-fixture", "approval_reviewer", "unmapped", {"input_uncached": 2000, "input_cached": 6000, "output": 1000}),
    ("agent-fixture", "subagent", "gpt-5.6-terra", {"input_uncached": 1000, "input_cached": 1000, "output": 500}),
]


def _golden() -> str:
    """The golden numbers: usage by class as published, and the rate cards applied to it."""
    rows = []
    for ns, role, model, classes in _USAGE:
        for c, n in classes.items():
            usd, credit = (card.get(model, {}).get(c) for card in (A.USD_PER_MILLION, A.CREDITS_PER_MILLION))
            rows.append(("ai_agent_token_usage_total", ns, role, model, c, n))
            rows.append(("ai_agent_estimated_cost_usd_total" if usd is not None else "ai_agent_unpriced_api_token_usage_total", ns, role, model, c, n * usd / 1e6 if usd is not None else n))
            rows.append(("ai_agent_estimated_credit_usage_total" if credit is not None else "ai_agent_unpriced_credit_token_usage_total", ns, role, model, c, n * credit / 1e6 if credit is not None else n))
    values = ", ".join(f"({', '.join(map(q, r[:-1]))}, cast({r[-1]!r} as double))" for r in rows)
    return f"select rule, 'nation-' || n_nationkey || '-' || ns as service_namespace, agent_role, model_id, usage_class, round(value * (n_regionkey + 1), 9) as value from nation, (values {values}) t(rule, ns, agent_role, model_id, usage_class, value)"


_factors = ", ".join(f"({q(c)}, cast({f} as double))" for c, f in CLASS_FACTORS.items())
_word = "case event_id % 7 when 0 then '1' when 1 then ' Yes' when 2 then 'off' when 3 then 'TRUE' when 4 then '' when 5 then '0' else 'on' end"
_url = "case event_id % 5 when 0 then 'http://localhost:4318/v1' when 1 then 'https://127.0.0.1/x' when 2 then 'http://example.com' when 3 then 'http://[::1]:80' else 'ftp://localhost' end"
_native = "case event_id % 3 when 0 then 'antigravity_session_tokens' when 1 then 'antigravity_artifact_count' else 'antigravity_pending_input_count' end"

ORACLE: dict[str, str] = {
    "jsn01_event_conformance": """
        select event_id, case when event_id % 11 = 0 or event_id % 13 = 0 then '$' else array_to_string(list_filter([
            case when event_id % 5 = 0 then 'workflow.stage' end, case when event_id % 3 = 1 then 'operation.type' end, case when event_id % 7 = 0 then 'prompt' end], lambda x: x is not null), ',') end as violations
        from events""",
    "sm02_sm08_golden_numbers": _golden(),
    "chk02_forbidden_keys": f"""{_RAW}
        select 'raw' as stage, key, n from (select 'prompt' as key, count(p) as n from r union all select 'prompt.text', count(t) from r union all select 'arguments', count(a) from r union all select 'url.full', count(u) from r)""",
    "sm12_stored_logs_report": """
        select name, failures, failures = 0 as passed from (
            select 'raw bodies' as name, count(*) as failures from events union all select 'bodies', 0 union all select 'raw addresses', count(*) from events union all select 'addresses', 0)""",
    "sm11_gauge_pairs": f"""
        with n as (select {_native} as metric, event_type as state, max(value) as value from events group by all)
        select metric, state, value as native, case when metric = 'antigravity_artifact_count' then value + 1 end as copied from n where metric <> 'antigravity_session_tokens'""",
    "sm13_route_presence": f"""
        with s as (select event_id, event_id % 5 <> 0 and coalesce({E.OPT_OUT}, true) and coalesce({E.HEADER}, 'true') <> 'false' as chosen from events where event_id % 97 = 0)
        select md5(cast(event_id as varchar)) as trace_id, 'traces' as store, 'unexpected' as fault from s union all select md5(cast(event_id as varchar)), 'evaluation', case when chosen then 'unexpected' else 'missing' end from s""",
    "sm10_request_labels": """
        with n as (select count(*) as n from events where event_id % 7 = 1)
        select mode, label, n from n, (select unnest(['core', 'corporate']) as mode), (select unnest(['agent_role', 'model_family', 'model_id', 'evidence_class', 'skill_id', 'mcp_server_name', 'mcp_tool_name']) as label)
        where mode = 'core' or label in ('agent_role', 'model_family', 'model_id', 'evidence_class')""",
    "snk07_smoke_report": """
        select '{"schema_version":"1.0","mode":"core","started_at":"' || strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') || '","completed_at":"' || strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') || '","checks":[{"name":"evaluation","status":"SKIP","detail":"not in this mode"},{"name":"languages","status":"' ||
               (select case when count(*) = 0 then 'PASS' else 'FAIL' end || '","detail":"' || count(*) from documents where lang not in ('en', 'fr')) || ' failures"},{"name":"parts","status":"PASS","detail":"0 failures"}]}' as report from events""",
    "src05_template_times": "select cast(event_id as varchar) as trace_id, event_type as name, case when event_id % 2 = 0 then 1699999999950000000 else 1700000000000000000 end as start_ns, 1700000000000000000 as end_ns from events",
    "chk17_composition_faults": """
        with faults as (select * from (values
            (1, 'logs', 'initial', 'out of order'), (1, 'logs', 'initial', 'stage behind an export'), (2, 'traces/evaluation', 'routing clean-up', 'out of order'), (2, 'traces/evaluation', 'routing clean-up', 'stage behind an export'),
            (3, 'metrics', 'finish', 'unknown stage'), (3, 'metrics', 'final', 'missing stage'), (4, 'traces', 'initial', 'repeated stage'), (4, 'traces', 'initial', 'repeated stage'), (4, 'traces', 'initial', 'out of order'), (4, 'traces', 'final', 'missing stage'),
            (5, 'logs', 'log store', 'changed kind'), (5, 'logs', null, 'nothing exported'), (6, 'traces/evaluation', 'routed', 'changed detail'), (7, 'traces/evaluation', 'routing clean-up', 'changed detail'), (7, 'traces/evaluation', 'routing', 'key left behind'),
            (8, 'logs', 'canonicalise', 'missing stage'), (8, 'metrics', 'canonicalise', 'missing stage'), (8, 'traces', 'canonicalise', 'missing stage'), (8, 'traces/evaluation', 'canonicalise', 'missing stage')) t(remainder, pipeline, stage, fault))
        select n_nationkey, pipeline, stage, fault from nation join faults on n_nationkey % 9 = remainder""",
    "chk08_mixed_contracts": "select r_regionkey, case r_regionkey when 1 then 'cu02' else 'cu06' end as panel, case r_regionkey when 1 then 'ai_agent,native' else 'none' end as contracts from region where r_regionkey in (1, 2)",
    "chk12_rubric_faults": "select * from (values ('other', 'unexpected name'), ('check 1', 'unknown type'), ('check 2', 'no labels'), ('check 3', 'repeated label')) t(name, fault)",
    "src20_rate_files": f"select 'openai' as ai_agent_provider, p_brand as model_id, usage_class, 'USD' as currency, 'v1' as rate_card_version, min(p_size) * factor as value from part, (values {_factors}) f(usage_class, factor) group by p_brand, usage_class, factor",
    "chk16_late_preflight": f"{_WORK}, f as (select session, min(ts) filter (where kind = 'validation') as checked, min(ts) filter (where kind = 'edit') as acted from w group by session) select session from f where acted is not null and (checked is null or checked > acted)",
    "chk16_unattributed_waits": f"{_WORK} select event_id, session from w where kind = 'wait' and value <= 50",
    "chk16_context_budget": f"{_WORK} select session, round(sum(value), 6) as total from w group by session having sum(value) > 500",
    "chk16_subagent_overlap": f"{_WORK}, s as (select *, ts + to_seconds(cast(floor(value * 20) as bigint)) as finish from w where kind = 'subagent'), o as (select *, max(finish) over (partition by session order by ts rows between unbounded preceding and 1 preceding) as until from s) select event_id, session from o where ts < until",
    "chk16_untruthful_outcomes": f"{_WORK}, f as (select session, max(ts) as failed from w where kind = 'failure' group by session) select event_id, session from w join f using (session) where kind = 'validation' and value > 30 and failed >= ts",
    "map03_delete_where": "select event_id, case when event_id % 2 = 0 then 'status,tool' else 'model,status,tool' end as keys from events",
    "agg13_last_not_null": "select event_type, max_by(value, ts) as value from events where user_id % 2 = 0 group by event_type",
    "flt08_flt11_text_tests": f"select {_word} as word, {_url} as url, lower(trim({_word})) in ('1', 'true', 'yes', 'on') as truthy, event_id % 5 in (0, 1, 3) as loopback from events group by all",
    "str14_str15_ids": "select page_id, 'id' as key, url as value, page_id % 3 <> 0 as logical, true as hex16, false as hex32 from pages",
    "cnd02_cnd03_outcomes": "select case event_id % 3 when 0 then 'file-operation' when 1 then 'search-operation' else 'other-tool' end as category, case when user_id % 3 = 0 then 'error' else 'success' end as outcome, case when user_id % 3 = 0 then 'tool_error' end as error, count(*) as n from events group by all",
    "snk01_snk04_samples_fan_out": """
        select 'kept' as sink, 'm_' || event_type as metric, count(*) as n, round(sum(value), 4) as value from events where cast(ts as date) >= date '2024-01-15' group by all
        union all select 'lines', 'm_' || event_type, count(*), round(sum(value), 4) from events group by all""",
    "snk02_logs_by_stream": f"select coalesce({E.RESOURCE['service.name']}, 'unknown-ai-client') as service_name, coalesce({E.RESOURCE['service.namespace']}, '') as service_namespace, count(*) as n, max(event_id * 1000) as newest from events group by all",
    "snk03_spans_by_date": "select '1970-01-01' as date, case when value > 20 then 2 else 1 end as status_code, count(*) as n from events group by all",
    "stm08_counted_drops": "select event_type, cast(sum(case when event_type = 'error' then 0 else 1 end) as bigint) as delivered, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as dropped, event_type = 'error' as retried from events group by event_type",
    "snk04_evaluation_stores": f"""
        with s as (select event_type as span, case when value > 20 then 2 else 1 end as status_code, event_id % 5 <> 0 and coalesce({E.OPT_OUT}, true) and coalesce({E.HEADER}, 'true') <> 'false' as chosen from events)
        select 'traces' as store, span, status_code, count(*) as n from s group by all union all select 'evaluation', span, status_code, count(*) from s where chosen group by all""",
    "src08_scrapes": "select 'up' as metric, event_type as instance, count(*) as n, cast(sum(case when value > 20 then 1 else 0 end) as double) as up from events group by all",
    "stm05_windows": "select event_type as event_name, date_trunc('day', ts) as ts, count(*) as value from events where date_trunc('day', ts) + interval '1 day' <= (select max(ts) from events) - interval '48 hours' group by all",
    "stm05_sliding_windows": """
        with e as (select event_type as event_name, unnest(range(0, 6)) as k, ts from events), w as (select event_name, date_trunc('hour', ts) + interval '1 hour' * (k + 1) as ts from e)
        select event_name, ts, count(*) as value from w where ts <= (select max(ts) from events) - interval '48 hours' group by all""",
    "tsf11_series_ends": """
        with g as (select *, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts)
        ), l as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as life from g)
        select user_id, min(ts) as first, max(ts) as last, max_by(value, (ts, value)) as value, count(*) as n from l group by user_id, life
        having max(ts) + interval '30 minutes' <= (select max(ts) from events)""",
    "stm11_unique_events": "select event_type, count(*) as n from events group by all",
}
