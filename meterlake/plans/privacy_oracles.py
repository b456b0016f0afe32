"""DuckDB SQL for the queries of the privacy profiles: the rules as columns of one key each, stage by stage."""

from __future__ import annotations

from meterlake.operators import privacy_names as N
from meterlake.operators.canonical import COPIES, PROFILE_VALUES, RAW_KEYS, REQUEST_METRIC, SERVICES, UNKNOWN_SERVICE
from meterlake.plans import envelopes as E
from meterlake.plans import privacy_queries as P

#: Steps of the hook protocol: open invocations and first-seen times by recursion-free windows over runs between stops.
_STEPS = "with e as (select " + ", ".join(f"{v} as {k}" for k, v in P.HOOKS.items()) + """ from events), r as (
            select *, conversation_id as c, time_ns as ns, coalesce(sum(case when event = 'Stop' then 1 else 0 end) over (partition by conversation_id order by time_ns rows between unbounded preceding and 1 preceding), 0) as run,
                   coalesce(max_by(model, time_ns) filter (where model <> 'unknown') over (partition by conversation_id order by time_ns), 'unknown') as known, coalesce(fully_idle, false) as idle,
                   case event when 'Stop' then coalesce(termination_reason, '') = 'error' or trim(coalesce(error, '')) <> '' when 'PostToolUse' then trim(coalesce(error, '')) <> '' else false end as bad from e
        ), p as (
            select *, min(ns) over (partition by c, run) as first, lag(event) over i as prior, lag(ns) over i as prior_ns from r window i as (partition by c, run, invocation_num, event in ('PreInvocation', 'PostInvocation') order by ns)
        ), s as (
            select *, case when event = 'Stop' then first when prior = 'PreInvocation' then prior_ns else ns end as start_ns from p
        )"""

#: Snapshots that are sent: fingerprints of their canonical JSON, then the change-or-heartbeat rule as a walk.
_SENT = """with recursive e as (
            select user_id, cast(user_id as varchar) as session, event_id * 1000000000 as time_ns, case when event_type in ('click', 'view') then 'busy' else 'idle' end as state, value > 200 as big,
                   case when least(100, greatest(0, value - 10)) > 20 then 20.5 else 0.0 end::double as used, row_number() over (partition by user_id order by event_id) as k from events
        ), f as (
            select *, sha256('{"agent_state":"' || state || '","artifact_count":0,"current":{"cache_creation":0,"cache_read":7,"input":0,"output":0},"exceeds_200k_tokens":' || big || ',"execution_mode":"unknown","model":"gemini","pending_input_count":0,'
                   || '"quota":{"daily":' || case when big then '0.0' else '1.0' end || ',"weekly":0.9378},"task_count":0,"tool_confirmation_pending":false,"total_input":' || user_id * 3 || ',"total_output":' || user_id || ',"used_percentage":' || used || '}') as fingerprint from e
        ), walk as (
            select *, time_ns as last, true as chosen from f where k = 1
            union all
            select f.*, case when f.fingerprint <> w.fingerprint or f.time_ns - w.last >= 1000000000000 then f.time_ns else w.last end, f.fingerprint <> w.fingerprint or f.time_ns - w.last >= 1000000000000
            from walk w join f on f.session = w.session and f.k = w.k + 1
        ), sent as (select * from walk where chosen)"""

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def col(prefix: str, key: str) -> str:
    return f"{prefix}_{key.replace('.', '__')}"


def columns(prefix: str, keys) -> str:
    return "".join(f", {col(prefix, k)}" for k in keys)


def each(prefix: str, keys, change) -> str:
    """One column a key: ``change`` gives the SQL of its new value."""
    return "".join(f", {change(k, col(prefix, k))} as {col(prefix, k)}" for k in keys)


def without(pattern: str):
    return lambda k, c: f"case when not regexp_matches({q(k)}, {q(pattern)}) then {c} end"


def only(keys):
    return lambda k, c: f"case when list_contains([{', '.join(map(q, keys))}], {q(k)}) then {c} end"


def _nothing(k, c):
    return "cast(null as varchar)"


def final_keys(k, c):
    """Last deletion of traces and logs: by name, then by pattern."""
    return f"case when not list_contains([{', '.join(map(q, N.FINAL_KEYS))}], {q(k)}) and not regexp_matches({q(k)}, {q(N.FINAL)}) then {c} end"


def listed(prefix: str, keys) -> str:
    pairs = ", ".join(f"{q(k + '=')} || {col(prefix, k)}" for k in keys)
    return f"array_to_string(list_sort(list_filter([{pairs}], lambda x: x is not null)), ',')"


def raw(prefix: str, values: dict[str, str]) -> str:
    return "".join(f", cast({v} as varchar) as {col(prefix, k)}" for k, v in values.items())


FIXED = ("ai_context.environment.profile", "ai_observability.profile", "deployment.environment.name")
OWNER = ("ai_agent.provider", "ai_agent.product", "ai_agent.surface")
RESOURCE = [*E.RESOURCE, *FIXED, *OWNER]


def resource(profile: str, flags: dict[str, str] | None = None) -> str:
    """Columns of a resource after the first rules: fixed values and a default service."""
    value, environment = PROFILE_VALUES[profile]
    fixed = "".join(f", {q(v)} as {col('r', k)}" for k, v in zip(FIXED, (value, value, environment)))
    own = E.RESOURCE | {"service.name": f"coalesce({E.RESOURCE['service.name']}, {q(UNKNOWN_SERVICE)})"}
    return raw("r", own) + fixed + raw("r", flags or {})


def owner() -> str:
    """Provider, product and surface of known services."""
    case = lambda at: "case r_service__name " + " ".join(f"when {q(s)} then {q(v[at])}" for s, v in SERVICES.items()) + " end"
    return "".join(f", {case(at)} as {col('r', k)}" for at, k in enumerate(OWNER))


# --- data points ----------------------------------------------------------------------------------------------------

#: Keys that the rules derive on canonical metrics.
DERIVED = ("model_family", "model_id", "agent_role", "operation", "evidence_class", "token_type", "skill_id", "mcp_server_name", "mcp_tool_name", "tool_category", "content_scope", "measurement_method")
POINT = [*E.POINT, *(k for k in DERIVED if k not in E.POINT)]


def points(profile: str, time: str = "event_id * 1000") -> str:
    """CTEs up to ``done``: time_ns, metric, kind, value, event_value and a column for each key of resource and point."""
    corporate = profile == "corporate"
    copy = "case metric " + " ".join(f"when {q(a)} then {q(b)}" for a, b in COPIES.items()) + " end"
    first = [k for k in E.RESOURCE] + list(FIXED)
    point_keys = [k for k in N.POINT_KEYS if not (corporate and k in N.CORPORATE_POINT_DROPS)]
    prompt, response = (f"metric = {q(m)}" for m in N.CONTENT_SIZE_METRICS)
    size = f"({prompt} or {response})"
    derived = {
        "model_family": """case when own and new_model then 'gpt-5.6' when own and server then 'unmapped'
            when request then case when starts_with(a_model, 'claude-opus-') then 'claude-opus' when starts_with(a_model, 'claude-sonnet-') then 'claude-sonnet' when starts_with(a_model, 'claude-haiku-') then 'claude-haiku' else 'claude' end end""",
        "model_id": "case when own and a_model in ('gpt-5.6-sol', 'gpt-5.6-terra', 'gpt-5.6-luna') then a_model when request or own and server then 'unmapped' end",
        "agent_role": "case when own and server and role2 = 'unknown' and new_model then 'primary' else role2 end",
        "operation": "case when starts_with(metric, 'ai_agent.api.') then 'api' when starts_with(metric, 'ai_agent.mcp.') then 'mcp' when starts_with(metric, 'ai_agent.tool.') then 'tool' when starts_with(metric, 'ai_agent.turn.') then 'turn' when request then 'request' end",
        "evidence_class": "case when starts_with(metric, 'ai_agent.observed.') then 'observed' when request or own and server then 'provider-reported' end",
        "token_type": "case when request and a_type in ('input', 'output') then a_type when request and a_type = 'cacheRead' then 'cached_input' when request and a_type = 'cacheCreation' then 'cache_write_input' else a_token_type end",
        "skill_id": "case when request then coalesce(a_skill__name, 'none') end" if not corporate else "cast(null as varchar)",
        "mcp_server_name": "case when request then coalesce(a_mcp_server__name, 'none') end",
        "mcp_tool_name": "case when request then 'none' end",
        "tool_category": "case when starts_with(metric, 'ai_agent.tool.') then case when regexp_matches(a_tool, '^[a-z0-9_]+\\.') then 'connector' when a_tool = 'apply_patch' then 'editor' when a_tool in ('exec', 'exec_command') then 'execution' end end",
    }
    if not corporate:
        derived |= {"content_scope": f"case when {prompt} then 'user_prompt' when {response} then 'hook_tool_response' end", "measurement_method": f"case when {size} then 'utf8_bytes' end"}
    # a native metric keeps what it came with, but for the two keys of content sizes
    native = lambda k: "cast(null as varchar)" if k not in E.POINT or (k == "content_scope" and not corporate) else col("a", k)
    left = lambda k: "cast(null as varchar)" if k in RAW_KEYS or k not in E.POINT else native(k)
    attributes = "".join(f", case when own then {derived.get(k, left(k)) if k in derived else left(k)} else {native(k)} end as {'b_' + col('a', k)}" for k in POINT)
    picked = lambda k: f"b_{col('a', k)}"
    keep = only(point_keys)
    dropped = f" where metric not in ({', '.join(map(q, N.CONTENT_SIZE_METRICS))})" if corporate else ""
    return f"""
with raw as (
    select {time} as time_ns, {E.METRIC} as metric, {E.KIND} as kind, value as event_value, case when event_id % 3 = 1 then trunc(value) else value end as value{resource(profile)}{raw('a', E.POINT)} from events
), small as (
    select time_ns, metric, kind, value, event_value{each('r', first, without(N.INITIAL_METRIC))}{each('a', E.POINT, without(N.INITIAL_METRIC))} from raw
), owned as (
    select *{owner()} from small
), copied as (
    select * from owned union all select * replace ({copy} as metric) from owned where {copy} is not null
), flags as (
    select *, starts_with(metric, 'ai_agent.') as own, metric = {q(REQUEST_METRIC)} as request, coalesce(r_service__name = 'codex-app-server', false) as server,
           coalesce(a_model = 'gpt-5.6' or starts_with(a_model, 'gpt-5.6-'), false) as new_model from copied
), roles as (
    select *, case when own and a_model = 'codex-auto-review' then 'approval_reviewer' when own and coalesce(role0 not in ('primary', 'approval_reviewer', 'subagent', 'unknown'), true) then 'unknown' else role0 end as role2
    from (select *, case when request then case a_query_source when 'main' then 'primary' when 'subagent' then 'subagent' else 'unknown' end else a_agent_role end as role0 from flags)
), ruled as (
    select time_ns, metric, kind, value, event_value{columns('r', RESOURCE)}{attributes} from roles
), done as (
    select time_ns, metric, kind, value, event_value{each('r', RESOURCE, only(N.METRIC_RESOURCE_KEYS))}{''.join(f", {keep(k, picked(k))} as {col('a', k)}" for k in POINT)} from ruled{dropped}
)"""


for _profile in PROFILE_VALUES:
    ORACLE[f"prc_points_{_profile}"] = f"{points(_profile)} select time_ns, metric, kind, round(value, 6) as value, {listed('r', RESOURCE)} as resource, '' as scope, {listed('a', POINT)} as attributes, '' as description from done"

_SHOWN = "r_service__name as service_name, a_status as status, a_operation as operation, a_token_type as token_type"
_LES = ", ".join(f"('{b}', {b})" for b in E.BOUNDS) + ", ('+Inf', 'infinity'::double)"
ORACLE["trx06_trx08_samples"] = rf"""{points('core', "event_id % 40 * 1000000000")}, series as (
    select regexp_replace(metric, '[^a-zA-Z0-9_:]', '_', 'g') as metric, {listed('r', RESOURCE)} || '|' || {listed('a', POINT)} as series, {_SHOWN}, time_ns, kind, value, event_value from done
), merged as (
    select metric, series, service_name, status, operation, token_type, time_ns, kind, case when kind = 'gauge' then max(value) else sum(value) end as value, count(*) as n, list(event_value) as vs from series group by metric, series, service_name, status, operation, token_type, time_ns, kind
), rows as (
    select metric, series, service_name, status, operation, token_type, time_ns, kind, cast(null as varchar) as le, value from merged where kind <> 'histogram'
    union all select metric || '_sum', series, service_name, status, operation, token_type, time_ns, kind, null, value from merged where kind = 'histogram'
    union all select metric || '_count', series, service_name, status, operation, token_type, time_ns, kind, null, n from merged where kind = 'histogram'
    union all select metric || '_bucket', series, service_name, status, operation, token_type, time_ns, kind, le, len(list_filter(vs, lambda v: v <= bound)) from merged, (values {_LES}) b(le, bound) where kind = 'histogram'
), totals as (
    select *, case when kind = 'gauge' then value else sum(value) over (partition by metric, series, le order by time_ns) end as total from rows
)
select metric, service_name, status, operation, token_type, le, time_ns // 1000 as us, round(sum(total), 4) as value, count(*) as series from totals group by all"""


# --- log records and spans ------------------------------------------------------------------------------------------


def records(profile: str, values: dict[str, str], head: str, names: str, flags: dict[str, str] | None = None, events: bool = False) -> str:
    """CTEs up to ``done`` for log records or spans: columns ``names`` and one for each key of resource, scope, record and event."""
    corporate = profile == "corporate"
    more = list(flags or {})
    first, every = [*E.RESOURCE, *FIXED, *more], [*RESOURCE, *more]
    r, rec = (N.CORPORATE_RESOURCE, N.CORPORATE_RECORD) if corporate else (N.INITIAL_RESOURCE, N.INITIAL_RECORD)
    scope = _nothing if corporate else without(N.INITIAL_SCOPE)
    last_r, last = (only(N.CORPORATE_RESOURCE_KEYS), only(N.CORPORATE_RECORD_KEYS)) if corporate else (final_keys, final_keys)
    inner = [("e", E.SPAN_EVENT, without(N.INITIAL_EVENT), last)] if events else []
    return f"""
with raw as (
    select {head}{resource(profile, flags)}{raw('s', E.SCOPE)}{raw('a', values)}{''.join(raw(p, v) for p, v, _, _ in inner)} from events
), small as (
    select {names}{each('r', first, without(r))}{each('s', E.SCOPE, scope)}{each('a', values, without(rec))}{''.join(each(p, v, c) for p, v, c, _ in inner)} from raw
), owned as (
    select *{owner()} from small
), done as (
    select {names}{each('r', every, last_r)}{each('s', E.SCOPE, _nothing if corporate else final_keys)}{each('a', values, last)}{''.join(each(p, v, c) for p, v, _, c in inner)} from owned
)"""


_SPAN_HEAD = "event_id * 1000 as time_ns, md5(cast(event_id as varchar)) as trace_id, event_type as name, case when value > 20 then 2 else 1 end as status_code, event_id"
_FLAG = {"ai_context.export.phoenix": E.OPT_OUT}


def spans(profile: str) -> str:
    corporate = profile == "corporate"
    keys = [*RESOURCE, *_FLAG]
    return f"""{records(profile, E.SPAN, _SPAN_HEAD, 'time_ns, trace_id, name, status_code, event_id', _FLAG, True)}
select time_ns, trace_id, {q(N.SPAN_NAME) if corporate else 'name'} as name, 500 as duration_ns, status_code, '' as status_message, '' as trace_state, {q(N.EVENT_NAME) if corporate else "'e'"} as event_name,
       {listed('e', E.SPAN_EVENT)} as event, {listed('r', keys)} as resource, {listed('s', E.SCOPE)} as scope, {listed('a', E.SPAN)} as attributes from done"""


for _profile in PROFILE_VALUES:
    ORACLE[f"prc_logs_{_profile}"] = (
        f"{records(_profile, E.RECORD, 'event_id * 1000 as time_ns', 'time_ns')} select time_ns, 'INFO' as severity, {q(N.LOG_BODY)} as body, "
        f"{listed('r', RESOURCE)} as resource, {listed('s', E.SCOPE)} as scope, {listed('a', E.RECORD)} as attributes from done"
    )
    ORACLE[f"prc_spans_{_profile}"] = spans(_profile)

ORACLE["flt04_evaluation_branch"] = f"{spans('evaluation')} where a_openinference__span__kind is not null and coalesce({E.OPT_OUT}, true) and coalesce({E.HEADER}, 'true') <> 'false'"
ORACLE["map14_typed_values"] = f'select {E.RESOURCE["service.name"]} as service, cast({E.OPT_OUT} as varchar) as flag, {E.HEADER} as header, count(*) as n from events group by all'


# --- hooks and status line ------------------------------------------------------------------------------------------

_HOOKS = "with e as (select *, cast(conv_id * 3600 + turn * 60 as bigint) * 1000000000 as ns from conversations where role in ('user', 'assistant'))"
ORACLE |= {
    "prc04_hook_spans": f"""{_HOOKS}, s as (select *, max(ns) filter (where role = 'user') over (partition by conv_id order by ns) as begin from e)
        select cast(conv_id as varchar) as session_id, 'codex.agent.turn' as name, 'AGENT' as span_kind, cast(null as varchar) as tool_category, 'gpt-5.6-sol' as model, coalesce(begin, ns - 1) as start_ns, ns as end_ns from s where role = 'assistant'
        union all select cast(conv_id as varchar), 'codex.tool.' || c, 'TOOL', c, 'gpt-5.6-sol', ns - 3000000000, ns - 1000000000
        from (select *, case turn % 3 when 0 then 'execution' when 1 then 'editor' else 'connector' end as c from e where role = 'assistant')""",
    "stm02_tool_stream": f"""{_HOOKS}, r as (select *, coalesce(sum(case when role = 'assistant' then 1 else 0 end) over (partition by conv_id order by ns rows between unbounded preceding and 1 preceding), 0) as run from e),
        p as (select *, max(ns) filter (where role = 'user') over (partition by conv_id, run order by ns) as begin from r)
        select cast(conv_id as varchar) as session_id, 'turn' as name, cast(null as varchar) as tool_use_id, coalesce(begin, ns - 1) as start_ns, ns as end_ns from p where role = 'assistant'
        union all select cast(conv_id as varchar), 'tool', 'u' || turn, ns - 3000000000, ns - 1000000000 from e where role = 'assistant'""",
    "flt09_content_sizes": f"""{_HOOKS}
        select 'ai_agent.observed.user_prompt.bytes' as metric, cast(null as varchar) as tool_id, count(*) as n, cast(sum(strlen(text)) as bigint) as bytes from e where role = 'user'
        union all select 'ai_agent.observed.mcp_tool_response.bytes', 'files', count(*), cast(sum(strlen('{{"a":' || length(text) || ',"b":' || turn || '}}')) as bigint) from e where role = 'assistant' and turn % 3 = 2""",
    "prc05_invocations": f"""{_STEPS} select c as conversation_id, case when event = 'Stop' then 'antigravity.agent.execution' else 'antigravity.agent.invocation' end as name, known as model, start_ns,
               greatest(ns, start_ns + 1) as end_ns, (ns - start_ns) // 1000000 as duration_ms, not (event = 'Stop' and bad) as success from s where event in ('PostInvocation', 'Stop')""",
    "prc05_lifecycle_logs": f"""{_STEPS}
        select c as conversation_id, ns as time_ns, case event when 'PreInvocation' then 'antigravity.invocation.started' when 'PostInvocation' then 'antigravity.invocation.completed' when 'PostToolUse' then 'antigravity.tool.completed' else 'antigravity.execution.stopped' end as event_name,
               case when bad then 'ERROR' else 'INFO' end as severity, case event when 'PostToolUse' then 'tool_use' when 'Stop' then 'agent_execution' else 'model_invocation' end as operation,
               case event when 'PreInvocation' then 'pre_invocation' when 'PostInvocation' then 'post_invocation' when 'PostToolUse' then 'post_tool_use' else 'stop' end as stage,
               case event when 'PreInvocation' then 'started' when 'Stop' then case when idle then 'idle' else 'background_active' end else 'completed' end as state,
               case event when 'PostInvocation' then 'success' when 'PostToolUse' then case when bad then 'error' else 'success' end when 'Stop' then coalesce(termination_reason, 'unknown') end as outcome,
               case event when 'PostToolUse' then case when bad then 'tool_error' else 'none' end when 'Stop' then case when bad then 'system_error' else 'none' end end as error_category,
               case when event in ('PostInvocation', 'Stop') then (ns - start_ns) // 1000000 end as duration_ms, case when event <> 'PreInvocation' then not bad end as success,
               case when event in ('PreInvocation', 'PostInvocation') then invocation_num when event = 'Stop' then execution_num end as number, case when event in ('PreInvocation', 'PostInvocation') then coalesce(initial_steps, 0) end as initial_steps,
               case when event = 'PostToolUse' then case operation when 'dancing' then 'other-tool' else operation end end as tool_category, case when event = 'PostToolUse' then coalesce(step_idx, 0) end as step_index,
               case when event = 'Stop' then idle end as fully_idle, known as model
        from s where event <> 'Notification'""",
    "trx11_status_gauges": """
        with s as (
            select *, case when event_id % 3 <> 0 then 'gemini' else 'Gemini/1' end as model, least(100, greatest(0, value - 10)) as used from events
        ), g as (
            select 'antigravity_session_tokens' as metric, model, 'input' as token_type, null as state, null as type, event_id * 3 as v from s
            union all select 'antigravity_session_tokens', model, 'output', null, null, event_id from s
            union all select 'antigravity_context_tokens', model, 'input', null, null, event_id % 1000 from s
            union all select 'antigravity_context_tokens', model, 'output', null, null, user_id % 50 from s
            union all select 'antigravity_context_tokens', model, 'cache_creation', null, null, 0 from s
            union all select 'antigravity_context_tokens', model, 'cache_read', null, null, 7 from s
            union all select 'antigravity_context_used_ratio', model, null, null, null, round(used, 4) / 100.0 from s
            union all select 'antigravity_background_task_count', model, null, event_type, null, greatest(0, event_id % 5 - 2) from s
            union all select 'antigravity_artifact_count', model, null, null, null, 0 from s
            union all select 'antigravity_context_exceeds_200k', model, null, null, null, case when value > 200 then 1 else 0 end from s
            union all select 'antigravity_pending_input_count', model, null, null, null, 0 from s
            union all select 'antigravity_tool_confirmation_pending', model, null, null, null, 0 from s
            union all select 'antigravity_quota_remaining_ratio', model, null, null, 'weekly', least(1, event_id % 4 / 2) from s
        )
        select metric, model as model_family, cast(token_type as varchar) as token_type, cast(state as varchar) as state, cast(type as varchar) as type, round(sum(cast(v as double)), 4) as value, count(*) as n from g group by all""",
    "map18_safe_snapshots": """
        with s as (
            select event_id * 1000 as time_ns, cast(user_id as varchar) as session, case when event_id % 3 <> 0 then 'gemini' else 'Gemini/1' end as model, event_type as agent_state, event_id * 3 as total_input, event_id as total_output,
                   cast(round(least(100, greatest(0, value - 10)), 4) as double) as used_percentage, greatest(0, event_id % 5 - 2) as task_count, value > 200 as exceeds_200k_tokens from events
        ), t as (
            select *, 'AGY ' || model || ' | ' || agent_state || ' | ctx ' || printf('%.1f', round(used_percentage, 1)) || '% | in ' || total_input || ' out ' || total_output as whole from s
        )
        select time_ns, session, model, agent_state, 'unknown' as execution_mode, total_input, used_percentage, task_count, exceeds_200k_tokens, case when length(whole) >= 30 then substr(whole, 1, 28) || '…' else whole end as line from t""",
    "prc06_sent_snapshots": f"""{_SENT}
        select session, time_ns, 'antigravity.status.changed' as event_name, 'INFO' as severity, 'status_update' as operation, 'unknown' as stage, state, 'gemini' as model, user_id * 3 as input_tokens, user_id as output_tokens,
               cast(7 as bigint) as cached_input_tokens, fingerprint from sent""",
    "prc06_sent_gauges": f"""{_SENT}, g as (
            select session, unnest([
                {{'metric': 'antigravity_session_tokens', 'token_type': 'input', 'state': null, 'type': null, 'v': user_id * 3.0}}, {{'metric': 'antigravity_session_tokens', 'token_type': 'output', 'state': null, 'type': null, 'v': user_id * 1.0}},
                {{'metric': 'antigravity_context_tokens', 'token_type': 'input', 'state': null, 'type': null, 'v': 0.0}}, {{'metric': 'antigravity_context_tokens', 'token_type': 'output', 'state': null, 'type': null, 'v': 0.0}},
                {{'metric': 'antigravity_context_tokens', 'token_type': 'cache_creation', 'state': null, 'type': null, 'v': 0.0}}, {{'metric': 'antigravity_context_tokens', 'token_type': 'cache_read', 'state': null, 'type': null, 'v': 7.0}},
                {{'metric': 'antigravity_context_used_ratio', 'token_type': null, 'state': null, 'type': null, 'v': used / 100.0}}, {{'metric': 'antigravity_background_task_count', 'token_type': null, 'state': state, 'type': null, 'v': 0.0}},
                {{'metric': 'antigravity_artifact_count', 'token_type': null, 'state': null, 'type': null, 'v': 0.0}}, {{'metric': 'antigravity_context_exceeds_200k', 'token_type': null, 'state': null, 'type': null, 'v': case when big then 1.0 else 0.0 end}},
                {{'metric': 'antigravity_pending_input_count', 'token_type': null, 'state': null, 'type': null, 'v': 0.0}}, {{'metric': 'antigravity_tool_confirmation_pending', 'token_type': null, 'state': null, 'type': null, 'v': 0.0}},
                {{'metric': 'antigravity_quota_remaining_ratio', 'token_type': null, 'state': null, 'type': 'weekly', 'v': 0.9378}}, {{'metric': 'antigravity_quota_remaining_ratio', 'token_type': null, 'state': null, 'type': 'daily', 'v': case when big then 0.0 else 1.0 end}}
            ]) as p from sent)
        select session, p.metric as metric, p.token_type as token_type, p.state as state, p.type as type, count(*) as n, round(sum(cast(p.v as double)), 4) as value from g group by all""",
}

ORACLE |= {"prc05_hook_stream": ORACLE["prc05_invocations"], "prc05_log_stream": ORACLE["prc05_lifecycle_logs"]}
