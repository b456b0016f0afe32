"""DuckDB SQL for the registered queries, over the same generic tables."""

from __future__ import annotations

from meterlake.functions import text as T
from meterlake.operators import accounting as A
from meterlake.operators import traces
from meterlake.plans import catalog as C
from meterlake.plans import check_oracles, privacy_oracles
from meterlake.plans import queries as Q
from meterlake.plans import views as W

ORACLE: dict[str, str] = {}

LINES = "lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"
NOT_FIXTURE = "not regexp_full_match(coalesce(service_namespace, ''), '.+-fixture')"
LABELS = list(W.TOKEN_LABELS)
NAMES = ", ".join(LABELS)
PX = "ai_agent_provider = 'openai' and ai_agent_product = 'codex'"
AR = "agent_role = 'approval_reviewer'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def exprs(labels: dict[str, str]) -> str:
    return ", ".join(f"{e} as {k}" for k, e in labels.items())


def card(prices: dict, unit: str) -> str:
    rows = ", ".join(f"('openai', {q(m)}, {q(c)}, {q(unit)}, 'v1', 'public-list-price', 'standard', cast({p} as double))" for m, by in prices.items() for c, p in by.items())
    return f"(values {rows}) t(ai_agent_provider, model_id, usage_class, currency, rate_card_version, rate_card_source, pricing_scope, price)"


def part_card(factors: dict[str, float], unit: str) -> str:
    rows = ", ".join(f"({q(c)}, cast({f} as double))" for c, f in factors.items())
    return f"with card as (select 'openai' as ai_agent_provider, p_brand as model_id, usage_class, '{unit}' as currency, 'v1' as rate_card_version, 'public-list-price' as rate_card_source, 'standard' as pricing_scope, min(p_size) * factor as value from part, (values {rows}) f(usage_class, factor) group by p_brand, usage_class, factor)"


_CLASSES = {"input_uncached": 5.0, "input_cached": 0.5, "input_cache_write": 6.25, "output": 30.0}
USD = card({f"Brand#{n}": _CLASSES for n in range(3, 15)}, "USD")
CREDIT = card({f"Brand#{n}": {k: 25 * v for k, v in _CLASSES.items() if k != "input_cache_write"} for n in range(3, 15)}, "credit")

_REQ = ", ".join(f"case when l_returnflag = 'R' then {e} end as {k}" for k, e in W.REQUEST_ONLY.items())
CURRENT = f"""
current as (
    select l_returnflag = 'R' as request, {exprs(W.TOKEN_LABELS)}, {_REQ}, {W.TOKEN_TYPE} as token_type,
           cast(sum(cast(l_quantity as bigint)) as double) as value
    from {LINES} group by all
)"""
_MORE = "skill_id, mcp_server_name, mcp_tool_name"
#: Usage by class from the current values; the one-sided hiding of equal label sets can't occur, as providers differ.
USAGE = f"""
with {CURRENT}, wide as (
    select request, {NAMES}, {_MORE},
           sum(value) filter (where token_type = 'non_cached_input') as explicit, sum(value) filter (where token_type = 'input') as input,
           sum(value) filter (where token_type = 'cached_input') as cached, sum(value) filter (where token_type = 'cache_write_input') as write,
           sum(value) filter (where token_type = 'output') as output
    from current group by request, {NAMES}, {_MORE}
), cells as (
    select *, 'input_uncached' as usage_class,
           case when request then input else coalesce(explicit, case when input is not null then greatest(0, input - coalesce(cached, 0) - coalesce(write, 0)) end) end as value from wide
    union all select *, 'input_cached', cached from wide
    union all select *, 'input_cache_write', write from wide
    union all select *, 'output', output from wide
), usage as (
    select {NAMES}, {_MORE}, usage_class, value, 'v2' as accounting_schema from cells where value is not null
)"""
_OWN = f"own as (select * from usage where {PX})"
_RATE = "using (ai_agent_provider, model_id, usage_class)"
_CARRY = "currency, rate_card_version, rate_card_source, pricing_scope"
ALL = f"{NAMES}, {_MORE}, usage_class, accounting_schema"

ORACLE |= {
    "priced_usage_by_model_and_class": f"{USAGE} select model_id, usage_class, rate_card_version, round(sum(value * (price / 1000000)), 9) as value from usage join {USD} {_RATE} where {NOT_FIXTURE} group by all",
    "rr01_price_card": f"{part_card(W.CLASS_FACTORS, 'USD')} select * from card",
    "rr02_credit_card": f"{part_card(W.CREDIT_FACTORS, 'credit')} select * from card",
    "rr03_rr06_token_usage": f"{USAGE} select {ALL}, value from usage",
    "rr07_estimated_cost": f"{USAGE} select {ALL}, {_CARRY}, round(value * (price / 1000000), 9) as value, 'estimated_api_list_price' as cost_source from usage join {USD} {_RATE}",
    "rr08_estimated_credits": f"{USAGE}, {_OWN} select {ALL}, {_CARRY}, round(value * (price / 1000000), 9) as value, 'estimated_public_codex_rate_card' as credit_source from own join {CREDIT} {_RATE}",
    "rr09_unpriced_usage": f"{USAGE} select {ALL}, value, 'api_usd' as estimate_scope from usage anti join {USD} {_RATE}",
    "rr10_unpriced_credit_usage": f"{USAGE}, {_OWN} select {ALL}, value, 'codex_credits' as estimate_scope from own anti join {CREDIT} {_RATE}",
    "cu03_priced_coverage": f"{USAGE} select round(sum(value) filter (where price is not null) / sum(value), 6) as value from usage left join {USD} {_RATE} where {PX} and {NOT_FIXTURE}",
    "cu04_cache_ratio": f"{USAGE} select round(sum(value) filter (where usage_class = 'input_cached') / sum(value), 6) as value from usage where {PX} and {NOT_FIXTURE} and usage_class like 'input_%'",
    "un05_priced_coverage": f"{USAGE} select round(sum(value) filter (where price is not null) / sum(value), 6) as value from usage left join {USD} {_RATE} where {NOT_FIXTURE}",
    "un06_cache_ratio": f"{USAGE} select round(sum(value) filter (where usage_class = 'input_cached') / sum(value), 6) as value from usage where {NOT_FIXTURE} and usage_class like 'input_%'",
    "cu08_prices": f"{part_card(W.CLASS_FACTORS, 'USD')} select * exclude (ai_agent_provider) from card",
    "ar12_unpriced_api": f"{USAGE} select model_id, usage_class, sum(value) as value from usage anti join {USD} {_RATE} where {PX} and {AR} and {NOT_FIXTURE} group by all",
    "ar13_unpriced_credits": f"{USAGE}, {_OWN} select model_id, usage_class, sum(value) as value from own anti join {CREDIT} {_RATE} where {AR} and {NOT_FIXTURE} group by all",
    "un08_unpriced_credits": f"{USAGE}, {_OWN} select model_id, usage_class, sum(value) as value from own anti join {CREDIT} {_RATE} where {NOT_FIXTURE} group by all",
}

ORACLE["src20_rule_files"] = f"""{USAGE}
    select 'ai_agent_token_usage_total' as rule, {ALL}, value from usage
    union all select 'ai_agent_estimated_cost_usd_total', {ALL}, round(value * (price / 1000000), 9) from usage join {USD} {_RATE}
    union all select 'ai_agent_unpriced_api_token_usage_total', {ALL}, value from usage anti join {USD} {_RATE}"""

RECORDED = f"""
daily as (
    select {exprs(W.TOKEN_LABELS)}, {W.USAGE_CLASS} as usage_class, o_orderdate as ts, sum(cast(l_quantity as bigint)) as t, count(*) as c
    from {LINES} group by all
), recorded as (
    select {NAMES}, usage_class, ts, cast(sum(t) over w as double) as value, cast(sum(c) over w as double) as turns
    from daily window w as (partition by {NAMES}, usage_class order by ts)
)"""
_ORDERS_IN = f"ts > timestamp '{W.ORDERS_END}' - interval '{W.ORDERS_RANGE}' and ts <= timestamp '{W.ORDERS_END}'"
_ORDERS, _EVENTS = (W.ORDERS_END, W.ORDERS_RANGE), (W.EVENTS_END, W.EVENTS_RANGE)
_EVENTS_IN = f"ts > timestamp '{W.EVENTS_END}' - interval '{W.EVENTS_RANGE}' and ts <= timestamp '{W.EVENTS_END}'"


def stretched(value: str, begin: str, end: str) -> str:
    """``value`` that grew between the samples ``first`` and ``last`` of ``n``, stretched to the range from ``begin`` to ``end``."""
    seconds = lambda a, b: f"((epoch_us({b}) - epoch_us({a})) / 1e6)"
    sampled = seconds("first", "last")
    near = lambda gap: f"case when {gap} < {sampled} / (n - 1) * 1.1 then {gap} else {sampled} / (n - 1) / 2 end"
    zero = f"case when {value} > 0 and begin >= 0 then {sampled} * (begin / {value}) end"
    return f"case when {sampled} > 0 then {value} * (({sampled} + least({near(seconds(begin, 'first'))}, {zero}) + {near(seconds('last', end))}) / {sampled}) else {value} end"


_GROWTH = "cast(sum(case when v < before then v else v - before end) as double) as grew, count(*) as n, min(ts) as first, max(ts) as last, min_by(v, ts) as begin"


def grown(source: str, series: str, span: tuple[str, str], value: str = "value", name: str = "grown") -> str:
    """CTE of the growth of each series of ``source`` within (end - length, end], corrected for restarts and stretched."""
    end, length = f"timestamp '{span[0]}'", f"interval '{span[1]}'"
    by = f"partition by {series} order by ts" if series else "order by ts"
    group = f"group by {series}" if series else ""
    head = f"{series}, " if series else ""
    return f"""
{name}_steps as (
    select {head}ts, {value} as v, lag({value}) over ({by}) as before from {source} where ts > {end} - {length} and ts <= {end}
), {name}_ranges as (
    select {head}{_GROWTH} from {name}_steps {group} having count(*) > 1
), {name} as (
    select {head}{stretched('grew', f'({end} - {length})', end)} as value from {name}_ranges
)"""


_SERIES = f"{NAMES}, usage_class"
_GROWN = f"with {RECORDED}, {grown('recorded', _SERIES, _ORDERS)}"
_COST = f"priced as (select {_SERIES}, rate_card_version, ts, value * (price / 1000000) as value from recorded join {USD} {_RATE})"
_CREDITS = f"priced as (select {_SERIES}, rate_card_version, ts, value * (price / 1000000) as value from recorded join {CREDIT} {_RATE} where {PX})"
_PRICED = f"{_SERIES}, rate_card_version"
_TURNS = f"turns as (select {_SERIES}, ts, turns as value from recorded where usage_class = 'output')"
_ALL_TURNS = f"turns as (select {NAMES}, usage_class, ts, turns as value from recorded where usage_class = 'output')"


def some(select: str) -> str:
    """One row, or none where nothing was summed."""
    return f"select value from ({select}) where value is not null"


ORACLE |= {
    "cu01_usage": f"with {RECORDED}, last as (select {_SERIES}, max_by(value, ts) as value from recorded where ts > timestamp '{W.ORDERS_END}' - interval '3650 days' and ts <= timestamp '{W.ORDERS_END}' group by all) {some(f'select round(sum(value), 6) as value from last where {PX} and {NOT_FIXTURE}')}",
    "ar03_usage": f"{_GROWN} {some(f'select round(sum(value), 6) as value from grown where {PX} and {AR} and {NOT_FIXTURE}')}",
    "ar10_usage": f"{_GROWN} select model_id, usage_class, round(sum(value), 6) as value from grown where {PX} and {AR} and {NOT_FIXTURE} group by all",
    "un02_usage": f"{_GROWN} {some(f'select round(sum(value), 6) as value from grown where {NOT_FIXTURE}')}",
    "cu02_cost": f"with {RECORDED}, {_COST}, {grown('priced', _PRICED, _ORDERS)} {some(f'select round(sum(value), 6) as value from grown where {PX} and {NOT_FIXTURE}')}",
    "cu06_cost": f"with {RECORDED}, {_COST}, {grown('priced', _PRICED, _ORDERS)} select model_id, usage_class, rate_card_version, round(sum(value), 6) as value from grown where {PX} and {NOT_FIXTURE} group by all",
    "ar05_cost": f"with {RECORDED}, {_COST}, {grown('priced', _PRICED, _ORDERS)} {some(f'select round(sum(value), 6) as value from grown where {PX} and {AR} and {NOT_FIXTURE}')}",
    "un03_cost": f"with {RECORDED}, {_COST}, {grown('priced', _PRICED, _ORDERS)} {some(f'select round(sum(value), 6) as value from grown where {NOT_FIXTURE}')}",
    "ar06_credits": f"with {RECORDED}, {_CREDITS}, {grown('priced', _PRICED, _ORDERS)} {some(f'select round(sum(value), 6) as value from grown where {AR} and {NOT_FIXTURE}')}",
    "un07_credits": f"with {RECORDED}, {_CREDITS}, {grown('priced', _PRICED, _ORDERS)} {some(f'select round(sum(value), 6) as value from grown where {NOT_FIXTURE}')}",
    "ar02_reviews": f"with {RECORDED}, {_TURNS}, {grown('turns', _SERIES, _ORDERS)} {some(f'select cast(floor(sum(value) + 0.5) as double) as value from grown where {PX} and {AR} and {NOT_FIXTURE}')}",
    "un04_reviews": f"with {RECORDED}, {_ALL_TURNS}, {grown('turns', _SERIES, _ORDERS)} {some(f'select cast(floor(sum(value) + 0.5) as double) as value from grown where {NOT_FIXTURE}')}",
    "cu07_unpriced_last": f"with {RECORDED}, last as (select {_SERIES}, max_by(value, ts) as value from recorded where {_ORDERS_IN} and {PX} and {NOT_FIXTURE} group by {_SERIES}) select model_id, usage_class, sum(value) as value from last anti join {USD} {_RATE} group by all",
    "ar01_freshness": f"with {RECORDED} {some(f'''select cast(epoch(timestamp '2001-08-02 00:00:00' - max(ts)) as double) as value from recorded where usage_class = 'output' and {PX} and {AR} and {NOT_FIXTURE}''')}",
    "un01_freshness": f"with {RECORDED} {some(f'''select cast(epoch(timestamp '2001-08-02 00:00:00' - max(ts)) as double) as value from recorded where {NOT_FIXTURE}''')}",
    "ar04_reviewer_share": f"{_GROWN} select round(sum(value) filter (where {AR}) / greatest(sum(value), 1), 6) as value from grown where {PX} and {NOT_FIXTURE}",
    "ar07_tokens_per_review": f"with {RECORDED}, {_TURNS}, {grown('recorded', _SERIES, _ORDERS)}, {grown('turns', _SERIES, _ORDERS, name='reviewed')} select round((select sum(value) from grown where {PX} and {AR} and {NOT_FIXTURE}) / greatest((select floor(sum(value) + 0.5) from reviewed where {PX} and {AR} and {NOT_FIXTURE}), 1), 6) as value",
    "ar08_reviewer_cached_ratio": f"{_GROWN} select round(sum(value) filter (where usage_class = 'input_cached') / greatest(sum(value), 1), 6) as value from grown where {PX} and {AR} and {NOT_FIXTURE}",
    "ar09_exact_model_coverage": f"{_GROWN} select round(sum(value) filter (where model_id <> 'unmapped') / greatest(sum(value), 1), 6) as value from grown where {PX} and {AR} and {NOT_FIXTURE}",
    "cu19_model_values": f"with {RECORDED} select distinct model_id as value from recorded",
    "src12_series": f"with {RECORDED} select distinct {_SERIES} from recorded",
    "trx08_running_total": f"with {RECORDED} select model_id, usage_class, max(value) as value, count(*) as samples from recorded group by all",
}


def grid(source: str, series: str, start: str, end: str, step: str, scale: str = "value") -> str:
    """Growth in each step; ``ts`` is the step's end."""
    s = f"{series}, " if series else ""
    return f"""
cells as (
    select {s}value, ts, timestamp '{start}' + interval '{step}' * (cast((epoch_us(ts) - epoch_us(timestamp '{start}') - 1) // cast(epoch(interval '{step}') * 1000000 as bigint) as bigint) + 1) as step_end
    from {source} where ts > timestamp '{start}' and ts <= timestamp '{end}'
), cell_steps as (
    select {s}step_end, ts, value as v, lag(value) over (partition by {s}step_end order by ts) as before from cells
), cell_ranges as (
    select {s}step_end, {_GROWTH} from cell_steps group by {s}step_end having count(*) > 1
), grid as (
    select {s}step_end as ts, {stretched('grew', f"(step_end - interval '{step}')", 'step_end')} as value from cell_ranges
)"""


ORACLE["ar11_token_rate_grid"] = (
    f"with {RECORDED}, {grid('recorded', _SERIES, W.ORDERS_START, W.ORDERS_END, '73 days')} select usage_class, ts, round(sum(value) / epoch(interval '73 days'), 6) as value from grid where {PX} and {AR} and {NOT_FIXTURE} group by all"
)


def counter(labels: dict[str, str], inc: str = "1", where: str = "true", name: str = "samples") -> str:
    by = ", ".join(labels)
    return f"""
{name}_rows as (select ts, event_id, {exprs(labels)}, cast({inc} as bigint) as inc from events where {where}
), {name} as (
    select {by}, ts, cast(sum(inc) over (partition by {by} order by ts, event_id) % {W.RESET} as double) as value from {name}_rows
)"""


def int_inc(inc: str) -> str:
    """Spark truncates a double that becomes a whole number; DuckDB rounds it."""
    return f"trunc({inc})" if "value" in inc else inc


for _name, (_labels, _inc, _where) in Q.COUNTERS.items():
    p = C.PANELS[_name]
    conditions = [NOT_FIXTURE] if "service_namespace" in _labels else []
    conditions += [f"{k} <> {q(v)}" for k, v in p.ne.items()]
    where = f" where {' and '.join(conditions)}" if conditions else ""
    scale = f" / epoch(interval '{W.EVENTS_RANGE}')" if p.shape == "rate" else ""
    head = ", ".join(p.by)
    body = f"select {head}, round(sum(value){scale}, 6) as value from grown{where} group by all" if p.by else some(f"select round(sum(value){scale}, 6) as value from grown{where}")
    ORACLE[f"{_name}_{p.shape}"] = f"with {counter(_labels, int_inc(_inc), _where)}, {grown('samples', ', '.join(_labels), _EVENTS)} {body}"

_BY_TYPE = f"with {counter(Q.BY_TYPE, int_inc('value'))}"
_HIST_LABELS = "model"
_LES = ", ".join([f"({q(str(b))}, {b})" for b in W.BOUNDS] + ["('+Inf', 'infinity'::double)"])
_BUCKETS = f"""
bucket_samples as (
    select model, le, ts, cast(sum(hit) over (partition by model, le order by ts, event_id) as double) as value
    from (select event_type as model, event_id, ts, le, case when value <= bound then 1 else 0 end as hit from events, (values {_LES}) b(le, bound))
)"""
_P95 = f"""
with {_BUCKETS}, {grown('bucket_samples', 'model, le', _EVENTS)}, cum as (
    select model, case when le = '+Inf' then 'infinity'::double else cast(le as double) end as bound, sum(value) / epoch(interval '{W.EVENTS_RANGE}') as total from grown group by all
), ranked as (
    select *, 0.95 * max(total) over (partition by model) as rank, coalesce(lag(total) over (partition by model order by bound), 0) as below,
           coalesce(lag(bound) over (partition by model order by bound), 0) as low from cum
), hit as (
    select model, arg_min(bound, bound) as bound, arg_min(total, bound) as total, arg_min(below, bound) as below, arg_min(low, bound) as low, arg_min(rank, bound) as rank
    from ranked where total >= rank group by model
)
select model, round(case when isinf(bound) then low else low + (bound - low) * ((rank - below) / (total - below)) end, 6) as value from hit"""
for _name in ("cu09", "cu10", "cu14", "cu15"):
    ORACLE[f"{_name}_p95"] = _P95

for _name, (_labels, _value) in Q.GAUGES.items():
    p = C.PANELS[_name]
    fold = "min" if p.shape == "min" else "max"
    by = ", ".join(p.by)
    conditions = [f"regexp_full_match({k}, {q(v)})" for k, v in p.re.items()]
    where = f" where {' and '.join(conditions)}" if conditions else ""
    last = f"last as (select {', '.join(_labels)}, max_by(value, ts) as value from rows where ts > timestamp '{W.EVENTS_END}' - interval '{Q.GAUGE_LOOKBACK}' and ts <= timestamp '{W.EVENTS_END}' group by {', '.join(_labels)})"
    body = f"select {by}, round({fold}(value) * {p.scale}, 6) as value from last{where} group by all" if p.by else some(f"select round({fold}(value) * {p.scale}, 6) as value from last{where}")
    ORACLE[f"{_name}_gauge"] = f"with rows as (select {exprs(_labels)}, ts, cast({_value} as double) as value from events), {last} {body}"

_FAILED_CTES = ", ".join(f"{counter({'exporter': 'event_type'}, '1', w, f's{n}')}, {grown(f's{n}', 'exporter', _EVENTS, name=f'g{n}')}" for n, w in enumerate(Q.FAILED.values()))
ORACLE |= {
    "ca06_compaction_grid": f"with {counter(Q.COMPACTION)}, {grid('samples', 'ai_agent_product', W.EVENTS_START, W.EVENTS_END, '1 day')} select ai_agent_product, ts, round(value, 6) as value from grid",
    "ch05_failed_sends": f"with {_FAILED_CTES}, picked as (select * from g0 union all select * from g1 where exporter not in (select exporter from g0)), every as (select * from picked union all select * from g2 where exporter not in (select exporter from picked)) select exporter, round(value / epoch(interval '{W.EVENTS_RANGE}'), 6) as value from every",
    "tsf01_increase": f"{_BY_TYPE}, {grown('samples', 'event_type', _EVENTS)} select event_type, round(value, 6) as value from grown",
    "tsf02_rate": f"{_BY_TYPE}, {grown('samples', 'event_type', _EVENTS)} select event_type, round(value / epoch(interval '{W.EVENTS_RANGE}'), 6) as value from grown",
    "agg09_last_over_time": f"{_BY_TYPE} select event_type, max_by(value, ts) as value from samples where {_EVENTS_IN} group by all",
    "agg10_max_over_time": f"{_BY_TYPE} select event_type, max(value) as value from samples where {_EVENTS_IN} group by all",
    "src10_instant": f"{_BY_TYPE} select event_type, max_by(value, ts) as value from samples where ts > timestamp '{W.EVENTS_END}' - interval '6 hours' and ts <= timestamp '{W.EVENTS_END}' group by all",
    "tsf02_increase_grid": f"{_BY_TYPE}, {grid('samples', 'event_type', W.EVENTS_START, W.EVENTS_END, '12 hours')} select event_type, ts, round(value, 6) as value from grid",
    "tsf02_overlapping_grid": f"""{_BY_TYPE}, ends as (
            select timestamp '{W.EVENTS_START}' + interval '12 hours' * k as e from range(1, 41) t(k)
        ), inside as (
            select event_type, e, ts, value as v, lag(value) over (partition by event_type, e order by ts) as before from samples join ends on ts > e - interval '2 days' and ts <= e
        ), ranges as (
            select event_type, e, {_GROWTH} from inside group by event_type, e having count(*) > 1
        )
        select event_type, e as ts, round({stretched('grew', "(e - interval '2 days')", 'e')}, 6) as value from ranges""",
    "tsf11_not_expired": f"select cast(user_id as varchar) as \"user\", count(*) as n from events where ts <= timestamp '{W.EVENTS_END}' group by 1 having max(ts) >= timestamp '{W.EVENTS_END}' - interval '6 hours'",
    "trx07_histogram_buckets": f"with {_BUCKETS} select model, le, max(value) as value from bucket_samples group by all",
}

_SIDE = "select case when c_nationkey % 5 <> 0 then cast(c_nationkey as varchar) end as nation, c_mktsegment as segment, cast(count(*) as double) as value from customer where {w} group by all"
_SIDES = f"""with l as ({_SIDE.format(w='c_acctbal >= 0')}), r as ({_SIDE.format(w="c_mktsegment <> 'BUILDING' or c_acctbal < -500")})"""
_SAME = "coalesce(l.nation, '') = coalesce(r.nation, '') and l.segment = r.segment"
ORACLE |= {
    "set01_or": f"{_SIDES} select * from l union all select * from r where not exists (select 1 from l where {_SAME})",
    "set02_unless": f"{_SIDES} select * from l where not exists (select 1 from r where {_SAME})",
    "set03_and": f"{_SIDES} select * from l where exists (select 1 from r where {_SAME})",
    "join05_subtract": f"{_SIDES} select l.nation, l.segment, l.value - r.value as value from l join r on {_SAME}",
    "join01_group_left": f"{_SIDES}, one as (select segment, sum(value) as value from r group by all) select l.nation, l.segment, 'v1' as version, l.value * one.value as value from l join one using (segment)",
    "join12_reconcile": "with a as (select l_returnflag, cast(sum(cast(l_quantity as bigint)) as double) as v from lineitem group by all), b as (select l_returnflag, cast(sum(cast(l_quantity as bigint)) as double) as v from lineitem where l_returnflag <> 'A' or l_linenumber < 7 group by all) select l_returnflag, a.v as left_value, b.v as right_value from a full join b using (l_returnflag) where a.v is null or b.v is null or abs(a.v - b.v) > 1e-6",
    "agg16_missing_values": "with s as (select distinct event_type as e from events), w as (select unnest(['click', 'error', 'purchase', 'refund']) as e) select coalesce((select string_agg(e, ',' order by e) from w where e not in (select e from s)), '') as missing, coalesce((select string_agg(e, ',' order by e) from s where e not in (select e from w)), '') as unexpected",
    "agg04_agg05_max_min": "select event_type, max(value) as value, min(value) as least from events group by all",
}

_LOGS = f"with logs as (select {exprs(W.LOG_COLUMNS)} from events)"
_SERVICE = f"regexp_full_match(service_name, {q(Q.SERVICES)})"
_WINDOW = f"ts > timestamp '{W.EVENTS_START}' and ts <= timestamp '{W.EVENTS_END}'"


def counted(test: str) -> str:
    return f"{_LOGS} select count(*) as value from logs where {_SERVICE} and {test} and {_EVENTS_IN} having count(*) > 0"


def listed(test: str) -> str:
    return f"{_LOGS} select event_id, service_name, event_name, success, trace_id from logs where {_SERVICE} and {test} and {_WINDOW} order by ts desc, event_id desc limit 100"


ORACLE |= {
    "ac01_named_events": counted("coalesce(event_name, '') <> ''"),
    "ac02_user_prompts": counted("event_name = 'codex.user_prompt'"),
    "ac03_tool_decisions": counted("event_name = 'codex.tool_decision'"),
    "ac04_failed_tool_results": counted("event_name = 'codex.tool_result' and success = 'false'"),
    "ac05_api_requests": counted("event_name = 'codex.api_request'"),
    "ac06_sandbox_outcomes": counted("event_name = 'codex.sandbox_outcome'"),
    "ac07_events_over_time": f"{_LOGS} select event_name, cast(date_trunc('day', ts) as timestamp) as ts, count(*) as value from logs where {_SERVICE} and event_name is not null and ts >= timestamp '{W.EVENTS_START}' and ts < timestamp '{W.EVENTS_END}' group by 1, 2",
    "ac09_prompt_events": listed("event_name = 'codex.user_prompt'"),
    "ac10_failed_events": listed("success = 'false'"),
    "ac11_trace_linked_events": listed("trace_id is not null"),
    "src14_newest_logs": listed("true"),
    "ac12_service_values": f"{_LOGS} select distinct service_name as value from logs",
    "ag10_lifecycle_logs": f"{_LOGS} select event_id, event_name from logs where regexp_full_match(service_name, 'svc(-cli|1)?') and {NOT_FIXTURE} and {_WINDOW} order by ts desc, event_id desc limit 100",
    "flt02_choice": f"{_LOGS} select service_name, count(*) as n from logs where service_name in ('svc0', 'svc2') group by all",
    "flt10_recent_logs": f"{_LOGS} select event_name, count(*) as n from logs where ts >= timestamp '{W.EVENTS_END}' - interval '336 hours' group by all",
    "join08_trace_id_in_line": f"{_LOGS}, lines as (select event_id, concat_ws(' ', 'handled', case when event_id % 2 = 0 then 'traceid=' || trace_id else 'trace_id: ' || upper(trace_id) end) as line from logs) select event_id, nullif(lower(regexp_extract(line, {q(traces.DERIVED_TRACE_ID)}, 1)), '') as trace_id from lines where regexp_matches(line, {q(traces.DERIVED_TRACE_ID)})",
    "join09_logs_of_spans": f"{_LOGS}, s as (select trace_id, min(ts) as first from logs where trace_id is not null group by all) select event_id, trace_id, trace_id as span_id from logs join s using (trace_id) where ts >= first + interval '1 day' - interval '1 minute' and ts <= first + interval '9 days' + interval '1 minute'",
}

_SPANS = """
with lines as (
    select l_orderkey, l_linenumber, min(l_shipdate) as ship, min(l_returnflag) as flag, min(l_suppkey) as supp from lineitem group by all
), spans as materialized (
    select cast(o_orderkey as varchar) as trace_id, cast(o_orderkey as varchar) as span_id, cast(null as varchar) as parent_span_id, 'order ' || o_orderstatus as name,
           epoch_us(o_orderdate) * 1000 as start_ns, epoch_us(o_orderdate + interval '90 days') * 1000 as end_ns,
           case o_orderstatus when 'F' then 1 when 'P' then 2 else 0 end as status_code, cast(null as boolean) as success, o_orderpriority as service_name
    from orders
    union all
    select cast(o_orderkey as varchar), concat_ws('-', cast(o_orderkey as varchar), cast(l_linenumber as varchar)), cast(o_orderkey as varchar), 'line ' || flag,
           epoch_us(greatest(ship, o_orderdate)) * 1000, epoch_us(greatest(ship, o_orderdate) + interval '1 day' * (supp % 9 + 1)) * 1000,
           case when flag = 'R' then 2 else 0 end, supp % 4 <> 0, o_orderpriority
    from lines join orders on l_orderkey = o_orderkey
), kids as materialized (
    select s.*, r.start_ns as root_start, r.end_ns as root_end from spans s join spans r on s.trace_id = r.trace_id and s.parent_span_id = r.span_id and r.parent_span_id is null
)"""
ORACLE |= {
    "ac08_latest_traces": f"{_SPANS} select trace_id, max(name) filter (where parent_span_id is null) as root_name, min(start_ns) as start_ns, max(end_ns) - min(start_ns) as duration_ns from spans where start_ns >= {W.TRACES_START_NS} and start_ns < {W.TRACES_END_NS} group by trace_id having bool_or(service_name in ('1-URGENT', '2-HIGH')) order by start_ns desc, trace_id limit 50",
    "src17_evaluation_spans_by_trace": f"{_SPANS} select span_id, name, start_ns from spans where trace_id = '32' and success is not null order by start_ns, span_id limit 100",
    "src15_trace_by_id": f"{_SPANS} select span_id, parent_span_id, name, start_ns, end_ns from spans where trace_id = '32'",
    "join10_parents": f"{_SPANS} select s.name, p.name as parent_name, count(*) as n from spans s left join spans p on s.trace_id = p.trace_id and s.parent_span_id = p.span_id group by all",
    "ta01_trace_table": f"{_SPANS} select trace_id, min(start_ns) as start_ns, max(name) filter (where parent_span_id is null) as root_name, max(end_ns - start_ns) filter (where parent_span_id is null) as duration_ns, max(status_code) filter (where parent_span_id is null) as status_code, count(*) as span_count from spans group by trace_id",
    "ta02_longest_child": f"{_SPANS} select trace_id, name, duration_ns from (select trace_id, name, end_ns - start_ns as duration_ns, row_number() over (partition by trace_id order by end_ns - start_ns desc, span_id) as k from kids) where k = 1",
    "ta03_repeated_siblings": f"{_SPANS} select trace_id, parent_span_id, name, count(*) as n from spans where parent_span_id is not null group by all having count(*) > 1",
    "ta04_error_spans": """
        with lines as (select l_orderkey, l_linenumber, min(l_shipdate) as ship, min(l_returnflag) as flag, min(l_suppkey) as supp from lineitem group by l_orderkey, l_linenumber)
        select cast(o_orderkey as varchar) as trace_id, cast(o_orderkey as varchar) as span_id, 'order P' as name, false as parent_continued from orders where o_orderstatus = 'P'
        union all
        select cast(o_orderkey as varchar), concat_ws('-', cast(o_orderkey as varchar), cast(l_linenumber as varchar)), 'line ' || flag, o_orderdate + interval '90 days' > greatest(ship, o_orderdate) + interval '1 day' * (supp % 9 + 1)
        from lines join orders on l_orderkey = o_orderkey where flag = 'R' or supp % 4 = 0""",
    "ta05_ta06_coverage": f"{_SPANS}, cut as (select trace_id, span_id, root_start, root_end, greatest(start_ns, root_start) as a, least(end_ns, root_end) as b from kids), seen as (select *, coalesce(max(b) over (partition by trace_id order by a, span_id rows between unbounded preceding and 1 preceding), root_start) as s from cut where b > a), per as (select trace_id, root_start, root_end, cast(sum(greatest(0, b - greatest(a, s))) as bigint) as covered_ns, cast(sum(b - a) as bigint) as summed_ns from seen group by all) select trace_id, root_end - root_start as root_ns, covered_ns, summed_ns, root_end - root_start - covered_ns as gap_ns, summed_ns > covered_ns as overlapping from per",
    "ta07_status": f"{_SPANS} select case status_code when 1 then 'ok' when 2 then 'error' else 'unset' end as status, count(*) as n from spans group by all",
    "tsf09_durations": f"{_SPANS} select name, cast(sum(greatest(0, (end_ns - start_ns) // 1000000)) as bigint) as ms from spans group by all",
}

_PROMPTS = "with e as (select conv_id, turn, role, text, cast(conv_id * 3600 + turn * 60 as bigint) * 1000000000 as ns from conversations where role in ('user', 'assistant'))"
ORACLE |= {
    "prc04_turn_spans": f"{_PROMPTS}, s as (select *, max(ns) filter (where role = 'user') over (partition by conv_id order by ns) as begin from e) select cast(conv_id as varchar) as session_id, 'codex.agent.turn' as name, 'AGENT' as span_kind, coalesce(begin, ns - 1) as start_ns, ns as end_ns from s where role = 'assistant'",
    "str08_prompt_sizes": f"{_PROMPTS}, hot as (select len(list_filter([256, 1024, 4096, 16384, 65536, 262144], lambda b: b < strlen(text))) as bucket from e where role = 'user') select cast(b as integer) as bucket, (select count(*) from hot where bucket = b) as value from range(7) t(b)",
    "tsf10_change_or_heartbeat": """
        with recursive e as (
            select cast(user_id as varchar) as session, case when value > 15 then 'high' else 'low' end as fingerprint, epoch_us(ts) * 1000 as time_ns,
                   row_number() over (partition by user_id order by ts) as k
            from events
        ), walk as (
            select session, fingerprint, time_ns, k, time_ns as last, true as sent from e where k = 1
            union all
            select e.session, e.fingerprint, e.time_ns, e.k,
                   case when e.fingerprint <> w.fingerprint or e.time_ns - w.last >= 86400000000000 then e.time_ns else w.last end,
                   e.fingerprint <> w.fingerprint or e.time_ns - w.last >= 86400000000000
            from walk w join e on e.session = w.session and e.k = w.k + 1
        )
        select session, fingerprint, time_ns from walk where sent""",
}

_KEYS = "[" + ", ".join(map(q, Q.TRIED_KEYS)) + "]"
for _name, (_, (_kind, _what)) in Q.BAG_QUERIES.items():
    inside = "[" + ", ".join(map(q, _what)) + "]" if _kind != "pattern" else ""
    test = {"pattern": f"not regexp_matches(k, {q(_what)})" if _kind == "pattern" else "", "drop": f"not list_contains({inside}, k)", "keep": f"list_contains({inside}, k)"}[_kind]
    ORACLE[_name] = f"select event_id, array_to_string(list_sort(list_filter(list_filter({_KEYS}, lambda k, i: (i - 1) % 3 = event_id % 3), lambda k: {test})), ',') as keys from events"

ORACLE |= {
    "str01_str02_safe_text": f"select page_id, case when trim(url) = '' then 'unknown' else substr(regexp_replace(trim(url), {q(T.STATUS_TEXT)}, '_', 'g'), 1, 160) end as status_text, case when trim(url) = '' then 'unknown' else substr(regexp_replace(trim(url), {q(T.HOOK_TEXT)}, '_', 'g'), 1, 80) end as hook_text from pages",
    "str04_sha256": "select page_id, sha256(url) as digest, substr(sha256('trace:' || url || ':t'), 1, 32) as trace_id, substr(sha256('span:' || url || ':t'), 1, 16) as span_id from pages",
    "str08_utf8_size": "select conv_id, turn, cast(strlen(text) as bigint) as bytes from conversations",
    "str09_canonical_json": "select event_id, cast(json(props) as varchar) as json from events",
    "str12_url_base": "select page_id, case page_id % 3 when 2 then 'http://localhost:4318/v1/other' else 'http://localhost:4318' end as base from pages",
    "trx09_one_hot": "with hot as (select len(list_filter([50, 100, 200, 400], lambda b: b < value)) as bucket from events) select cast(b as integer) as bucket, (select count(*) from hot where bucket = b) as n from range(5) t(b)",
    "trx12_clamp": "select event_type, cast(sum(least(10000, greatest(500, cast(trunc(value * 100) as bigint)))) as double) as value from events group by all",
    "cnd01_tool_category": "select case event_id % 6 when 0 then 'execution' when 1 then 'editor' when 2 then 'agent-collaboration' when 3 then 'agent-collaboration' when 4 then 'connector' else 'other' end as category, count(*) as n from events group by all",
    "cnd04_thresholds": "select case when value >= 200 then 'bad' when value >= 50 then 'warn' else 'good' end as state, count(*) as n from events group by all",
    "chk01_sentinels": "select doc_id from documents where contains(text, '@mail') or contains(text, 'Apache License')",
    "chk13_duplicate_keys": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
    "agg17_cardinality": "select count(distinct p_brand) as found, 12 as expected from part having count(distinct p_brand) <> 12",
    "chk11_domains": "with v as (select doc_id, concat_ws(',', case when lang is not null and lang not in ('en', 'fr') then 'lang' end, case when source is not null and source not in ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') then 'source' end, case when lang is null then 'lang missing' end) as violations from documents) select * from v where violations <> ''",
    "join13_annotation_diff": "with w as (select doc_id, cast(quality as double) as score from labels where quality = 1 or toxic = 0), h as (select doc_id, case when toxic = 1 then 0.5 else cast(quality as double) end as score from labels where quality = 1 or toxic = 1) select coalesce(w.doc_id, h.doc_id) as doc_id, case when h.doc_id is null then 'missing' when w.doc_id is null then 'not_assigned' else 'drifted' end as state from w full join h on w.doc_id = h.doc_id where h.doc_id is null or w.doc_id is null or w.score <> h.score",
    "chk16_repeats_within": "select event_id, user_id, event_type from (select *, lag(ts) over (partition by user_id, event_type order by ts) as previous from events) where ts - previous <= interval '1 hour'",
}

_STREAM_TURNS = "with e as (select concat_ws('/', cast(conv_id as varchar), cast(turn // 2 as varchar)) as session_id, role, cast(conv_id * 3600 + turn * 60 as bigint) as t from conversations where role in ('user', 'assistant')), s as (select *, sum(case when role = 'assistant' then 1 else 0 end) over (partition by session_id order by t rows between unbounded preceding and 1 preceding) as run from e), p as (select *, max(t) filter (where role = 'user') over (partition by session_id, coalesce(run, 0) order by t) as begin from s)"
ORACLE |= {
    "snk07_check_report": "with r as (select 'duplicate line numbers' as name, count(*) as failures from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1) union all select 'duplicate parts', count(*) from (select 1 from part group by p_partkey having count(*) > 1) union all select 'languages', count(*) from documents where lang not in ('en', 'fr', 'de', 'es')) select name, failures, failures = 0 as passed from r",
    "snk09_feedback_bundle": """select '{"schema_version":"1.0","environment_profile":"corporate-redacted","framework_version":"1.0","metrics":{' || string_agg('"' || name || '":' || n, ',' order by name) || '}}' as bundle from (select event_type as name, count(*) as n from events group by all)""",
    "set04_additive_copy": "with m as (select case event_id % 3 when 0 then 'codex.tool.call' when 1 then 'codex.mcp.call' else 'other.metric' end as metric from events) select metric, count(*) as n from (select metric from m union all select case metric when 'codex.tool.call' then 'ai_agent.tool.call' else 'ai_agent.mcp.call' end from m where metric <> 'other.metric') group by all",
    "trx05_safe_names": "select page_id, regexp_replace(url, '[^a-zA-Z0-9_:]', '_', 'g') as name from pages",
    "stm09_running_totals": "select event_type, cast(sum(cast(trunc(value * 100) as bigint)) as bigint) as total, count(*) as n from events group by all",
    "stm07_rules_by_batch": f"""
        with current as (
            select {W.TOKEN_LABELS['agent_role']} as agent_role, case when l_returnflag = 'R' then 'gpt-5.6-sol' else 'other' end as model_id,
                   sum(cast(l_quantity as bigint)) filter (where l_linenumber % 3 = 1) as input, sum(cast(l_quantity as bigint)) filter (where l_linenumber % 3 = 0) as cached,
                   sum(cast(l_quantity as bigint)) filter (where l_linenumber % 3 = 2) as output
            from lineitem join orders on l_orderkey = o_orderkey group by 1, 2
        ), usage as (
            select agent_role, model_id, 'input_uncached' as usage_class, greatest(0, input - coalesce(cached, 0)) as value from current where input is not null
            union all select agent_role, model_id, 'input_cached', cached from current where cached is not null
            union all select agent_role, model_id, 'output', output from current where output is not null
        ), rates as (select * from {card(A.USD_PER_MILLION, 'USD')})
        select 'ai_agent_estimated_cost_usd_total' as rule, agent_role, model_id, usage_class, round(value * (price / 1000000), 9) as value from usage join rates using (model_id, usage_class)
        union all select 'ai_agent_unpriced_api_token_usage_total', agent_role, model_id, usage_class, cast(value as double) from usage anti join rates using (model_id, usage_class)""",
    "stm10_change_or_heartbeat": ORACLE["tsf10_change_or_heartbeat"],
    "stm02_turn_stream": f"{_STREAM_TURNS} select session_id, 'turn' as name, coalesce(begin, t - 1) as start_ns, greatest(t, coalesce(begin, t - 1) + 1) as end_ns from p where role = 'assistant'",
}

ORACLE |= privacy_oracles.ORACLE | check_oracles.ORACLE
