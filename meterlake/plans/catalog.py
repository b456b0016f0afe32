"""The dashboard catalogue: every panel as a shape over samples, with its metric, matchers and grouping."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions import timeseries as ts
from meterlake.functions.labels import FIXTURES, label, select_series, without_fixtures
from meterlake.functions.text import round_half_up
from meterlake.operators import vector as V

USAGE, COST, CREDITS = "ai_agent_token_usage_total", "ai_agent_estimated_cost_usd_total", "ai_agent_estimated_credit_usage_total"
PX = {"ai_agent_provider": "openai", "ai_agent_product": "codex"}
V2 = {"accounting_schema": "v2"}
AR = {"agent_role": "approval_reviewer"}
CLAUDE = {"ai_agent_provider": "anthropic", "ai_agent_product": "claude-code"}
SIZES = {"ai_agent_product": "codex", "content_scope": "hook_tool_response", "measurement_method": "utf8_bytes"}
AG = {"tool": "antigravity"}


@dataclass(frozen=True)
class Panel:
    """shape: how ``metric`` is folded; eq, ne, re: matchers; by: labels of the result; scale: a factor."""

    shape: str
    metric: str
    by: tuple[str, ...] = ()
    eq: dict = field(default_factory=dict)
    ne: dict = field(default_factory=dict)
    re: dict = field(default_factory=dict)
    scale: float = 1.0


# The panels, by dashboard.
PANELS = {
    "cu01": Panel("sum", USAGE, eq=PX | V2),
    "cu02": Panel("increase", COST, eq=PX | V2),
    "cu05": Panel("increase", "codex_turn_token_usage_sum", ("model", "token_type")),
    "cu06": Panel("increase", COST, ("model_id", "usage_class", "rate_card_version"), PX | V2),
    "cu08": Panel("max", "ai_agent_token_price_usd_per_million", ("model_id", "usage_class", "currency", "rate_card_version", "rate_card_source", "pricing_scope"), {"ai_agent_provider": "openai"}),
    "cu09": Panel("p95", "codex_turn_e2e_duration_ms_bucket", ("model",)),
    "cu10": Panel("p95", "codex_turn_ttft_duration_ms_bucket", ("model",)),
    "cu11": Panel("increase", "codex_tool_call", ("tool", "success")),
    "cu12": Panel("increase", "codex_mcp_call", ("status",)),
    "cu13": Panel("increase", "codex_mcp_error", ("status",)),
    "cu14": Panel("p95", "codex_responses_api_inference_time_duration_ms_bucket", ("model",)),
    "cu15": Panel("p95", "codex_responses_api_overhead_duration_ms_bucket", ("model",)),
    "cu16": Panel("increase", "codex_task_compact", ("type", "manual")),
    "cu17": Panel("increase", "codex_skill_injected", ("source",)),
    "cu18": Panel("increase", "codex_thread_started", ("source",)),
    "ar02": Panel("reviews", "ai_agent_turn_token_usage_count", eq=PX | AR | {"token_type": "total"}),
    "ar03": Panel("increase", USAGE, eq=PX | AR | V2),
    "ar05": Panel("increase", COST, eq=PX | AR | V2),
    "ar06": Panel("increase", CREDITS, eq=PX | AR | V2),
    "ar10": Panel("increase", USAGE, ("model_id", "usage_class"), PX | AR | V2),
    "ar11": Panel("rate_grid", USAGE, ("usage_class",), PX | AR | V2),
    "ar12": Panel("sum", "ai_agent_unpriced_api_token_usage_total", ("model_id", "usage_class"), PX | AR | V2),
    "ar13": Panel("sum", "ai_agent_unpriced_credit_token_usage_total", ("model_id", "usage_class"), PX | AR | V2),
    "ag01": Panel("max", "antigravity_session_tokens", ("token_type", "model_family"), AG),
    "ag02": Panel("max", "antigravity_context_tokens", ("token_type", "model_family"), AG),
    "ag03": Panel("max", "antigravity_context_used_ratio", eq=AG, scale=100.0),
    "ag04": Panel("max", "antigravity_quota_remaining_ratio", ("type",), AG, scale=100.0),
    "ag05": Panel("max", "antigravity_background_task_count", eq=AG),
    "ag06": Panel("max", "antigravity_artifact_count", eq=AG),
    "ag07": Panel("max", "antigravity_context_exceeds_200k", eq=AG),
    "ag08": Panel("max", "antigravity_pending_input_count", eq=AG),
    "ag09": Panel("max", "antigravity_tool_confirmation_pending", eq=AG),
    "ca01": Panel("increase", "ai_agent_request_token_usage_total", eq=CLAUDE),
    "ca02": Panel("increase", "ai_agent_request_token_usage_total", ("skill_id", "token_type"), CLAUDE, {"skill_id": "none"}),
    "ca03": Panel("increase", "ai_agent_request_token_usage_total", ("mcp_server_name", "mcp_tool_name", "token_type"), CLAUDE, {"mcp_server_name": "none"}),
    "ca04": Panel("increase", "ai_agent_observed_mcp_tool_response_bytes_sum", eq=SIZES),
    "ca05": Panel("increase", "ai_agent_observed_mcp_tool_response_bytes_count", eq=SIZES),
    "ca06": Panel("increase_grid", "ai_agent_compaction", ("ai_agent_product",)),
    "ch01": Panel("min", "up", re={"job": "otel-collector.*"}),
    "ch02": Panel("rate", "otelcol_receiver_accepted_spans", ("receiver", "transport")),
    "ch03": Panel("rate", "otelcol_receiver_accepted_log_records", ("receiver", "transport")),
    "ch04": Panel("rate", "otelcol_receiver_accepted_metric_points", ("receiver", "transport")),
    "ch06": Panel("instant", "otelcol_process_memory_rss", ("instance",), {"job": "otel-collector-internal"}),
    # the provider-neutral panels, reconstructed: the same forms without the product
    "un02": Panel("increase", USAGE, eq=V2),
    "un03": Panel("increase", COST, eq=V2),
    "un04": Panel("reviews", "ai_agent_turn_token_usage_count", eq={"token_type": "total"}),
    "un07": Panel("increase", CREDITS, eq=V2),
    "un08": Panel("sum", "ai_agent_unpriced_credit_token_usage_total", ("model_id", "usage_class"), V2),
    "un09": Panel("increase", "ai_agent_observed_user_prompt_bytes_sum"),
    "un10": Panel("increase", "ai_agent_observed_user_prompt_bytes_count"),
}
FAILED_SENDS = ("otelcol_exporter_send_failed_spans", "otelcol_exporter_send_failed_log_records", "otelcol_exporter_send_failed_metric_points")


def chosen(samples: DataFrame, p: Panel, model: str | None = None, fixtures: str = FIXTURES) -> DataFrame:
    """The panel's series without fixtures; ``model`` is the pattern of the model variable."""
    pattern = {"model_id" if "model_id" in samples.columns else "model": model} if model else {}
    return without_fixtures(select_series(samples, p.metric, p.eq, p.ne, p.re | pattern), fixtures)


def panel(name: str, samples: DataFrame, end, length: str, start=None, step: str | None = None, lookback: str = ts.LOOKBACK, model: str | None = None, extrapolate: bool = True) -> DataFrame:
    """Result of a panel: its ``by`` labels and value. ``length`` is the range; grids also take ``start`` and ``step``."""
    p = PANELS[name]
    rows = chosen(samples, p, model)
    by = list(p.by)
    folds = {"sum": F.sum, "max": F.max, "min": F.min, "instant": F.max}
    if p.shape in folds:
        current, function = ts.instant(rows, end, lookback), folds[p.shape]
    elif p.shape in ("increase", "reviews"):
        current, function = ts.increase(rows, end, length, extrapolate), F.sum
    elif p.shape in ("rate", "p95"):
        current, function = ts.rate(rows, end, length, extrapolate), F.sum
    else:
        grid = ts.increase_on_grid(rows, start, end, step, extrapolate)
        current, function, by = grid, F.sum, [*by, "ts"]
    if p.shape == "p95":
        return ts.histogram_quantile(0.95, V.sum_by(current, [*by, "le"]), by)
    out = current.groupBy(*by).agg(function("value").alias("value")) if by else V.fold(current, function)
    if p.shape == "reviews":
        return out.withColumn("value", round_half_up(F.col("value")).cast("double"))
    if p.shape == "rate_grid":
        return out.withColumn("value", F.col("value") / ts.seconds_of(step))
    return out.withColumn("value", F.col("value") * p.scale) if p.scale != 1.0 else out


def priced_coverage(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Share of tokens whose provider, model and class have a price."""
    keys = rates.select("ai_agent_provider", "model_id", "usage_class").distinct().withColumn("_priced", F.lit(True))  # once, whatever versions the card has
    marked = usage.join(keys, ["ai_agent_provider", "model_id", "usage_class"], "left")
    return V.ratio(marked, F.col("_priced"))


def cache_ratio(usage: DataFrame) -> DataFrame:
    inputs = usage.where(label(usage, "usage_class").rlike("^input_.+$"))
    return V.ratio(inputs, F.col("usage_class") == "input_cached")


def share(grown: DataFrame, part: Column) -> DataFrame:
    """Part of a growth in the whole; a whole below 1 counts as 1."""
    return V.ratio(grown, part, 1.0)


def per_review(tokens: DataFrame, reviews: DataFrame) -> DataFrame:
    """Tokens per review of two one-row results; absent if either is."""
    both = tokens.select(F.lit("t").alias("k"), "value").unionByName(reviews.select(F.lit("r").alias("k"), "value"))
    wide = both.groupBy().agg(F.max(F.when(F.col("k") == "t", F.col("value"))).alias("t"), F.max(F.when(F.col("k") == "r", F.col("value"))).alias("r"))
    return wide.where("t is not null and r is not null").select((F.col("t") / F.greatest(F.col("r"), F.lit(1.0))).alias("value"))


def unpriced_last(usage_samples: DataFrame, rates: DataFrame, end, length: str) -> DataFrame:
    """Last usage of a range by model and class where no price exists."""
    last = ts.last_over_time(usage_samples, end, length)
    return V.sum_by(V.vec_unless(last, rates, ["ai_agent_provider", "model_id", "usage_class"]), ["model_id", "usage_class"])


def failed_sends(samples: DataFrame, end, length: str) -> DataFrame:
    """Failure rates by exporter: spans, or else log records, or else points of the same labels, as union by label set."""
    rates = [ts.rate(without_fixtures(select_series(samples, m)), end, length).drop("metric") for m in FAILED_SENDS]
    return V.sum_by(V.vec_or(V.vec_or(rates[0], rates[1]), rates[2]), ["exporter"])
