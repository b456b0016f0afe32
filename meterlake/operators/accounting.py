"""Token accounting: non-overlapping usage classes, rate cards, estimated cost, unpriced usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.labels import label
from meterlake.operators.vector import group_left, vec_unless

TURN_LABELS = ["ai_agent_provider", "ai_agent_product", "agent_role", "model_id", "model_family", "evidence_class", "service_namespace"]
REQUEST_LABELS = [*TURN_LABELS, "skill_id", "mcp_server_name", "mcp_tool_name"]
RATE_KEY = ["ai_agent_provider", "model_id", "usage_class"]
CLASSES = {"cached_input": "input_cached", "cache_write_input": "input_cache_write", "output": "output"}

# List prices in USD and credits per million tokens, by model and usage class.
USD_PER_MILLION = {
    "gpt-5.6-sol": {"input_uncached": 5.0, "input_cached": 0.5, "input_cache_write": 6.25, "output": 30.0},
    "gpt-5.6-terra": {"input_uncached": 2.0, "input_cached": 0.2, "input_cache_write": 2.5, "output": 12.0},
    "gpt-5.6-luna": {"input_uncached": 0.2, "input_cached": 0.02, "input_cache_write": 0.25, "output": 1.2},
}
CREDITS_PER_MILLION = {
    "gpt-5.6-sol": {"input_uncached": 125.0, "input_cached": 12.5, "output": 750.0},
    "gpt-5.6-terra": {"input_uncached": 50.0, "input_cached": 5.0, "output": 300.0},
    "gpt-5.6-luna": {"input_uncached": 5.0, "input_cached": 0.5, "output": 30.0},
}


def rate_card(spark: SparkSession, prices=USD_PER_MILLION, unit: str = "USD", version: str = "v1", source: str = "public-list-price", scope: str = "standard", provider: str = "openai") -> DataFrame:
    """A constant table, one row a price: the key, currency, version, source, scope and value per million tokens."""
    rows = [(provider, model, c, unit, version, source, scope, float(p)) for model, by in prices.items() for c, p in by.items()]
    return spark.createDataFrame(rows, "ai_agent_provider string, model_id string, usage_class string, currency string, rate_card_version string, rate_card_source string, pricing_scope string, value double")


def rate_card_of(models: DataFrame, classes: dict[str, float], unit: str = "USD", version: str = "v1", source: str = "public-list-price", scope: str = "standard", provider: str = "openai") -> DataFrame:
    """The card of a table (model_id, base): a rate for each model and class, the model's base times the factor of the class."""
    cells = F.array(*(F.struct(F.lit(c).alias("usage_class"), (F.col("base") * F.lit(float(f))).alias("value")) for c, f in classes.items()))
    fixed = {"ai_agent_provider": provider, "currency": unit, "rate_card_version": version, "rate_card_source": source, "pricing_scope": scope}
    return models.select(F.col("model_id"), F.inline(cells)).withColumns({k: F.lit(v) for k, v in fixed.items()}).select("ai_agent_provider", "model_id", "usage_class", "currency", "rate_card_version", "rate_card_source", "pricing_scope", "value")


def _kept(samples: DataFrame, metric: str) -> Column:
    return (F.col("metric") == metric) & (label(samples, "model_id") != "") & (label(samples, "agent_role") != "")


def token_usage(current: DataFrame) -> DataFrame:
    """Usage by class from the current values of the token counters (metric, labels..., token_type, value).

    Turn counters: cached and cache-write tokens are parts of ``input``, so the uncached class is an explicit
    ``non_cached_input`` or else input less both, at least 0; without either there is no uncached row, and missing parts
    count as 0. Request counters already report classes apart. One conditional aggregation for each counter and one
    unpivot; ``reasoning_output`` and ``total`` never count. A request series that equals a turn series in all labels
    is hidden by it, as union by label set has it.
    """
    of = lambda kind: F.sum(F.when(F.col("token_type") == kind, F.col("value")))

    def classes(metric: str, labels: list[str], nested: bool) -> DataFrame:
        rows = current.where(_kept(current, metric)).withColumns({c: F.lit(None).cast("string") for c in labels if c not in current.columns})
        wide = rows.groupBy(*labels).agg(of("non_cached_input").alias("explicit"), of("input").alias("input"), *(of(k).alias(k) for k in CLASSES))
        derived = F.when(F.col("input").isNotNull(), F.greatest(F.lit(0.0), F.col("input") - F.coalesce("cached_input", F.lit(0.0)) - F.coalesce("cache_write_input", F.lit(0.0))))
        uncached = F.coalesce("explicit", derived) if nested else F.col("input")
        cells = [F.struct(F.lit("input_uncached").alias("usage_class"), uncached.alias("value"))]
        cells += [F.struct(F.lit(v).alias("usage_class"), F.col(k).alias("value")) for k, v in CLASSES.items()]
        return wide.select(*labels, F.inline(F.array(*cells))).where(F.col("value").isNotNull())

    turn = classes("ai_agent_turn_token_usage_sum", TURN_LABELS, True).withColumns({c: F.lit(None).cast("string") for c in REQUEST_LABELS[7:]})
    request = classes("ai_agent_request_token_usage_total", REQUEST_LABELS, False)
    request = vec_unless(request, turn, [*REQUEST_LABELS, "usage_class"])
    return turn.unionByName(request).withColumn("accounting_schema", F.lit("v2"))


def estimated(usage: DataFrame, rates: DataFrame, source_label: str = "cost_source", source: str = "estimated_api_list_price") -> DataFrame:
    """Usage times its rate, per row; usage without a rate has no row."""
    priced = group_left(usage, rates, RATE_KEY, ["currency", "rate_card_version", "rate_card_source", "pricing_scope"], lambda tokens, price: tokens * (price / 1_000_000))
    return priced.withColumn(source_label, F.lit(source))


def unpriced(usage: DataFrame, rates: DataFrame, scope: str = "api_usd") -> DataFrame:
    """Usage whose provider, model and class have no rate; it stays visible instead of counting as zero."""
    return vec_unless(usage, rates, RATE_KEY).withColumn("estimate_scope", F.lit(scope))


def one_product(usage: DataFrame, provider: str = "openai", product: str = "codex") -> DataFrame:
    return usage.where((label(usage, "ai_agent_provider") == provider) & (label(usage, "ai_agent_product") == product))


def recording_rules(current: DataFrame, usd: DataFrame, credits: DataFrame) -> dict[str, DataFrame]:
    """All derived series of one evaluation, in order; the later ones read the earlier."""
    usage = token_usage(current)
    own = one_product(usage)
    return {
        "ai_agent_token_price_usd_per_million": usd,
        "ai_agent_token_credit_per_million": credits,
        "ai_agent_token_usage_total": usage,
        "ai_agent_estimated_cost_usd_total": estimated(usage, usd),
        "ai_agent_estimated_credit_usage_total": estimated(own, credits, "credit_source", "estimated_public_codex_rate_card"),
        "ai_agent_unpriced_api_token_usage_total": unpriced(usage, usd, "api_usd"),
        "ai_agent_unpriced_credit_token_usage_total": unpriced(own, credits, "codex_credits"),
    }
