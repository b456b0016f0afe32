"""Configuration documents: annotation rubrics and rate cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Types of a rubric entry and of a rate.
RUBRIC = "name string, type string, labels array<struct<label:string,score:double>>"
RATE = "currency string, rate_card_version string, rate_card_source string, pricing_scope string, ai_agent_provider string, model_id string, usage_class string, value double"


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an annotation rubric, one JSON object a line; one that doesn't parse raises an error."""
    return spark.read.schema(RUBRIC).option("mode", "FAILFAST").json(path)


def read_rates(spark: SparkSession, pattern: str, base: str | None = None) -> DataFrame:
    """Rates of all files that match a pattern; folders below ``base`` named column=value give that column."""
    reader = spark.read.schema(RATE).option("mode", "FAILFAST")
    return (reader.option("basePath", base) if base else reader).json(pattern)
