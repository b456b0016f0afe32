"""Sinks: partitioned Parquet for the three signals, JSON captures, fan-out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.canonical import text
from meterlake.operators.logs import STREAM_LABELS
from meterlake.operators.samples import safe_name


def with_stream_labels(logs: DataFrame) -> DataFrame:
    """The four index labels of the log store as columns, from the resource; missing ones are empty."""
    keys = {label: key for label, key in zip(STREAM_LABELS, ("service.name", "service.namespace", "deployment.environment.name", "ai_observability.profile"))}
    return logs.withColumns({label: F.coalesce(text(F.col("resource"), key), F.lit("")) for label, key in keys.items()})


def write_logs(logs: DataFrame, path: str) -> None:
    with_stream_labels(logs).withColumn("date", F.to_date("ts")).write.mode("append").partitionBy(*STREAM_LABELS, "date").parquet(path)


def write_samples(samples: DataFrame, path: str) -> None:
    samples.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("metric", "date").parquet(path)


def write_spans(spans: DataFrame, path: str, codec: str = "zstd") -> None:
    spans.withColumn("date", F.to_date("ts")).write.mode("append").option("compression", codec).partitionBy("date").parquet(path)


def capture(table: DataFrame, path: str) -> None:
    """Every row as a line of JSON, for inspection."""
    table.write.mode("append").json(path)


def fan_out(table: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """One input to several sinks, computed once."""
    kept = table.persist()
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()


def expire(spark, path: str, date: str) -> DataFrame:
    """The stored rows that retention keeps: partitions from ``date`` on, pruned by the partition column."""
    return spark.read.parquet(path).where(F.col("date") >= F.lit(date).cast("date"))


def safe_columns(table: DataFrame) -> DataFrame:
    """Column names under the rules of label names."""
    return table.select(*(F.col(f"`{c}`").alias(_plain(c)) for c in table.columns))


def _plain(name: str) -> str:
    import re

    return re.sub(r"[^a-zA-Z0-9_:]", "_", name)


__all__ = ["capture", "expire", "fan_out", "safe_columns", "safe_name", "with_stream_labels", "write_logs", "write_samples", "write_spans"]
