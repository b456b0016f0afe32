"""Log streams: selection by stream labels and metadata, event counts, newest-first listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.labels import anchored, label
from meterlake.functions.timeseries import at_time, count_over_time

STREAM_LABELS = ("service_name", "service_namespace", "deployment_environment_name", "ai_observability_profile")


def stream(logs: DataFrame, service: str, exclude_namespace: str | None = None) -> DataFrame:
    """Log rows of services that match the anchored pattern; both labels partition the stored table."""
    out = logs.where(anchored(label(logs, "service_name"), service))
    return out.where(~anchored(label(out, "service_namespace"), exclude_namespace)) if exclude_namespace else out


def having(logs: DataFrame, **values: str | None) -> DataFrame:
    """Metadata filters in a row (all must hold): a text must be equal, None means present."""
    for name, value in values.items():
        logs = logs.where(label(logs, name) != "" if value is None else label(logs, name) == value)
    return logs


def event_count(logs: DataFrame, service: str, end, length: str, **values: str | None) -> DataFrame:
    """Number of matching rows in a range; no row if there is none."""
    return count_over_time(having(stream(logs, service), **values), end, length, [])


def events_over_time(logs: DataFrame, service: str, start, end, step: str) -> DataFrame:
    """(event_name, ts, value): named events counted in tumbling steps."""
    rows = having(stream(logs, service), event_name=None).where((F.col("ts") >= at_time(start)) & (F.col("ts") < at_time(end)))
    return rows.groupBy("event_name", F.window("ts", step).alias("w")).agg(F.count(F.lit(1)).alias("value")).select("event_name", F.col("w.start").alias("ts"), "value")


def newest(logs: DataFrame, start, end, limit: int = 100, tie: str = "event_id") -> DataFrame:
    """Newest-first listing of a range."""
    return logs.where((F.col("ts") > at_time(start)) & (F.col("ts") <= at_time(end))).orderBy(F.desc("ts"), F.desc(tie)).limit(limit)


def label_values(table: DataFrame, name: str) -> DataFrame:
    """Values of a label that are present, sorted."""
    return table.select(F.col(name).alias("value")).where(F.coalesce("value", F.lit("")) != "").distinct().orderBy("value")
