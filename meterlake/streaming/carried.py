"""Streams whose state is the rows that later batches still need: the batch operator runs over them and the new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators import sessions, status_line
from meterlake.sources.scratch import discard

#: Marks rows of earlier batches; they take part, but give out nothing again.
CARRIED = "_carried"

Step = Callable[[DataFrame], tuple[dict[str, DataFrame], DataFrame]]


def with_carried_rows(table: DataFrame, step: Step, folder: str, trigger: str | None = None):
    """Started stream: ``step`` gets the rows of a batch and those carried over to it, marked by ``CARRIED``, and returns tables to
    write (``folder``/<name>/batch=n) and the rows to carry over.

    Spark sorts and groups the rows of a batch as in any batch job, so no key's rows are held by one Python task. All is
    written under the batch's number: a batch that is repeated replaces what an earlier attempt wrote and starts from the
    same carried rows.
    """
    schema = table.schema

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn(CARRIED, F.lit(False))
        if n:
            rows = rows.unionByName(spark.read.schema(schema).parquet(f"{folder}/carried/batch={n - 1}").withColumn(CARRIED, F.lit(True)))
        rows = rows.persist()
        try:
            tables, kept = step(rows)
            for name, out in tables.items():
                out.write.mode("overwrite").parquet(f"{folder}/{name}/batch={n}")
            kept.select(*schema.names).write.mode("overwrite").parquet(f"{folder}/carried/batch={n}")
        finally:
            rows.unpersist()
        if n > 1:
            discard(spark, f"{folder}/carried/batch={n - 2}")

    writer = table.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def hook_stream(events: DataFrame, folder: str, trigger: str | None = None):
    """Spans (``folder``/spans) and lifecycle logs (``folder``/logs) of the hook protocol with invocations, batch by batch.

    Carried over for each conversation: the first event since its last Stop, invocations that are open, and the last event
    that named a model. Equals ``invocation_spans`` and ``lifecycle_logs`` over all rows as long as each batch's events of a
    conversation are later than those before it.
    """

    def step(rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        paired = sessions.hook_steps(rows)
        own = paired.where(~F.col(CARRIED))
        return {"spans": sessions.spans_of_steps(own), "logs": sessions.logs_of_steps(own)}, paired.where(sessions.still_needed())

    return with_carried_rows(sessions.hook_columns(events), step, folder, trigger)


def turn_stream(events: DataFrame, folder: str, trigger: str | None = None):
    """Ends of turns and tools (``folder``/ends: session_id, turn_id, tool_use_id, name, start_ns, end_ns), batch by batch.

    Carried over for each turn since its last Stop: the last prompt and the starts of open tools.
    """
    columns = ["session_id", "turn_id", "tool_use_id", "hook_event_name", "time_ns"]

    def step(rows: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        paired = sessions.turn_steps(rows)
        return {"ends": sessions.ends_of_turns(paired.where(~F.col(CARRIED)))}, paired.where(sessions.turn_still_open())

    return with_carried_rows(events.select(*columns), step, folder, trigger)


def emitted_stream(rows: DataFrame, key: str, folder: str, heartbeat_ns: int = status_line.HEARTBEAT_NS, trigger: str | None = None):
    """Rows (key, fingerprint, time_ns) that the change-or-heartbeat rule sends on (``folder``/sent), batch by batch.

    Carried over for each key: its last row, with the time of the last one sent.
    """

    def step(both: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
        seen = status_line.passed(both.drop(CARRIED), [key], heartbeat_ns)
        return {"sent": seen.where("sent_ns = time_ns and not last").select(key, "fingerprint", "time_ns")}, seen.where("last")

    return with_carried_rows(rows.select(key, "time_ns", "fingerprint", F.lit(None).cast("bigint").alias("sent_ns")), step, folder, trigger)
