"""Status-line snapshots: safe columns, gauges, display text, fingerprint, and emission by change or heartbeat."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from meterlake.functions import text as T

HEARTBEAT_NS = 60_000_000_000


def _count(column: str) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), T.safe_int(F.col(column)))


def safe_snapshot(rows: DataFrame) -> DataFrame:
    """Bounded columns of snapshots: texts made safe, counts not negative, percentages within 0 to 100."""
    usage = "context_window.current_usage"
    quota = F.transform_values(F.transform_keys(F.map_filter(F.coalesce("quota", F.expr("cast(map() as map<string,struct<remaining_fraction:double,reset_time:string>>)")), lambda k, v: v["remaining_fraction"].isNotNull()), lambda k, v: T.safe_text(k)), lambda k, v: F.round(v["remaining_fraction"], 6))
    return rows.select(
        T.safe_text(F.coalesce("session_id", "conversation_id")).alias("session"), "time_ns", T.safe_text(F.coalesce(F.nullif("model.id", F.lit("")), "model.display_name")).alias("model"),
        T.safe_text(F.col("agent_state")).alias("agent_state"), T.safe_text(F.col("execution_mode")).alias("execution_mode"),
        _count("context_window.total_input_tokens").alias("total_input"), _count("context_window.total_output_tokens").alias("total_output"),
        F.round(T.clamp(T.safe_float(F.col("context_window.used_percentage")), 0.0, 100.0), 4).alias("used_percentage"),
        _count(f"{usage}.input_tokens").alias("input"), _count(f"{usage}.output_tokens").alias("output"), _count(f"{usage}.cache_creation_input_tokens").alias("cache_creation"), _count(f"{usage}.cache_read_input_tokens").alias("cache_read"),
        _count("task_count").alias("task_count"), _count("artifact_count").alias("artifact_count"), F.coalesce("exceeds_200k_tokens", F.lit(False)).alias("exceeds_200k_tokens"),
        _count("pending_input_count").alias("pending_input_count"), F.coalesce("tool_confirmation_pending", F.lit(False)).alias("tool_confirmation_pending"), quota.alias("quota"), _count("terminal_width").alias("terminal_width"),
    )


def _rounded_number(value: Column) -> Column:
    """A number of four or six places as the shortest JSON number that reads back as it, in plain notation."""
    return F.regexp_replace(F.regexp_replace(value.cast("decimal(24,6)").cast("string"), "0+$", ""), r"\.$", ".0")


def canonical_snapshot(snapshot: DataFrame) -> Column:
    """The snapshot as JSON without blanks, keys sorted at every level: nested usage, quotas by name; without its time, session and
    display width."""
    plain = {"agent_state", "artifact_count", "exceeds_200k_tokens", "execution_mode", "model", "pending_input_count", "task_count", "tool_confirmation_pending", "total_input", "total_output"}
    text = {"agent_state", "execution_mode", "model"}
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))  # noqa: E731  texts are safe: no quotes, backslashes or control characters
    cells = {k: quote(F.col(k)) if k in text else F.col(k).cast("string") for k in plain}
    usage = [F.concat(F.lit(f'"{k}":'), F.col(k).cast("string")) for k in ("cache_creation", "cache_read", "input", "output")]
    cells["current"] = F.concat(F.lit("{"), F.concat_ws(",", *usage), F.lit("}"))
    quotas = F.transform(F.array_sort(F.map_entries("quota")), lambda e: F.concat(quote(e["key"]), F.lit(":"), _rounded_number(e["value"])))
    cells["quota"] = F.concat(F.lit("{"), F.array_join(quotas, ","), F.lit("}"))
    cells["used_percentage"] = _rounded_number(F.col("used_percentage"))
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), cells[k]) for k in sorted(cells))), F.lit("}"))


def fingerprint(snapshot: DataFrame) -> Column:
    """SHA-256 of the canonical JSON: equal for snapshots that show the same."""
    return F.sha2(canonical_snapshot(snapshot), 256)


def sent_snapshots(snapshots: DataFrame, heartbeat_ns: int = HEARTBEAT_NS) -> DataFrame:
    """Safe snapshots that are sent on: their fingerprint has changed, or the session's last one sent is a heartbeat ago.

    Snapshots of one session, time and fingerprint are one. Those without a time, which have no place in the order, aren't sent.
    """
    marked = snapshots.where("time_ns is not null").withColumn("fingerprint", fingerprint(snapshots))
    return emitted(marked, ["session"], heartbeat_ns).where("fingerprint is not null")


def status_logs(sent: DataFrame) -> DataFrame:
    """The one log row that goes beside the gauges of a snapshot that is sent."""
    return sent.select(
        "session", "time_ns", F.lit("antigravity.status.changed").alias("event_name"), F.lit("INFO").alias("severity"), F.lit("status_update").alias("operation"), F.col("execution_mode").alias("stage"), F.col("agent_state").alias("state"),
        "model", F.col("total_input").alias("input_tokens"), F.col("total_output").alias("output_tokens"), F.col("cache_read").alias("cached_input_tokens"), "fingerprint",
    )


def gauges(snapshot: DataFrame) -> DataFrame:
    """(session, time_ns, metric, tool, model_family, token_type, state, type, value): nine gauges, one row a point."""
    def point(metric: str, value: Column, **labels: Column) -> Column:
        named = [labels.get(k, F.lit(None).cast("string")).cast("string").alias(k) for k in ("token_type", "state", "type")]
        return F.struct(F.lit(metric).alias("metric"), *named, value.cast("double").alias("value"))

    fixed = [point("antigravity_session_tokens", F.col(f"total_{k}"), token_type=F.lit(k)) for k in ("input", "output")]
    fixed += [point("antigravity_context_tokens", F.col(k), token_type=F.lit(k)) for k in ("input", "output", "cache_creation", "cache_read")]
    fixed += [
        point("antigravity_context_used_ratio", F.col("used_percentage") / 100.0), point("antigravity_background_task_count", F.col("task_count"), state=F.col("agent_state")),
        point("antigravity_artifact_count", F.col("artifact_count")), point("antigravity_context_exceeds_200k", F.col("exceeds_200k_tokens").cast("int")),
        point("antigravity_pending_input_count", F.col("pending_input_count")), point("antigravity_tool_confirmation_pending", F.col("tool_confirmation_pending").cast("int")),
    ]
    quotas = F.transform(F.map_entries("quota"), lambda e: point("antigravity_quota_remaining_ratio", T.clamp(e["value"], 0.0, 1.0), type=e["key"]))
    return snapshot.select("session", "time_ns", F.lit("antigravity").alias("tool"), F.col("model").alias("model_family"), F.inline(F.concat(F.array(*fixed), quotas)))


def status_text(snapshot: DataFrame) -> Column:
    """One line for the terminal, cut to its width with an ellipsis."""
    line = F.format_string("AGY %s | %s | ctx %.1f%% | in %d out %d", "model", "agent_state", "used_percentage", "total_input", "total_output")
    width = F.col("terminal_width").cast("int")
    return F.when((width > 8) & (F.length(line) >= width), F.concat(F.substring(line, F.lit(1), F.greatest(F.lit(1), width - 2)), F.lit("…"))).otherwise(line)


def passed(rows: DataFrame, key: list[str], heartbeat_ns: int = HEARTBEAT_NS) -> DataFrame:
    """(key..., time_ns, fingerprint, ..., sent_ns, last) of rows (key..., time_ns, fingerprint, sent_ns, ...): those sent on (``sent_ns``
    is their time) and, with ``last``, once more the last row of each key with the time of the last one sent.

    A row with ``sent_ns`` is such a last row of an earlier run: it isn't sent again. Spark sorts the rows of each key by time
    (rows of one time by fingerprint) and a task goes through them once, batch by batch, keeping only what it saw and sent last.
    Further columns go along in Arrow, so nothing needs to be joined to the rows that are sent.
    """
    beat = max(1_000_000_000, heartbeat_ns)
    columns = [*key, "time_ns", "fingerprint"]
    columns += [c for c in rows.columns if c not in {*columns, "sent_ns"}]
    names, width = [*columns, "sent_ns", "last"], len(key)

    def send(batches):
        now = before = last = newest = None

        def table(batch, found):
            at, times, lasts = zip(*found)
            kept = batch.take(pa.array(at, pa.int64()))
            return pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(times, pa.int64()), pa.array(lasts, pa.bool_())], names)

        for batch in batches:
            # the row before goes first, as it may be the last of its key
            seen, found = 0 if newest is None else 1, []
            batch = pa.concat_batches([newest, batch]) if seen else batch
            read = [batch.column(n).slice(seen).to_pylist() for n in (*range(width + 2), len(columns))]
            for n, row in enumerate(zip(*read), seen):
                own, time, mark, sent = row[:width], row[width], row[width + 1], row[width + 2]
                if own != now and now is not None:
                    found.append((n - 1, last, True))
                if sent is not None:
                    last = sent
                elif own != now or mark != before or time - last >= beat:
                    last = time
                    found.append((n, time, False))
                now, before = own, mark
            if batch.num_rows:
                newest = batch.take(pa.array([batch.num_rows - 1], pa.int64()))
            if found:
                yield table(batch, found)
        if newest is not None:
            yield table(newest, [(0, last, True)])

    # a carried row comes first among rows of its time
    ordered = rows.select(*columns, "sent_ns").repartition(*key).sortWithinPartitions(*key, "time_ns", F.col("sent_ns").isNull(), "fingerprint")
    return ordered.mapInArrow(send, StructType([*ordered.schema.fields, StructField("last", BooleanType())]))


def emitted(rows: DataFrame, key: list[str], heartbeat_ns: int = HEARTBEAT_NS) -> DataFrame:
    """Rows (key..., fingerprint, time_ns, ...) that are sent on: the fingerprint differs from the one before, or the last row that
    was sent is at least the heartbeat ago."""
    seen = passed(rows.withColumn("sent_ns", F.lit(None).cast("bigint")), key, heartbeat_ns).where("not last").drop("sent_ns", "last")
    first = [*key, "fingerprint", "time_ns"]
    return seen.select(*first, *(c for c in seen.columns if c not in first))
