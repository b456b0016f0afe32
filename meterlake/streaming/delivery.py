"""Sinks of streams: delivery with bounded queues, retries and counted drops; several sinks committed batch by batch."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.sources.scratch import exists

# Records of a queue, first and longest pause between attempts, and how long a record is retried, in seconds.
QUEUE_ROWS, FIRST_PAUSE, LONGEST_PAUSE, DEADLINE = 2048, 1.0, 10.0, 60.0
#: Bytes of a queue, whatever its number of rows; a single larger row is a queue of its own.
QUEUE_BYTES = 32 << 20

Send = Callable[[str, pa.RecordBatch], None]


def deliver(rows: DataFrame, send: Send, to: str, label: str = "", queue: int = QUEUE_ROWS, queue_bytes: int = QUEUE_BYTES, first_pause: float = FIRST_PAUSE, longest_pause: float = LONGEST_PAUSE, deadline: float = DEADLINE) -> DataFrame:
    """(to, chunk string, n long, sent boolean, attempts int, error string) of rows that ``send`` delivers on the executors.

    Each task keeps one queue for each destination (column ``to``) of at most ``queue`` rows and ``queue_bytes`` bytes; a full queue
    is sent as one chunk. A chunk that fails is sent again after a pause that doubles from ``first_pause`` to
    ``longest_pause``, until ``deadline`` seconds have passed; then it is dropped, counted and named by the kind of error, and
    delivery goes on, so one dead destination neither stops the others nor fills memory. A chunk's name (``label``, task, number)
    is the same when the task runs again, and ``send`` should use it to take no chunk twice. While chunks are retried
    the batch isn't finished, so the source hands out no more: that is the back-pressure.
    """
    place = rows.columns.index(to)

    def attempt(name: str, chunk: pa.RecordBatch) -> tuple[bool, int, str | None]:
        end, pause, tries = time.monotonic() + deadline, first_pause, 0
        while True:
            tries += 1
            try:
                send(name, chunk)
                return True, tries, None
            except Exception as error:  # noqa: BLE001  whatever a destination raises counts as a failed attempt
                if time.monotonic() + pause > end:
                    return False, tries, type(error).__name__
            time.sleep(pause)
            pause = min(2 * pause, longest_pause)

    def run(batches):
        part, number, held, sizes = TaskContext.get().partitionId(), 0, {}, {}

        def flushed(where):
            nonlocal number
            chunk = pa.Table.from_batches(held.pop(where)).combine_chunks().to_batches()[0]
            del sizes[where]
            name = f"{label}-{part}-{number}"
            number += 1
            sent, tries, error = attempt(name, chunk)
            arrays = [pa.array([x], t) for x, t in zip((where, name, chunk.num_rows, sent, tries, error), (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.string()))]
            return pa.RecordBatch.from_arrays(arrays, [to, "chunk", "n", "sent", "attempts", "error"])

        for batch in batches:
            for where in batch.column(place).unique().to_pylist():
                own = batch.filter(pc.equal(batch.column(place), where) if where is not None else pc.is_null(batch.column(place)))
                each = max(1, min(queue, own.num_rows, queue_bytes * own.num_rows // max(1, own.nbytes)))
                for at in range(0, own.num_rows, each):
                    cut = own.slice(at, each)
                    n, size = sizes.get(where, (0, 0))
                    if n and (n + cut.num_rows > queue or size + cut.nbytes > queue_bytes):
                        yield flushed(where)
                        n = size = 0
                    held.setdefault(where, []).append(cut)
                    sizes[where] = (n + cut.num_rows, size + cut.nbytes)
            while sum(n for n, _ in sizes.values()) > 8 * queue or sum(s for _, s in sizes.values()) > 2 * queue_bytes:
                yield flushed(max(sizes, key=lambda w: sizes[w][1]))
        for where in list(held):
            yield flushed(where)

    return rows.mapInArrow(run, f"`{to}` string, chunk string, n long, sent boolean, attempts int, error string")


def delivering_stream(table: DataFrame, send: Send, to: str, folder: str, trigger: str | None = None, **limits):
    """Started stream that delivers each batch once and keeps what became of it under ``folder``/deliveries/batch=n.

    A batch that is repeated after a crash delivers under the same chunk names and replaces its report.
    """

    def run(batch: DataFrame, n: int) -> None:
        deliver(batch, send, to, str(n), **limits).write.mode("overwrite").parquet(f"{folder}/deliveries/batch={n}")

    writer = table.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def delivery_report(spark: SparkSession, folder: str, to: str) -> DataFrame:
    """(to, delivered, dropped, retried): rows by destination over all batches; ``retried`` counts extra attempts."""
    rows = spark.read.parquet(f"{folder}/deliveries")
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return rows.groupBy(to).agg(count(F.col("sent")).alias("delivered"), count(~F.col("sent")).alias("dropped"), F.sum(F.col("attempts") - 1).cast("bigint").alias("retried"))


def fan_out_stream(table: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], folder: str, trigger: str | None = None):
    """Started stream that writes each batch to several stores (``folder``/<name>/batch=n), each the result of its function.

    A store commits a batch by finishing its folder (Spark's marker file), so when one fails, the batch is repeated for
    those that haven't: stores that have it are left alone, and a half-written folder is replaced. Nothing is doubled or lost.
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        due = {name: f"{folder}/{name}/batch={n}" for name in sinks if not exists(spark, f"{folder}/{name}/batch={n}/_SUCCESS")}
        rows = batch.persist() if len(due) > 1 else batch
        try:
            for name, path in due.items():
                sinks[name](rows).write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            rows.unpersist()

    writer = table.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
