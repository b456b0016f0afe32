"""Structured Streaming: micro-batched ingest, watermarked windows, running totals, rules by batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.operators.samples import running_sum
from meterlake.sources.scratch import scratch_path
from meterlake.streaming.series import SeriesTable

TRIGGER = "2 seconds"
#: Input that one batch of a stored table takes.
BATCH_BYTES = 1 << 30


def append_stream(table: DataFrame, path: str, checkpoint: str, trigger: str | None = None, partition_by: tuple[str, ...] = ()):
    """Exactly-once file sink; without a trigger everything available is processed and the query ends."""
    writer = table.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def rules_by_batch(table: DataFrame, evaluate: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = None):
    """Evaluates recording rules once for each micro-batch; ``evaluate`` must replace what an earlier attempt wrote."""
    writer = table.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def events_by_window(events: DataFrame, size: str, late: str = "336 hours", name: str = "event_name") -> DataFrame:
    """(name, ts, value): events counted in tumbling windows; rows later than the watermark are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), name).agg(F.count(F.lit(1)).alias("value"))
    return counted.select(name, F.col("w.start").alias("ts"), "value")


def events_by_sliding_window(events: DataFrame, size: str, slide: str, late: str = "336 hours", name: str = "event_name") -> DataFrame:
    """(name, ts, value): events counted in windows of ``size`` that end every ``slide``; ``ts`` is the window's end.

    Events are counted in panes as wide as the slide, and the windows that share a pane add up its count, so state holds
    counts of panes and windows, not events, and no event is copied to each window. Rows later than the watermark are
    left out; a window is given out once the watermark has passed its end.
    """
    panes = events.withWatermark("ts", late).groupBy(F.window("ts", slide).alias("pane"), name).agg(F.count(F.lit(1)).alias("n"))
    timed = panes.select(name, F.window_time("pane").alias("ts"), "n")
    summed = timed.groupBy(F.window("ts", size, slide).alias("w"), name).agg(F.sum("n").alias("value"))
    return summed.select(name, F.col("w.end").alias("ts"), "value")


def series_ends(samples: DataFrame, key: list[str], after: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """(key..., first, last, value, n): each life of a series, once it has been silent for ``after``.

    A series that comes back starts a new life. ``value`` is its last one. State is one row for each series that lives; it goes
    out when the watermark, ``late`` behind the newest sample, has passed ``after`` the series' last sample.
    """
    lives = samples.withWatermark("ts", late).groupBy(F.session_window("ts", after).alias("life"), *key)
    out = lives.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("value", F.struct("ts", "value")).alias("value"), F.count(F.lit(1)).alias("n"))
    return out.select(*key, "first", "last", "value", "n")


def unique_events(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: replays of the at-most-once senders do no harm."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_totals(points: DataFrame, key: list[str], folder: str, trigger: str | None = None):
    """Delta points (key..., time_ns, value) to cumulative ones, batch by batch: started stream, rows in ``folder``/out.

    Each batch is added up by Spark, by key and day and then inside the day, so no key's rows meet in one task; the totals
    so far are a table of one row a key. Both are written under the number of the batch, so a repeated batch replaces
    what an earlier attempt wrote. Rows that come in a later batch are added after it, whatever their time.
    """
    kinds = [*(F.col(k).cast("string").alias(k) for k in key), F.col("time_ns").cast("bigint").alias("time_ns"), F.col("value").cast("double").alias("value")]
    schema = ", ".join([*(f"{k} string" for k in key), "total double"])

    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        earlier = spark.read.schema(schema).parquet(f"{folder}/totals/batch={n - 1}") if n else spark.createDataFrame([], schema)
        day = F.call_function("div", F.col("time_ns"), F.lit(86_400_000_000_000))
        summed = running_sum(batch, key, ["time_ns"], "value", day, "_sum")
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key))
        before = earlier.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("total").alias("_total"))
        out = summed.join(before, same, "left").select(*key, "time_ns", (F.coalesce("_total", F.lit(0.0)) + F.col("_sum")).alias("value"))
        out.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        both = earlier.union(batch.groupBy(*key).agg(F.sum("value").alias("total")))
        both.groupBy(*key).agg(F.sum("total").alias("total")).write.mode("overwrite").parquet(f"{folder}/totals/batch={n}")

    return rules_by_batch(points.select(*kinds), add, f"{folder}/checkpoint", trigger)


def recording_rules(samples: DataFrame, key: list[str], evaluate: Callable[[DataFrame], dict[str, DataFrame]], folder: str, fold: str = "last", trigger: str | None = None, compact_every: int = 10, keep: str | None = None):
    """Evaluates recording rules over the current value of every series, once a batch: started stream.

    ``samples`` has (key..., ts, value); a ``SeriesTable`` under ``folder``/series takes in each batch, so what a batch reads is
    the series and a few changelogs, not what arrived before. ``evaluate`` gets (key..., ts, value) and returns a table for
    each rule, written to ``folder``/rules/<name>/batch=n under the number of the batch.
    """
    kinds = dict(samples.dtypes)

    def step(batch: DataFrame, n: int) -> None:
        series = SeriesTable(batch.sparkSession, f"{folder}/series", {k: kinds[k] for k in key}, fold, compact_every, keep)
        for name, table in evaluate(series.merge(batch, n)).items():
            table.write.mode("overwrite").parquet(f"{folder}/rules/{name}/batch={n}")

    return rules_by_batch(samples.select(*key, "ts", "value"), step, f"{folder}/checkpoint", trigger)


def newest_batch(spark, path: str) -> DataFrame:
    """The result of the last batch under ``path``, without its number."""
    every = spark.read.parquet(path)
    return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")


def scrapes(spark, path: str, schema: str, max_files: int | None = 1000) -> DataFrame:
    """Scraped samples as a stream: JSON lines (metric, labels..., ts, value) that targets leave under ``path``; to be
    started with the scrape interval as trigger."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)


def read_table_stream(spark, sf_dir: str, name: str, max_files: int | None = None, max_bytes: int = BATCH_BYTES) -> DataFrame:
    """A stored table as a stream of its files, with the schema of the stored files; a batch takes at most ``max_files``
    files or, if that isn't given, ``max_bytes`` of them, so the rows of one key in a batch are bounded.

    A stream's path must be a folder or a pattern; as a pattern a table that is one file is read as well.
    """
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema)
    path = f"{sf_dir}/{name}.parque[t]"
    limit = ("maxFilesPerTrigger", max_files) if max_files else ("maxBytesPerTrigger", max_bytes)
    return reader.option(*limit).parquet(path)


def run_available(table: DataFrame) -> DataFrame:
    """Runs a stream over everything available into the shared folder and reads the result."""
    folder = scratch_path(table.sparkSession, "stream")
    append_stream(table, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return table.sparkSession.read.schema(table.schema).parquet(f"{folder}/out")
