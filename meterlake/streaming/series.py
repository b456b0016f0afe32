"""The newest sample of each series as a compacted table that micro-batches are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.sources.scratch import discard


class SeriesTable:
    """One row a series (key..., ts, value) under ``folder``, as a changelog with a full table every so many batches.

    Batch n writes only the series it touched (``changes/batch=n``); after every ``compact_every`` batches the whole table is
    written (``full/batch=n``). So the state before a batch is read from the last full table and fewer than
    ``compact_every`` changes after it, whatever n is. Everything is written under the number of its batch, so a batch that
    is repeated replaces what an earlier attempt wrote; what no repeated batch can need is removed.

    ``fold`` is "last" (a series' newest sample counts, of equal times the later batch's, then the greater value) or "sum"
    (samples are deltas and add up). A null value is a tombstone: the series has ended, and samples older than that don't
    bring it back. With ``keep`` full tables leave out series and tombstones whose newest sample is older than that before the
    newest sample of all; without it all stay.
    """

    def __init__(self, spark: SparkSession, folder: str, key: dict[str, str], fold: str = "last", compact_every: int = 10, keep: str | None = None):
        if fold not in ("last", "sum"):
            raise ValueError(f"unknown fold: {fold}")
        self.spark, self.folder, self.key, self.fold, self.every, self.keep = spark, folder, list(key), fold, compact_every, keep
        self.schema = ", ".join([*(f"`{k}` {t}" for k, t in key.items()), "ts timestamp", "n bigint", "value double"])

    def _read(self, *paths: str) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*(f"{self.folder}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], self.schema)

    def _folded(self, rows: DataFrame) -> DataFrame:
        if self.fold == "sum":
            newest = [F.max("ts").alias("ts"), F.max("n").alias("n"), F.sum("value").alias("value")]
            return rows.groupBy(*self.key).agg(*newest)
        return rows.groupBy(*self.key).agg(F.max(F.struct("ts", "n", "value")).alias("_s")).select(*self.key, "_s.*")

    def before(self, n: int) -> DataFrame:
        """The rows that make up the state before batch ``n``: those of the last full table and of the changes since."""
        full = n // self.every * self.every - 1
        return self._read(*([f"full/batch={full}"] if full >= 0 else []), *(f"changes/batch={k}" for k in range(full + 1, n)))

    def merge(self, batch: DataFrame, n: int) -> DataFrame:
        """Takes in the samples (key..., ts, value) of batch ``n``; returns the live series (key..., ts, value) after it."""
        own = batch.select(*self.key, F.col("ts").cast("timestamp").alias("ts"), F.lit(n).cast("bigint").alias("n"), F.col("value").cast("double").alias("value"))
        self._folded(own).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={n}")
        state = self._folded(self.before(n).unionByName(self._read(f"changes/batch={n}")))
        if (n + 1) % self.every == 0:
            self._kept(state).write.mode("overwrite").parquet(f"{self.folder}/full/batch={n}")
            for k in range(n - 2 * self.every + 1, n - self.every + 1):
                if k >= 0:
                    discard(self.spark, f"{self.folder}/changes/batch={k}")
            if n - 2 * self.every >= 0:
                discard(self.spark, f"{self.folder}/full/batch={n - 2 * self.every}")
            state = self._read(f"full/batch={n}")
        return state.where(F.col("value").isNotNull()).select(*self.key, "ts", "value")

    def _kept(self, state: DataFrame) -> DataFrame:
        if not self.keep:
            return state
        newest = state.agg(F.max("ts")).first()[0]
        return state.where(F.col("ts") >= F.lit(newest) - F.expr(f"interval {self.keep}"))
