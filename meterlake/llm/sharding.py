"""Contiguous shards of nearly equal bytes: prefix sums over all documents from the totals of range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import column, materialize, whole_row

#: Digits of the products that place a document: sizes up to 10^18 bytes in all, times twice the number of shards.
EXACT = "decimal(38,0)"


def prefix_sums(rows: DataFrame, order: list[Column], size: str, label: str) -> DataFrame:
    """``rows`` with ``_before`` (sum of ``size`` over all rows before it in ``order``), ``_rank`` (their number) and ``_all``
    (sum over all rows).

    Rows are dealt by ranges of ``order`` and written with the number of their partition; then only the totals of
    partitions are added up over the table, and each row's own sum is taken inside its partition. ``order`` must order
    rows that differ, and its last key should tell equal rows apart, so that no partition outgrows the others.
    """
    keys = {f"_o{k}": c for k, c in enumerate(order)}
    dealt = rows.withColumns(keys).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, label)
    totals = dealt.groupBy("_part").agg(F.sum(size).alias("_size"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sum_of = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    starts = totals.select("_part", sum_of("_size", earlier).alias("_s"), sum_of("_rows", earlier).alias("_r"), F.sum("_size").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumns({"_own": sum_of(size, inside), "_nth": F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0))})
    placed = placed.join(F.broadcast(starts), "_part")  # at most one row a shuffle partition
    return placed.withColumns({"_before": F.col("_s") + F.col("_own"), "_rank": F.col("_r") + F.col("_nth")}).drop(*keys, "_part", "_s", "_r", "_own", "_nth")


def shard_by_bytes(docs: DataFrame, shards: int = 8, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, size long, text_crc32 long, shard int, slot long, row struct of ``carry``, by default all columns).

    Documents stand in the order of their ids and are cut at equal targets: a document belongs to the shard in whose
    share of all bytes its middle lies, so a shard misses its share by at most half a document at either end. ``size`` is
    the text's UTF-8 bytes plus one; ``slot`` counts a shard's documents from 0. A null text has size 1; null ids come
    first; rows of one id go by checksum and size of their texts, equal rows by where they are stored; extra columns of
    any name go into ``row``; an empty table gives none. A document larger than a share may leave shards empty.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce(column(text_col), F.lit("")).cast("binary")
    names = docs.columns if carry is None else carry
    rows = docs.select(
        column(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"),
        (whole_row(docs, names) if names else F.lit(None).cast("void")).alias("row"), F.monotonically_increasing_id().alias("_at"),
    )
    placed = prefix_sums(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_at")], "size", "shards").drop("_at")
    middle = (2 * F.col("_before") + F.col("size")).cast(EXACT) * F.lit(shards).cast("decimal(9,0)")
    placed = placed.withColumn("shard", F.least(F.call_function("div", middle.cast(EXACT), (2 * F.col("_all")).cast(EXACT)), F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    out = placed.join(F.broadcast(first), "shard")  # one row a shard
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"), *(["row"] if names else []))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all columns of ``docs`` to ``path``/shard=n, files and rows in the order of the ids."""
    placed = shard_by_bytes(docs, shards, None, id_col, text_col)
    dealt = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.select("shard", "slot", "row").write.partitionBy("shard").option("compression", "zstd").parquet(path)
