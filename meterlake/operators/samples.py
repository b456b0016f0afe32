"""From data points to samples: names and labels, running totals, histogram buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.sources.otlp import text_of
from meterlake.sources.scratch import scratch_path

DELTA = 1


def running_sum(rows: DataFrame, by: list[str], order: list[str], value: str, bucket: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the running sum of ``value`` by ``by`` in ``order``, whose values ascend with ``bucket``.

    Totals by key and bucket come first, map-side combined; their prefix over the few buckets of a key is joined back, and
    the sum inside a bucket is added. So a key with most of the rows is spread over its buckets.
    """
    cut = rows.withColumn("_bucket", bucket)
    totals = cut.groupBy(*by, "_bucket").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(by)), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_bucket") == F.col("_b")
    for n, k in enumerate(by):
        same &= F.col(k).eqNullSafe(F.col(f"_k{n}"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(before, same).withColumn(name, F.col("_before") + F.sum(value).over(inside)).select(*rows.columns, name)


def safe_name(name: Column) -> Column:
    """A metric or label name with underscores for what names may not hold; no suffix for type or unit."""
    clean = F.regexp_replace(name, r"[^a-zA-Z0-9_:]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("_"), clean)).otherwise(clean)


def promoted_labels(df: DataFrame) -> Column:
    """map<string,string> of resource and point attributes under safe names; the point's win."""
    flat = lambda bag: F.transform_values(F.transform_keys(bag, lambda k, _: safe_name(k)), lambda _, v: text_of(v))
    own, shared = flat(F.col("attributes")), flat(F.col("resource"))
    return F.map_concat(F.map_filter(shared, lambda k, _: ~F.map_contains_key(own, k)), own)


def to_long(points: DataFrame) -> DataFrame:
    """(metric, labels map, series, kind, temporality, time_ns, ts, value, count, bucket_counts, bounds) of points."""
    named = points.withColumn("labels", promoted_labels(points)).withColumn("metric", safe_name(F.col("metric")))
    series = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))
    return named.select("metric", "labels", series.alias("series"), "kind", "temporality", "time_ns", "ts", "value", "count", "bucket_counts", "bounds")


def reaggregate(long: DataFrame) -> DataFrame:
    """Points that have become one series by losing attributes are added up (gauges: the greatest stays); cells of
    histograms only where their bounds agree."""
    total = F.when(F.first("kind") == "gauge", F.max("value")).otherwise(F.sum("value"))
    add = F.aggregate(F.collect_list("bucket_counts"), F.array().cast("array<bigint>"), lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))
    out = long.groupBy("metric", "series", "kind", "temporality", "time_ns", "ts", "bounds").agg(F.any_value("labels").alias("labels"), total.alias("value"), F.sum("count").alias("count"), add.alias("bucket_counts"))
    return out.select(long.columns)


def to_samples(long: DataFrame, labels: list[str]) -> DataFrame:
    """(metric, labels..., le, ts, value): numbers as they are, histograms as _bucket by upper bound (cumulative), _sum, _count.

    ``labels`` become columns, null where a series lacks them. Delta points become running totals in time order, for
    each series and bucket on its own, in two levels (``running_sum``), so a long series is spread over its days.
    """
    delta = ((F.col("kind") != "gauge") & (F.coalesce("temporality", F.lit(2)) == DELTA)).alias("delta")
    sample = lambda suffix, le, value: F.struct(F.concat("metric", F.lit(suffix)).alias("metric"), le.cast("string").alias("le"), value.cast("double").alias("value"))
    none = F.lit(None)
    below = F.transform("bucket_counts", lambda _, i: F.aggregate(F.slice("bucket_counts", 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    bound = lambda i: F.coalesce(F.regexp_replace(F.get("bounds", i).cast("string"), r"\.0$", ""), F.lit("+Inf"))
    cells = F.coalesce(F.transform(below, lambda c, i: sample("_bucket", bound(i), c)), F.array())
    parts = F.when(F.col("kind") == "histogram", F.concat(cells, F.array(sample("_sum", none, F.col("value")), sample("_count", none, F.col("count"))))).when(F.col("kind").isNotNull(), F.array(sample("", none, F.col("value"))))
    # one pass over the points: a union of numbers, cells, sums and counts would compute all that is before it four times
    rows = long.select("labels", "series", "time_ns", "ts", delta, F.inline(parts))
    day = F.call_function("div", F.col("time_ns"), F.lit(86_400_000_000_000))
    path = scratch_path(rows.sparkSession, "samples")
    rows.write.option("compression", "zstd").parquet(path)  # read twice by the running sum
    rows = running_sum(rows.sparkSession.read.schema(rows.schema).parquet(path), ["metric", "series", "le"], ["time_ns"], "value", day, "_sum")
    total = F.when(F.col("delta"), F.col("_sum")).otherwise(F.col("value"))
    return rows.select("metric", *(F.col("labels")[k].alias(k) for k in labels), "le", "ts", total.alias("value"))
