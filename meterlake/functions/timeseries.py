"""Range and instant functions over samples (metric, labels..., ts, value). Ranges are left-open: (end - range, end]."""

from __future__ import annotations

import math
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.labels import labels_of

LOOKBACK = "5 minutes"


def _series(samples: DataFrame) -> list[str]:
    return (["metric"] if "metric" in samples.columns else []) + labels_of(samples)


def at_time(end: datetime | str) -> Column:
    return F.lit(end).cast("timestamp")


def span(samples: DataFrame, end, length: str) -> DataFrame:
    """The samples of a range; the filter reaches the scan."""
    return samples.where((F.col("ts") > at_time(end) - F.expr(f"interval {length}")) & (F.col("ts") <= at_time(end)))


def instant(samples: DataFrame, end, lookback: str = LOOKBACK) -> DataFrame:
    """Current value of each series: its last sample within the look-back; older series are absent."""
    return span(samples, end, lookback).groupBy(*_series(samples)).agg(F.max_by("value", "ts").alias("value"))


def last_over_time(samples: DataFrame, end, length: str) -> DataFrame:
    return instant(samples, end, length)


def max_over_time(samples: DataFrame, end, length: str) -> DataFrame:
    return span(samples, end, length).groupBy(*_series(samples)).agg(F.max("value").alias("value"))


def count_over_time(rows: DataFrame, end, length: str, by: list[str]) -> DataFrame:
    """Rows of a log stream in a range, by ``by``; nothing at all if there is none."""
    counted = span(rows, end, length).groupBy(*by).agg(F.count(F.lit(1)).alias("value"))
    return counted.where("value > 0")


def _stretched(grown: DataFrame, begin: Column, end: Column) -> DataFrame:
    """``value`` grown between ``first`` and ``last`` sample, stretched to the range from ``begin`` to ``end``."""
    seconds = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    sampled = seconds(F.col("first"), F.col("last"))
    mean = sampled / (F.col("n") - 1)
    near = lambda gap: F.when(gap < mean * 1.1, gap).otherwise(mean / 2)
    zero = F.when((F.col("value") > 0) & (F.col("begin") >= 0), sampled * (F.col("begin") / F.col("value")))
    factor = (sampled + F.least(near(seconds(begin, F.col("first"))), zero) + near(seconds(F.col("last"), end))) / sampled
    return grown.withColumn("value", F.when(sampled > 0, F.col("value") * factor).otherwise(F.col("value")))


#: Slices that a range is cut into for summaries of growth: a series is spread over as many tasks.
SLICES = 128


def _micros(length: str) -> Column:
    return F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {length}"))


def _step(value: Column, before: Column) -> Column:
    """Growth from one sample to the next; a value below its predecessor is a restart from zero."""
    return F.when(value < before, value).otherwise(value - before)


def growth_summaries(samples: DataFrame, base: Column, width: Column) -> DataFrame:
    """(series..., slice, first, last, begin, end, gain, n): what each slice of time, ``width`` microseconds from ``base`` on, knows of the
    growth of each series: times and values of its first and last sample, growth between them, number of samples.

    Slices are left-open. Summaries of one series merge in the order of their slices (``merged_growth``), so the rows of a
    series never meet; only those of a slice do.
    """
    series = _series(samples)
    nth = F.call_function("div", F.unix_micros("ts") - base - 1, width)
    cut = samples.select(*series, "ts", "value", nth.alias("slice"))
    before = F.lag("value").over(Window.partitionBy(*series, "slice").orderBy("ts"))
    steps = cut.withColumn("step", _step(F.col("value"), before))
    ends = [F.min("ts").alias("first"), F.max("ts").alias("last"), F.min_by("value", "ts").alias("begin"), F.max_by("value", "ts").alias("end")]
    return steps.groupBy(*series, "slice").agg(*ends, F.coalesce(F.sum("step"), F.lit(0)).alias("gain"), F.count(F.lit(1)).alias("n"))


def merged_growth(summaries: DataFrame, by: list[str]) -> DataFrame:
    """(by..., value, n, first, last, begin): summaries of consecutive slices added up, with the step from each slice's last
    sample to the next one's first."""
    before = F.lag("end").over(Window.partitionBy(*by).orderBy("slice"))
    gain = F.col("gain") + F.coalesce(_step(F.col("begin"), before), F.lit(0))
    out = summaries.withColumn("_gain", gain).groupBy(*by)
    return out.agg(F.sum("_gain").alias("value"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.min_by("begin", "slice").alias("begin"))


def increase(samples: DataFrame, end, length: str, extrapolate: bool = True, slices: int = SLICES) -> DataFrame:
    """Growth of each counter series within a range, corrected for resets; series with fewer than two samples are absent.

    A value below its predecessor is a restart from zero. With ``extrapolate`` the growth between the first and the
    last sample is stretched to the range: towards each end by the gap there, but by half the mean distance between
    samples if the gap is over 1.1 times that distance, and towards the start no further than to where the counter
    would have been zero. The range is summarised in ``slices`` slices, which are then merged.
    """
    series = _series(samples)
    begin = at_time(end) - F.expr(f"interval {length}")
    width = F.greatest(F.lit(1), F.call_function("div", _micros(length) + slices - 1, F.lit(slices)))
    grown = merged_growth(growth_summaries(span(samples, end, length), F.unix_micros(begin), width), series).where("n > 1")
    grown = _stretched(grown, begin, at_time(end)) if extrapolate else grown
    return grown.select(*series, F.col("value").cast("double").alias("value"))


def seconds_of(length: str) -> Column:
    return _micros(length) / 1e6


def rate(samples: DataFrame, end, length: str, extrapolate: bool = True) -> DataFrame:
    """Growth per second of the range."""
    return increase(samples, end, length, extrapolate).withColumn("value", F.col("value") / seconds_of(length))


def increase_on_grid(samples: DataFrame, start, end, step: str, extrapolate: bool = True, length: str | None = None, steps: int = 1) -> DataFrame:
    """Growth of each series in the range before each step's end (ts). The range is the step, or ``length``, which takes up to
    ``steps`` steps.

    Where ranges overlap, they share panes: each sample is summarised once, in a pane as wide as the greatest common part
    of step and range, and the few panes of each range are merged. A step with fewer than two samples of a series is absent. ``extrapolate`` as for ``increase``.
    """
    series = _series(samples)
    width, range_ = pd.Timedelta(step) // pd.Timedelta("1us"), pd.Timedelta(length or step) // pd.Timedelta("1us")
    if not 0 < range_ <= width * steps:
        raise ValueError("a range takes up to so many steps")
    pane = math.gcd(width, range_)
    origin = F.unix_micros(at_time(start))
    base = origin - (-(-range_ // width) - 1) * width  # whole steps before the first range, no later than it begins
    rows = samples.where((F.col("ts") > F.timestamp_micros(base)) & (F.col("ts") <= at_time(end)))
    panes = growth_summaries(rows, base, F.lit(pane))
    per_step, per_range = width // pane, range_ // pane
    ends = F.sequence(F.call_function("div", F.col("slice"), F.lit(per_step)) + 1, F.call_function("div", F.col("slice") + per_range - 1, F.lit(per_step)) + 1) if range_ != width else F.array(F.col("slice") + 1)
    each = panes.withColumn("_nth", F.explode(ends)).where(F.col("slice") >= F.col("_nth") * per_step - per_range)
    each = each.withColumn("step_end", F.timestamp_micros(base + F.col("_nth") * width)).where((F.col("step_end") > at_time(start)) & (F.col("step_end") <= at_time(end)))
    out = merged_growth(each, [*series, "step_end"]).where("n > 1")
    out = _stretched(out, F.timestamp_micros(F.unix_micros("step_end") - range_), F.col("step_end")) if extrapolate else out
    return out.select(*series, F.col("step_end").alias("ts"), F.col("value").cast("double").alias("value"))


def histogram_quantile(q: float, buckets: DataFrame, by: list[str]) -> DataFrame:
    """Quantile of cumulative buckets (``le`` as text, value) for each group: linear within the bucket.

    In the bucket of +Inf the highest finite bound counts; a group without +Inf, without observations or with one bucket
    is absent. Buckets of a group are few (the bounds), so each group is folded as one array.
    """
    le = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    cells = F.sort_array(F.collect_list(F.struct(F.col("bound"), F.col("total"))))
    summed = buckets.withColumn("bound", le).groupBy(*by, "bound").agg(F.sum("value").alias("total"))
    g = summed.groupBy(*by).agg(cells.alias("c"))
    g = g.where((F.size("c") > 1) & (F.element_at("c", -1)["bound"] == float("inf")) & (F.element_at("c", -1)["total"] > 0))
    g = g.withColumn("rank", F.lit(q) * F.element_at("c", -1)["total"])
    at = F.expr("array_position(transform(c, x -> x.total >= rank), true)").cast("int")
    g = g.withColumn("at", at)
    here, prev = F.expr("c[at - 1]"), F.expr("if(at > 1, c[at - 2], null)")
    low = F.when(F.col("at") > 1, prev["bound"]).otherwise(F.when(here["bound"] <= 0, here["bound"]).otherwise(0.0))
    below = F.coalesce(prev["total"], F.lit(0.0))
    inside = F.when((F.col("at") == 1) & (here["bound"] <= 0), here["bound"]).otherwise(low + (here["bound"] - low) * F.try_divide(F.col("rank") - below, here["total"] - below))
    value = F.when(F.col("at") == F.size("c"), F.expr("c[size(c) - 2].bound")).otherwise(inside)
    return g.select(*by, value.alias("value"))


def freshness(samples: DataFrame, now) -> DataFrame:
    """Seconds since the newest sample; no row if there is none."""
    newest = samples.agg(F.max("ts").alias("ts")).where(F.col("ts").isNotNull())
    return newest.select(((F.unix_micros(at_time(now)) - F.unix_micros("ts")) / 1e6).alias("value"))


def not_expired(samples: DataFrame, now, after: str = "30 minutes") -> DataFrame:
    """Series whose last sample is at most ``after`` old; all their samples."""
    newest = F.max("ts").over(Window.partitionBy(*_series(samples)))
    return samples.withColumn("_newest", newest).where(F.col("_newest") >= at_time(now) - F.expr(f"interval {after}")).drop("_newest")


def recent_enough(rows: DataFrame, now, hours: int = 336) -> DataFrame:
    """Rows that the log store takes: not older than ``hours``."""
    return rows.where(F.col("ts") >= at_time(now) - F.expr(f"interval {hours} hours"))


def last_not_null(samples: DataFrame, by: list[str]) -> DataFrame:
    """Reducer of a panel: the newest value that isn't null."""
    return samples.where(F.col("value").isNotNull()).groupBy(*by).agg(F.max_by("value", "ts").alias("value"))
