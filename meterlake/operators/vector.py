"""Vector algebra: aggregation, set operations and arithmetic on labelled values. Missing labels compare as equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.labels import labels_of


def _with(df: DataFrame, labels: list[str]) -> DataFrame:
    """``df`` with every label of ``labels``; those it lacks are null."""
    return df.withColumns({c: F.lit(None).cast("string") for c in labels if c not in df.columns})


def sum_by(v: DataFrame, by: list[str]) -> DataFrame:
    return _with(v, by).groupBy(*by).agg(F.sum("value").alias("value"))


def max_by_labels(v: DataFrame, by: list[str]) -> DataFrame:
    return _with(v, by).groupBy(*by).agg(F.max("value").alias("value"))


def fold(v: DataFrame, function=F.sum) -> DataFrame:
    """One value over all series; no row, not null or zero, if there is none."""
    return v.groupBy().agg(function("value").alias("value"), F.count("value").alias("_n")).where("_n > 0").select("value")


def _partners(df: DataFrame, on: list[str]) -> DataFrame:
    """The distinct ``on`` labels of ``df`` under names of their own, missing ones as empty texts."""
    return _with(df, on).select(*(F.coalesce(F.col(c), F.lit("")).alias(f"_r_{c}") for c in on)).distinct()


def _match(right: DataFrame, on: list[str]) -> Column:
    tests = [F.coalesce(F.col(c), F.lit("")) == right[f"_r_{c}"] for c in on]
    return reduce(lambda a, b: a & b, tests)


def vec_and(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` where ``right`` has a series with the same ``on`` labels."""
    right = _partners(right, on)
    return _with(left, on).join(right, _match(right, on), "left_semi")


def vec_unless(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` where ``right`` has no series with the same ``on`` labels."""
    right = _partners(right, on)
    return _with(left, on).join(right, _match(right, on), "left_anti")


def vec_or(left: DataFrame, right: DataFrame, on: list[str] | None = None) -> DataFrame:
    """All of ``left`` and of ``right`` what has label sets that ``left`` lacks."""
    labels = list(dict.fromkeys([*labels_of(left), *labels_of(right)]))
    left, right = _with(left, labels).select(*labels, "value"), _with(right, labels).select(*labels, "value")
    return left.unionByName(vec_unless(right, left, on or labels))


def vec_binop(left: DataFrame, right: DataFrame, on: list[str], op, keep: list[str] | None = None) -> DataFrame:
    """``op(left value, right value)`` of one-to-one matching series; those without a partner vanish."""
    left, right = _with(left, on), _with(right, on)
    r = right.select(*(F.coalesce(F.col(c), F.lit("")).alias(f"_r_{c}") for c in on), F.col("value").alias("_r"))
    test = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) == F.col(f"_r_{c}") for c in on])
    return left.join(r, test).select(*(keep or labels_of(left)), op(F.col("value"), F.col("_r")).alias("value"))


def group_left(left: DataFrame, one: DataFrame, on: list[str], carry: list[str], op) -> DataFrame:
    """Many-to-one: ``op(left, one)`` with the ``carry`` labels of the "one" side, a rate card or another table that is
    a few rows long and therefore broadcast by its size. Unmatched rows of ``left`` vanish: unknown isn't zero."""
    r = one.select(*(F.coalesce(F.col(c), F.lit("")).alias(f"_r_{c}") for c in on), *carry, F.col("value").alias("_r"))
    test = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit("")) == F.col(f"_r_{c}") for c in on])
    return left.drop(*[c for c in carry if c in left.columns]).join(r, test).select(*[c for c in left.columns if c not in (*carry, "value")], *carry, op(F.col("value"), F.col("_r")).alias("value"))


def duplicate_keys(one: DataFrame, on: list[str]) -> DataFrame:
    """Keys that the "one" side of a many-to-one match has twice, which would be an error there."""
    return one.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ratio(v: DataFrame, part: Column, least: float | None = None) -> DataFrame:
    """sum(value where part) / sum(value) in one pass. With ``least`` the denominator is at least that, else a zero
    denominator gives null. Absent if either sum has no series."""
    a = v.groupBy().agg(F.sum(F.when(part, F.col("value"))).alias("p"), F.count(F.when(part, F.lit(1))).alias("np"), F.sum("value").alias("t"), F.count("value").alias("nt")).where("np > 0 and nt > 0")
    bottom = F.greatest(F.col("t"), F.lit(least)) if least is not None else F.col("t")
    return a.select(F.try_divide(F.col("p"), bottom).alias("value"))


def reconcile(left: DataFrame, right: DataFrame, on: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Keys whose two totals differ by over ``tolerance``, or that one side lacks: (on..., left_value, right_value)."""
    a = left.select(*on, F.col("value").alias("left_value"))
    b = right.select(*(F.col(c).alias(f"_r_{c}") for c in on), F.col("value").alias("right_value"))
    test = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    joined = a.join(b, test, "full_outer").select(*(F.coalesce(F.col(c), F.col(f"_r_{c}")).alias(c) for c in on), "left_value", "right_value")
    return joined.where(F.col("left_value").isNull() | F.col("right_value").isNull() | (F.abs(F.col("left_value") - F.col("right_value")) > tolerance))
