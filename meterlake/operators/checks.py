"""Data-quality checks: each returns the rows that break a rule; empty means passed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def containing(table: DataFrame, sentinels: list[str]) -> DataFrame:
    """Rows in which any column holds one of the texts, however nested.

    Each row passes through a generator as one struct, so that the test reads finished columns; pushed below the
    projections of a long pipeline it would repeat their expressions for every column that it reads.
    """
    rows = table.select(F.explode(F.array(F.struct("*"))).alias("_row"))
    whole = F.to_json("_row")
    return rows.where(reduce(lambda a, b: a | b, [whole.contains(s) for s in sentinels])).select("_row.*")


def forbidden_keys(table: DataFrame, bag: str, forbidden: list[str]) -> DataFrame:
    """(key, n) of forbidden keys that a map column still has."""
    return table.select(F.explode(F.map_keys(bag)).alias("key")).where(F.col("key").isin(*forbidden)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def missing_values(table: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """(missing, unexpected): the difference of the distinct values and a list."""
    wanted = F.array(*map(F.lit, expected))
    seen = F.coalesce(F.collect_set(column), F.array().cast("array<string>"))
    return table.groupBy().agg(seen.alias("s")).select(F.sort_array(F.array_except(wanted, "s")).alias("missing"), F.sort_array(F.array_except("s", wanted)).alias("unexpected"))


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cardinality(table: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """(found, expected) if the number of distinct keys isn't the expected one."""
    return table.select(*keys).distinct().groupBy().agg(F.count(F.lit(1)).alias("found")).where(F.col("found") != expected).withColumn("expected", F.lit(expected))


def not_constant(table: DataFrame, column: str, value: str) -> DataFrame:
    return table.where(~F.col(column).eqNullSafe(F.lit(value)))


def outside_domain(table: DataFrame, domains: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``violations``: columns whose value isn't in its domain (null is allowed unless the column is required)."""
    tests = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.lit(c)) for c, values in domains.items()]
    tests += [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in required]
    return table.withColumn("violations", F.array_compact(F.array(*tests))).where(F.size("violations") > 0)


# Names of the rubric and the kinds it may have.
RUBRIC_KINDS = ("CATEGORICAL", "FREEFORM")


def rubric_faults(rubric: DataFrame, names: list[str]) -> DataFrame:
    """(name, fault) of an annotation rubric (name, type, labels array<struct<label,score>>)."""
    fault = (
        F.when(~F.col("name").isin(*names), "unexpected name").when(~F.col("type").isin(*RUBRIC_KINDS), "unknown type")
        .when((F.col("type") == "CATEGORICAL") & (F.size(F.coalesce("labels", F.array())) == 0), "no labels")
        .when(F.size(F.array_distinct(F.transform("labels", lambda x: x["label"]))) < F.size("labels"), "repeated label")
    )
    rows = rubric.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name")))
    return rows.select("name", F.when(F.col("n") > 1, "repeated name").otherwise(fault).alias("fault")).where(F.col("fault").isNotNull())


def config_diff(desired: DataFrame, actual: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key..., state): missing in actual, drifted in a column, or not assigned (only in actual)."""
    d = desired.select(*key, F.struct(*columns).alias("d"))
    a = actual.select(*(F.col(k).alias(f"_{k}") for k in key), F.struct(*columns).alias("a"))
    test: Column = reduce(lambda x, y: x & y, [d[k].eqNullSafe(a[f"_{k}"]) for k in key])
    joined = d.join(a, test, "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"d.{c}").eqNullSafe(F.col(f"a.{c}")) for c in columns])
    state = F.when(F.col("a").isNull(), "missing").when(F.col("d").isNull(), "not_assigned").when(~same, "drifted")
    return joined.select(*(F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in key), state.alias("state")).where(F.col("state").isNotNull())


def repeats_within(table: DataFrame, keys: list[str], gap: str, ts: str = "ts") -> DataFrame:
    """Rows that repeat the same keys within a gap after the row before: suspected duplicate work."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    return table.withColumn("previous", before).where(F.col(ts) - F.col("previous") <= F.expr(f"interval {gap}"))


def unpaired(samples: DataFrame, copies: dict[str, str], by: list[str]) -> DataFrame:
    """(metric, by..., native, copied): points of a copied metric whose copy is missing or has another value."""
    back = F.create_map(*(F.lit(x) for native, copy in copies.items() for x in (copy, native)))
    known = samples.where(F.col("metric").isin(*copies, *copies.values()))
    native = F.coalesce(back[F.col("metric")], F.col("metric"))
    value = lambda own: F.max(F.when(F.col("metric").isin(*own), F.col("value")))
    both = known.groupBy(native.alias("_native"), *by).agg(value(copies).alias("native"), value(copies.values()).alias("copied"))
    return both.where(F.col("native").isNotNull() & ~F.col("native").eqNullSafe(F.col("copied"))).withColumnRenamed("_native", "metric")


def late_first(work: DataFrame, session: str, check: str, act: str) -> DataFrame:
    """(session, checked, acted): sessions whose first ``check`` comes after their first ``act``, or not at all."""
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    both = work.groupBy(session).agg(first(check).alias("checked"), first(act).alias("acted"))
    return both.where(F.col("acted").isNotNull() & (F.col("checked").isNull() | (F.col("checked") > F.col("acted")))).select(session)


def without_reason(work: DataFrame, kind: str, reason: str) -> DataFrame:
    """Rows of a kind that give no reason."""
    return work.where((F.col("kind") == kind) & (F.coalesce(F.trim(reason), F.lit("")) == ""))


def over_budget(work: DataFrame, by: list[str], amount: Column, budget: float) -> DataFrame:
    """(by..., total) of those that use more than a budget."""
    return work.groupBy(*by).agg(F.sum(amount).alias("total")).where(F.col("total") > budget)


def overlapping(work: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Rows that begin before an earlier one of the same keys has ended."""
    earlier = Window.partitionBy(*by).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    return work.withColumn("_until", F.max(end).over(earlier)).where(F.col(start) < F.col("_until")).drop("_until")


def contradicted(claims: DataFrame, failures: DataFrame, session: str) -> DataFrame:
    """Claims of success in a session that a failure at the same time or later follows."""
    last = failures.groupBy(session).agg(F.max("ts").alias("_failed"))
    return claims.join(last, session).where(F.col("_failed") >= F.col("ts")).drop("_failed")


def order_faults(stages: list[str], expected: tuple[str, ...]) -> list[str]:
    """Stages that are missing, unknown or out of their order."""
    kept = [s for s in stages if s in expected]
    wrong = [s for s, want in zip(kept, [e for e in expected if e in kept]) if s != want]
    return sorted({*(e for e in expected if e not in stages), *(s for s in stages if s not in expected), *wrong})
