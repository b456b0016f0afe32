"""Label matching. A missing label equals the empty text; label patterns are anchored, attribute patterns are not."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Namespaces of synthetic fixtures, kept out of every usage query; a parameter of the catalogue.
FIXTURES = r".+-fixture"
#: Columns of a samples table that aren't labels.
NOT_LABELS = ("metric", "ts", "value")


def label(df: DataFrame, name: str) -> Column:
    """The label as text, empty if it is missing from the row or from the table."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def labels_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_LABELS]


def anchored(value: Column, pattern: str) -> Column:
    """Whole-value match, as label matchers have it."""
    return value.rlike(f"^(?:{pattern})$")


def is_match(value: Column, pattern: str) -> Column:
    """Match anywhere, as attribute statements have it; false for null."""
    return F.coalesce(value.rlike(pattern), F.lit(False))


def differs(value: Column, other) -> Column:
    """``value != other`` where a missing value differs from everything."""
    return ~value.eqNullSafe(F.lit(other))


def select_series(samples: DataFrame, metric: str | None = None, eq=None, ne=None, re=None, nre=None) -> DataFrame:
    """Rows of one metric whose labels match: ``eq`` and ``ne`` by value, ``re`` and ``nre`` by anchored pattern."""
    tests = [F.col("metric") == metric] if metric else []
    tests += [label(samples, k) == v for k, v in (eq or {}).items()] + [label(samples, k) != v for k, v in (ne or {}).items()]
    tests += [anchored(label(samples, k), v) for k, v in (re or {}).items()] + [~anchored(label(samples, k), v) for k, v in (nre or {}).items()]
    return samples.where(reduce(lambda a, b: a & b, tests)) if tests else samples


def without_fixtures(samples: DataFrame, pattern: str = FIXTURES) -> DataFrame:
    """Leaves out rows of fixture namespaces; rows without a namespace stay."""
    return samples.where(~anchored(label(samples, "service_namespace"), pattern))


def choice(values: list[str] | None) -> str:
    """Pattern of a multi-select variable: an alternation of the values; none chosen means all that are present."""
    return "|".join(values) if values else ".+"


def label_value_test(df: DataFrame, name: str, pattern: str) -> Column:
    """Test of a label against the pattern of a variable."""
    return anchored(label(df, name), pattern)
