"""Rows as finished columns, for what comes after a costly expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fields_once(value: Column) -> Column:
    """The fields of a struct as columns (a null struct: nulls), by a generator: the struct is computed once for each row.

    Selecting the fields of a computed struct lets the optimizer repeat its expression for each field and filter that is read.
    """
    return F.inline(F.array(value))


def computed(table: DataFrame) -> DataFrame:
    """``table``, whose columns are computed once for each row, whatever reads them: later filters aren't pushed below them,
    where they would repeat the expressions of every column that they mention."""
    return table.select(fields_once(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in table.columns))))


def spread(table: DataFrame) -> DataFrame:
    """``table`` dealt evenly over some tasks a core if its files give fewer tasks than cores: a file of few row groups is read by
    as many tasks, which would do all the narrow work that follows."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.isStreaming or table.rdd.getNumPartitions() >= cores else table.repartition(3 * cores)
