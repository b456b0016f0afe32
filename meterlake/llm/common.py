"""Shared helpers of the training-data operators: tables, columns, written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.sources.scratch import discard, scratch_path

#: Documents handled at once inside a Python task; bounds the Python copy of an Arrow batch.
SLICE_ROWS = 256


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        folder = os.path.realpath(tempfile.mkdtemp(prefix="meterlake-"))
        sc.addPyFile(shutil.make_archive(f"{folder}/meterlake", "zip", root, "meterlake"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark reads the file until the application ends


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table under ``sf_dir``, which may be in any store that Spark reads."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Removes the files of a materialised table that nothing reads any more."""
    discard(df.sparkSession, df.scratch_path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of ``docs``; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def column(name: str) -> Column:
    """The column of that very name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame, names: list[str] | None = None) -> Column:
    """A struct of all columns of ``docs`` (or of ``names``), so that no name can clash with those that an operator uses."""
    return F.struct(*(column(c).alias(c) for c in (docs.columns if names is None else names)))


def slices(batches, rows: int = SLICE_ROWS):
    """Cuts Arrow record batches into small ones, so that Python copies of the rows stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
