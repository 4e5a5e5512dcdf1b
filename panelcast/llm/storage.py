"""Stages on shared storage and small helpers that the corpus operators have in common."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_path, ensure_checkpoint_dir, scratch_path, ship_package, write_stage

__all__ = ["arrow_type", "ascii_lower", "cut_lineage", "drop_path", "ensure_checkpoint_dir", "held_out", "read_table",
           "row_id", "scratch_path", "ship_package", "small_batches", "write_stage"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a table; any others it has are left out at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    ``lower`` does the same on pure ASCII and is much cheaper than ``translate``.
    """
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, LOWER)))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def arrow_type(df: DataFrame, column: str):
    """The Arrow type of a column."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """A number for each row.  Write the result before using it twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def small_batches(spark: SparkSession, rows: int = 2000, mb: int = 16) -> None:
    """Before Arrow functions: the package is on the executors, and a batch ends at ``rows`` rows or
    ``mb`` MB, so that long texts don't pile up in a task."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))
