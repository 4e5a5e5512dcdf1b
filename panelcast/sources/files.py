"""CSV and parquet sources and sinks.

* headered CSV with a declared schema, the text ``NA`` read as NULL;
* lookups whose columns are addressed by position;
* a scenario x model matrix of files read with one glob, the identity of each
  row taken from its file path;
* result tables written as headered CSV (NULL written as ``NA``), forecasts
  partitioned by scenario and model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _fields(spark: SparkSession, schema: StructType | str) -> StructType:
    return spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Headered CSV by column name: the columns of ``schema``, wherever they stand, cast; others are left out.

    The header is read first (one line); every file must have the same one, a line with another
    number of fields or a value that can't be cast raises, and ``NA`` is NULL.  No inference pass."""
    fields = _fields(spark, schema)
    header = spark.read.option("header", True).csv(path).columns
    lower = {h.lower(): h for h in header}
    missing = [f.name for f in fields if f.name.lower() not in lower]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    text = StructType([StructField(h, StringType()) for h in header])
    raw = (spark.read.schema(text).option("header", True).option("enforceSchema", False)
           .option("nullValue", "NA").option("mode", "FAILFAST").csv(path))
    return raw.select(*[F.col(f"`{lower[f.name.lower()]}`").cast(f.dataType).alias(f.name) for f in fields],
                      F.col("_metadata.file_path").alias("_path"))


def read_panel(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Headered CSV by column name (see :func:`read_csv`); extra columns are left out."""
    return read_csv(spark, path, schema).drop("_path")


def read_lookup(spark: SparkSession, path: str, positions: Sequence[int] = (1, 36),
                names: Sequence[str] = ("unit", "area"),
                types: Sequence[str] = ("bigint", "double")) -> DataFrame:
    """Keep lookup columns by 1-based position, typed and renamed, then distinct.

    Only the header is read to resolve positions (all columns as text, no
    inference pass); the positional columns are then cast.
    """
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    if max(positions) > len(raw.columns):
        raise ValueError(f"lookup has {len(raw.columns)} columns, position {max(positions)} asked")
    picked = [F.col(f"`{raw.columns[p - 1]}`").cast(t).alias(n)
              for p, n, t in zip(positions, names, types)]
    return raw.select(*picked).distinct()


def read_scenario_matrix(spark: SparkSession, glob: str, schema: StructType | str,
                         pattern: str = r"all_([^/]+)_([^_/]+)\.csv",
                         names: Sequence[str] = ("scenario", "model")) -> DataFrame:
    """S3: one read over all scenario files; each regex group of ``pattern``
    applied to the file path becomes a column (the reference's double loop).
    A file whose path doesn't match raises."""
    df = read_csv(spark, glob, schema)
    return df.select("*", *names_in_path(F.col("_path"), pattern, names)).drop("_path")


def names_in_path(path: Column, pattern: str, names: Sequence[str]) -> list[Column]:
    """Each regex group of ``pattern`` in a file's path as a column; a path that doesn't match raises."""
    part = [F.regexp_extract(path, pattern, i + 1) for i in range(len(names))]
    return [F.when(p != "", p).otherwise(F.raise_error(F.concat(F.lit("no scenario in the name of "), path))).alias(n)
            for p, n in zip(part, names, strict=True)]


def write_table(df: DataFrame, path: str, single_file: bool = False) -> None:
    """K1/K3: headered CSV, no row index, NULL as ``NA``; the folder is created.

    ``single_file`` is for small reports only; large tables keep their partitions."""
    out = df.coalesce(1) if single_file else df
    (out.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path))


def write_scenarios(df: DataFrame, path: str, keys: Sequence[str] = ("scenario", "model")) -> None:
    """K2: one folder per (scenario, model) -- a partitioned write instead of 16 files.

    No repartition by the keys: one hot scenario would land in a single task.
    Each task writes its own share of every folder."""
    (df.write.mode("overwrite").partitionBy(*keys)
     .option("header", True).option("nullValue", "NA").csv(path))


def read_scenarios(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read back K2 output; ``scenario``/``model`` come from the folder names,
    so a filter on them prunes folders.  A malformed line or another header raises."""
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("nullValue", "NA").option("mode", "FAILFAST").csv(path))


def save_parquet(df: DataFrame, path: str) -> None:
    """K4: model tables (forest nodes, leaves) as parquet."""
    df.write.mode("overwrite").parquet(path)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Model tables back."""
    return spark.read.parquet(path)
