"""Scenario files scored as they arrive.

The reference reads one scenario file after another, scores it and writes two
tables.  As a Structured Streaming query the folder of scenario files is a
file source; each micro-batch (one or more new files) goes through the same
forecast as the batch job (identity from the file path, restriction to the
cohort's units, start-year filter, scoring).  Each batch's forecast goes to a folder of its own
(``epoch=N``), partitioned by scenario and model, and is written with overwrite: a batch
that is replayed after a crash replaces its own files, so every row is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import scenario
from ..sources import files
from ..spec import PanelSpec


def scenario_stream(spark: SparkSession, in_glob: str, schema: StructType | str,
                    pattern: str = r"all_([^/]+)_([^_/]+)\.csv", files_per_batch: int = 16) -> DataFrame:
    """Streaming read of scenario CSV files; scenario/model come from each file's path.

    As in the batch reader, a path that doesn't match, another header or a malformed line stops the query."""
    s = (spark.readStream.schema(schema).option("header", True).option("nullValue", "NA")
         .option("enforceSchema", False).option("mode", "FAILFAST").option("maxFilesPerTrigger", files_per_batch).csv(in_glob))
    return s.select("*", *files.names_in_path(F.col("_metadata.file_path"), pattern, ("scenario", "model")))


def write_batch(forecast: DataFrame, out_dir: str, epoch: int) -> None:
    """One batch's forecast in its own folder, compressed; writing it again gives the same files."""
    (forecast.write.mode("overwrite").partitionBy("scenario", "model").option("compression", "gzip")
     .option("header", True).option("nullValue", "NA").csv(f"{out_dir}/epoch={epoch}"))


def read_forecasts(spark: SparkSession, out_dir: str, schema: StructType | str) -> DataFrame:
    """All batches' forecasts."""
    return files.read_scenarios(spark, out_dir, schema).drop("epoch")


ROLLUP_SCHEMA = "date DATE, n LONG, n_pred LONG, pred_sum DOUBLE, scenario STRING, model STRING"


def write_rollup(forecast: DataFrame, out_dir: str, epoch: int) -> None:
    """One batch's partial rollup (rows, rows with a prediction, their sum) in its own folder; a replay replaces it."""
    part = forecast.groupBy("scenario", "model", "date").agg(
        F.count(F.lit(1)).alias("n"), F.count("pred").alias("n_pred"), F.sum("pred").alias("pred_sum"))
    part.write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")


def read_rollup(spark: SparkSession, out_dir: str) -> DataFrame:
    """A4 over all batches: one row a (scenario, model, date), also where its files came in several
    batches; the sum is NULL where a prediction is."""
    parts = spark.read.schema(f"{ROLLUP_SCHEMA}, epoch LONG").parquet(out_dir)
    return parts.groupBy("scenario", "model", "date").agg(
        F.sum("n").alias("n"), F.when(F.sum("n") == F.sum("n_pred"), F.sum("pred_sum")).alias("pred_sum"))


def start_forecast_stream(spark: SparkSession, in_glob: str, schema: StructType | str,
                          units: DataFrame, spec: PanelSpec,
                          score: Callable[[DataFrame], DataFrame],
                          out_dir: str, checkpoint: str, once: bool = True,
                          files_per_batch: int = 16, rollup_dir: str | None = None) -> StreamingQuery:
    """Score every new scenario file with ``score`` and write the forecast, partitioned by
    (scenario, model); with ``rollup_dir`` also its partial rollups, which :func:`read_rollup` adds up.
    ``once``: process what is there and stop.  Hand in ``units`` (and what
    ``score`` reads) as written tables, or each batch computes them anew."""
    src = scenario_stream(spark, in_glob, schema, files_per_batch=files_per_batch)

    def batch(df: DataFrame, epoch: int) -> None:
        forecast = scenario.scenario_forecast(df, units, spec, score)
        write_batch(forecast, out_dir, epoch)
        if rollup_dir is not None:
            write_rollup(forecast, rollup_dir, epoch)

    w = src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
