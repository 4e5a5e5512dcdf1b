"""Queries: CSV sources and sinks round trips.

Each query writes a table Spark derived from the test tables into a fresh
folder under the shared checkpoint directory and reads it back through the
source under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..sources.panel import panel_table as panel
from ..session import cut_lineage, scratch_path
from .q_accuracy import ERR_COLS, ERR_D, errors_of
from .q_cohort import _PCOLS, PANEL_COLS, PANEL_DOUBLES
from .q_scenario import forecast, lookup_table, scen_ctes
from ..operators import scenario
from ..sources.panel import PANEL_SQL
from .oracle_sql import ols_scored_ctes
from .registry import query
from ..spec import ANALOGUE as S

PANEL_SCHEMA = ("unit BIGINT, year INT, month INT, wyear INT, target_a DOUBLE, target_b DOUBLE, "
                "cover DOUBLE, tax DOUBLE, lines BIGINT, size DOUBLE, price DOUBLE, bal DOUBLE, "
                "nation INT, project INT")
ERR_SCHEMA = ("unit BIGINT, year INT, month INT, wyear INT, actual DOUBLE, pred DOUBLE, "
              "error DOUBLE, error_pct DOUBLE")
SCEN_SCHEMA = ("unit BIGINT, date STRING, month INT, wyear INT, year INT, tax DOUBLE, lines DOUBLE, "
               "size DOUBLE, price DOUBLE, bal DOUBLE, nation INT, project INT")
FORECAST_SCHEMA = "unit BIGINT, date DATE, month INT, wyear INT, year INT, pred DOUBLE, scenario STRING, model STRING"


def write_scenario_files(scen: DataFrame, path: str) -> None:
    """A folder of CSV files run_all_{scenario}_{model}.csv for each scenario and model.

    A task sorts its rows by file before it writes them: rebalanced, it has some 64 MB of them, however large the part of the
    panel was that it read, and a hot file is divided among tasks."""
    named = scen.withColumn("file", F.concat(F.lit("run_all_"), "scenario", F.lit("_"),
                                             "model", F.lit(".csv"))).drop("scenario", "model")
    named.hint("rebalance", "file").write.mode("overwrite").partitionBy("file").option("header", True).csv(path)


def write_scenario_grid(panel: DataFrame, path: str) -> None:
    """The files of :func:`write_scenario_files` for all scenarios and models, one after the other and compressed: the panel is
    read once for each, so no copy of its rows is sent or sorted, and the files are all that is on disk."""
    for cell in scenario.scenario_grid():
        scen = scenario.scenario_table(panel, [cell]).drop("scenario", "model")
        (scen.write.mode("overwrite").option("header", True).option("compression", "gzip")
         .csv(f"{path}/file=run_all_{cell[0]}_{cell[1]}.csv"))


@query("scan_csv_roundtrip", f"WITH {PANEL_SQL} SELECT {_PCOLS} FROM panel", PANEL_DOUBLES)
def q_scan_csv_roundtrip(spark, d):
    """The panel written as headered CSV and read back with a declared schema."""
    path = scratch_path(spark, "panel-csv")
    files.write_table(panel(spark, d).select(*PANEL_COLS), path)
    return files.read_panel(spark, path, PANEL_SCHEMA)


@query("lookup_positional",
       "SELECT DISTINCT s_suppkey AS unit, s_acctbal AS area FROM supplier", ("area",))
def q_lookup_positional(spark, d):
    """A 37-column lookup CSV; columns 1 and 36 kept by position, then distinct."""
    path = scratch_path(spark, "lookup-csv")
    files.write_table(lookup_table(spark, d), path)
    return files.read_lookup(spark, path, (1, 36))


@query("scan_scenario_matrix", scen_ctes() + """
SELECT unit, date, wyear, lines, scenario, model FROM scen""", ("lines",))
def q_scan_scenario_matrix(spark, d):
    """S3: 16 files named ..._{scenario}_{model}.csv read by one glob; the
    identity columns come from the file path."""
    path = scratch_path(spark, "scenario-files")
    write_scenario_grid(panel(spark, d), path)
    back = files.read_scenario_matrix(spark, f"{path}/*/*.csv.gz", SCEN_SCHEMA)
    return back.select("unit", "date", "wyear", "lines", "scenario", "model")


@query("sink_csv_roundtrip", ols_scored_ctes() + f"""
SELECT {ERR_COLS} FROM errors WHERE split = 'test'""", ERR_D)
def q_sink_csv_roundtrip(spark, d):
    """K1/K3: the error table written as CSV (NULL as NA) into a new folder, read back."""
    path = scratch_path(spark, "errors-csv") + "/run1/grid"
    files.write_table(errors_of(spark, d, "test"), path)
    return files.read_panel(spark, path, ERR_SCHEMA)


@query("sink_partitioned_roundtrip", scen_ctes() + """
SELECT unit, date, month, wyear, year, pred, scenario, model FROM fc""", ("pred",))
def q_sink_partitioned_roundtrip(spark, d):
    """K2: forecasts written one folder per (scenario, model), read back with the
    identity recovered from the folder names."""
    path = scratch_path(spark, "forecast-parts")
    files.write_scenarios(forecast(spark, d), path)
    return files.read_scenarios(spark, path, FORECAST_SCHEMA)


@query("sink_rollup_roundtrip", scen_ctes() + """
SELECT scenario, model, date, CAST(count(*) AS BIGINT) AS n,
       CASE WHEN count(*) = count(pred) THEN sum(pred) END AS pred_sum
FROM fc GROUP BY scenario, model, date""", ("pred_sum",))
def q_sink_rollup_roundtrip(spark, d):
    """K2: the forecast's rollup, the second table of each scenario and model, written and read back."""
    path = scratch_path(spark, "rollup-parts")
    files.write_scenarios(scenario.scenario_rollup(forecast(spark, d)), path)
    return files.read_scenarios(spark, path, "date DATE, n BIGINT, pred_sum DOUBLE, scenario STRING, model STRING")


@query("scenario_stream_forecast", scen_ctes() + """
SELECT unit, date, month, wyear, year, pred, scenario, model FROM fc""", ("pred",))
def q_scenario_stream_forecast(spark, d):
    """M5 as a file stream: the 16 scenario files are picked up by a streaming
    source and scored batch by batch; the appended forecast is read back."""
    from ..streaming.scenario_stream import read_forecasts, start_forecast_stream
    from .q_scenario import ols_score_fn, selected_units
    base = scratch_path(spark, "scenario-stream")
    write_scenario_grid(panel(spark, d), f"{base}/in")
    units = selected_units(spark, d)
    q = start_forecast_stream(spark, f"{base}/in/*/*.csv.gz", SCEN_SCHEMA, units,
                              S, ols_score_fn(spark, d, written=True), f"{base}/out", f"{base}/chk")
    q.awaitTermination()
    return read_forecasts(spark, f"{base}/out", FORECAST_SCHEMA)
