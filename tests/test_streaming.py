"""The file-stream scenario scorer gives the same forecast as the batch job."""

import datetime
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from panelcast.operators import scenario
from panelcast.sources.panel import panel
from panelcast.spec import ANALOGUE
from panelcast.streaming.scenario_stream import (read_forecasts, read_rollup, scenario_stream, start_forecast_stream,
                                                 write_batch, write_rollup)

SCHEMA = ("unit BIGINT, date STRING, month INT, wyear INT, year INT, tax DOUBLE, lines DOUBLE, "
          "size DOUBLE, price DOUBLE, bal DOUBLE, nation INT, project INT")


def test_stream_equals_batch(spark, tmp_dir):
    p = panel(spark, "/root/testdata/sf0.001")
    scen = scenario.scenario_table(p, [("s1", "m1", 20, 1.0), ("s2", "m2", 30, 1.1)])
    units = p.select("unit").distinct().withColumn("area", F.lit(1.0))

    def score(df):
        return df.withColumn("pred", F.col("lines") * 2.0 + 1.0)
    src = os.path.join(tmp_dir, "in")
    named = scen.withColumn("file", F.concat(F.lit("CA_all_"), "scenario", F.lit("_"), "model",
                                             F.lit(".csv"))).drop("scenario", "model")
    named.write.partitionBy("file").option("header", True).csv(src)
    q = start_forecast_stream(spark, f"{src}/*/*.csv", SCHEMA, units, ANALOGUE, score,
                              os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "chk"))
    q.awaitTermination()
    got = read_forecasts(spark, os.path.join(tmp_dir, "out"),
                         "unit BIGINT, date DATE, month INT, wyear INT, year INT, pred DOUBLE, "
                         "scenario STRING, model STRING")
    want = scenario.scenario_forecast(scen, units, ANALOGUE, score)
    cols = ["scenario", "model", "unit", "date", "month", "wyear", "year", "pred"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in want.select(*cols).collect())
    assert a == b and len(a) > 0
    write_batch(want, os.path.join(tmp_dir, "out"), 0)     # a replay of the batch after a crash
    again = read_forecasts(spark, os.path.join(tmp_dir, "out"), got.schema)
    assert sorted(tuple(r) for r in again.select(*cols).collect()) == b


def test_rollup_adds_up_over_batches(spark, tmp_dir):
    """A date whose rows come in two batches has one row; a NULL prediction in either makes its sum NULL."""
    schema = "scenario STRING, model STRING, date DATE, pred DOUBLE"
    day = [datetime.date(2010, m, 1) for m in (1, 2, 3)]
    first = [("s", "m", day[0], 1.0), ("s", "m", day[0], 2.0), ("s", "m", day[1], None), ("t", "m", day[0], 7.0)]
    second = [("s", "m", day[0], 4.0), ("s", "m", day[1], 3.0), ("s", "m", day[2], None)]
    out = os.path.join(tmp_dir, "rollup")
    for epoch, rows in ((0, first), (1, second), (1, second)):      # the last batch is replayed
        write_rollup(spark.createDataFrame(rows, schema), out, epoch)
    got = {tuple(r) for r in read_rollup(spark, out).select("scenario", "model", "date", "n", "pred_sum").collect()}
    want = scenario.scenario_rollup(spark.createDataFrame(first + second, schema))
    assert got == {tuple(r) for r in want.select("scenario", "model", "date", "n", "pred_sum").collect()}
    assert ("s", "m", day[0], 3, 7.0) in got and ("s", "m", day[1], 2, None) in got


@pytest.mark.parametrize("name, header", [("other.csv", "unit,date"), ("CA_all_s_m.csv", "date,unit")])
def test_stream_refuses_other_names_and_headers(spark, tmp_dir, name, header):
    src = os.path.join(tmp_dir, name.replace(".", "_"))
    os.makedirs(src)
    with open(os.path.join(src, name), "w") as f:
        f.write(f"{header}\n1,2010-01-01\n")
    df = scenario_stream(spark, f"{src}/*.csv", "unit STRING, date STRING")
    q = (df.writeStream.foreachBatch(lambda b, e: b.write.format("noop").mode("overwrite").save())
         .option("checkpointLocation", f"{src}-chk").trigger(availableNow=True).start())
    with pytest.raises(StreamingQueryException):
        q.awaitTermination()


def test_forecast_batches_are_compressed(spark, tmp_path):
    rows = [("s", "m", 1.5), ("s", "n", None)]
    write_batch(spark.createDataFrame(rows, "scenario STRING, model STRING, pred DOUBLE"), str(tmp_path / "out"), 3)
    assert {x.name[-7:] for x in (tmp_path / "out").rglob("part-*")} == {".csv.gz"}
    back = read_forecasts(spark, str(tmp_path / "out"), "pred DOUBLE, scenario STRING, model STRING")
    assert sorted(map(tuple, back.select("scenario", "model", "pred").collect()), key=str) == sorted(rows, key=str)
