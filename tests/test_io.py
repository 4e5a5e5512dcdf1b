"""CSV sources and sinks in a temporary folder."""

import os

import pytest
from pyspark.sql import functions as F

from panelcast.sources import files


def test_csv_roundtrip_with_na(spark, tmp_dir):
    df = spark.createDataFrame([(1, 2.5, "x"), (2, None, None)], "unit long, v double, s string")
    path = os.path.join(tmp_dir, "out", "2019_2hr", "cmip5")
    files.write_table(df, path, single_file=True)
    text = "".join(open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".csv"))
    assert "NA" in text and text.startswith("unit,v,s")
    back = files.read_panel(spark, path, "unit long, v double, s string")
    assert sorted(back.collect()) == sorted(df.collect())


def test_lookup_by_position(spark, tmp_dir):
    cols = [F.lit(i).alias(f"c{i}") for i in range(2, 36)]
    df = spark.range(3).select(F.col("id").alias("key"), *cols, (F.col("id") * 1.5).alias("area"), F.lit("z").alias("name"))
    df = df.unionByName(df)  # duplicates collapse under distinct
    path = os.path.join(tmp_dir, "lookup")
    files.write_table(df, path)
    lk = files.read_lookup(spark, path, (1, 36))
    assert lk.columns == ["unit", "area"]
    assert sorted((r.unit, r.area) for r in lk.collect()) == [(0, 0.0), (1, 1.5), (2, 3.0)]
    short = os.path.join(tmp_dir, "short")
    files.write_table(spark.range(2), short)
    with pytest.raises(ValueError):
        files.read_lookup(spark, short, (1, 36))


def test_scenario_matrix_names_from_paths(spark, tmp_dir):
    base = os.path.join(tmp_dir, "scen")
    for s in ("ssp1_rcp45", "ssp5_rcp85"):
        for m in ("CanESM2", "HadGEM2-ES"):
            files.write_table(spark.createDataFrame([(1, 2.0)], "unit long, x double"),
                              os.path.join(base, f"CA_wtr_HUC8_all_{s}_{m}.csv"), single_file=True)
    df = files.read_scenario_matrix(spark, f"{base}/*/*.csv", "unit long, x double")
    got = sorted((r.scenario, r.model) for r in df.collect())
    assert got == sorted((s, m) for s in ("ssp1_rcp45", "ssp5_rcp85") for m in ("CanESM2", "HadGEM2-ES"))


def test_columns_by_name_and_strict(spark, tmp_dir):
    path = os.path.join(tmp_dir, "named")
    files.write_table(spark.createDataFrame([(2011, 7, 1.5, "x"), (2012, None, None, "y")],
                                            "year int, unit long, v double, extra string"), path, single_file=True)
    rows = files.read_panel(spark, path, "unit long, year int, v double").collect()
    assert sorted((r.unit or 0, r.year, r.v or 0.0) for r in rows) == [(0, 2012, 0.0), (7, 2011, 1.5)]
    with pytest.raises(ValueError, match="no column"):
        files.read_panel(spark, path, "unit long, other int")
    for name, line in (("short", "1"), ("text", "1,abc")):
        bad = os.path.join(tmp_dir, name)
        os.makedirs(bad)
        with open(os.path.join(bad, "a.csv"), "w") as f:
            f.write(f"unit,v\n2,3.0\n{line}\n")
        with pytest.raises(Exception):
            files.read_panel(spark, bad, "unit long, v double").collect()


def test_unmatched_scenario_file_raises(spark, tmp_dir):
    base = os.path.join(tmp_dir, "odd")
    files.write_table(spark.createDataFrame([(1, 2.0)], "unit long, x double"), os.path.join(base, "nothing.csv"))
    with pytest.raises(Exception, match="no scenario"):
        files.read_scenario_matrix(spark, f"{base}/*/*.csv", "unit long, x double").collect()


def test_partitioned_sink_prunes(spark, tmp_dir):
    df = spark.createDataFrame([(1, 1.0, "s1", "m1"), (2, 2.0, "s1", "m2"), (3, 3.0, "s2", "m1")],
                               "unit long, pred double, scenario string, model string")
    path = os.path.join(tmp_dir, "fc")
    files.write_scenarios(df, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("scenario=")) == ["scenario=s1", "scenario=s2"]
    back = files.read_scenarios(spark, path, "unit long, pred double, scenario string, model string")
    assert sorted(back.collect()) == sorted(df.collect())
    plan = back.filter(F.col("scenario") == "s2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_scenario_files_are_written_by_tasks_of_bounded_size(spark, tmp_path):
    """One large part of the panel is divided among tasks before it is sorted by file; the rows stay the same."""
    from panelcast.plans import q_io
    rows = spark.range(0, 20000, 1, 1).selectExpr("id AS unit", "concat('s', id % 4) AS scenario", "concat('m', id div 4 % 4) AS model")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
             "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        q_io.write_scenario_files(rows.repartition(1).withColumn("pad", F.md5(F.col("unit").cast("string"))), str(tmp_path / "in"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    tasks = {p.name[:10] for p in (tmp_path / "in").rglob("part-*.csv")}
    assert {p.name for p in (tmp_path / "in").glob("file=*")} == {f"file=run_all_s{i}_m{j}.csv" for i in range(4) for j in range(4)}
    assert len(tasks) > 1
    back = spark.read.option("header", True).csv(str(tmp_path / "in"))
    assert back.count() == back.select("unit").distinct().count() == 20000


def test_scenario_grid_is_written_compressed_without_a_shuffle(spark, tmp_path, monkeypatch):
    """One folder a scenario and model with the rows of the exploded grid, without the write that sends and sorts them."""
    from panelcast.operators import scenario
    from panelcast.plans import q_io
    from panelcast.sources.panel import panel
    p = panel(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(q_io, "write_scenario_files", None)
    q_io.write_scenario_grid(p, str(tmp_path / "in"))
    assert {x.name for x in (tmp_path / "in").glob("file=*")} == {f"file=run_all_s{i}_m{j}.csv" for i in range(1, 5) for j in range(1, 5)}
    assert {x.name[-7:] for x in (tmp_path / "in").rglob("part-*")} == {".csv.gz"}
    cols = ["scenario", "model", "unit", "date", "wyear", "lines", "nation"]
    back = files.read_scenario_matrix(spark, str(tmp_path / "in" / "*" / "*.csv.gz"), q_io.SCEN_SCHEMA)
    want = scenario.scenario_table(p).withColumn("unit", F.col("unit").cast("bigint"))
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
