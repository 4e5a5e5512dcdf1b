"""Scenario restriction, leading columns, rollups."""

import itertools

import pytest
from pyspark.sql import functions as F

from panelcast.operators import scenario
from panelcast.sources.panel import panel, panel_table
from panelcast.spec import ANALOGUE


def test_repeated_lookup_key_fails(spark):
    s = spark.createDataFrame([(1, "2020-01-01", 1, 2020)], "unit long, date string, month int, wyear int")
    units = spark.createDataFrame([(1, 2.0), (1, 3.0)], "unit long, area double")
    with pytest.raises(Exception, match="not unique"):
        scenario.restrict_to_units(s, units).collect()


def test_restrict_moves_key_first_and_drops_other_units(spark):
    s = spark.createDataFrame([("2020-01-01", 1, 2020, 1), ("2020-01-01", 1, 2020, 2)],
                              "date string, month int, wyear int, unit long")
    units = spark.createDataFrame([(1, 2.0)], "unit long, area double")
    r = scenario.restrict_to_units(s, units)
    assert r.columns[0] == "unit" and r.columns[-1] == "area"
    assert r.count() == 1


def test_leading_with_first(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert scenario.leading(df, 3).columns == ["a", "b", "c"]
    assert scenario.leading(df, 3, ["c"]).columns == ["c", "a", "b"]


def test_scenario_table_is_16_copies(spark):
    p = panel(spark, "/root/testdata/sf0.001")
    st = scenario.scenario_table(p)
    assert st.count() == 16 * p.count()
    assert st.select("scenario", "model").distinct().count() == 16


def test_rollup_poisoned_by_null_pred(spark):
    f = spark.createDataFrame([("s1", "m1", "2020-01-01", 1.0), ("s1", "m1", "2020-01-01", None),
                               ("s1", "m1", "2020-02-01", 2.0)], "scenario string, model string, date string, pred double")
    got = {r.date: (r.n, r.pred_sum) for r in scenario.scenario_rollup(f).collect()}
    assert got["2020-01-01"] == (2, None) and got["2020-02-01"] == (1, 2.0)


def test_forecast_filters_start_year(spark):
    p = panel(spark, "/root/testdata/sf0.001")
    st = scenario.scenario_table(p)
    units = p.select("unit").distinct().withColumn("area", F.lit(1.0))
    fc = scenario.scenario_forecast(st, units, ANALOGUE, lambda d: d.withColumn("pred", F.lit(1.0)),
                                    start=2015)
    assert fc.filter(F.col("wyear") <= 2015).count() == 0
    assert fc.columns[:2] == ["scenario", "model"] and fc.columns[-1] == "pred"


def test_the_unit_list_has_its_real_size(spark):
    """The grid's explode isn't in the rows' size estimate: beside a list still to be joined they look small and are broadcast."""
    from panelcast.plans import q_scenario
    q = q_scenario.selected_units(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
    assert "Join" not in q.toString() and int(str(q.stats().sizeInBytes())) < 1_000_000


def test_scenario_rows_are_never_broadcast(spark):
    """Once a list's joins have run, its estimate is the product of their sides: beside it the exploded rows were the side to broadcast."""
    p = panel_table(spark, "/root/testdata/sf0.01")
    area = p.select("unit", F.col("bal").alias("area")).distinct()
    units = p.select("unit").distinct().join(area, "unit")
    r = scenario.restrict_to_units(scenario.scenario_table(p), units)
    assert len(r.collect()) == 16 * p.count()
    lines = r._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            below = itertools.takewhile(lambda j: depth[j] > depth[i], range(i + 1, len(lines)))
            assert not any("Generate explode" in lines[j] for j in below), x


def test_restricted_rows_are_those_of_the_inner_join(spark):
    """Rows with a NULL unit go, a unit listed twice gives two rows when the list isn't checked, a NULL area stays."""
    s = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 13), (None, 14)], "unit long, wyear int")
    units = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None), (4, 5.0), (None, 6.0)], "unit long, area double")
    got = scenario.restrict_to_units(s, units, check=False)
    want = s.join(units, "unit").select("unit", "wyear", "area")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5
