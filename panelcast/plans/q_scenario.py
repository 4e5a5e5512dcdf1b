"""Queries: unit lookup, scenario tables, forecasts and rollups (SURVEY 2.1 S4, 2.3 X7-X8,
2.4 F9-F10, 2.5 J1-J2, 2.6 A4-A5, 2.9 M5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, scenario, search
from ..session import cut_lineage
from ..sources.panel import panel_table as panel, read_table
from ..spec import ANALOGUE as S
from ..spec import ANALOGUE_B as S_B
from .oracle_sql import ols_scored_ctes
from .q_accuracy import OLS_X
from .registry import query

N_FILLER = 34   # lookup columns between the key (position 1) and the area (position 36)


def lookup_table(spark: SparkSession, d: str) -> DataFrame:
    """Analogue of the unit lookup: key at position 1, area (account balance) at 36."""
    s = read_table(spark, d, "supplier")
    fillers = [(F.col("s_nationkey") + i).alias(f"f{i:02d}") for i in range(2, 2 + N_FILLER)]
    return s.select(F.col("s_suppkey").alias("unit"), *fillers,
                    F.col("s_acctbal").alias("area"), "s_name")


def selected_units(spark: SparkSession, d: str, spec=S) -> DataFrame:
    """J1 + A5: distinct cohort units joined with the distinct (position 1, position 36) pairs.

    Written: without its real size the planner takes this list for the larger side and broadcasts the scenario rows."""
    lk = lookup_table(spark, d)
    pairs = lk.select(lk.columns[0], lk.columns[35]).distinct()
    units = cohort.search_cohort(panel(spark, d), spec).select(spec.unit).distinct()
    return cut_lineage(units.join(pairs, spec.unit), "units")


def ols_score_fn(spark: SparkSession, d: str, spec=S, written: bool = False):
    """Scorer with the one-variable model of ``spec``'s target; ``written``: its row is computed once, now."""
    c = cohort.with_split(cohort.search_cohort(panel(spark, d), spec), spec)
    coefs = search.fit_ols(c.filter(F.col("split") == "train"), spec.target, OLS_X)
    coefs = cut_lineage(coefs, "coefficients") if written else coefs
    return lambda df: search.score_ols(df, coefs, OLS_X)


def forecast(spark: SparkSession, d: str, spec=S) -> DataFrame:
    scen = scenario.scenario_table(panel(spark, d))
    return scenario.scenario_forecast(scen, selected_units(spark, d, spec), spec, ols_score_fn(spark, d, spec))


def _grid_sql() -> str:
    rows = ", ".join(f"('{s}', '{m}', {sh}, CAST({fa!r} AS DOUBLE))"
                     for s, m, sh, fa in scenario.scenario_grid())
    return f"grid AS (SELECT * FROM (VALUES {rows}) g(scenario, model, shift, factor))"


def scen_ctes(target: str = "target_a") -> str:
    return ols_scored_ctes(target) + f""",
{_grid_sql()},
scen AS (SELECT p.unit, printf('%04d-%02d-01', p.year + g.shift, p.month) AS date, p.month,
                p.wyear + g.shift AS wyear, p.year + g.shift AS year,
                p.tax * g.factor AS tax, CAST(p.lines AS DOUBLE) * g.factor AS lines,
                p.size * g.factor AS size, p.price * g.factor AS price,
                p.bal, p.nation, p.project, g.scenario, g.model
         FROM panel p, grid g),
units AS (SELECT DISTINCT c.unit, s.s_acctbal AS area
          FROM (SELECT DISTINCT unit FROM cohort) c JOIN supplier s ON c.unit = s.s_suppkey),
fc AS (SELECT s.scenario, s.model, s.unit, CAST(s.date AS DATE) AS date, s.month, s.wyear, s.year,
              coefs.intercept + coefs.slope * s.lines AS pred
       FROM scen s JOIN units u ON s.unit = u.unit, coefs
       WHERE s.wyear > {S.scenario_start})"""


@query("selected_unit_area", scen_ctes() + "\nSELECT unit, area FROM units", ("area",))
def q_selected_unit_area(spark, d):
    """Cohort units with their area from the lookup (columns by position)."""
    return selected_units(spark, d)


@query("scenario_restrict", scen_ctes() + """
SELECT s.unit, s.scenario, s.model, s.date, s.wyear, s.lines, u.area
FROM scen s JOIN units u ON s.unit = u.unit""", ("lines", "area"))
def q_scenario_restrict(spark, d):
    """Scenario rows restricted to cohort units, area attached, key first."""
    r = scenario.restrict_to_units(scenario.scenario_table(panel(spark, d)), selected_units(spark, d))
    return r.select("unit", "scenario", "model", "date", "wyear", "lines", "area")


@query("scenario_filter", scen_ctes() + f"""
SELECT unit, scenario, model, date, wyear FROM scen
WHERE wyear > {S.scenario_start + 5} AND model = 'm2'""")
def q_scenario_filter(spark, d):
    """scenario rows after a start year for one climate model."""
    s = scenario.scenario_filter(scenario.scenario_table(panel(spark, d)), S,
                                 S.scenario_start + 5, "m2")
    return s.select("unit", "scenario", "model", "date", "wyear")


@query("scenario_forecast", scen_ctes() + """
SELECT scenario, model, unit, date, month, wyear, year, pred FROM fc""", ("pred",))
def q_scenario_forecast(spark, d):
    """All 16 scenario x model tables scored in one job."""
    return forecast(spark, d)


@query("scenario_rollup", scen_ctes() + """
SELECT scenario, model, date, CAST(count(*) AS BIGINT) AS n,
       CASE WHEN count(*) = count(pred) THEN sum(pred) END AS pred_sum
FROM fc GROUP BY scenario, model, date""", ("pred_sum",))
def q_scenario_rollup(spark, d):
    """A4: forecast rollup per (scenario, model, month date)."""
    return scenario.scenario_rollup(forecast(spark, d))


@query("scenario_forecast_b", scen_ctes("target_b") + """
SELECT scenario, model, unit, date, month, wyear, year, pred FROM fc""", ("pred",))
def q_scenario_forecast_b(spark, d):
    """M5 for the second target: its own cohort, units and model."""
    return forecast(spark, d, S_B)


@query("scenario_rollup_b", scen_ctes("target_b") + """
SELECT scenario, model, date, CAST(count(*) AS BIGINT) AS n,
       CASE WHEN count(*) = count(pred) THEN sum(pred) END AS pred_sum
FROM fc GROUP BY scenario, model, date""", ("pred_sum:2",))
def q_scenario_rollup_b(spark, d):
    """A4 for the second target."""
    return scenario.scenario_rollup(forecast(spark, d, S_B))


LATE_START = S.scenario_start + 4     # the later start year of the files that hold all models


@query("all_models_forecast", scen_ctes() + f"""
SELECT unit, date, month, wyear, year, model, pred FROM fc WHERE scenario = 's2' AND wyear > {LATE_START}""", ("pred",))
def q_all_models_forecast(spark, d):
    """One scenario file that holds all its models, from its own later start year, with the
    leading six columns: read, restricted, filtered, scored in one job."""
    scen = scenario.scenario_table(panel(spark, d)).filter(F.col("scenario") == "s2").drop("scenario")
    lead = ["unit", "date", "month", "wyear", "year", "model"]
    scen = scen.select(*lead, *[c for c in scen.columns if c not in lead])
    s = scenario.restrict_to_units(scenario.prepare(scen), selected_units(spark, d))
    scored = ols_score_fn(spark, d)(scenario.scenario_filter(s, S, LATE_START))
    return scored.select(*scenario.leading(scored, 6).columns, "pred")


@query("leading_with_key_first", scen_ctes() + """
SELECT wyear, unit, date, month, year, model, pred FROM fc WHERE scenario = 's1'""", ("pred",))
def q_leading_with_key_first(spark, d):
    """One scenario file holding all models (cmip6 layout): water year first,
    then the leading six columns without repeating it."""
    scen = scenario.scenario_table(panel(spark, d)).filter(F.col("scenario") == "s1").drop("scenario")
    units = selected_units(spark, d)
    s = scenario.restrict_to_units(scenario.prepare(scen), units)
    s = scenario.scenario_filter(s, S, S.scenario_start)
    s = s.select("unit", "date", "month", "wyear", "year", "model",
                 *[c for c in s.columns if c not in ("unit", "date", "month", "wyear", "year", "model")])
    scored = ols_score_fn(spark, d)(s)
    lead = scenario.leading(scored, 6, first=["wyear"]).columns
    return scored.select(*lead, "pred")


@query("scenario_models", scen_ctes() + "\nSELECT DISTINCT model FROM scen")
def q_scenario_models(spark, d):
    """Distinct climate models of a scenario table."""
    return scenario.list_models(scenario.scenario_table(panel(spark, d)))
