"""Scenario forecasting: many scenario x climate-model tables scored in one job.

The reference loops over 16 files, scoring each in turn.  Here all scenario
rows live in one DataFrame carrying ``scenario`` and ``model`` columns; the
unit restriction is one join, scoring one projection and the rollup one
aggregate keyed by (scenario, model, date).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import parse_date, quarter_of
from ..spec import PanelSpec

# The analogue scenario grid.  Scenario i shifts years by 10*i;
# model j with scenario i scales the features by 1 + 0.1*(j-1) - 0.05*(i-1).
SCENARIO_NAMES = ("s1", "s2", "s3", "s4")
MODEL_NAMES = ("m1", "m2", "m3", "m4")
SCALED_FEATURES = ("tax", "lines", "size", "price")


def scenario_grid() -> list[tuple[str, str, int, float]]:
    return [(s, m, 10 * (i + 1), round(1.0 + 0.1 * j - 0.05 * i, 2))
            for i, s in enumerate(SCENARIO_NAMES) for j, m in enumerate(MODEL_NAMES)]


def scenario_table(panel: DataFrame, grid: Sequence[tuple[str, str, int, float]] | None = None
                   ) -> DataFrame:
    """Analogue of the climate scenario files: every panel row once per
    (scenario, model), years shifted and features scaled.

    The grid is a literal array exploded per row -- a narrow, bounded (x16)
    expansion with no join and no shuffle.
    """
    grid = list(grid or scenario_grid())
    g = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(m).alias("model"),
                           F.lit(sh).alias("shift"), F.lit(float(fa)).alias("factor"))
                  for s, m, sh, fa in grid])
    x = panel.select("*", F.explode(g).alias("_g"))
    yr = F.col("year") + F.col("_g.shift")
    return x.select(
        "unit",
        F.format_string("%04d-%02d-01", yr, F.col("month")).alias("date"),
        "month",
        (F.col("wyear") + F.col("_g.shift")).alias("wyear"),
        yr.alias("year"),
        *[(F.col(c).cast("double") * F.col("_g.factor")).alias(c) for c in SCALED_FEATURES],
        "bal", "nation", "project",
        F.col("_g.scenario").alias("scenario"), F.col("_g.model").alias("model"))


def prepare(scen: DataFrame) -> DataFrame:
    """X3, X4 on scenario rows: ISO text to date, quarter."""
    return scen.withColumn("date", parse_date("date")).withColumn("quarter", quarter_of("month"))


def unique_rows(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row a key; a repeated key (it would multiply rows) raises when the query runs.
    One aggregate over the small list, no job while the plan is built."""
    rest = [c for c in df.columns if c != key]
    text = F.concat(F.lit(f"lookup key {key} is not unique: "), F.col(key).cast("string"))
    one = df.groupBy(key).agg(*[F.first(c).alias(c) for c in rest], F.count(F.lit(1)).alias("_n"))
    return one.select(F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(text).cast(dict(df.dtypes)[key]))
                      .alias(key), *rest)


def restrict_to_units(scen: DataFrame, units: DataFrame, key: str = "unit",
                      check: bool = True) -> DataFrame:
    """Inner join with the selected (unit, area) list, key moved first.

    The unit list is tiny next to the scenario rows; the planner broadcasts it
    when its size estimate allows and falls back to a shuffle join otherwise.
    An explode (the scenario grid) isn't in the estimate of the rows, a join is
    in that of the list: in an inner join, a list still to be computed looks
    larger than the rows and they are broadcast.  So the rows are restricted by
    a semi join and get the list's columns by a left join, neither of which can
    broadcast its left side.  Hand the list in as a written table, or it is
    computed for each of the two.
    """
    if check:
        units = unique_rows(units, key)
    rest = [c for c in scen.columns if c != key]
    extra = [c for c in units.columns if c != key]
    kept = scen.join(units.select(key), key, "left_semi")
    return kept.join(units, key, "left").select(key, *rest, *extra)


def leading(df: DataFrame, n: int, first: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` columns, optionally with some columns put first
    (de-duplicated, order kept)."""
    cols = list(first) + [c for c in df.columns[:n] if c not in first]
    return df.select(*cols)


def scenario_filter(scen: DataFrame, spec: PanelSpec, start: int, model: str | None = None
                    ) -> DataFrame:
    """water year after ``start`` (and one climate model)."""
    cond = F.col(spec.wyear) > start
    if model is not None:
        cond = cond & (F.col("model") == model)
    return scen.filter(cond)


def scenario_forecast(scen: DataFrame, units: DataFrame, spec: PanelSpec, score,
                      start: int | None = None, n_lead: int = 5,
                      ids: Sequence[str] = ("scenario", "model")) -> DataFrame:
    """M5 over all scenarios at once: prepare, restrict to units, filter start
    year, score, keep the leading id columns and the prediction.

    ``score(df) -> df`` adds a ``pred`` column (a fitted MLlib model's
    ``transform`` or a closed-form scorer)."""
    s = restrict_to_units(prepare(scen), units)
    s = scenario_filter(s, spec, spec.scenario_start if start is None else start)
    scored = score(s)
    lead = [c for c in s.columns[:n_lead] if c not in ids]
    return scored.select(*ids, *lead, "pred")


def scenario_rollup(forecast: DataFrame, keys: Sequence[str] = ("scenario", "model", "date")
                    ) -> DataFrame:
    """A4: n and prediction sum per (scenario, model, date); NULL-poisoned sum."""
    p = F.col("pred")
    return forecast.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) == F.count(p), F.sum(p)).alias("pred_sum"))


def list_models(scen: DataFrame, col: str = "model") -> DataFrame:
    """The distinct climate models of a table."""
    return scen.select(col).distinct()

