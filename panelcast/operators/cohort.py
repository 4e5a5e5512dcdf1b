"""Cohort selection: group-qualified filters, year lists, unit exclusion, splits.

A group-qualified filter keeps every row of a group whose aggregate passes a
predicate (dplyr ``group_by() %>% filter(agg(x) >= v)``).  Two plans:

* ``how="window"`` (default for the panel rules): an aggregate over
  ``Window.partitionBy(keys)``.  The table is read once and shuffled once; the
  sum and mean rules use the same keys, so one exchange serves both.  A panel
  group (unit, calendar year) holds at most 12 monthly rows, so no window
  partition can grow with the data.
* ``how="semi"`` for groups of unbounded size: a partial aggregate per group and
  a left-semi join of the passing keys.  The aggregate combines map-side, so a
  group holding a third of all rows costs no more than any other; the input is
  read twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fold_number, strict_avg, strict_sum
from ..spec import PanelSpec


def _null_safe_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def filter_groups(t: DataFrame, keys: Sequence[str], agg: Callable[[object], Column],
                  pred: Callable[[Column], Column], how: str = "window") -> DataFrame:
    """Keep all rows of the groups ``keys`` whose aggregate satisfies ``pred``.

    ``agg(window)`` builds the aggregate, as a window aggregate when given a
    window spec and as a plain aggregate when given None (use
    ``strict_sum``/``strict_avg`` for R's NA-poisoning rule: a NULL aggregate
    fails the predicate and drops the group).  NULL keys form their own group,
    as in dplyr.
    """
    keys = list(keys)
    if how == "window":
        g = agg(Window.partitionBy(*keys))
        return (t.withColumn("_g", g).filter(F.coalesce(pred(F.col("_g")), F.lit(False)))
                .drop("_g"))
    passing = (t.groupBy(*keys).agg(agg(None).alias("_g"))
               .filter(pred(F.col("_g"))).select(*keys))
    return t.join(passing, _null_safe_keys(t, passing, keys), "left_semi")


def filter_sum_at_least(t: DataFrame, spec: PanelSpec, cut: float | None = None,
                        how: str = "window") -> DataFrame:
    """keep (unit, calendar year) groups whose target sum >= cut."""
    cut = spec.sum_cut if cut is None else cut
    return filter_groups(t, [spec.unit, spec.year], lambda w: strict_sum(spec.target, w),
                         lambda g: g >= cut, how)


def filter_cover(t: DataFrame, spec: PanelSpec, forest: bool = True,
                 cut: float | None = None, how: str = "window") -> DataFrame:
    """F3 (mean cover >= cut, ``forest``) or F4 (mean cover < cut)."""
    cut = spec.cover_cut if cut is None else cut
    pred = (lambda g: g >= cut) if forest else (lambda g: g < cut)
    return filter_groups(t, [spec.unit, spec.year], lambda w: strict_avg(spec.cover, w), pred, how)


def filter_positive(t: DataFrame, spec: PanelSpec) -> DataFrame:
    """rows with target > 0."""
    return t.filter(F.col(spec.target) > 0)


def in_years(t: DataFrame, spec: PanelSpec, years: Sequence[int]) -> DataFrame:
    """water year in a list."""
    return t.filter(F.col(spec.wyear).isin(list(years)))


def exclude_units(t: DataFrame, spec: PanelSpec, units: Sequence[int] | None = None) -> DataFrame:
    """F8: drop listed units; a NULL unit is kept (R ``!(x %in% ids)``)."""
    units = list(spec.excluded_units if units is None else units)
    return t.filter(~F.coalesce(F.col(spec.unit).isin(units), F.lit(False)))


def temporal_split(t: DataFrame, spec: PanelSpec) -> tuple[DataFrame, DataFrame]:
    """train = water year <= split year, test = water year > split year."""
    w = F.col(spec.wyear)
    return t.filter(w <= spec.split_year), t.filter(w > spec.split_year)


def with_split(t: DataFrame, spec: PanelSpec, name: str = "split") -> DataFrame:
    """Tag rows ``train``/``test`` in one frame (NULL water year: no split, dropped)."""
    w = F.col(spec.wyear)
    return (t.withColumn(name, F.when(w <= spec.split_year, F.lit("train"))
                         .when(w > spec.split_year, F.lit("test")))
            .filter(F.col(name).isNotNull()))


def search_cohort(t: DataFrame, spec: PanelSpec) -> DataFrame:
    """Forecast cohort: sum cut -> positive target -> mean cover cut (in this order)
    and the fold column (water year minus the fold base)."""
    c = filter_sum_at_least(t, spec)
    c = filter_positive(c, spec)
    c = filter_cover(c, spec, forest=True)
    return c.withColumn("fold", fold_number(spec.wyear, spec.fold_base))


def forest_cohort(t: DataFrame, spec: PanelSpec, forest: bool = True,
                  drought: bool = False) -> DataFrame:
    """sum cut -> cover side -> year list -> unit exclusion, no positive filter."""
    c = filter_sum_at_least(t, spec)
    c = filter_cover(c, spec, forest=forest)
    c = in_years(c, spec, spec.drought_years if drought else spec.nondrought_years)
    return exclude_units(c, spec)


def cohort_matrix(t: DataFrame, spec: PanelSpec, targets: Sequence[str]) -> DataFrame:
    """All cover x year-list x target cohorts in one job: rows and target sum each.

    The panel is first pre-aggregated to (unit, year, water year) -- at most two
    water years per calendar year -- so the group rules are evaluated by a
    window over a handful of rows per (unit, year) and the full-size panel is
    shuffled only as partial aggregates.  Per-cohort totals are conditional sums
    in one final aggregate.
    """
    u, y, wy = spec.unit, spec.year, spec.wyear
    sub = t.groupBy(u, y, wy).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count(spec.cover).alias("_c_cov"), F.sum(spec.cover).alias("_s_cov"),
        *[e for tg in targets for e in (F.count(tg).alias(f"_c_{tg}"), F.sum(tg).alias(f"_s_{tg}"))])
    w = Window.partitionBy(u, y)
    n_all = F.sum("_n").over(w)
    cov = F.when(F.sum("_c_cov").over(w) == n_all, F.sum("_s_cov").over(w) / n_all)
    g = sub.select(u, wy, "_n", cov.alias("_cov"),
                   *[F.col(f"_s_{tg}") for tg in targets],
                   *[F.when(F.sum(f"_c_{tg}").over(w) == n_all, F.sum(f"_s_{tg}").over(w))
                     .alias(f"_g_{tg}") for tg in targets])
    kept = ~F.coalesce(F.col(u).isin(list(spec.excluded_units)), F.lit(False))
    sides = {"forest": F.col("_cov") >= spec.cover_cut, "nonforest": F.col("_cov") < spec.cover_cut}
    years = {"drought": F.col(wy).isin(list(spec.drought_years)),
             "nondrought": F.col(wy).isin(list(spec.nondrought_years))}
    aggs, labels = [], []
    for tg in targets:
        for sname, scond in sides.items():
            for yname, ycond in years.items():
                cond = F.coalesce((F.col(f"_g_{tg}") >= spec.sum_cut) & scond & ycond & kept,
                                  F.lit(False))
                i = len(labels)
                labels.append((f"{sname}_{yname}", tg))
                aggs += [F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0)).cast("bigint").alias(f"n{i}"),
                         F.sum(F.when(cond, F.col(f"_s_{tg}"))).alias(f"s{i}")]
    wide = g.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("cohort"), F.lit(tg).alias("target"),
                     F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("target_sum"))
            for i, (c, tg) in enumerate(labels)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
