"""Queries: panel fixture, time columns, cohort filters and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import month_start, quarter_of, yearmonth
from ..operators import accuracy, cohort
from ..sources.panel import PANEL_SQL, panel, panel_table
from ..spec import ANALOGUE as S
from .oracle_sql import _in, cohort_ctes, forest_cohort_ctes, strict_win
from .registry import query

PANEL_COLS = ("unit", "year", "month", "wyear", "target_a", "target_b", "cover", "tax",
              "lines", "size", "price", "bal", "nation", "project")
PANEL_DOUBLES = ("target_a", "target_b", "cover", "tax", "size", "price", "bal")
_PCOLS = ", ".join(PANEL_COLS)


@query("panel_monthly", f"WITH {PANEL_SQL} SELECT {_PCOLS} FROM panel", PANEL_DOUBLES)
def q_panel_monthly(spark, d):
    """PNL: line items rolled up to a unit x month panel (built from lineitem each run)."""
    return panel(spark, d).select(*PANEL_COLS)


@query("derive_time_columns", f"""WITH {PANEL_SQL}
SELECT unit, year, month,
       CAST(year AS VARCHAR) || '-' || CAST(month AS VARCHAR) AS yearmonth,
       CASE WHEN month BETWEEN 1 AND 12 THEN make_date(year, month, 1) END AS date,
       CASE WHEN month BETWEEN 1 AND 12 THEN CAST((month - 1) // 3 + 1 AS INTEGER) END AS quarter
FROM panel""")
def q_derive_time_columns(spark, d):
    """Yearmonth text, month-start date, quarter."""
    return panel_table(spark, d).select(
        "unit", "year", "month", yearmonth("year", "month").alias("yearmonth"),
        month_start("year", "month").alias("date"), quarter_of("month").alias("quarter"))


@query("fold_assignment", cohort_ctes() + """
SELECT unit, year, month, wyear, fold FROM cohort""")
def q_fold_assignment(spark, d):
    """fold = water year - base, on the search cohort."""
    return cohort.search_cohort(panel_table(spark, d), S).select("unit", "year", "month", "wyear", "fold")


@query("filter_positive", f"WITH {PANEL_SQL} SELECT {_PCOLS} FROM panel WHERE target_a > 0",
       PANEL_DOUBLES)
def q_filter_positive(spark, d):
    """rows with a positive target."""
    return cohort.filter_positive(panel_table(spark, d), S).select(*PANEL_COLS)


@query("group_filter_sum", f"""WITH {PANEL_SQL}
SELECT {_PCOLS} FROM panel QUALIFY {strict_win('sum', 'target_a')} >= {S.sum_cut}""", PANEL_DOUBLES)
def q_group_filter_sum(spark, d):
    """keep (unit, year) groups whose target sum reaches the cut."""
    return cohort.filter_sum_at_least(panel_table(spark, d), S).select(*PANEL_COLS)


@query("group_filter_mean_ge", f"""WITH {PANEL_SQL},
a AS (SELECT * FROM panel QUALIFY {strict_win('sum', 'target_a')} >= {S.sum_cut})
SELECT {_PCOLS} FROM a QUALIFY {strict_win('avg', 'cover')} >= {S.cover_cut}""", PANEL_DOUBLES)
def q_group_filter_mean_ge(spark, d):
    """F2 then F3: mean cover at or above the cut."""
    p = cohort.filter_sum_at_least(panel_table(spark, d), S)
    return cohort.filter_cover(p, S, forest=True).select(*PANEL_COLS)


@query("group_filter_mean_lt", f"""WITH {PANEL_SQL},
a AS (SELECT * FROM panel QUALIFY {strict_win('sum', 'target_a')} >= {S.sum_cut})
SELECT {_PCOLS} FROM a QUALIFY {strict_win('avg', 'cover')} < {S.cover_cut}""", PANEL_DOUBLES)
def q_group_filter_mean_lt(spark, d):
    """F2 then F4: mean cover below the cut."""
    p = cohort.filter_sum_at_least(panel_table(spark, d), S)
    return cohort.filter_cover(p, S, forest=False).select(*PANEL_COLS)


@query("temporal_split", cohort_ctes() + f"""
SELECT unit, year, month, wyear, fold,
       CASE WHEN wyear <= {S.split_year} THEN 'train' ELSE 'test' END AS split
FROM cohort WHERE wyear IS NOT NULL""")
def q_temporal_split(spark, d):
    """train / test by water year on the search cohort."""
    c = cohort.with_split(cohort.search_cohort(panel_table(spark, d), S), S)
    return c.select("unit", "year", "month", "wyear", "fold", "split")


@query("cohort_nondrought", forest_cohort_ctes(forest=True, drought=False) + f"""
SELECT {_PCOLS} FROM fcohort""", PANEL_DOUBLES)
def q_cohort_nondrought(spark, d):
    """F11 with F3 + F6 + F8: forest, non-drought years, units excluded."""
    return cohort.forest_cohort(panel_table(spark, d), S, forest=True, drought=False).select(*PANEL_COLS)


@query("cohort_drought", forest_cohort_ctes(forest=True, drought=True) + f"""
SELECT {_PCOLS} FROM fcohort""", PANEL_DOUBLES)
def q_cohort_drought(spark, d):
    """F11 with F3 + F7 + F8: forest, drought years."""
    return cohort.forest_cohort(panel_table(spark, d), S, forest=True, drought=True).select(*PANEL_COLS)


@query("cohort_nonforest_drought", forest_cohort_ctes(forest=False, drought=True) + f"""
SELECT {_PCOLS} FROM fcohort""", PANEL_DOUBLES)
def q_cohort_nonforest_drought(spark, d):
    """F11 with F4 + F7 + F8: non-forest, drought years."""
    return cohort.forest_cohort(panel_table(spark, d), S, forest=False, drought=True).select(*PANEL_COLS)


@query("exclude_units", f"""WITH {PANEL_SQL}
SELECT {_PCOLS} FROM panel WHERE NOT coalesce(unit IN {_in(S.excluded_units)}, false)""",
       PANEL_DOUBLES)
def q_exclude_units(spark, d):
    """F8: drop listed units (NULL ids kept)."""
    return cohort.exclude_units(panel_table(spark, d), S).select(*PANEL_COLS)


def _cohort_matrix_sql() -> str:
    parts = []
    for tg in ("target_a", "target_b"):
        for side, op in (("forest", ">="), ("nonforest", "<")):
            for yname, years in (("drought", S.drought_years), ("nondrought", S.nondrought_years)):
                parts.append(f"""SELECT '{side}_{yname}' AS cohort, '{tg}' AS target,
       CAST(count(*) AS BIGINT) AS n, sum({tg}) AS target_sum
FROM g WHERE g_{tg} >= {S.sum_cut} AND g_cover {op} {S.cover_cut}
  AND wyear IN {_in(years)} AND NOT coalesce(unit IN {_in(S.excluded_units)}, false)""")
    return f"""WITH {PANEL_SQL},
g AS (SELECT *, {strict_win('sum', 'target_a')} AS g_target_a,
              {strict_win('sum', 'target_b')} AS g_target_b,
              {strict_win('avg', 'cover')} AS g_cover FROM panel)
""" + "\nUNION ALL\n".join(parts)


@query("cohort_matrix", _cohort_matrix_sql(), ("target_sum:2",))
def q_cohort_matrix(spark, d):
    """F11 x 8: every cover side x year list x target in one job."""
    return cohort.cohort_matrix(panel_table(spark, d), S, ["target_a", "target_b"])


@query("unit_count", cohort_ctes() + """
SELECT CAST(count(DISTINCT unit) AS BIGINT) AS n_units FROM cohort""")
def q_unit_count(spark, d):
    """Exact count of distinct units in the search cohort."""
    return accuracy.unit_count(cohort.search_cohort(panel_table(spark, d), S))


@query("parse_iso_date", f"""WITH {PANEL_SQL}
SELECT unit, year, month,
       CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-01' AS date_text,
       TRY_CAST(CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0') || '-01' AS DATE) AS date
FROM panel""")
def q_parse_iso_date(spark, d):
    """ISO text to date (text built from the panel's year and month)."""
    from ..functions.columns import parse_date
    txt = F.format_string("%d-%02d-01", F.col("year"), F.col("month"))
    return panel_table(spark, d).select("unit", "year", "month", txt.alias("date_text"),
                                  parse_date(txt).alias("date"))

