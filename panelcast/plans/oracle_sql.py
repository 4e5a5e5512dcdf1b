"""SQL building blocks for the DuckDB twins (independent formulations, windows and CTEs)."""

from __future__ import annotations

from ..sources.panel import PANEL_SQL
from ..spec import ANALOGUE as S


def _in(vals) -> str:
    return "(" + ", ".join(str(v) for v in vals) + ")"


# strict (NA-poisoning) group aggregates as windows
def strict_win(agg: str, col: str, part: str = "unit, year") -> str:
    w = f"OVER (PARTITION BY {part})"
    return f"CASE WHEN count(*) {w} = count({col}) {w} THEN {agg}({col}) {w} END"


def cohort_ctes(target: str = "target_a") -> str:
    """panel -> search cohort (sum cut, positive target, mean cover cut, fold)."""
    return f"""WITH {PANEL_SQL},
s1 AS (SELECT * FROM panel QUALIFY {strict_win('sum', target)} >= {S.sum_cut}),
s2 AS (SELECT * FROM s1 WHERE {target} > 0),
cohort AS (SELECT *, CAST(wyear - {S.fold_base} AS INTEGER) AS fold
           FROM s2 QUALIFY {strict_win('avg', 'cover')} >= {S.cover_cut})"""


def forest_cohort_ctes(target: str = "target_a", forest: bool = True, drought: bool = False) -> str:
    op = ">=" if forest else "<"
    years = S.drought_years if drought else S.nondrought_years
    return f"""WITH {PANEL_SQL},
f1 AS (SELECT * FROM panel QUALIFY {strict_win('sum', target)} >= {S.sum_cut}),
f2 AS (SELECT * FROM f1 QUALIFY {strict_win('avg', 'cover')} {op} {S.cover_cut}),
fcohort AS (SELECT * FROM f2 WHERE wyear IN {_in(years)}
            AND NOT coalesce(unit IN {_in(S.excluded_units)}, false))"""


def ols_scored_ctes(target: str = "target_a", x: str = "lines") -> str:
    """search cohort + split + OLS fitted on train + raw prediction."""
    return cohort_ctes(target) + f""",
split AS (SELECT *, CASE WHEN wyear <= {S.split_year} THEN 'train' ELSE 'test' END AS split
          FROM cohort WHERE wyear IS NOT NULL),
coefs AS (SELECT regr_intercept({target}, {x}) AS intercept, regr_slope({target}, {x}) AS slope
          FROM split WHERE split = 'train'),
scored AS (SELECT split.*, coefs.intercept + coefs.slope * CAST({x} AS DOUBLE) AS pred
           FROM split, coefs),
errors AS (SELECT unit, year, month, wyear, split, {target} AS actual,
                  CASE WHEN pred IS NULL THEN NULL ELSE greatest(pred, 0.0) END AS pred,
                  {target} - CASE WHEN pred IS NULL THEN NULL ELSE greatest(pred, 0.0) END AS error,
                  CASE WHEN {target} <> 0 THEN
                    ({target} - CASE WHEN pred IS NULL THEN NULL ELSE greatest(pred, 0.0) END) / {target}
                  END AS error_pct
           FROM scored)"""
