"""Queries: scoring with the one-variable least-squares scorer and accuracy tables
(SURVEY 2.3 X6-X13, 2.5 J3, 2.6 A1-A3, A7, 2.9 M4, M7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accuracy, cohort, search
from ..sources.panel import panel_table as panel
from ..spec import ANALOGUE as S
from .oracle_sql import ols_scored_ctes
from .registry import query

OLS_X = "lines"   # one-variable scorer: target_a ~ number of line items


def ols_scored(spark, d) -> DataFrame:
    """Search cohort tagged train/test, scored by OLS fitted on train only."""
    c = cohort.with_split(cohort.search_cohort(panel(spark, d), S), S)
    coefs = search.fit_ols(c.filter(F.col("split") == "train"), S.target, OLS_X)
    return search.score_ols(c, coefs, OLS_X)


def errors_of(spark, d, split: str | None = None) -> DataFrame:
    s = ols_scored(spark, d)
    if split:
        s = s.filter(F.col("split") == split)
    return accuracy.prediction_errors(s, S)


ERR_COLS = "unit, year, month, wyear, actual, pred, error, error_pct"
ERR_D = ("actual", "pred", "error", "error_pct")


@query("score_ols", ols_scored_ctes() + """
SELECT unit, year, month, split, target_a, pred FROM scored""", ("target_a", "pred"))
def q_score_ols(spark, d):
    """M4: score train and test with a fixed one-variable model (raw prediction)."""
    return ols_scored(spark, d).select("unit", "year", "month", "split", "target_a", "pred")


@query("prediction_errors", ols_scored_ctes() + f"""
SELECT {ERR_COLS} FROM errors WHERE split = 'test'""", ERR_D)
def q_prediction_errors(spark, d):
    """Error table on test rows, prediction clamped at 0."""
    return errors_of(spark, d, "test")


@query("period_rollup_test", ols_scored_ctes() + """
SELECT year, month, wyear, CAST(count(*) AS BIGINT) AS n,
       CASE WHEN count(*) = count(actual) THEN sum(actual) END AS actual_sum,
       CASE WHEN count(*) = count(pred) THEN sum(pred) END AS pred_sum
FROM errors WHERE split = 'test' GROUP BY year, month, wyear""", ("actual_sum", "pred_sum"))
def q_period_rollup_test(spark, d):
    """A2: rollup of test errors by (year, month, water year)."""
    return accuracy.period_rollup(errors_of(spark, d, "test"))


@query("period_rollup_train", ols_scored_ctes() + """
SELECT year, month, wyear, CAST(count(*) AS BIGINT) AS n,
       CASE WHEN count(*) = count(actual) THEN sum(actual) END AS actual_sum,
       CASE WHEN count(*) = count(pred) THEN sum(pred) END AS pred_sum
FROM errors WHERE split = 'train' GROUP BY year, month, wyear""", ("actual_sum", "pred_sum"))
def q_period_rollup_train(spark, d):
    """A3: rollup of train errors."""
    return accuracy.period_rollup(errors_of(spark, d, "train"))


def _summary_sql(by: str) -> str:
    grp = f"GROUP BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    def s(expr):
        return f"CASE WHEN count(*) = count({expr}) THEN avg({expr}) END"
    return ols_scored_ctes() + f"""
SELECT {sel}{s('error')} AS me, sqrt({s('error * error')}) AS rmse, {s('abs(error)')} AS mae,
       {s('abs(error_pct)')} AS mape, {s('error_pct')} AS mpe
FROM errors WHERE split = 'test' {grp}"""


SUM_D = ("me", "rmse", "mae", "mape", "mpe")


@query("error_summary_unit_year", _summary_sql("unit, year"), SUM_D)
def q_error_summary_unit_year(spark, d):
    """A1 with the grouping the reference frame still carries: one row per (unit, year)."""
    return accuracy.error_summary(errors_of(spark, d, "test"), ["unit", "year"])


@query("error_summary_global", _summary_sql(""), SUM_D)
def q_error_summary_global(spark, d):
    """A1 over all test rows."""
    return accuracy.error_summary(errors_of(spark, d, "test"))


def _metrics_sql() -> str:
    cols = []
    for tag, sfx in (("test", ""), ("train", "_train")):
        r = f"CASE WHEN split = '{tag}' THEN target_a - pred END"
        y = f"CASE WHEN split = '{tag}' THEN target_a END"
        mse = f"avg(({r}) * ({r}))"
        cols += [f"{mse} AS MSE{sfx}", f"sqrt({mse}) AS RMSE{sfx}", f"avg(abs({r})) AS MAE{sfx}",
                 f"1.0 - sum(({r}) * ({r})) / regr_sxx({y}, {y}) AS R2{sfx}",
                 f"{mse} AS Mean_Residual_Deviance{sfx}"]
    return ols_scored_ctes() + "\nSELECT " + ",\n       ".join(cols) + "\nFROM scored"


MET_D = tuple(f"{m}{s}" for s in ("", "_train")
              for m in ("MSE", "RMSE", "MAE", "R2", "Mean_Residual_Deviance"))


@query("regression_metrics", _metrics_sql(), MET_D)
def q_regression_metrics(spark, d):
    """Test and train metrics on the raw prediction, one row."""
    return accuracy.regression_metrics(ols_scored(spark, d), S.target)


@query("attach_prediction_keyed", ols_scored_ctes() + """
, preds AS (SELECT unit, year, month, pred FROM scored)
SELECT c.unit, c.year, c.month, c.target_a AS actual, p.pred
FROM cohort c JOIN preds p ON c.unit = p.unit AND c.year = p.year AND c.month = p.month""",
       ("actual", "pred"))
def q_attach_prediction_keyed(spark, d):
    """Predictions made elsewhere attached by key (unit, year, month), never by position."""
    c = cohort.search_cohort(panel(spark, d), S)
    preds = ols_scored(spark, d).select("unit", "year", "month", "pred")
    return c.join(preds, ["unit", "year", "month"]).select(
        "unit", "year", "month", F.col(S.target).alias("actual"), "pred")
