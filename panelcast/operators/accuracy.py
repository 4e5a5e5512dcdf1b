"""Accuracy tables: error rows, error summaries, period rollups, regression metrics.

Error tables clamp negative predictions to 0; metrics use the raw prediction,
as in the reference.  Summaries follow R's NA rule (one NULL poisons the group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp0, safe_ratio, strict_avg, strict_sum
from ..spec import PanelSpec


def prediction_errors(scored: DataFrame, spec: PanelSpec, pred: str = "pred") -> DataFrame:
    """Rows (unit, year, month, wyear, actual, pred, error, error_pct), prediction clamped at 0."""
    p = clamp0(pred)
    return scored.select(
        spec.unit, spec.year, spec.month, spec.wyear,
        F.col(spec.target).alias("actual"),
        p.alias("pred"),
        (F.col(spec.target) - p).alias("error"),
        safe_ratio(F.col(spec.target) - p, F.col(spec.target)).alias("error_pct"),
    )


def error_summary(errors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """me, rmse, mae, mape, mpe per ``by`` group (empty ``by``: one row)."""
    e, pct = F.col("error"), F.col("error_pct")
    aggs = [strict_avg(e).alias("me"),
            F.sqrt(strict_avg(e * e)).alias("rmse"),
            strict_avg(F.abs(e)).alias("mae"),
            strict_avg(F.abs(pct)).alias("mape"),
            strict_avg(pct).alias("mpe")]
    return errors.groupBy(*by).agg(*aggs)


def period_rollup(errors: DataFrame, by: Sequence[str] = ("year", "month", "wyear")) -> DataFrame:
    """n, actual_sum, pred_sum per period (sums are NULL-poisoned, as R ``sum``)."""
    return errors.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        strict_sum("actual").alias("actual_sum"),
        strict_sum("pred").alias("pred_sum"))


def unit_count(t: DataFrame, unit: str = "unit") -> DataFrame:
    """Exact number of distinct units."""
    return t.agg(F.countDistinct(unit).alias("n_units"))


def regression_metrics(scored: DataFrame, actual: str, pred: str = "pred",
                       split: str = "split") -> DataFrame:
    """MSE, RMSE, MAE, R2, mean residual deviance on test and ``*_train`` on train, one row.

    One pass over the scored frame: each metric is a conditional aggregate, so
    test and train share the scan.  All metrics are over the rows that have an actual value and
    a prediction.  R2 = 1 - MSE / variance (NULL where the actuals don't vary); the built-in
    variance doesn't cancel.  The Gaussian deviance equals the MSE.
    """
    return scored.agg(*_metric_exprs(actual, pred, split))


def accuracy_report(scored: DataFrame, spec: PanelSpec, pred: str = "pred",
                    split: str = "split") -> DataFrame:
    """M7: metrics on raw predictions (test and train) and the error summary on
    clamped test predictions, in one row from one pass over the scored frame."""
    on = F.col(split) == "test"
    p = clamp0(pred)
    e = F.when(on, F.col(spec.target) - p)
    pct = F.when(on, safe_ratio(F.col(spec.target) - p, F.col(spec.target)))
    n_test = F.count(F.when(on, 1))

    def strict(x):
        return F.when(n_test == F.count(x), F.avg(x))
    # err_ prefix: names are case-insensitive, so ``rmse`` would collide with ``RMSE``
    summary = [strict(e).alias("err_me"), F.sqrt(strict(e * e)).alias("err_rmse"),
               strict(F.abs(e)).alias("err_mae"), strict(F.abs(pct)).alias("err_mape"),
               strict(pct).alias("err_mpe"), n_test.alias("n_test"),
               F.count(F.when(F.col(split) == "train", 1)).alias("n_train")]
    return scored.agg(*_metric_exprs(spec.target, pred, split), *summary)


def _metric_exprs(actual: str, pred: str, split: str):
    out = []
    for tag, sfx in (("test", ""), ("train", "_train")):
        on = F.col(split) == tag
        r = F.when(on, F.col(actual) - F.col(pred))
        y = F.when(r.isNotNull(), F.col(actual))     # the same rows in both sums
        mse = F.avg(r * r)
        out += [mse.alias(f"MSE{sfx}"), F.sqrt(mse).alias(f"RMSE{sfx}"),
                F.avg(F.abs(r)).alias(f"MAE{sfx}"),
                F.when(F.var_pop(y) > 0, F.lit(1.0) - mse / F.var_pop(y)).alias(f"R2{sfx}"),
                mse.alias(f"Mean_Residual_Deviance{sfx}")]
    return out
