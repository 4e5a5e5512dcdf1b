"""Error tables, summaries, rollups and metrics on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import accuracy, search
from panelcast.spec import ANALOGUE

SCHEMA = "unit long, year int, month int, wyear int, target_a double, pred double, split string"


def scored(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_errors_clamp_and_ratio(spark):
    s = scored(spark, [(1, 2000, 1, 2000, 0.0, 5.0, "test"), (1, 2000, 2, 2000, 10.0, -3.0, "test"),
                       (1, 2000, 3, 2000, 10.0, None, "test")])
    e = {r.month: r for r in accuracy.prediction_errors(s, ANALOGUE).collect()}
    assert e[1].error_pct is None and e[1].error == -5.0
    assert e[2].pred == 0.0 and e[2].error == 10.0 and e[2].error_pct == 1.0
    assert e[3].pred is None and e[3].error is None


def test_summary_poisoned_by_null_error(spark):
    s = scored(spark, [(1, 2000, 1, 2000, 10.0, 8.0, "test"), (1, 2000, 2, 2000, 10.0, None, "test"),
                       (2, 2000, 1, 2000, 10.0, 8.0, "test")])
    e = accuracy.prediction_errors(s, ANALOGUE)
    got = {r.unit: r for r in accuracy.error_summary(e, ["unit"]).collect()}
    assert got[1].me is None and got[1].rmse is None
    assert got[2].me == 2.0 and got[2].mape == pytest.approx(0.2)


def test_rollup_counts_sum_to_rows(spark):
    data = [(u, 2000, m, 2000, float(u * m), float(u + m), "test") for u in range(1, 5) for m in range(1, 4)]
    e = accuracy.prediction_errors(scored(spark, data), ANALOGUE)
    r = accuracy.period_rollup(e)
    assert r.agg(F.sum("n")).first()[0] == len(data)


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(100, 10, 50)
    p = y + rng.normal(0, 3, 50)
    split = ["test"] * 20 + ["train"] * 30
    data = [(1, 2000, i, 2000, float(a), float(b), s) for i, (a, b, s) in enumerate(zip(y, p, split))]
    m = accuracy.regression_metrics(scored(spark, data), "target_a").first()
    yt, pt = y[:20], p[:20]
    mse = np.mean((yt - pt) ** 2)
    assert m.MSE == pytest.approx(mse)
    assert m.RMSE == pytest.approx(np.sqrt(mse))
    assert m.MAE == pytest.approx(np.mean(np.abs(yt - pt)))
    assert m.R2 == pytest.approx(1 - np.sum((yt - pt) ** 2) / np.sum((yt - yt.mean()) ** 2))
    assert m.MSE_train == pytest.approx(np.mean((y[20:] - p[20:]) ** 2))
    assert m.Mean_Residual_Deviance == m.MSE


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 10, 40)
    y = 3 + 2 * x + rng.normal(0, 1, 40)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    co = search.fit_ols(df, "y", "x").first()
    b, a = np.polyfit(x, y, 1)
    assert co.slope == pytest.approx(b) and co.intercept == pytest.approx(a)
    pred = search.score_ols(df, search.fit_ols(df, "y", "x"), "x").select("pred").collect()
    assert pred[0].pred == pytest.approx(a + b * x[0])


def test_cv_baseline_mean_is_leave_one_fold_out(spark):
    data = [(f, float(v)) for f, vals in {1: [1, 3], 2: [5], 3: [10, 20]}.items() for v in vals]
    df = spark.createDataFrame(data, "fold int, y double")
    got = {r.fold: r.mse for r in search.cv_baseline(df, "y", "fold").collect()}
    m1 = np.mean([5, 10, 20])
    assert got[1] == pytest.approx(np.mean([(1 - m1) ** 2, (3 - m1) ** 2]))
