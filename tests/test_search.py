"""Closed-form candidates of the search (large offsets, missing values), importance of any scorer, the stored leader."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import linear, search


def rows(offset=0.0, missing=False):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 3, 240)
    y = 2.0 * x + rng.normal(0, 0.1, 240)
    return [(int(i % 4), float(y[i]), None if missing and i % 5 == 0 else float(x[i] + offset)) for i in range(240)]


def brute(data):
    out = {}
    for fold in range(4):
        fit = [(x, y) for f, y, x in data if f != fold and x is not None]
        b, a = np.polyfit([p[0] - fit[0][0] for p in fit], [p[1] for p in fit], 1)
        r = [y - (a + b * (x - fit[0][0])) for f, y, x in data if f == fold and x is not None]
        out[fold] = (len(r), float(np.mean(np.square(r))), float(np.mean(np.abs(r))))
    return out


@pytest.mark.parametrize("offset, missing", [(0.0, False), (1e9, False), (0.0, True), (1e6, True)])
def test_least_squares_by_folds(spark, offset, missing):
    data = rows(offset, missing)
    df = spark.createDataFrame(data, "fold int, y double, x double")
    want = brute(data)
    got = {r.fold: r for r in search.cv_baselines(df, "y", "fold", [("mean", None), ("ols", "x")]).where("model = 'ols'").collect()}
    for fold, (n, mse, mae) in want.items():
        assert got[fold].n == n
        assert got[fold].mse == pytest.approx(mse, rel=1e-3) and got[fold].mae == pytest.approx(mae, rel=1e-3)


FEATS = ["a", "b", "same", "twice"]


def wide(offset=0.0, n=200):
    """Target and features, one of them constant and one the double of another; every seventh row lacks a value."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(0, 2, n), rng.exponential(1, n)
    y = 3 * a - b + rng.normal(0, 0.2, n)
    return [(i, i % 4, float(y[i]), None if i % 7 == 0 else float(a[i] + offset), float(b[i]), 5.0, float(2 * b[i])) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, fold int, y double, a double, b double, same double, twice double")


def ridge(fit, penalty):
    """Intercept and coefficients by numpy, on the two features that count (``twice`` repeats ``b``, ``same`` is constant)."""
    x, y = np.array([r[3:5] for r in fit]), np.array([r[2] for r in fit])
    sx, sy = x.std(0), y.std()
    z = (x - x.mean(0)) / sx
    u = np.linalg.solve(z.T @ z / len(z) + penalty * np.eye(2), z.T @ ((y - y.mean()) / sy) / len(z))
    b = u * sy / sx
    return x.mean(0), y.mean(), b


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_linear_search_equals_fits_one_by_one(spark, offset):
    data = wide(offset)
    full = [r for r in data if r[3] is not None]
    got = {(r.penalty, r.fold): r for r in linear.linear_search(frame(spark, data), "y", FEATS[:3], "fold", [0.0, 0.3]).collect()}
    assert len(got) == 8
    for (penalty, fold), r in got.items():
        mx, my, b = ridge([q for q in full if q[1] != fold], penalty)
        errors = [q[2] - my - (np.array(q[3:5]) - mx) @ b for q in full if q[1] == fold]
        assert r.n == len(errors) and r.mse == pytest.approx(float(np.mean(np.square(errors))), rel=1e-6)
        assert r.model == f"linear[penalty={penalty}]"


def test_linear_fit_and_score(spark):
    data = wide()
    full = [r for r in data if r[3] is not None]
    df = frame(spark, data)
    fit = linear.linear_fit(df, "y", FEATS)
    mx, my, b = ridge(full, 0.0)
    row = fit.first()
    assert row.coefficients == pytest.approx([*b, 0.0, 0.0])
    assert row.intercept == pytest.approx(my - mx @ b)
    scored = {r.id: r.pred for r in linear.score_linear(df, fit, FEATS).collect()}
    for q in data:
        want = None if q[3] is None else pytest.approx(my + (np.array(q[3:5]) - mx) @ b)
        assert scored[q[0]] == want


def test_linear_search_without_rows_or_with_one_fold(spark):
    df = frame(spark, wide())
    assert linear.linear_search(df.where("id < 0"), "y", FEATS, "fold").count() == 0
    assert linear.linear_search(df.where("fold = 1"), "y", FEATS, "fold").count() == 0
    nothing = linear.linear_fit(df.where("id < 0"), "y", FEATS)
    assert nothing.count() == 0


def test_importance_of_a_function(spark):
    """Against permutations drawn one by one from the same hashes; a feature the scorer ignores has importance 0."""
    data = [r for r in wide(n=90) if r[3] is not None] + [(500, 0, None, 1.0, 1.0, 5.0, 2.0), (501, None, 1.0, 2.0, 3.0, 5.0, 6.0)]
    def score(df):
        return df.withColumn("pred", 3 * F.col("a") - F.col("b"))
    out = search.permutation_importance(frame(spark, data), score, "y", ["a", "b", "same"], "id", ["fold"], 5)
    got = {r.feature: (r.n, r.importance) for r in out.collect()}

    def h(which, r):
        text = f"5|{which}|{'' if r[1] is None else r[1]}|{r[0]}"
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16), r[0]
    donor = {}
    for fold in {r[1] for r in data}:
        rows = [r for r in data if r[1] == fold]
        for r, q in zip(sorted(rows, key=lambda r: h("o", r)), sorted(rows, key=lambda r: h("p", r)), strict=True):
            donor[r[0]] = q
    rows = [r for r in data if r[2] is not None]
    base = np.mean([(r[2] - 3 * r[3] + r[4]) ** 2 for r in rows])
    a = np.mean([(r[2] - 3 * donor[r[0]][3] + r[4]) ** 2 for r in rows]) - base
    b = np.mean([(r[2] - 3 * r[3] + donor[r[0]][4]) ** 2 for r in rows]) - base
    n = len(rows)
    assert got == {"a": (n, pytest.approx(a)), "b": (n, pytest.approx(b)), "same": (n, 0.0)}


def test_search_equals_fits_one_by_one(spark):
    """Folds with gaps, and rows without a fold, which take no part; each candidate's error is the mean over the folds."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression
    data = [(i, f * 3 + 1, *rest) for i, f, *rest in wide() if rest[1] is not None]
    df = frame(spark, data + [(900, None, 9e9, 1.0, 1.0, 5.0, 2.0)]).repartition(30).cache()
    feats = ["a", "b"]
    options = {"reg_params": (0.0, 0.5), "rf_trees": 2, "rf_depths": (2,), "gbt_rounds": 2, "gbt_depths": (1,)}
    rows, model, name = search.model_search(df, "y", feats, "fold", seed=3, parallelism=3, **options)
    assert [r["rank"] for r in rows] == [1, 2, 3, 4] and {r["n_folds"] for r in rows} == {4}
    assert [r["rmse"] for r in rows] == sorted(r["rmse"] for r in rows)
    assert name == rows[0]["model_id"] == "linear[regParam=0.0]"
    ev = RegressionEvaluator(labelCol="y")
    x = search.assemble(df.where("fold IS NOT NULL"), feats).cache()
    got = {r["model_id"]: r["rmse"] for r in rows}
    for model_id, est in (("linear[regParam=0.0]", LinearRegression(labelCol="y", regParam=0.0)),
                          ("linear[regParam=0.5]", LinearRegression(labelCol="y", regParam=0.5))):
        errors = [ev.evaluate(est.fit(x.where(f"fold <> {f}")).transform(x.where(f"fold = {f}"))) for f in (1, 4, 7, 10)]
        assert got[model_id] == pytest.approx(np.mean(errors))
    whole = LinearRegression(labelCol="y").fit(x)
    assert model.coefficients.toArray() == pytest.approx(whole.coefficients.toArray())
    with pytest.raises(ValueError, match="folds"):
        search.model_search(df.where("fold = 1"), "y", feats)


def test_search_table_has_few_partitions(spark):
    """A search runs thousands of stages over it: their tasks follow the cores and the rows, not the partitions read."""
    cores = spark.sparkContext.defaultParallelism
    df = frame(spark, wide()).repartition(40 * cores)
    table, n_folds = search.search_table(df, "y", ["a", "b"])
    assert n_folds == 4 and table.columns == ["features", "y", "_fold_idx"]
    assert table.rdd.getNumPartitions() <= 3 * cores
    assert table.count() == 200
    assert sorted(r[0] for r in table.select("_fold_idx").distinct().collect()) == [0, 1, 2, 3]


def test_leader_comes_back_from_its_folder(spark, tmp_dir):
    from pyspark.ml.regression import LinearRegression
    df = search.assemble(frame(spark, [r for r in wide() if r[3] is not None]), ["a", "b"])
    model = LinearRegression(labelCol="y").fit(df)
    search.save_leader(model, f"{tmp_dir}/m", ["a", "b"], "y", "id % 4")
    back = search.load_leader(spark, f"{tmp_dir}/m", ["a", "b"], "y", "id % 4")
    want = [r.prediction for r in model.transform(df).orderBy("id").collect()]
    assert [r.prediction for r in back.transform(df).orderBy("id").collect()] == want
    for wrong in ((["b", "a"], "y", "id % 4"), (["a", "b"], "z", "id % 4"), (["a", "b"], "y", "id % 5")):
        with pytest.raises(ValueError, match="the model in"):
            search.load_leader(spark, f"{tmp_dir}/m", *wrong)
