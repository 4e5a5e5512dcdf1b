"""Model search with user folds, scoring, leaderboard and importance.

Two kinds of candidates:
* closed-form scorers fitted in one aggregate (group mean, one-variable least
  squares) -- exact, so their fold errors can be checked against SQL;
* MLlib estimators (linear, random forest, gradient-boosted trees) cross-validated
  over the user's fold column, several folds beside each other.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import __version__
from ..functions.columns import month_start, quarter_of
from ..session import cut_lineage
from .importance import permute_within


# --- closed-form scorers ------------------------------------------------------

def fit_ols(train: DataFrame, y: str, x: str) -> DataFrame:
    """One-variable least squares in one aggregate: (intercept, slope)."""
    return train.agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"))


def score_ols(df: DataFrame, coefs: DataFrame, x: str, out: str = "pred") -> DataFrame:
    """Attach ``intercept + slope * x``.  The coefficients enter as scalar
    subqueries (one row), so nothing is collected and no join is planned."""
    a = coefs.select("intercept").scalar()
    b = coefs.select("slope").scalar()
    return df.withColumn(out, a + b * F.col(x).cast("double"))


def time_features(t: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """yearmonth, date, quarter and the date as a number (days since 1970)."""
    d = month_start(year, month)
    return (t.withColumn("date", d)
             .withColumn("quarter", quarter_of(month))
             .withColumn("date_num", F.unix_date(F.col("date")).cast("double")))


def fold_index(t: DataFrame, folds: Sequence, fold: str = "fold", out: str = "fold_idx") -> DataFrame:
    """Dense 0-based index of a row's fold in ``folds``; a row without a fold is dropped.

    The fold values are few (one per water year) and stand in the expression: no join, no shuffle of the rows."""
    place = F.array_position(F.array(*[F.lit(v) for v in folds]), F.col(fold))
    return t.where(F.col(fold).isNotNull()).withColumn(out, (place - 1).cast("int"))


def cv_baselines(train: DataFrame, y: str, fold: str,
                 candidates: Sequence[tuple[str, str | None]]) -> DataFrame:
    """M3: out-of-fold error of closed-form candidates, all in one job.

    A candidate is (name, x): x None is the mean of the other folds, otherwise a
    one-variable least squares fitted on the other folds, over the rows where x and y are not
    NULL; only these are scored and counted.  One aggregate gives per-fold sums of differences from the means
    (one row, taken first) for every candidate's x, so large offsets don't cancel; fold k's coefficients are the totals
    minus fold k, over a table of one row a fold; each training row is then
    scored once per candidate by a narrow explode and the errors are averaged
    per (model, fold).  Returns (model, fold, n, mse, mae).
    """
    yc = F.col(y).cast("double")
    xs = [(name, F.col(x).cast("double") if x else F.lit(0.0)) for name, x in candidates]
    both = [yc.isNotNull() & xc.isNotNull() for _, xc in xs]
    means = train.agg(*[F.avg(F.when(b, v)) for b, (_, xc) in zip(both, xs) for v in (xc, yc)]).first()
    mx, my = ([F.lit(m).cast("double") for m in means[k::2]] for k in (0, 1))
    sums = []
    for i, (_, xc) in enumerate(xs):
        dx, dy = F.when(both[i], xc - mx[i]), F.when(both[i], yc - my[i])
        sums += [F.count(dx).alias(f"n{i}"), F.sum(dy).alias(f"sy{i}"), F.sum(dx).alias(f"sx{i}"),
                 F.sum(dx * dx).alias(f"sxx{i}"), F.sum(dx * dy).alias(f"sxy{i}")]
    sums = train.groupBy(fold).agg(*sums)
    names = [c for c in sums.columns if c != fold]
    everything = Window.partitionBy()   # one row a fold
    others = sums.select(fold, *[(F.sum(c).over(everything) - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in names])
    other = {c: F.col(c) for c in names}
    coef_cols = []
    for i, (_, x) in enumerate(candidates):
        n, sy, sx, sxx, sxy = (other[f"{c}{i}"] for c in ("n", "sy", "sx", "sxx", "sxy"))
        b = F.try_divide(sxy - sx * F.try_divide(sy, n), sxx - sx * F.try_divide(sx, n)) if x else F.lit(0.0)
        coef_cols += [F.try_divide(sy - b * sx, n).alias(f"a{i}"), b.alias(f"b{i}")]
    coefs = others.select(fold, *coef_cols)
    scored = train.join(coefs, fold)   # one row per fold: the planner broadcasts it by its size
    per = F.array(*[F.struct(F.lit(name).alias("model"),
                             (yc - my[i] - (F.col(f"a{i}") + F.col(f"b{i}") * (xc - mx[i]))).alias("r"))
                    for i, (name, xc) in enumerate(xs)])
    e = scored.select(fold, F.explode(per).alias("e")).select(fold, "e.model", "e.r")
    return e.groupBy("model", fold).agg(
        F.count("r").alias("n"), F.avg(F.col("r") * F.col("r")).alias("mse"),
        F.avg(F.abs("r")).alias("mae"))


def cv_baseline(train: DataFrame, y: str, fold: str, x: str | None = None) -> DataFrame:
    """Out-of-fold error of one closed-form candidate (see :func:`cv_baselines`)."""
    return cv_baselines(train, y, fold, [("m", x)]).drop("model")


def leaderboard(cv_errors: DataFrame, model: str = "model", metric: str = "mse") -> DataFrame:
    """O1: rank candidates by mean cross-validated error, best first (ties by name).
    One row per candidate; the global window runs over that small table only."""
    per = cv_errors.groupBy(model).agg(
        F.avg(metric).alias(f"mean_{metric}"), F.count(F.lit(1)).alias("n_folds"))
    w = Window.orderBy(F.col(f"mean_{metric}").asc_nulls_last(), F.col(model))
    return per.withColumn("rank", F.row_number().over(w))


def leader(lb: DataFrame) -> DataFrame:
    """Top-1 of the leaderboard (a one-row report, not a cap on data)."""
    return lb.filter(F.col("rank") == 1)


def feature_ranking(importances: DataFrame, feature: str = "feature",
                    value: str = "importance") -> DataFrame:
    """Ordered variable importance with scaled value and share of the total."""
    tot = Window.partitionBy()
    mx = F.max(value).over(tot)
    return importances.select(
        feature, value,
        F.when(mx > 0, F.col(value) / mx).alias("scaled_importance"),
        (F.col(value) / F.sum(value).over(tot)).alias("percentage"),
        F.row_number().over(Window.orderBy(F.col(value).desc(), F.col(feature))).alias("rank"))


# --- MLlib search ---------------------------------------------------------------

def assemble(t: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """M1: features to one vector column; NULL/NaN kept as NaN (``handleInvalid='keep'``)."""
    from pyspark.ml.feature import VectorAssembler
    cast = t.select("*", *[F.col(c).cast("double").alias(f"_f_{c}") for c in features])
    va = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol=out,
                         handleInvalid="keep")
    return va.transform(cast).drop(*[f"_f_{c}" for c in features])


def candidate_grid(label: str, seed: int, reg_params: Sequence[float] = (0.0, 0.1), rf_trees: int = 20,
                   rf_depths: Sequence[int] = (5,), gbt_rounds: int = 20, gbt_depths: Sequence[int] = (3,)):
    """The candidate families replacing the time-budgeted search: linear, random forest and
    gradient-boosted trees, each with the grid that is asked for."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
    from pyspark.ml.tuning import ParamGridBuilder
    lr = LinearRegression(featuresCol="features", labelCol=label)
    rf = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed, numTrees=rf_trees)
    gbt = GBTRegressor(featuresCol="features", labelCol=label, seed=seed, maxIter=gbt_rounds)
    return [
        ("linear", lr, ParamGridBuilder().addGrid(lr.regParam, list(reg_params)).build()),
        ("random_forest", rf, ParamGridBuilder().addGrid(rf.maxDepth, list(rf_depths)).build()),
        ("gbt", gbt, ParamGridBuilder().addGrid(gbt.maxDepth, list(gbt_depths)).build()),
    ]


#: Training rows of one partition of the search, about, where there are more than the cores can share.
ROWS = 250_000


def search_table(train: DataFrame, label: str, features: Sequence[str], fold: str = "fold") -> tuple[DataFrame, int]:
    """(features, label, _fold_idx) of the rows with a fold, and the number of folds.

    A search is some thousand short stages over this table, and each of their tasks sends its result to the driver: so
    it has three partitions a core, or one for ``ROWS`` rows, and not one for some MB of what it is made from."""
    counts = train.where(F.col(fold).isNotNull()).groupBy(fold).count().collect()   # one row a fold
    folds, n = sorted(r[0] for r in counts), sum(r["count"] for r in counts)
    if len(folds) < 2:
        raise ValueError(f"{len(folds)} folds in {fold}, at least two are needed")
    parts = max(3 * train.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS))
    rows = fold_index(assemble(train, features), folds, fold, "_fold_idx")
    return rows.select("features", label, "_fold_idx").coalesce(parts), len(folds)


def model_search(train: DataFrame, label: str, features: Sequence[str], fold: str = "fold",
                 seed: int = 160617, parallelism: int = 4, **grid_options):
    """M2: cross-validated search with the user's fold column (leave one fold out).

    Returns (leaderboard rows as a list of dicts, best fitted model, its name).  Of a family, ``parallelism`` fits (a
    candidate on one fold's other rows) run beside each other: a fit is a row of short jobs, which alone leave most cores
    idle.  They read the one persisted table (memory and disk), no copy a fold; only the leader is fitted on all rows.
    """
    from pyspark import StorageLevel
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.util import inheritable_thread_target

    table, n_folds = search_table(train, label, features, fold)
    data = table.persist(StorageLevel.MEMORY_AND_DISK)
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse")
    rows, fits = [], {}
    try:
        for family, est, grid in candidate_grid(label, seed, **grid_options):
            def error(pm, i):
                model = est.fit(data.where(F.col("_fold_idx") != i), pm)
                return ev.evaluate(model.transform(data.where(F.col("_fold_idx") == i)))
            # wrapped one by one: each fit has job properties of its own
            jobs = [inheritable_thread_target(train.sparkSession)(partial(error, pm, i)) for pm in grid for i in range(n_folds)]
            began = time.perf_counter()
            with ThreadPool(parallelism) as pool:
                errors = pool.map(lambda job: job(), jobs, chunksize=1)
            took = time.perf_counter() - began
            for pm, metric in zip(grid, np.reshape(errors, (len(grid), n_folds)).mean(axis=1)):
                params = ",".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name))
                name = f"{family}[{params}]"
                rows.append({"model_id": name, "family": family, "rmse": float(metric), "mse": float(metric) ** 2,
                             "n_folds": n_folds, "family_fit_sec": took})
                fits[name] = est, pm
        rows.sort(key=lambda r: (r["rmse"], r["model_id"]))
        for i, r in enumerate(rows):
            r["rank"] = i + 1
        best = rows[0]["model_id"]
        est, pm = fits[best]
        model = est.fit(data, pm)
    finally:
        data.unpersist()
    return rows, model, best


def model_importance(model, features: Sequence[str], train: DataFrame | None = None) -> list[tuple[str, float]]:
    """M6: variable importance of a fitted model.  Trees: split-gain importances;
    linear: |coefficient| x feature standard deviation (standardised effect)."""
    if hasattr(model, "featureImportances"):
        imp = model.featureImportances.toArray()
        return [(f, float(v)) for f, v in zip(features, imp)]
    coefs = model.coefficients.toArray()
    sds = [1.0] * len(features)
    if train is not None:
        row = train.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in features]).first()
        sds = [float(row[c] or 0.0) for c in features]
    return [(f, abs(float(c)) * s) for f, c, s in zip(features, coefs, sds)]


def permutation_importance(df: DataFrame, score: Callable[[DataFrame], DataFrame], y: str, features: Sequence[str],
                           key: str, within: Sequence[str], seed: int) -> DataFrame:
    """M6 for any leader: (feature, n, importance), the rise of the mean squared error when a feature is permuted.

    ``score(df) -> df`` adds ``pred`` and keeps the other columns.  ``key`` tells rows apart.  Each row has one
    donor in its group (``within``, the folds), drawn by seeded hashes; for each feature in turn the row takes the donor's value.  All
    features stand in one table of (features + 1) x rows, so the scorer runs once.  Rows without target or prediction, with
    the value or the donor's, don't count in that feature's errors.  A feature the scorer doesn't use has importance 0.
    """
    cols = [F.col(c) for c in features]
    donors = permute_within(df.withColumn("_x", F.struct(*cols)), within, "_x", key, seed, out="_donor")
    donors = cut_lineage(donors.drop("_x"), "donors")   # read once more for each feature
    versions = F.array(
        F.struct(F.lit(None).cast("string").alias("feature"), *cols),
        *[F.struct(F.lit(f).alias("feature"), *[(F.col("_donor")[c] if c == f else F.col(c)).alias(c) for c in features])
          for f in features])
    rest = [c for c in df.columns if c not in features]
    table = donors.select(*rest, F.explode(versions).alias("_v")).select(*rest, "_v.feature", *[f"_v.{c}" for c in features])
    scored = score(table.withColumnRenamed("feature", "_feature"))
    r = F.col(y).cast("double") - F.col("pred")
    errors = scored.groupBy("_feature").agg(F.count(r).alias("n"), F.avg(r * r).alias("mse"))   # features + 1 rows
    base = errors.where("_feature IS NULL").select("mse").scalar()
    return errors.where("_feature IS NOT NULL").select(F.col("_feature").alias("feature"), "n",
                                                       (F.col("mse") - base).alias("importance"))


# --- the leader on disk -----------------------------------------------------------

def save_leader(model, path: str, features: Sequence[str], target: str, fold_rule: str) -> None:
    """K4: the fitted MLlib leader with a manifest (one row) of what it was fitted on; ``path`` is a new folder."""
    from pyspark.sql import SparkSession
    kind = type(model)
    model.write().save(f"{path}/model")
    row = [(f"{kind.__module__}.{kind.__name__}", list(features), target, fold_rule, __version__)]
    (SparkSession.getActiveSession().createDataFrame(
        row, "kind string, features array<string>, target string, fold_rule string, version string")
     .write.parquet(f"{path}/manifest"))


def load_leader(spark, path: str, features: Sequence[str], target: str, fold_rule: str):
    """The leader back; raises if the manifest names other features, another order, target, fold rule or version."""
    import importlib
    m = spark.read.parquet(f"{path}/manifest").first()
    asked = {"features": list(features), "target": target, "fold_rule": fold_rule, "version": __version__}
    for name, value in asked.items():
        if m[name] != value:
            raise ValueError(f"the model in {path} has {name} {m[name]!r}, not {value!r}")
    module, _, kind = m["kind"].rpartition(".")
    if not module.startswith("pyspark.ml."):
        raise ValueError(f"the model in {path} is a {m['kind']}")
    return getattr(importlib.import_module(module), kind).load(f"{path}/model")
