"""Queries: feature matrix, fold-wise baselines, leaderboard, MLlib search, importance,
accuracy report (SURVEY 2.8 O1-O3, 2.9 M1-M4, M6, M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accuracy, cohort, linear, search
from ..sources.panel import panel_table as panel
from ..spec import ANALOGUE as S
from ..spec import ANALOGUE_B as B
from ..spec import SEARCH_FEATURES
from .oracle_sql import cohort_ctes, ols_scored_ctes
from .q_accuracy import ols_scored
from .q_forest import _h
from .registry import query
from ..session import scratch_path, session_key

BASELINES = (("mean", None), ("ols_lines", "lines"), ("ols_price", "price"), ("ols_tax", "tax"))


def train_frame(spark, d, spec=S):
    c = cohort.with_split(cohort.search_cohort(panel(spark, d), spec), spec)
    return search.time_features(c.filter(F.col("split") == "train"))


FM_COLS = ("unit", "year", "month", "fold") + SEARCH_FEATURES + ("target_a",)


@query("feature_matrix", cohort_ctes() + """
SELECT unit, year, month, fold,
       CAST(date_diff('day', DATE '1970-01-01', make_date(year, month, 1)) AS DOUBLE) AS date_num,
       wyear, CAST((month - 1) // 3 + 1 AS INTEGER) AS quarter,
       tax, lines, size, price, bal, nation, project, target_a
FROM cohort""", ("date_num", "tax", "size", "price", "bal", "target_a"))
def q_feature_matrix(spark, d):
    """M1: the model's feature columns (date as days since 1970, quarter) on the cohort."""
    c = search.time_features(cohort.search_cohort(panel(spark, d), S))
    return c.select(*dict.fromkeys(FM_COLS))


def _cv_sql(x: str | None, model: str | None = None) -> str:
    xc = f"CAST({x} AS DOUBLE)" if x else "target_a"
    sel = f"'{model}' AS model, " if model else ""
    if x is None:
        co = "(t.sy - f.sy) / (t.n - f.n) AS a, 0.0 AS b"
    else:
        b = (f"((t.sxy - f.sxy) - (t.sx - f.sx) * (t.sy - f.sy) / (t.n - f.n)) / "
             f"((t.sxx - f.sxx) - (t.sx - f.sx) * (t.sx - f.sx) / (t.n - f.n))")
        co = f"((t.sy - f.sy) - ({b}) * (t.sx - f.sx)) / (t.n - f.n) AS a, {b} AS b"
    return f"""SELECT {sel}r.fold, CAST(count(*) AS BIGINT) AS n,
       avg((r.target_a - (c.a + c.b * {xc})) * (r.target_a - (c.a + c.b * {xc}))) AS mse,
       avg(abs(r.target_a - (c.a + c.b * {xc}))) AS mae
FROM train r JOIN (
  SELECT f.fold, {co}
  FROM (SELECT fold, count(*) AS n, sum(target_a) AS sy, sum({xc}) AS sx,
               sum({xc} * {xc}) AS sxx, sum({xc} * target_a) AS sxy FROM train GROUP BY fold) f,
       (SELECT count(*) AS n, sum(target_a) AS sy, sum({xc}) AS sx,
               sum({xc} * {xc}) AS sxx, sum({xc} * target_a) AS sxy FROM train) t
) c ON r.fold = c.fold
GROUP BY r.fold"""


TRAIN_CTE = ols_scored_ctes() + ",\ntrain AS (SELECT * FROM split WHERE split = 'train')\n"


@query("cv_baseline_mean", TRAIN_CTE + _cv_sql(None), ("mse", "mae"))
def q_cv_baseline_mean(spark, d):
    """M3 (a): out-of-fold error of the mean of the other folds, per fold."""
    return search.cv_baseline(train_frame(spark, d), S.target, "fold")


@query("cv_baseline_ols", TRAIN_CTE + _cv_sql("lines"), ("mse", "mae"))
def q_cv_baseline_ols(spark, d):
    """M3 (b): out-of-fold error of one-variable least squares fitted on the other folds."""
    return search.cv_baseline(train_frame(spark, d), S.target, "fold", "lines")


def cv_errors(spark, d):
    return search.cv_baselines(train_frame(spark, d), S.target, "fold", BASELINES)


@query("leaderboard", TRAIN_CTE + """, cv AS (
""" + "\nUNION ALL\n".join(_cv_sql(x, m) for m, x in BASELINES) + """)
SELECT model, avg(mse) AS mean_mse, CAST(count(*) AS BIGINT) AS n_folds,
       sqrt(avg(mse)) AS rmse,
       CAST(row_number() OVER (ORDER BY avg(mse), model) AS INTEGER) AS rank
FROM cv GROUP BY model""", ("mean_mse", "rmse"))
def q_leaderboard(spark, d):
    """O1 + O2: closed-form candidates ranked by cross-validated error; rank 1 is the leader."""
    lb = search.leaderboard(cv_errors(spark, d))
    return lb.select("model", "mean_mse", "n_folds", F.sqrt("mean_mse").alias("rmse"), "rank")


_SEARCH_MEMO: dict = {}


def fitted_search(spark, d):
    """Fit the search once per (session, data folder); later queries reuse the leader."""
    key = session_key(spark, d)
    if key not in _SEARCH_MEMO:
        _SEARCH_MEMO.clear()
        _SEARCH_MEMO[key] = search.model_search(train_frame(spark, d), S.target, SEARCH_FEATURES,
                                                "fold", seed=S.seed)
    return _SEARCH_MEMO[key]


@query("cv_search")
def q_cv_search(spark, d):
    """M2: MLlib candidates (linear, random forest, GBT) cross-validated over the
    water-year folds; leaderboard of mean fold RMSE.  Rows-only (MLlib values
    are not reproducible by SQL)."""
    rows, _, _ = fitted_search(spark, d)
    return spark.createDataFrame(rows, "model_id string, family string, rmse double, mse double, "
                                       "n_folds long, family_fit_sec double, rank long")


@query("feature_ranking")
def q_feature_ranking(spark, d):
    """O3 + M6: ordered variable importance of the leader of the MLlib search."""
    _, model, _ = fitted_search(spark, d)
    imp = search.model_importance(model, SEARCH_FEATURES, train_frame(spark, d))
    return search.feature_ranking(spark.createDataFrame(imp, "feature string, importance double"))


def _report_sql() -> str:
    from .q_accuracy import _metrics_sql
    m = _metrics_sql()
    head, _, tail = m.rpartition("\nSELECT ")
    def s(expr):
        return f"CASE WHEN count(*) = count({expr}) THEN avg({expr}) END"
    summ = f"""SELECT {s('error')} AS err_me, sqrt({s('error * error')}) AS err_rmse,
       {s('abs(error)')} AS err_mae, {s('abs(error_pct)')} AS err_mape, {s('error_pct')} AS err_mpe,
       CAST(count(*) AS BIGINT) AS n_test FROM errors WHERE split = 'test'"""
    return (head + f""",
met AS (SELECT {tail}),
summ AS ({summ}),
ntr AS (SELECT CAST(count(*) AS BIGINT) AS n_train FROM scored WHERE split = 'train')
SELECT * FROM met, summ, ntr""")


_REP_D = tuple(f"{m}{s}" for s in ("", "_train")
               for m in ("MSE", "RMSE", "MAE", "R2", "Mean_Residual_Deviance")) + (
    "err_me", "err_rmse", "err_mae", "err_mape", "err_mpe")


@query("accuracy_report", _report_sql(), _REP_D)
def q_accuracy_report(spark, d):
    """M7: metrics (test, train) and the test error summary from one scored frame, one row."""
    return accuracy.accuracy_report(ols_scored(spark, d), S)


@query("leader", TRAIN_CTE + """, cv AS (
""" + "\nUNION ALL\n".join(_cv_sql(x, m) for m, x in BASELINES) + """)
SELECT model, mean_mse FROM (
  SELECT model, avg(mse) AS mean_mse, row_number() OVER (ORDER BY avg(mse), model) AS rk
  FROM cv GROUP BY model) WHERE rk = 1""", ("mean_mse",))
def q_leader(spark, d):
    """O2: the leader of the closed-form candidates (the top-1 row is the feature)."""
    return search.leader(search.leaderboard(cv_errors(spark, d))).select("model", "mean_mse")


@query("scenario_forecast_gbt")
def q_scenario_forecast_gbt(spark, d):
    """M5 with the MLlib leader as scorer: all 16 scenario tables scored by
    ``transform`` in one job (rows-only)."""
    from ..operators import scenario
    from .q_scenario import selected_units
    _, model, _ = fitted_search(spark, d)

    def score(df):
        x = df.withColumn("date_num", F.unix_date("date").cast("double"))
        out = model.transform(search.assemble(x, SEARCH_FEATURES))
        return out.withColumnRenamed("prediction", "pred").drop("features")
    scen = scenario.scenario_table(panel(spark, d))
    return scenario.scenario_forecast(scen, selected_units(spark, d), S, score)


# --- exact linear search ------------------------------------------------------------

PENALTIES = (0.0, 0.01, 0.1, 1.0)


def _linear_sql(target: str) -> str:
    """Twin of the linear search: for every fold the correlations of the other folds' rows, elimination one variable at a
    time over (row, column, value) tables, and every row scored with its fold's coefficients."""
    p = len(SEARCH_FEATURES)
    num = {"date_num": "date_diff('day', DATE '1970-01-01', make_date(year, month, 1))", "quarter": "(month - 1) // 3 + 1"}
    values = ", ".join(f"CAST({num.get(c, c)} AS DOUBLE)" for c in (*SEARCH_FEATURES, target))
    steps = "".join(f""",
e{k + 1} AS (SELECT a.k, a.pen, a.i, a.j,
         CASE WHEN c.v > {linear.LEAST_PIVOT} THEN CASE WHEN a.i = {k} THEN a.v / c.v ELSE a.v - b.v * r.v / c.v END
              WHEN a.i = {k} THEN 0.0 ELSE a.v END AS v
       FROM e{k} a JOIN e{k} b ON b.k = a.k AND b.pen = a.pen AND b.i = a.i AND b.j = {k}
       JOIN e{k} r ON r.k = a.k AND r.pen = a.pen AND r.i = {k} AND r.j = a.j
       JOIN e{k} c ON c.k = a.k AND c.pen = a.pen AND c.i = {k} AND c.j = {k})""" for k in range(p))
    return ols_scored_ctes(target) + f""",
full_rows AS (SELECT row_number() OVER () AS rid, fold, v FROM (
  SELECT fold, [{values}] AS v FROM split WHERE split = 'train') WHERE fold IS NOT NULL AND list_aggregate(v, 'count') = {p + 1}),
vals AS (SELECT rid, fold, i, v[i + 1] AS x FROM full_rows, range({p + 1}) t(i)),
folds AS (SELECT DISTINCT fold AS k FROM full_rows),
centres AS (SELECT k, i, avg(x) AS m, stddev_pop(x) AS sd FROM folds JOIN vals ON fold <> k GROUP BY k, i),
std AS (SELECT f.k, v.rid, v.i, CASE WHEN c.sd > 0 THEN (v.x - c.m) / c.sd ELSE 0.0 END AS z
        FROM folds f JOIN vals v ON v.fold <> f.k JOIN centres c ON c.k = f.k AND c.i = v.i),
corr AS (SELECT a.k, a.i, b.i AS j, avg(a.z * b.z) AS r FROM std a JOIN std b ON a.k = b.k AND a.rid = b.rid
         WHERE a.i < {p} GROUP BY a.k, a.i, b.i),
e0 AS (SELECT k, pen, i, j, r + CASE WHEN i = j THEN pen ELSE 0.0 END AS v
       FROM corr, (SELECT unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in PENALTIES)}]) AS pen)){steps},
coef AS (SELECT e.k, e.pen, e.i, CASE WHEN c.sd > 0 THEN e.v * y.sd / c.sd ELSE 0.0 END AS b, c.m
         FROM e{p} e JOIN centres c ON c.k = e.k AND c.i = e.i JOIN centres y ON y.k = e.k AND y.i = {p} WHERE e.j = {p}),
fit AS (SELECT v.rid, v.fold, c.pen, sum(c.b * (v.x - c.m)) AS f FROM vals v JOIN coef c ON c.k = v.fold AND c.i = v.i
        GROUP BY v.rid, v.fold, c.pen),
linear AS (SELECT 'linear[penalty=' || CAST(f.pen AS VARCHAR) || ']' AS model, f.pen AS penalty, f.fold,
                  CAST(count(*) AS BIGINT) AS n, avg(pow(v.x - y.m - f.f, 2)) AS mse
           FROM fit f JOIN vals v ON v.rid = f.rid AND v.i = {p} JOIN centres y ON y.k = f.fold AND y.i = {p}
           GROUP BY f.pen, f.fold)"""


def linear_errors(spark, d, spec):
    return linear.linear_search(train_frame(spark, d, spec), spec.target, SEARCH_FEATURES, "fold", PENALTIES)


@query("cv_linear", _linear_sql(S.target) + "\nSELECT * FROM linear", ("mse:4",))
def q_cv_linear(spark, d):
    """M2: linear candidates on all features with four penalties; exact error on each fold of the fit on the others."""
    return linear_errors(spark, d, S)


_LB_SQL = """
SELECT model, avg(mse) AS mean_mse, CAST(count(*) AS BIGINT) AS n_folds, sqrt(avg(mse)) AS rmse,
       CAST(row_number() OVER (ORDER BY avg(mse), model) AS INTEGER) AS rank
FROM linear GROUP BY model"""


@query("leaderboard_linear_b", _linear_sql(B.target) + _LB_SQL, ("mean_mse:2", "rmse"))
def q_leaderboard_linear_b(spark, d):
    """M2 + O1 for the second target: its own cohort, linear candidates ranked by cross-validated error."""
    lb = search.leaderboard(linear_errors(spark, d, B))
    return lb.select("model", "mean_mse", "n_folds", F.sqrt("mean_mse").alias("rmse"), "rank")


# --- importance of any leader -------------------------------------------------------

IMP_FEATURES = ("lines", "price", "tax")


def keyed_train(spark, d):
    """Training rows with one key: unit, year and month."""
    return train_frame(spark, d).withColumn("key", F.concat_ws("-", "unit", "year", "month"))


def _scorer_importance_sql() -> str:
    key = "concat_ws('-', unit, year, month)"
    rank = "row_number() OVER (PARTITION BY fold ORDER BY {h}, key)"
    h = {c: _h(str(S.seed), f"'{c}'", "coalesce(CAST(fold AS VARCHAR), '')", "key") for c in "op"}
    sums = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST(count(*) AS BIGINT) AS n, "
        f"avg(pow(target_a - (intercept + slope * {'donor' if f == 'lines' else 'lines'}), 2)) "
        f"- avg(pow(target_a - (intercept + slope * lines), 2)) AS importance FROM dealt, coefs" for f in IMP_FEATURES)
    return TRAIN_CTE + f""",
keyed AS (SELECT *, {key} AS key FROM train),
ranked AS (SELECT *, {rank.format(h=h['o'])} AS r, {rank.format(h=h['p'])} AS q FROM keyed),
dealt AS (SELECT a.*, b.lines AS donor FROM ranked a JOIN ranked b ON a.fold IS NOT DISTINCT FROM b.fold AND a.r = b.q)
{sums}"""


@query("scorer_importance", _scorer_importance_sql(), ("importance",))
def q_scorer_importance(spark, d):
    """M6 for a scorer that is only a function (one-variable least squares): error rise of each feature permuted within folds."""
    t = keyed_train(spark, d)
    coefs = search.fit_ols(t, S.target, "lines")
    return search.permutation_importance(t, lambda df: search.score_ols(df, coefs, "lines"), S.target, IMP_FEATURES,
                                         "key", ["fold"], S.seed)


def mllib_score(model):
    """A fitted MLlib model as a scorer."""
    def score(df):
        return model.transform(search.assemble(df, SEARCH_FEATURES)).withColumnRenamed("prediction", "pred").drop("features")
    return score


@query("leader_importance")
def q_leader_importance(spark, d):
    """M6 + O3 for whatever model leads the search: ordered permutation importance within folds, negative ones as 0."""
    _, model, _ = fitted_search(spark, d)
    imp = search.permutation_importance(keyed_train(spark, d), mllib_score(model), S.target, SEARCH_FEATURES,
                                        "key", ["fold"], S.seed)
    return search.feature_ranking(imp.withColumn("importance", F.greatest("importance", F.lit(0.0))))


FOLD_RULE = f"wyear - {S.fold_base}"


@query("leader_store_roundtrip")
def q_leader_store_roundtrip(spark, d):
    """K4 + S5: the leader saved with its manifest, loaded, and its predictions of the training rows."""
    _, model, _ = fitted_search(spark, d)
    path = scratch_path(spark, "leader")
    search.save_leader(model, path, SEARCH_FEATURES, S.target, FOLD_RULE)
    back = search.load_leader(spark, path, SEARCH_FEATURES, S.target, FOLD_RULE)
    return mllib_score(back)(train_frame(spark, d)).select("unit", "year", "month", "pred")
