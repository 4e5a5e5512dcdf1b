"""Exact search of linear models over user folds, from one set of centred sums (M2).

The sums of products of target and features, less their means, are taken once per fold.  The sums of all *other*
folds are the totals less the fold's own, so leave-one-fold-out fits and the out-of-fold errors of every penalty come
from a table with one row a fold; the training rows are not read again.

A model is least squares with the penalty ``n * penalty * sum(u_i ** 2)`` on the coefficients u of standardised
features and target.  A feature that doesn't vary, or that the features before it determine, has the coefficient 0.

Rows with a NULL in target, features or fold take no part.  An empty table gives no rows.  Repeated rows count
as often as they stand there; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of a standardised feature's variance, what the features before it must leave unexplained for it to be fitted.
LEAST_PIVOT = 1e-9
#: Share of a variable's squares about the mean of all folds that its variance must be, or it counts as constant.
LEAST_SPREAD = 1e-12
#: Sums an aggregate holds, so that its code is generated.
SUMS = 40


def _add(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def fold_moments(train: DataFrame, y: str, features: Sequence[str], fold: str) -> DataFrame:
    """(fold, n, s, g, mean): per fold the rows, the sums of each variable less its mean over all folds, and of the
    products of these (upper triangle by rows); variables are the features, then ``y``.  One row a fold."""
    names = [*features, y]
    raw = train.select(F.col(fold).alias("fold"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    raw = raw.dropna()
    at = range(len(names))
    means = [F.lit(m).cast("double") for m in raw.agg(*[F.avg(f"v{i}") for i in at]).first()]   # one row
    rows = raw.select("fold", *[(F.col(f"v{i}") - means[i]).alias(f"c{i}") for i in at])
    sums = [F.sum(f"c{i}").alias(f"s{i}") for i in at]
    sums += [F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"g{i}_{j}") for i, j in _pairs(len(names))]
    parts = [rows.groupBy("fold").agg(*sums[k:k + SUMS]) for k in range(0, len(sums), SUMS)]
    table = reduce(lambda a, b: a.join(b, "fold"), parts, rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")))
    return table.select("fold", "n", F.array(*[f"s{i}" for i in at]).alias("s"),
                        F.array(*[f"g{i}_{j}" for i, j in _pairs(len(names))]).alias("g"),
                        F.array(*means).alias("mean"))


def _sum_arrays(col: str, n: int, over) -> Column:
    return F.array(*[F.sum(F.col(col)[i]).over(over) for i in range(n)])


def _standardised(t: DataFrame, p: int) -> DataFrame:
    """Adds ``centre`` and ``sd`` of all p variables, and ``m``, the correlations of the features with the target's as last
    column, to rows with (n, s, g).  A variable without variance correlates with nothing."""
    pairs = _pairs(p)
    at = {ij: k for k, ij in enumerate(pairs)}
    s, n = F.col("s"), F.col("n")
    t = t.withColumn("centre", F.transform("s", lambda v: v / F.col("n")))
    t = t.withColumn("_v", F.array(*[F.col("g")[k] - s[i] * s[j] / n for k, (i, j) in enumerate(pairs)]))
    t = t.withColumn("sd", F.array(*[F.when(F.col("_v")[k] > LEAST_SPREAD * F.col("g")[k], F.sqrt(F.col("_v")[k] / n))
                                     .otherwise(F.lit(0.0)) for k in (at[i, i] for i in range(p))]))

    def r(i: int, j: int) -> Column:
        k = at[min(i, j), max(i, j)]
        return F.coalesce(F.try_divide(F.col("_v")[k] / n, F.col("sd")[i] * F.col("sd")[j]), F.lit(0.0))

    return t.withColumn("m", F.array(*[F.array(*[r(i, j) for j in range(p)]) for i in range(p - 1)])).drop("_v")


def _solved(m: Column, p: int) -> Column:
    """Gauss-Jordan elimination of the p rows of ``m`` (positive semi-definite, the right side last): the solution."""
    def cell(x: Column, i: Column, j: Column) -> Column:
        return F.get(F.get(x, i), j)

    def step(x: Column, k: Column) -> Column:
        pivot = cell(x, k, k)
        fitted = pivot > F.lit(LEAST_PIVOT)
        return F.transform(x, lambda row, i: F.transform(row, lambda v, j: (
            F.when((i == k) & fitted, v / pivot)
            .when(i == k, F.lit(0.0))
            .when(fitted, v - F.get(row, k) * cell(x, k, j) / pivot)
            .otherwise(v))))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), m, step)
    return F.transform(done, lambda row: F.get(row, F.lit(p)))


def _with_coefficients(t: DataFrame, p: int, penalties: Sequence[float]) -> DataFrame:
    """One row for each of ``t``'s rows and penalty, with ``b``: the coefficients of the p features."""
    t = t.withColumn("penalty", F.explode(F.array(*[F.lit(float(x)) for x in penalties])))
    ridge = F.transform("m", lambda row, i: F.transform(row, lambda v, j: F.when(i == j, v + F.col("penalty")).otherwise(v)))
    t = t.withColumn("_r", ridge).withColumn("_u", _solved(F.col("_r"), p))
    b = [F.coalesce(F.try_divide(F.col("_u")[i] * F.col("sd")[p], F.col("sd")[i]), F.lit(0.0)) for i in range(p)]
    return t.withColumn("b", F.array(*b)).drop("_r", "_u", "m")


def model_name(penalty: Column) -> Column:
    return F.format_string("linear[penalty=%s]", penalty.cast("string"))


def linear_search(train: DataFrame, y: str, features: Sequence[str], fold: str,
                  penalties: Sequence[float] = (0.0, 0.01, 0.1, 1.0)) -> DataFrame:
    """(model, penalty, fold, n, mse): the error on each fold of the model fitted on the others, for every penalty.

    A fold is NULL-safe only in that rows without one are left out; with a single fold there is nothing to fit on and no row."""
    p, width = len(features), len(_pairs(len(features) + 1))
    everything = Window.partitionBy()   # one row a fold
    own = (fold_moments(train, y, features, fold)
           .withColumn("_n", F.sum("n").over(everything) - F.col("n"))
           .withColumn("_s", _sum_arrays("s", p + 1, everything))
           .withColumn("_g", _sum_arrays("g", width, everything)))
    others = own.where("_n > 0").select(
        "fold", F.struct("n", "s", "g").alias("own"), F.col("_n").alias("n"),
        F.zip_with("_s", "s", lambda a, b: a - b).alias("s"), F.zip_with("_g", "g", lambda a, b: a - b).alias("g"))
    fitted = _with_coefficients(_standardised(others, p + 1), p, penalties)
    # residual: the sum over all variables of w * (value - centre), with w = -b and 1 for the target
    fitted = fitted.withColumn("w", F.concat(F.transform("b", lambda v: -v), F.array(F.lit(1.0))))
    w, c, s, g = F.col("w"), F.col("centre"), F.col("own.s"), F.col("own.g")
    wc = _add([w[i] * c[i] for i in range(p + 1)])
    ws = _add([w[i] * s[i] for i in range(p + 1)])
    wgw = _add([w[i] * w[j] * g[k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(_pairs(p + 1))])
    n = F.col("own.n")
    return fitted.select(model_name(F.col("penalty")).alias("model"), "penalty", "fold", n.alias("n"),
                         (F.greatest(wgw - 2.0 * wc * ws + n * wc * wc, F.lit(0.0)) / n).alias("mse"))


def linear_fit(train: DataFrame, y: str, features: Sequence[str], penalty: float = 0.0) -> DataFrame:
    """(intercept, coefficients) of the model on all rows, one row; coefficients in the order of ``features``."""
    p = len(features)
    all_rows = fold_moments(train.withColumn("_all", F.lit(0)), y, features, "_all")
    t = _with_coefficients(_standardised(all_rows, p + 1), p, [penalty])
    centre = [F.col("centre")[i] + F.col("mean")[i] for i in range(p + 1)]
    return t.select((centre[p] - _add([F.col("b")[i] * centre[i] for i in range(p)])).alias("intercept"),
                    F.col("b").alias("coefficients"))


def score_linear(df: DataFrame, fit: DataFrame, features: Sequence[str], out: str = "pred") -> DataFrame:
    """Attach the prediction of :func:`linear_fit`; NULL where a feature is.  The one row enters as scalar subqueries."""
    b = fit.select("coefficients").scalar()
    return df.withColumn(out, fit.select("intercept").scalar() + _add(
        [F.get(b, F.lit(i)) * F.col(c).cast("double") for i, c in enumerate(features)]))
