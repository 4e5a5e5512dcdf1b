"""Queries: importance statistics on the analogue per-tree matrix
(SURVEY 2.3 X14-X16, 2.6 A8-A11, 2.7 R1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import t_quantile_sql, with_t_quantile
from ..operators import stats
from ..sources.panel import PANEL_SQL, panel, panel_table
from ..spec import FOREST_FEATURES as FEATS
from .registry import query


def matrix(spark, d):
    return stats.per_tree_matrix(panel_table(spark, d), FEATS, "target_a")


def _matrix_sql() -> str:
    cols = ",\n       ".join(
        f"CASE WHEN abs(r_{c}) >= 0.01 THEN r_{c} ELSE 0.0 END AS {c}" for c in FEATS)
    raw = ",\n       ".join(
        f"CASE WHEN var_pop(CAST({c} AS DOUBLE)) > 0 AND var_pop(target_a) > 0 "
        f"THEN round(covar_pop(CAST({c} AS DOUBLE), target_a) / (stddev_pop(CAST({c} AS DOUBLE))"
        f" * stddev_pop(target_a)), 6) END AS r_{c}" for c in FEATS)
    return f"""WITH {PANEL_SQL},
raw AS (SELECT wyear AS tree,
       {raw}
FROM panel GROUP BY wyear),
m AS (SELECT tree,
       {cols}
FROM raw)"""


def _long_sql() -> str:
    parts = "\nUNION ALL\n".join(
        f"SELECT tree, '{c}' AS Feature, CASE WHEN {c} = 0 THEN NULL ELSE {c} END AS value FROM m"
        for c in FEATS)
    return _matrix_sql() + f",\nlong AS (\n{parts})"


_FD = tuple(FEATS)


@query("zero_to_null", _matrix_sql() + "\nSELECT tree, " + ", ".join(
    f"nullif({c}, 0.0) AS {c}" for c in FEATS) + " FROM m", _FD)
def q_zero_to_null(spark, d):
    """Exact zeros become NULL across every feature column."""
    from ..functions.columns import zero_to_null
    return zero_to_null(matrix(spark, d), FEATS)


@query("melt_importance", _long_sql() + "\nSELECT Feature, value FROM long", ("value",))
def q_melt_importance(spark, d):
    """Per-tree matrix melted to (Feature, value), NULL rows kept."""
    return stats.per_tree_long(matrix(spark, d), FEATS).select("Feature", "value")


def stats_from_long(long_sql: str) -> str:
    """The statistics of a CTE ``long`` (Feature, value)."""
    t = t_quantile_sql(0.975, "n_avg - 1")
    return long_sql + f""",
g AS (SELECT Feature, avg(value) AS avg, stddev_samp(value) AS sd_avg,
             CAST(count(value) AS BIGINT) AS n_avg FROM long GROUP BY Feature),
h AS (SELECT *, sd_avg / sqrt(CAST(n_avg AS DOUBLE)) AS se_avg, {t} AS t FROM g)
SELECT Feature, avg, sd_avg, n_avg, se_avg, avg AS avg_pkg,
       avg - t * se_avg AS lower_ci_pkg, avg + t * se_avg AS upper_ci_pkg,
       avg - t * se_avg AS lower_ci_avg, avg + t * se_avg AS upper_ci_avg
FROM h"""


def _stats_sql() -> str:
    return stats_from_long(_long_sql())


_SD = ("avg", "sd_avg", "se_avg", "avg_pkg", "lower_ci_pkg", "upper_ci_pkg",
       "lower_ci_avg", "upper_ci_avg")


@query("importance_stats", _stats_sql(), _SD)
def q_importance_stats(spark, d):
    """Per-feature mean, sd, n, se and both 95 % intervals, NULLs skipped."""
    return stats.importance_stats(stats.per_tree_long(matrix(spark, d), FEATS))


@query("importance_ci", _stats_sql().replace(
    "SELECT Feature, avg, sd_avg, n_avg, se_avg, avg AS avg_pkg,",
    "SELECT Feature, avg AS avg_pkg,"),
    ("avg_pkg", "lower_ci_pkg", "upper_ci_pkg", "lower_ci_avg", "upper_ci_avg"))
def q_importance_ci(spark, d):
    """The packaged interval and the formula interval side by side."""
    s = stats.importance_stats(stats.per_tree_long(matrix(spark, d), FEATS))
    return s.select("Feature", "avg_pkg", "lower_ci_pkg", "upper_ci_pkg", "lower_ci_avg",
                    "upper_ci_avg")


@query("importance_mean_all", _matrix_sql() + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS Feature, avg(coalesce({c}, 0.0)) AS value FROM m" for c in FEATS),
    ("value",))
def q_importance_mean_all(spark, d):
    """Mean over all trees, zeros included, as (Feature, value)."""
    return stats.importance_mean_all(matrix(spark, d), FEATS)


@query("t_quantile_grid", f"""WITH {PANEL_SQL},
dfs AS (SELECT DISTINCT CAST(lines AS BIGINT) AS df FROM panel)
SELECT df, {t_quantile_sql(0.975, 'df')} AS q975, {t_quantile_sql(0.95, 'df')} AS q95 FROM dfs""",
       ("q975", "q95"))
def q_t_quantile_grid(spark, d):
    """Student-t quantiles for every degrees-of-freedom value present in the data."""
    dfs = panel_table(spark, d).select(F.col("lines").cast("bigint").alias("df")).distinct()
    return with_t_quantile(with_t_quantile(dfs, 0.975, "df", "q975"), 0.95, "df", "q95")
