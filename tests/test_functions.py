"""Null rules, time columns, safe arithmetic, t and chi-square quantiles."""

import math

import duckdb
from pyspark.sql import functions as F

from panelcast.functions.columns import (chi2_1_quantile, clamp0, month_start, parse_date,
                                         quarter_of, round_half_away, safe_ratio, strict_avg,
                                         strict_sum, t_quantile, t_quantile_sql, yearmonth,
                                         zero_to_null)


def test_strict_aggregates_poison_on_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 3.0), (2, 5.0)], "g int, x double")
    got = {r.g: (r.s, r.a) for r in df.groupBy("g").agg(strict_sum("x").alias("s"),
                                                        strict_avg("x").alias("a")).collect()}
    assert got[1] == (None, None)
    assert got[2] == (8.0, 4.0)


def test_clamp0_keeps_null_and_clamps_negative(spark):
    df = spark.createDataFrame([(-2.0,), (None,), (3.0,)], "p double")
    assert [r[0] for r in df.select(clamp0("p")).collect()] == [0.0, None, 3.0]


def test_safe_ratio_null_on_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_ratio("a", "b")).collect()] == [None, 0.5]


def test_time_columns_month_13_is_null(spark):
    df = spark.createDataFrame([(2011, 1), (2011, 12), (2011, 13)], "year int, month int")
    rows = df.select(yearmonth("year", "month").alias("ym"), month_start("year", "month").alias("d"),
                     quarter_of("month").alias("q")).collect()
    assert rows[0].ym == "2011-1" and str(rows[0].d) == "2011-01-01" and rows[0].q == 1
    assert rows[1].q == 4
    assert rows[2].d is None and rows[2].q is None


def test_parse_date_invalid_is_null(spark):
    df = spark.createDataFrame([("2020-03-01",), ("not a date",)], "s string")
    got = [r[0] for r in df.select(parse_date("s")).collect()]
    assert str(got[0]) == "2020-03-01" and got[1] is None


def test_zero_to_null(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0)], "t int, a double, b double")
    r = zero_to_null(df, ["a", "b"]).first()
    assert r.a is None and r.b == 2.0 and r.t == 1


def test_round_half_away_matches_duckdb(spark):
    vals = [0.1234565, -2.5e-7, 1.0000005, 123456.7890125, -0.0000015]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double")
           .select(round_half_away("x", 6)).collect()]
    want = [duckdb.sql(f"select round({v!r}::DOUBLE, 6)").fetchall()[0][0] for v in vals]
    assert got == want


def _t_cdf(t, n):
    # regularized incomplete beta by continued fraction
    def betacf(a, b, x):
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1 / d
        h = d
        for m in range(1, 400):
            m2 = 2 * m
            aa = m * (b - m) * x / ((a - 1 + m2) * (a + m2))
            d = 1 / (1 + aa * d)
            c = 1 + aa / c
            h *= d * c
            aa = -(a + m) * (a + b + m) * x / ((a + m2) * (a + 1 + m2))
            d = 1 / (1 + aa * d)
            c = 1 + aa / c
            h *= d * c
        return h
    x = n / (n + t * t)
    a, b = n / 2, 0.5
    bt = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    ib = bt * betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - bt * betacf(b, a, 1 - x) / b
    return 1 - 0.5 * ib


def _qt(p, n):
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _t_cdf(mid, n) < p else (lo, mid)
    return (lo + hi) / 2


def test_t_quantile_accuracy_and_engines_agree(spark):
    dfs = [1, 2, 3, 4, 5, 9, 29, 99, 999]
    got = {r.df: r.q for r in spark.createDataFrame([(d,) for d in dfs] + [(0,)], "df int")
           .select("df", t_quantile(0.975, "df").alias("q")).collect()}
    assert got[0] is None
    assert abs(got[1] - 12.706204736174694) < 1e-9
    assert abs(got[2] - 4.302652729749462) < 1e-9
    for d in dfs:
        assert abs(got[d] - _qt(0.975, d)) / _qt(0.975, d) < 1e-6
    duck = dict(duckdb.sql("select df, " + t_quantile_sql(0.975, "df") + " from unnest(" +
                           str(dfs) + ") t(df)").fetchall())
    for d in dfs:
        assert abs(duck[d] - got[d]) < 1e-12


def test_chi2_thresholds():
    assert round(chi2_1_quantile(0.80), 6) == 1.642374
    assert round(chi2_1_quantile(0.90), 6) == 2.705543
    assert round(chi2_1_quantile(0.95), 6) == 3.841459


def test_staged_t_quantile_equals_sql_form(spark):
    from panelcast.functions.columns import with_t_quantile
    df = spark.createDataFrame([(d,) for d in [0, 1, 2, 3, 4, 7, 30, 250]] + [(None,)], "df int")
    for p in (0.975, 0.95):
        a = {r.df: r.q for r in with_t_quantile(df, p, "df", "q").collect()}
        b = {r.df: r.q for r in df.select("df", t_quantile(p, "df").alias("q")).collect()}
        assert a == b


def test_rounding_leaves_large_values_alone(spark):
    from panelcast.functions.columns import round_half_away
    vals = [1e13, 2.5e13 + 0.5, 1e16, -1e16, 1.0000005, -2.5, 9.2e12]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(round_half_away("v", 6)).collect()]
    assert got[:4] == vals[:4] and got[5] == -2.5 and got[6] == 9.2e12
