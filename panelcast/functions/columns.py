"""Column-level helpers: null rules, time columns, safe arithmetic, rounding.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions``,
so they stay inside whole-stage codegen.  No Python UDFs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- null rules ---------------------------------------------------------------

def _over(agg: Column, window) -> Column:
    return agg if window is None else agg.over(window)


def strict_sum(col: str | Column, window=None) -> Column:
    """Sum that is NULL when any input is NULL (R ``sum`` without ``na.rm``).
    With ``window``, the same rule as a window aggregate."""
    c = _c(col)
    return F.when(_over(F.count(F.lit(1)), window) == _over(F.count(c), window),
                  _over(F.sum(c), window))


def strict_avg(col: str | Column, window=None) -> Column:
    """Mean that is NULL when any input is NULL (R ``mean`` without ``na.rm``)."""
    c = _c(col)
    return F.when(_over(F.count(F.lit(1)), window) == _over(F.count(c), window),
                  _over(F.avg(c), window))


def clamp0(col: str | Column) -> Column:
    """``pmax(x, 0)``: negatives become 0, NULL stays NULL (``greatest`` would give 0)."""
    c = _c(col)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den``, NULL where ``den`` is 0 or NULL."""
    n, d = _c(num), _c(den)
    return F.when(d != 0, n / d)


def zero_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Turn exact zeros into NULL in every listed column (one projection)."""
    cols = set(cols)
    return df.select(*[F.nullif(F.col(c), F.lit(0.0)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


# --- rounding -----------------------------------------------------------------

def round_half_away(col: str | Column, digits: int = 6) -> Column:
    """Round half away from zero on the binary value, as DuckDB's ``round`` does.

    From 2^52 scaled units on a double has no fraction left, so the value is its own
    rounding (``floor`` would overflow a BIGINT there)."""
    c = _c(col)
    scale = float(10 ** digits)
    scaled = F.abs(c) * scale
    return F.when(c.isNull() | F.isnan(c) | (scaled >= 2.0 ** 52), c).otherwise(
        F.signum(c) * F.floor(scaled + 0.5) / scale)


def round_doubles(df: DataFrame, digits: int = 6, per_column: dict | None = None) -> DataFrame:
    """Round every double column of ``df`` (``per_column`` overrides the digits)."""
    per_column = per_column or {}
    return df.select(*[
        round_half_away(f.name, per_column.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])


# --- time columns -------------------------------------------------------------

def yearmonth(year: str | Column, month: str | Column) -> Column:
    """``2011-1``: year and month joined by ``-`` without zero padding."""
    return F.concat_ws("-", _c(year).cast("string"), _c(month).cast("string"))


def month_start(year: str | Column, month: str | Column) -> Column:
    """First day of the month; NULL for a month outside 1..12 (R gives NA)."""
    y, m = _c(year), _c(month)
    return F.when(m.between(1, 12), F.make_date(y, m, F.lit(1)))


def parse_date(col: str | Column) -> Column:
    """ISO ``yyyy-MM-dd`` string to date; unparsable text gives NULL."""
    return F.try_to_date(_c(col))


def quarter_of(month: str | Column) -> Column:
    """Month 1..12 to quarter 1..4; anything else NULL."""
    m = _c(month)
    return F.when(m.between(1, 12), ((m - 1) / 3 + 1).cast("int"))


def fold_number(wyear: str | Column, base: int) -> Column:
    """Fold id = water year minus a base year."""
    return (_c(wyear) - F.lit(base)).cast("int")


# --- Student-t quantile -------------------------------------------------------

def _normal_quantile(p: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)


def _d(v: float) -> str:
    """Double literal in scientific notation (a plain ``0.3`` is DECIMAL in both engines)."""
    return f"{float(v):.17e}"


def t_quantile_sql(p: float, df_expr: str) -> str:
    """Student-t quantile ``qt(p, df)`` as a SQL expression valid in Spark and DuckDB.

    Closed form of Hill (1970), CACM Algorithm 396, for a fixed ``p`` and a
    per-row degrees-of-freedom expression.  Exact for df 1 and 2; relative
    error below 1e-6 from df 3.  NULL for df < 1.
    """
    if not 0.5 < p < 1.0:
        raise ValueError("p must be in (0.5, 1)")
    P = 2.0 * (1.0 - p)                 # two-sided tail probability
    x = _d(_normal_quantile(0.5 * P))   # lower-tail normal deviate (negative)
    xx = _d(_normal_quantile(0.5 * P) ** 2)
    k = {v: _d(v) for v in (0.5, 48.0, 20700.0, 98.0, 16.0, 96.36, 94.5, 3.0, 1.0, 5.0,
                            0.3, 4.5, 0.6, 0.05, 7.0, 2.0, 0.4, 6.3, 36.0, 0.002, 6.0,
                            0.089, 0.822, 4.0)}
    n = f"CAST(({df_expr}) AS DOUBLE)"
    a = f"({k[1.0]} / ({n} - {k[0.5]}))"
    b = f"({k[48.0]} / ({a} * {a}))"
    c0 = f"((({k[20700.0]} * {a} / {b} - {k[98.0]}) * {a} - {k[16.0]}) * {a} + {k[96.36]})"
    d = (f"((({k[94.5]} / ({b} + {c0}) - {k[3.0]}) / {b} + {k[1.0]})"
         f" * sqrt({a} * {_d(math.pi / 2)}) * {n})")
    y0 = f"power({d} * {_d(P)}, {k[2.0]} / {n})"
    # tail branch: asymptotic expansion about the normal deviate
    c1 = f"({c0} + CASE WHEN {n} < {k[5.0]} THEN {k[0.3]} * ({n} - {k[4.5]}) * ({x} + {k[0.6]}) ELSE 0e0 END)"
    c2 = f"(((({k[0.05]} * {d} * {x} - {k[5.0]}) * {x} - {k[7.0]}) * {x} - {k[2.0]}) * {x} + {b} + {c1})"
    y1 = (f"((((({k[0.4]} * {xx} + {k[6.3]}) * {xx} + {k[36.0]}) * {xx} + {k[94.5]}) / {c2}"
          f" - {xx} - {k[3.0]}) / {b} + {k[1.0]}) * {x}")
    y2 = f"({a} * ({y1}) * ({y1}))"
    tail = (f"sqrt({n} * CASE WHEN {y2} > {k[0.002]} THEN exp({y2}) - {k[1.0]}"
            f" ELSE {k[0.5]} * {y2} * {y2} + {y2} END)")
    # centre branch
    centre = (f"sqrt({n} * ((({k[1.0]} / ((({n} + {k[6.0]}) / ({n} * {y0}) - {k[0.089]} * {d} - {k[0.822]})"
              f" * ({n} + {k[2.0]}) * {k[3.0]}) + {k[0.5]} / ({n} + {k[4.0]})) * {y0} - {k[1.0]})"
              f" * ({n} + {k[1.0]}) / ({n} + {k[2.0]}) + {k[1.0]} / {y0}))")
    df1 = _d(1.0 / math.tan(math.pi * (1.0 - p)))
    df2 = _d((2.0 / (P * (2.0 - P)) - 2.0) ** 0.5)
    return (f"(CASE WHEN ({df_expr}) IS NULL OR {n} < {k[1.0]} THEN NULL "
            f"WHEN {n} = {k[1.0]} THEN {df1} WHEN {n} = {k[2.0]} THEN {df2} "
            f"WHEN {y0} > {k[0.05]} + {a} THEN {tail} ELSE {centre} END)")


def t_quantile(p: float, df_expr: str) -> Column:
    """Column form of :func:`t_quantile_sql`; ``df_expr`` is a SQL expression over columns."""
    return F.expr(t_quantile_sql(p, df_expr))


def with_t_quantile(df: DataFrame, p: float, dof: str | Column, out: str) -> DataFrame:
    """Add ``out`` = qt(p, dof) as staged projections.

    Same arithmetic, in the same order, as :func:`t_quantile_sql` (so both engines
    agree), but every shared subterm is computed once as a column instead of
    being repeated inside one large expression."""
    P = 2.0 * (1.0 - p)
    x = _normal_quantile(0.5 * P)
    xx = x * x
    dd = _c(dof).cast("double")
    # below 1 d.f. the quantile is NULL: null the input so no subterm divides by zero
    t = df.withColumn("_tq_n", F.when(dd >= 1.0, dd))
    n = F.col("_tq_n")
    t = t.withColumn("_tq_a", F.lit(1.0) / (n - 0.5))
    a = F.col("_tq_a")
    t = t.withColumn("_tq_b", F.lit(48.0) / (a * a))
    b = F.col("_tq_b")
    t = t.withColumn("_tq_c", ((F.lit(20700.0) * a / b - 98.0) * a - 16.0) * a + 96.36)
    c0 = F.col("_tq_c")
    t = t.withColumn("_tq_d", ((F.lit(94.5) / (b + c0) - 3.0) / b + 1.0) * F.sqrt(a * (math.pi / 2)) * n)
    d = F.col("_tq_d")
    t = t.withColumn("_tq_y0", F.pow(d * P, F.lit(2.0) / n))
    y0 = F.col("_tq_y0")
    c1 = c0 + F.when(n < 5.0, F.lit(0.3) * (n - 4.5) * (x + 0.6)).otherwise(F.lit(0.0))
    c2 = (((F.lit(0.05) * d * x - 5.0) * x - 7.0) * x - 2.0) * x + b + c1
    y1 = ((((F.lit(0.4) * xx + 6.3) * xx + 36.0) * xx + 94.5) / c2 - xx - 3.0) / b + 1.0
    t = t.withColumn("_tq_y1", y1 * x)
    t = t.withColumn("_tq_y2", a * F.col("_tq_y1") * F.col("_tq_y1"))
    y2 = F.col("_tq_y2")
    tail = F.sqrt(n * F.when(y2 > 0.002, F.exp(y2) - 1.0).otherwise(F.lit(0.5) * y2 * y2 + y2))
    centre = F.sqrt(n * (((F.lit(1.0) / (((n + 6.0) / (n * y0) - F.lit(0.089) * d - 0.822) * (n + 2.0) * 3.0)
                           + F.lit(0.5) / (n + 4.0)) * y0 - 1.0) * (n + 1.0) / (n + 2.0) + F.lit(1.0) / y0))
    df1 = 1.0 / math.tan(math.pi * (1.0 - p))
    df2 = (2.0 / (P * (2.0 - P)) - 2.0) ** 0.5
    q = (F.when(n.isNull() | (n < 1.0), F.lit(None).cast("double"))
         .when(n == 1.0, F.lit(df1)).when(n == 2.0, F.lit(df2))
         .when(y0 > F.lit(0.05) + a, tail).otherwise(centre))
    return t.withColumn(out, q).drop("_tq_n", "_tq_a", "_tq_b", "_tq_c", "_tq_d", "_tq_y0", "_tq_y1", "_tq_y2")


# --- chi-square(1) critical values -------------------------------------------

def chi2_1_quantile(q: float) -> float:
    """Quantile of chi-square with 1 d.f.: (Phi^-1((1+q)/2))^2."""
    z = _normal_quantile(0.5 + q / 2.0)
    return z * z
