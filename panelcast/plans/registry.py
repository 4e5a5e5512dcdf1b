"""Registry of named queries and their DuckDB twins.

Each query is ``fn(spark, sf_dir) -> DataFrame``.  Its twin is plain SQL over
the test tables.  Double columns are rounded to 6 decimals on both sides
(half away from zero), so float summation order cannot change a result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import round_doubles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DOUBLES: dict[str, tuple[str, ...]] = {}


def _digits(doubles: Sequence[str]) -> dict[str, int]:
    """``"col"`` rounds to 6 decimals, ``"col:2"`` to 2 (large money sums)."""
    out = {}
    for d in doubles:
        name, _, k = d.partition(":")
        out[name] = int(k) if k else 6
    return out


def _wrap_sql(sql: str, doubles: Sequence[str]) -> str:
    if not doubles:
        return sql
    rep = ", ".join(f"round({c}, {k}) AS {c}" for c, k in _digits(doubles).items())
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


def query(name: str, sql: str | None = None, doubles: Sequence[str] = ()):
    """Register ``fn`` under ``name``; ``sql`` is its twin (None: rows-only check)."""
    def deco(fn):
        digits = _digits(doubles)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), 6, digits)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        DOUBLES[name] = tuple(digits)
        if sql is not None:
            ORACLE[name] = _wrap_sql(sql, doubles)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


MODULES = ["q_cohort", "q_accuracy", "q_scenario", "q_io", "q_stats", "q_search", "q_forest"]
