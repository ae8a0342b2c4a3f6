"""Query registry: every inventory operator as a (Spark query, DuckDB oracle) pair.

Each query reads the whole test tables through the views of
``flowpanel.sources.testviews`` and returns a DataFrame.  The final projection
rounds doubles to 4 places (the oracle SQL does the same) so the value hash
does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _positive_zero(sql: str) -> str:
    """Wrap every ``ROUND(...)`` of the oracle SQL as ``(ROUND(...) + 0.0)`` so a
    value rounded to ``-0.0`` renders as ``0.0``, like the Spark side."""
    out, i, key = [], 0, "ROUND("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _positive_zero(sql[j + len(key):k])
        out.append(sql[i:j] + "(" + key + inner + ") + 0.0)")
        i = k + 1


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _positive_zero(sql)
        return fn
    return deco


def rounded(df: DataFrame, places: int = 4, fine=(), coarse=()) -> DataFrame:
    """Round every floating column (the oracle SQL rounds the same columns).

    Rounding is done as round-half-away-from-zero of ``x · 10^p`` divided by
    ``10^p`` — the same IEEE operations DuckDB's ``ROUND(x, p)`` performs — so
    an identical double renders identically even when it sits on a decimal tie.
    Columns in ``fine`` (interpolated quantiles) are rounded to 6 places,
    columns in ``coarse`` (sums of squares of money, ~1e10) to 0 places.
    ``+ 0.0`` turns a rounded ``-0.0`` into ``0.0``.
    """
    def rnd(c, p):
        m = float(10 ** p)
        return F.round(F.col(c) * F.lit(m), 0) / F.lit(m) + F.lit(0.0)

    return df.select(*[
        rnd(f.name, 6 if f.name in fine else (0 if f.name in coarse else places)).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        for f in df.schema.fields])


def R(expr: str, places: int = 4) -> str:
    """Oracle-side rounding twin of :func:`rounded`."""
    return f"(ROUND({expr}, {places}) + 0.0)"


def load_all() -> None:
    """Import the modules that register queries."""
    from . import q_core, q_stats, q_prep, q_graph, q_spatial, q_models  # noqa: F401
