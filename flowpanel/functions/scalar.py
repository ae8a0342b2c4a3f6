"""Scalar column expressions.

All are plain ``pyspark.sql.functions`` expressions so they stay inside
whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """num / den with a zero (or NULL) denominator giving NULL.

    Spark's ANSI mode throws on x/0, so the divisor is NULL-ed first.
    """
    d = col_(den)
    return col_(num) / F.when(d != 0, d)


def clip(c, lo, hi) -> Column:
    """NULL-preserving clip to [lo, hi] (F5). ``least``/``greatest`` alone skip NULLs."""
    x = col_(c)
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNull(), F.lit(None)).when(x < lo_c, lo_c).when(x > hi_c, hi_c).otherwise(x)


def log1p_shift(c, col_min) -> Column:
    """log1p(x) if the column minimum is > 0, else log1p(x - min + 1)."""
    x = col_(c)
    m = col_min if isinstance(col_min, Column) else F.lit(col_min)
    return F.when(m > 0, F.log1p(x)).otherwise(F.log1p(x - m + 1))


def gated_log(c, col_min) -> Column:
    """natural log, only when the whole column is > 0 (else NULL)."""
    m = col_min if isinstance(col_min, Column) else F.lit(col_min)
    return F.when(m > 0, F.ln(col_(c)))


def gated_sqrt(c, col_min) -> Column:
    """square root, only when the whole column is >= 0 (else NULL)."""
    m = col_min if isinstance(col_min, Column) else F.lit(col_min)
    return F.when(m >= 0, F.sqrt(col_(c)))


def interaction_cols(pairs) -> dict[str, Column]:
    """``{a}_x_{b}`` = a * b."""
    return {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs}


def ratio_cols(nums, dens) -> dict[str, Column]:
    """``{num}_per_{den}`` with 0 → NULL denominators."""
    return {f"{n}_per_{d}": safe_div(n, d) for n in nums for d in dens}


def poly_terms(cols, degree: int = 2, interaction_only: bool = False) -> list[tuple[str, tuple]]:
    """F8 term list: (name, column indices) of degree 2..degree, graded
    lexicographic order (combinations with replacement of the input order)."""
    from itertools import combinations, combinations_with_replacement

    out = []
    for d in range(2, degree + 1):
        gen = combinations(range(len(cols)), d) if interaction_only else \
            combinations_with_replacement(range(len(cols)), d)
        for combo in gen:
            counts: dict[int, int] = {}
            for i in combo:
                counts[i] = counts.get(i, 0) + 1
            name = " ".join(cols[i] if k == 1 else f"{cols[i]}^{k}" for i, k in counts.items())
            out.append((name, combo))
    return out


def poly_cols(cols, degree: int = 2, interaction_only: bool = False) -> dict[str, Column]:
    """F8: polynomial terms of degree 2..degree, named like ``a^2`` and ``a b``;
    degree-1 terms are the inputs themselves."""
    out: dict[str, Column] = {}
    for name, combo in poly_terms(cols, degree, interaction_only):
        expr = None
        for i in combo:
            expr = F.col(cols[i]) if expr is None else expr * F.col(cols[i])
        out[name] = expr
    return out


def lisa_label(q, p, alpha: float = 0.05) -> Column:
    """LISA class from quadrant q (1 HH, 2 LH, 3 LL, 4 HL) and p-value."""
    qc, pc = col_(q), col_(p)
    return (F.when(pc > alpha, F.lit("Not Significant"))
            .when(qc == 1, F.lit("High-High"))
            .when(qc == 2, F.lit("Low-High"))
            .when(qc == 3, F.lit("Low-Low"))
            .when(qc == 4, F.lit("High-Low"))
            .otherwise(F.lit("Not Significant")))


def format_loading(c, decimals: int = 3, threshold: float = 0.5) -> Column:
    """fixed-decimal text, wrapped in brackets when |x| >= threshold."""
    x = col_(c)
    txt = F.format_string(f"%.{decimals}f", x)
    return F.when(F.abs(x) >= threshold, F.concat(F.lit("["), txt, F.lit("]"))).otherwise(txt)


def sanitize_name(name: str) -> str:
    """Space → ``_``, ``%`` → ``pct``."""
    return name.replace(" ", "_").replace("%", "pct")
