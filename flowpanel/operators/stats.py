"""Descriptive, inequality and correlation statistics.

Moments come from one wide aggregate over the columns (partial + final hash
aggregation, nothing per row on the driver); order statistics (quantiles,
medians, ranks, Gini, Lorenz) come from :mod:`flowpanel.functions.ranks`,
which never puts a whole column into one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles, quantiles_wide, ranked_values, spread_join
from ..functions.scalar import safe_div


def to_long(df: DataFrame, cols, ids=(), var: str = "variable", value: str = "value") -> DataFrame:
    """Unpivot ``cols`` (cast to double) into (ids..., variable, value)."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]) \
             .unpivot(list(ids), list(cols), var, value)


def _stack(row_df: DataFrame, cols, stats, keys=()) -> DataFrame:
    """Reshape a wide ``{col}__{stat}`` aggregate into one row per variable."""
    items = [F.struct(F.lit(c).alias("variable"),
                      *[F.col(f"`{c}__{s}`").alias(s) for s in stats]) for c in cols]
    return row_df.select(*keys, F.explode(F.array(*items)).alias("_r")).select(*keys, "_r.*")


def sample_skew(n, g1):
    """Bias-corrected skewness G1 from Spark's population g1 (NULL when n < 3)."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurt(n, g2):
    """Bias-corrected excess kurtosis G2 from Spark's population excess g2 (NULL when n < 4)."""
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def moments(df: DataFrame, cols, by=()) -> DataFrame:
    """count, mean, std (n−1), min, max, population std, population skew/kurt per variable."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"),
                 F.max(x).alias(f"{c}__max"), F.stddev_pop(x).alias(f"{c}__std_pop"),
                 F.skewness(x).alias(f"{c}__g1"), F.kurtosis(x).alias(f"{c}__g2"),
                 F.sum(x).alias(f"{c}__sum")]
    wide = df.groupBy(*by).agg(*aggs)
    return _stack(wide, cols, ["count", "mean", "std", "min", "max", "std_pop", "g1", "g2", "sum"], by)


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, cols) -> DataFrame:
    """A2 + A3: count, mean, std, min, 25/50/75 % (linear), max, cv per variable."""
    m = moments(df, cols)
    q = quantiles_wide(to_long(df, cols), ["variable"], "value", QUARTILES)
    return (m.join(q, "variable", "left")
            .select("variable", "count", "mean", "std", "min", "p25", "p50", "p75", "max",
                    (F.col("std") / F.when(F.col("mean") != 0, F.col("mean"))).alias("cv")))


def missing_ratio(df: DataFrame, cols) -> DataFrame:
    """A4: missing count and ratio per column, one aggregate."""
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__missing_count"),
                 F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__missing_ratio")]
    return _stack(df.agg(*aggs), cols, ["missing_count", "missing_ratio"])


def skew_kurt(df: DataFrame, cols) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis (pandas ``skew`` / ``kurt``)."""
    m = moments(df, cols)
    n = F.col("count").cast("double")
    return m.select("variable", sample_skew(n, F.col("g1")).alias("skew"),
                    sample_kurt(n, F.col("g2")).alias("kurtosis"))


def group_stats_back(df: DataFrame, cols, by: str) -> DataFrame:
    """Per-group mean, std, min, max, median, skew, kurtosis of each column,
    prefixed ``{col}_`` and left-joined back to every row.

    A grouped aggregate plus a join (not a window) keeps the partial aggregate.
    """
    m = moments(df, cols, by=[by])
    med = exact_quantiles(to_long(df, cols, ids=[by]), [by, "variable"], "value", [0.5]) \
        .select(by, "variable", F.col("q").alias("median"))
    n = F.col("count").cast("double")
    st = (m.join(med, [by, "variable"], "left")
          .select(by, "variable", "mean", "std", "min", "max", "median",
                  sample_skew(n, F.col("g1")).alias("skew"),
                  sample_kurt(n, F.col("g2")).alias("kurtosis")))
    stat_names = ["mean", "std", "min", "max", "median", "skew", "kurtosis"]
    wide = st.groupBy(by).agg(*[
        F.max(F.when(F.col("variable") == c, F.col(s))).alias(f"{c}_{s}")
        for c in cols for s in stat_names])
    return spread_join(df, wide, by, "left")


def corr_matrix(df: DataFrame, cols, method: str = "pearson", id_col: str | None = None) -> DataFrame:
    """Correlation matrix in long form (var1, var2, corr), pairwise-complete.

    Pearson: all p² ``corr`` aggregates in one pass.  Spearman: average ranks
    per column (distributed ranking) then Pearson on the ranks.  Kendall: see
    :func:`kendall_tau`.
    """
    if method == "spearman":
        if id_col is None:
            raise ValueError("spearman needs id_col to re-align the per-column ranks")
        return corr_matrix(average_ranks(df, cols, id_col), cols, "pearson")
    if method == "kendall":
        return kendall_tau(df, cols)
    aggs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
            for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*aggs) if aggs else None
    items = []
    for a in cols:
        for b in cols:
            if a == b:
                v = F.lit(1.0)
            else:
                i, j = cols.index(a), cols.index(b)
                v = F.col(f"`{a}__{b}`") if i < j else F.col(f"`{b}__{a}`")
            items.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), v.alias("corr")))
    base = wide if wide is not None else df.limit(1)
    return base.select(F.explode(F.array(*items)).alias("_r")).select("_r.*")


def average_ranks(df: DataFrame, cols, id_col: str) -> DataFrame:
    """Average (tie-shared) rank of every column, all columns ranked in one job.

    Long form (id, variable, value) → distributed ranking per variable → join on
    (variable, value) → back to one row per id.  NULL values keep a NULL rank.
    """
    long = to_long(df, cols, ids=[id_col])
    r = ranked_values(long, ["variable"], "value").select(
        "variable", "value", (F.col("below") + (F.col("cnt") + 1) / 2.0).alias("rk"))
    j = long.join(r, ["variable", "value"], "left")
    return j.groupBy(id_col).agg(*[
        F.max(F.when(F.col("variable") == c, F.col("rk"))).alias(c) for c in cols])


#: Most value ranges of a column, and fewest rows of a range, in :func:`kendall_tau`.
KENDALL_RANGES, KENDALL_ROWS = 256, 4096


def inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Sum of w_a·w_b over the pairs of points with x_a < x_b and y_a > y_b, in O(n log n) steps.

    Two different x differ first at one bit: at each bit, points of equal higher bits lie in the order of y, and every
    point with a 0 there takes the weight of the points with a 1 and a smaller y."""
    if not len(x):
        return 0
    x = np.unique(x, return_inverse=True)[1]
    y = np.unique(y, return_inverse=True)[1]
    order = np.argsort(y, kind="stable")
    x, y, w, total = x[order], y[order], w[order], 0
    for bit in range(int(x.max()).bit_length() - 1, -1, -1):
        group, one = x >> (bit + 1), (x >> bit) & 1 == 1
        before = np.concatenate([[0], np.cumsum(np.where(one, w, 0))])
        place = np.arange(len(x))
        group_new = np.concatenate([[True], group[1:] != group[:-1]])
        run_new = group_new | np.concatenate([[True], y[1:] != y[:-1]])
        start = np.maximum.accumulate(np.where(group_new, place, 0))
        run = np.maximum.accumulate(np.where(run_new, place, 0))
        total += int((w * (before[run] - before[start]))[~one].sum())
        key = x >> bit
        order = np.argsort(key.astype(np.uint16) if key[-1] < 1 << 15 else key, kind="stable")
        x, y, w = x[order], y[order], w[order]
    return total


def kendall_tau(df: DataFrame, cols) -> DataFrame:
    """Kendall tau-b for every column pair, exact, without enumerating row pairs.

    With order keys rx, ry (distributed ranking), the discordant count is
    D = #{x_a < x_b, y_a > y_b}.  Each column is cut into at most ``KENDALL_RANGES`` ranges of about as many rows (a value
    of more rows is a range of its own).  Row pairs of one x range are counted within that range, others of one y range
    within that y range with the x ranges as keys, and the rest on the ranges' table: a row travels twice, a task holds
    one range (:func:`inversions`).  Ties on x or y are no inversions, so they are excluded as tau-b requires.  All
    column pairs run in one job, keyed by the pair name.
    """
    from .graph import _materialize
    pair_names = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    items = [F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(a).cast("double").alias("x"),
                      F.col(b).cast("double").alias("y")) for a, b in pair_names]
    pairs = (df.select(F.explode(F.array(*items)).alias("_p")).select("_p.*")
             .where(F.col("x").isNotNull() & F.col("y").isNotNull()))
    # duplicate (x, y) rows collapse to a weight: a hot pair costs one row
    xy = _materialize(pairs.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")))
    ranges = F.greatest(F.lit(1), F.least(F.lit(KENDALL_RANGES), F.floor(F.col("n") / KENDALL_ROWS)))
    hot = F.col("cnt") * ranges >= F.col("n")

    def keys(c):
        # a hot value's range lies between those of the smaller and the larger values
        return ranked_values(xy.select("pair", c), ["pair"], c).select(
            "pair", c, F.col("below").alias(f"r{c}"), hot.alias(f"h{c}"),
            (F.floor(F.col("below") * ranges / F.col("n")) * 2 + hot.cast("int")).cast("long").alias(f"b{c}"))

    t = _materialize(xy.join(keys("x"), ["pair", "x"]).join(keys("y"), ["pair", "y"]).drop("x", "y"))
    cells = t.groupBy("pair", "bx", "by").agg(F.sum("w").alias("w"))

    def part(rows, kind, block, x, y):
        return rows.select("pair", F.lit(kind).alias("kind"), F.lit(block).cast("long").alias("block") if isinstance(block, int) else F.col(block).alias("block"),
                           F.col(x).alias("x"), F.col(y).alias("y"), "w")

    every = part(t.where("not hx"), "x", "bx", "rx", "ry").unionByName(part(t.where("not hy"), "y", "by", "bx", "ry")) \
        .unionByName(part(cells, "cells", 0, "bx", "by"))

    def count(rows: pa.Table) -> pa.Table:
        x, y, w = (rows[c].to_numpy() for c in ("x", "y", "w"))
        return pa.table({"pair": rows["pair"].slice(0, 1), "D": pa.array([inversions(x, y, w)], pa.int64())})

    disc = every.groupBy("pair", "kind", "block").applyInArrow(count, "pair string, D long").groupBy("pair").agg(F.sum("D").alias("D"))
    n = xy.groupBy("pair").agg(F.sum("w").alias("n"))
    tie = lambda c, name: (xy.groupBy("pair", c).agg(F.sum("w").alias("count")).groupBy("pair")
                           .agg(F.sum(F.col("count") * (F.col("count") - 1) / 2).alias(name)))
    txy = xy.groupBy("pair").agg(F.sum(F.col("w") * (F.col("w") - 1) / 2).alias("n3"))
    s = disc.join(n, "pair").join(tie("x", "n1"), "pair").join(tie("y", "n2"), "pair").join(txy, "pair")
    n0 = F.col("n") * (F.col("n") - 1) / 2
    cd = n0 - F.col("n1") - F.col("n2") + F.col("n3")  # C + D
    tau = safe_div(cd - 2 * F.col("D"), F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2"))))  # NULL for a constant column
    return s.select(F.split("pair", r"\|").getItem(0).alias("var1"),
                    F.split("pair", r"\|").getItem(1).alias("var2"), tau.alias("tau"))


def gini_theil(df: DataFrame, cols, eps: float = 1e-10) -> DataFrame:
    """Gini and Theil T per variable, sorted by Gini descending.

    Gini = Σ(2i − n − 1)·x₍ᵢ₎ / (n·Σx) over the ascending order, values shifted by
    −min when any is negative, plus ``eps``.  With ties the inner sum over a block
    of equal values at positions below+1 … below+cnt is x·cnt·(2·below + cnt − n).
    Theil T = mean(r·ln(r + eps)), r = (x + eps)/mean(x + eps).
    """
    r = ranked_values(to_long(df, cols), ["variable"], "value")
    # one row of minima, looked up by name: no join of the values on their column's name
    low = df.agg(*[F.min(F.col(c).cast("double")).alias(f"{c}__min") for c in cols]).withColumn("_k", F.lit(1))
    r = r.withColumn("_k", F.lit(1)).join(F.broadcast(low), "_k")
    low_of = F.coalesce(*[F.when(F.col("variable") == c, F.col(f"`{c}__min`")) for c in cols])
    xs = F.col("value") + F.when(low_of < 0, -low_of).otherwise(0.0) + eps
    rr = safe_div(F.col("value") + eps, F.col("total") / F.col("n") + eps)
    return r.groupBy("variable").agg(
        F.sum(xs * F.col("cnt") * (2 * F.col("below") + F.col("cnt") - F.col("n"))).alias("_num"),
        F.sum(xs * F.col("cnt")).alias("_sum"), F.max("n").alias("_n"),
        F.sum(F.col("cnt") * rr * F.log(rr + eps)).alias("_theil")) \
        .select("variable", safe_div(F.col("_num"), F.col("_n") * F.col("_sum")).alias("gini"),
                (F.col("_theil") / F.col("_n")).alias("theil"))


def lorenz(df: DataFrame, col: str) -> DataFrame:
    """A19 (+ W7): Lorenz points per distinct value in ascending order:
    cumulative population share and cumulative value share."""
    r = ranked_values(df.select(F.col(col).cast("double").alias(col)), [], col)
    return r.select(F.col(col).alias("value"),
                    ((F.col("below") + F.col("cnt")) / F.col("n")).alias("pop_share"),
                    ((F.col("sum_below") + F.col(col) * F.col("cnt")) / F.col("total")).alias("value_share"))


def box_summary(df: DataFrame, col: str, by: str) -> DataFrame:
    """Five-number box summary per group with 1.5·IQR whiskers."""
    long = df.select(by, F.col(col).cast("double").alias("value"))
    q = quantiles_wide(long, [by], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    # equal values of a group are one row before the quartiles join them
    cells = long.where("value is not null").groupBy(by, "value").agg(F.count(F.lit(1)).alias("_n"))
    j = spread_join(cells, q, by)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("value") >= F.col("q1") - 1.5 * iqr) & (F.col("value") <= F.col("q3") + 1.5 * iqr)
    return j.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("_n")).otherwise(0)).alias("n_outliers"))


def histogram(df: DataFrame, col: str, bins: int = 15) -> DataFrame:
    """Equal-width histogram counts over [min, max] (last bin closed)."""
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")).withColumn("_k", F.lit(1))
    j = df.select(x.alias("_x")).where(F.col("_x").isNotNull()).withColumn("_k", F.lit(1)) \
          .join(F.broadcast(rng), "_k")
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col("_x") - F.col("_lo")) / F.when(width > 0, width)), F.lit(bins - 1))
    return (j.withColumn("bin", F.coalesce(b, F.lit(0)).cast("int"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("count"),
                                F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
            .select("bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"),
                    "count"))


def spatial_distribution(df: DataFrame, dim: DataFrame, value: str, key: str, year=None) -> DataFrame:
    """Per-entity mean in the dimension's order, entities without data kept (NULL)."""
    f = df if year is None else df.where(F.col("year") == year)
    m = f.groupBy(key).agg(F.avg(value).alias("mean_value"))
    return dim.join(m, key, "left")


def moments_flag(df: DataFrame, cols) -> DataFrame:
    """Population skewness and excess kurtosis with the shape part of the
    ``is_normal`` rule (|skew| < 2 and |kurt| < 7)."""
    m = moments(df, cols)
    return m.select("variable", F.col("g1").alias("skewness"), F.col("g2").alias("kurtosis"),
                    ((F.abs(F.col("g1")) < 2) & (F.abs(F.col("g2")) < 7)).alias("shape_ok"))


def norm_ppf(p):
    """Inverse standard normal CDF as a column expression (rational approximation
    with relative error < 1.2e-9 over (0, 1))."""
    # fixed coefficients of the published rational approximation
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155833342e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549671010139134e+00, 4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00]
    lo = 0.02425

    def horner(coefs, x):
        e = F.lit(coefs[0])
        for k in coefs[1:]:
            e = e * x + k
        return e

    q_lo = F.sqrt(-2 * F.log(p))
    tail_lo = horner(c, q_lo) / (horner(d, q_lo) * q_lo + 1)
    q = p - 0.5
    r = q * q
    central = horner(a, r) * q / (horner(b, r) * r + 1)
    q_hi = F.sqrt(-2 * F.log(1 - p))
    tail_hi = -horner(c, q_hi) / (horner(d, q_hi) * q_hi + 1)
    return F.when(p < lo, tail_lo).when(p <= 1 - lo, central).otherwise(tail_hi)


#: Values of a column up to which the Shapiro–Wilk weights and p-values are defined.
SHAPIRO_N = 5000


def _poly(coefs, x):
    """c0 + c1·x + c2·x² + ..."""
    out = F.lit(coefs[-1])
    for c in coefs[-2::-1]:
        out = out * x + c
    return out


def shapiro_wilk(df: DataFrame, cols) -> DataFrame:
    """(variable, n, shapiro_w, shapiro_p) by Royston's 1995 algorithm, for 3 to 5000 values of a column; other columns
    and constant ones have NULL.

    Its weights come from the normal scores of the ranks and two polynomials, so no covariance of order statistics is
    formed: the distributed ranks give every value its places, one aggregate sums scores and score times value, and the
    two largest weights are applied to the extreme values.
    """
    from ..operators.spatial import erfc
    r = ranked_values(to_long(df, cols), ["variable"], "value").where(F.col("n").between(3, SHAPIRO_N))
    i, n = F.col("i"), F.col("n")
    at = r.withColumn("i", F.explode(F.sequence(F.col("below") + 1, F.col("below") + F.col("cnt"))))
    m = norm_ppf((i - 0.375) / (n + 0.25))
    ends = F.when(n > 5, 2).otherwise(1)
    mid = (i > ends) & (i <= n - ends)
    s = at.withColumn("m", m).groupBy("variable").agg(
        F.max("n").alias("n"), F.sum(F.col("m") ** 2).alias("mm"), F.sum(F.when(mid, F.col("m") * F.col("value"))).alias("mx"),
        F.var_pop("value").alias("var"),
        *[F.max(F.when(i == place, F.col(x))).alias(name) for x, place, name in (
            ("value", F.lit(1), "x1"), ("value", F.lit(2), "x2"), ("value", n - 1, "xn1"), ("value", n, "xn"), ("m", n, "mn"), ("m", n - 1, "mn1"))])
    n = F.col("n").cast("double")
    u, root = 1 / F.sqrt(n), F.sqrt("mm")
    # fixed coefficients of the published algorithm
    an = F.when(n == 3, F.lit(math.sqrt(0.5))).otherwise(
        F.col("mn") / root + _poly([0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], u))
    an1 = F.when(n > 5, F.col("mn1") / root + _poly([0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u)).otherwise(0.0)
    left = F.when(n > 5, F.col("mm") - 2 * F.col("mn") ** 2 - 2 * F.col("mn1") ** 2).otherwise(F.col("mm") - 2 * F.col("mn") ** 2)
    scale = F.sqrt(F.col("left") / (1 - 2 * F.col("an") ** 2 - 2 * F.col("an1") ** 2))
    s = s.withColumns({"an": an, "an1": an1, "left": left})
    b = F.col("an") * (F.col("xn") - F.col("x1")) + F.col("an1") * (F.col("xn1") - F.col("x2")) + F.when(n > 3, F.coalesce("mx", F.lit(0.0)) / scale).otherwise(0.0)
    ratio = safe_div(b * b, F.col("var") * n)
    s = s.withColumn("w", F.when(ratio > 1, 1.0).otherwise(ratio))
    y, ln = F.log(1 - F.col("w")), F.log(n)
    gamma = _poly([-2.273, 0.459], n)
    few = (-F.log(gamma - y) - _poly([0.5440, -0.39978, 0.025054, -6.714e-4], n)) / F.exp(_poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
    many = (y - _poly([-1.5861, -0.31082, -0.083751, 0.0038915], ln)) / F.exp(_poly([-0.4803, -0.082676, 0.0030302], ln))
    tail = lambda z: 0.5 * erfc(z / math.sqrt(2.0))
    p = F.when(n == 3, F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))))) \
        .when(F.col("w") == 1, F.lit(1.0)).when((n <= 11) & (y >= gamma), F.lit(0.0)).when(n <= 11, tail(few)).otherwise(tail(many))
    return s.select("variable", F.col("n"), F.col("w").alias("shapiro_w"), F.when(F.col("w").isNotNull(), p).alias("shapiro_p"))


def normality(df: DataFrame, cols, min_n: int = 8) -> DataFrame:
    """Per variable Kolmogorov–Smirnov against N(mean, sd n−1)
    (spark.ml), Shapiro–Francia W' (squared correlation of the sorted values with
    Blom normal scores, from the distributed ranks) with Royston's normal
    approximation of ln(1 − W'), population skewness / excess kurtosis, and
    ``is_normal`` = p > .05 and |skew| < 2 and |kurt| < 7.

    The p of ``is_normal`` is Shapiro–Wilk's (:func:`shapiro_wilk`) up to 5000 values, beyond that W''s, its standard
    large-sample approximation.
    """
    from pyspark.ml.stat import KolmogorovSmirnovTest
    from ..operators.spatial import erfc
    long = to_long(df, cols)
    r = ranked_values(long, ["variable"], "value")
    n = F.col("n").cast("double")
    pos = F.col("below") + (F.col("cnt") + 1) / 2.0
    m = norm_ppf((pos - 0.375) / (n + 0.25))
    sf = (r.withColumn("m", m).groupBy("variable")
          .agg(F.max("n").alias("n"),
               F.sum(F.col("cnt") * F.col("value")).alias("sx"), F.sum(F.col("cnt") * F.col("m")).alias("sm"),
               F.sum(F.col("cnt") * F.col("value") ** 2).alias("sxx"), F.sum(F.col("cnt") * F.col("m") ** 2).alias("smm"),
               F.sum(F.col("cnt") * F.col("value") * F.col("m")).alias("sxm")))
    nn = F.col("n").cast("double")
    cov = F.col("sxm") - F.col("sx") * F.col("sm") / nn
    w = safe_div(cov * cov, (F.col("sxx") - F.col("sx") ** 2 / nn) * (F.col("smm") - F.col("sm") ** 2 / nn))
    lnn = F.log(nn)
    mu = -1.2725 + 1.0521 * (F.log(lnn) - lnn)
    sd = 1.0308 - 0.26758 * (F.log(lnn) + 2 / lnn)
    zsf = (F.log(1 - w) - mu) / sd
    sf = sf.select("variable", "n", w.alias("shapiro_francia_w"),
                   (0.5 * erfc(zsf / math.sqrt(2.0))).alias("shapiro_francia_p"))
    mom = moments(df, cols).select("variable", F.col("mean"), F.col("std"),
                                   F.col("g1").alias("skewness"), F.col("g2").alias("kurtosis"))
    # KS: one spark.ml test per column, parameters from the moments (p rows)
    ks_rows = []
    params = {row["variable"]: (row["mean"], row["std"]) for row in mom.collect()}
    spark = df.sparkSession
    for c in cols:
        mu_c, sd_c = params[c]
        if mu_c is None or not sd_c:
            ks_rows.append((c, None, None))
            continue
        t = KolmogorovSmirnovTest.test(df.select(F.col(c).cast("double").alias(c)).dropna(), c, "norm",
                                       float(mu_c), float(sd_c)).first()
        ks_rows.append((c, float(t.statistic), float(t.pValue)))
    ks = spark.createDataFrame(ks_rows, "variable string, ks_stat double, ks_p double")
    out = sf.join(ks, "variable").join(mom.drop("mean", "std"), "variable").where(F.col("n") >= min_n)
    out = out.join(shapiro_wilk(df, cols).drop("n"), "variable", "left")
    return out.withColumn("is_normal", (F.coalesce("shapiro_p", "shapiro_francia_p") > 0.05)
                          & (F.abs(F.col("skewness")) < 2) & (F.abs(F.col("kurtosis")) < 7))
