"""Preprocessing (R1–R18, F1–F5): imputation, outliers, transforms, scaling.

Every operator takes an explicit column list (keys such as year or codes are
never touched).  Parameters (means, medians, percentiles, min/max) are
computed by one distributed aggregate, kept as a one-row DataFrame and joined
back on a constant key (a broadcast of a single row), so no value passes
through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantiles_wide
from ..functions.scalar import clip, log1p_shift, safe_div
from .stats import _stack, to_long


def _attach(df: DataFrame, params: DataFrame) -> DataFrame:
    """Join a one-row parameter frame to every row (constant-key broadcast join)."""
    k = "_pk"
    return df.withColumn(k, F.lit(1)).join(F.broadcast(params.withColumn(k, F.lit(1))), k).drop(k)


def _wide_quantiles(df: DataFrame, cols, probs: dict) -> DataFrame:
    """One row with ``{c}__{name}`` exact quantiles of every column."""
    q = quantiles_wide(to_long(df, cols), ["variable"], "value", probs)
    return q.groupBy().agg(*[
        F.max(F.when(F.col("variable") == c, F.col(name))).alias(f"{c}__{name}")
        for c in cols for name in probs])


def impute(df: DataFrame, cols, method: str = "mean") -> DataFrame:
    """R1 mean / R2 median (exact, distributed) imputation of ``cols``."""
    if method == "mean":
        p = df.agg(*[F.avg(c).alias(f"{c}__fill") for c in cols])
    elif method == "median":
        p = _wide_quantiles(df, cols, {"fill": 0.5})
    else:
        raise ValueError(f"unknown imputation method {method}")
    j = _attach(df, p)
    return j.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}__fill")) for c in cols}) \
            .drop(*[f"{c}__fill" for c in cols])


def outlier_report(df: DataFrame, cols, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """R5 IQR fences / R6 z-score (population std) / R7 modified z-score:
    count and percent of outliers per column (no order; a constant column has none, a column
    without values no row).

    The parameters are one row, attached to every row; the counts are one wide aggregate with partial sums."""
    x = {c: F.col(c).cast("double") for c in cols}
    if method == "iqr":
        j = _attach(df, _wide_quantiles(df, cols, {"q1": 0.25, "q3": 0.75}))
        flags = {}
        for c in cols:
            q1, q3 = F.col(f"{c}__q1"), F.col(f"{c}__q3")
            flags[c] = (x[c] < q1 - threshold * (q3 - q1)) | (x[c] > q3 + threshold * (q3 - q1))
    elif method == "zscore":
        p = df.agg(*[a for c in cols for a in (F.avg(x[c]).alias(f"{c}__mu"), F.stddev_pop(x[c]).alias(f"{c}__sd"))])
        j = _attach(df, p)
        flags = {c: F.abs(safe_div(x[c] - F.col(f"{c}__mu"), F.col(f"{c}__sd"))) > threshold for c in cols}
    elif method == "modified_zscore":
        j = _attach(df, _wide_quantiles(df, cols, {"med": 0.5}))
        dev = j.select(*[F.abs(x[c] - F.col(f"{c}__med")).alias(c) for c in cols])
        j = _attach(j, _wide_quantiles(dev, cols, {"mad": 0.5}))
        flags = {c: F.abs(safe_div(0.6745 * (x[c] - F.col(f"{c}__med")), F.col(f"{c}__mad"))) > threshold for c in cols}
    else:
        raise ValueError(f"unknown outlier method {method}")
    wide = j.agg(*[a for c in cols for a in (F.count_if(flags[c]).alias(f"{c}__outliers_count"), F.count(x[c]).alias(f"{c}__n"))])
    return _stack(wide, cols, ["outliers_count", "n"]).where("n > 0").select(
        "variable", "outliers_count", (F.col("outliers_count") / F.col("n") * 100).alias("outliers_pct"))


def cap_percentiles(df: DataFrame, cols, low: float = 0.01, high: float = 0.99, min_n: int = 10) -> DataFrame:
    """R8 + F5: clip each column to its exact 1st / 99th percentile (linear),
    only for columns with at least ``min_n`` non-null values."""
    p = _wide_quantiles(df, cols, {"lo": low, "hi": high})
    cnt = df.agg(*[F.count(c).alias(f"{c}__n") for c in cols])
    p = _attach(p, cnt)
    j = _attach(df, p)
    return j.withColumns({
        c: F.when(F.col(f"{c}__n") >= min_n, clip(F.col(c).cast("double"), F.col(f"{c}__lo"), F.col(f"{c}__hi")))
           .otherwise(F.col(c).cast("double")) for c in cols}) \
        .drop(*[f"{c}__{s}" for c in cols for s in ("lo", "hi", "n")])


def null_outliers(df: DataFrame, cols, threshold: float = 3.0, min_n: int = 10) -> DataFrame:
    """Set values outside the IQR fences (threshold × IQR) to NULL."""
    p = _wide_quantiles(df, cols, {"q1": 0.25, "q3": 0.75})
    cnt = df.agg(*[F.count(c).alias(f"{c}__n") for c in cols])
    j = _attach(_attach(df, p), cnt)
    new = {}
    for c in cols:
        iqr = F.col(f"{c}__q3") - F.col(f"{c}__q1")
        x = F.col(c).cast("double")
        out = (x < F.col(f"{c}__q1") - threshold * iqr) | (x > F.col(f"{c}__q3") + threshold * iqr)
        new[c] = F.when((F.col(f"{c}__n") >= min_n) & out, F.lit(None).cast("double")).otherwise(x)
    return j.withColumns(new).drop(*[f"{c}__{s}" for c in cols for s in ("q1", "q3", "n")])


def log_transform(df: DataFrame, cols, min_n: int = 10) -> DataFrame:
    """log1p, shifted by −min + 1 when the column minimum is <= 0."""
    p = df.agg(*[F.min(c).alias(f"{c}__min") for c in cols], *[F.count(c).alias(f"{c}__n") for c in cols])
    j = _attach(df, p)
    return j.withColumns({
        c: F.when(F.col(f"{c}__n") >= min_n, log1p_shift(F.col(c).cast("double"), F.col(f"{c}__min")))
           .otherwise(F.col(c).cast("double")) for c in cols}) \
        .drop(*[f"{c}__{s}" for c in cols for s in ("min", "n")])


def scale_params(df: DataFrame, cols, method: str = "standard") -> DataFrame:
    """One-row parameter frame: ``{c}__center`` and ``{c}__scale``."""
    if method == "standard":
        return df.agg(*[x for c in cols for x in (
            F.avg(c).alias(f"{c}__center"), F.stddev_pop(c).alias(f"{c}__scale"))])
    if method == "minmax":
        return df.agg(*[x for c in cols for x in (
            F.min(c).alias(f"{c}__center"), (F.max(c) - F.min(c)).alias(f"{c}__scale"))])
    if method == "robust":
        q = _wide_quantiles(df, cols, {"q1": 0.25, "med": 0.5, "q3": 0.75})
        return q.select(*[x for c in cols for x in (
            F.col(f"{c}__med").alias(f"{c}__center"),
            (F.col(f"{c}__q3") - F.col(f"{c}__q1")).alias(f"{c}__scale"))])
    raise ValueError(f"unknown scaling {method}")


def apply_scale(df: DataFrame, cols, params: DataFrame) -> DataFrame:
    """(x − center) / scale; a zero scale (constant column) maps to 0."""
    j = _attach(df, params)
    return j.withColumns({
        c: F.when(F.col(f"{c}__scale") != 0,
                  (F.col(c).cast("double") - F.col(f"{c}__center")) / F.col(f"{c}__scale"))
            .when(F.col(c).isNotNull(), F.lit(0.0)) for c in cols}) \
        .drop(*[f"{c}__{s}" for c in cols for s in ("center", "scale")])


def scale(df: DataFrame, cols, method: str = "standard"):
    """R11 standard (population std), R12 min-max, R13 robust (median / IQR).

    Returns (scaled DataFrame, one-row parameter DataFrame)."""
    p = scale_params(df, cols, method)
    return apply_scale(df, cols, p), p


def prep_pipeline(df: DataFrame, cols, impute_method: str | None = "mean", cap: bool = True,
                  transform: bool = False, scale_method: str | None = "standard") -> DataFrame:
    """Impute → cap outliers → (log transform) → scale, each step optional."""
    out = df
    if impute_method:
        out = impute(out, cols, impute_method)
    if cap:
        out = cap_percentiles(out, cols)
    if transform:
        out = log_transform(out, cols)
    if scale_method:
        out, _ = scale(out, cols, scale_method)
    return out


def boxcox_lambda(df: DataFrame, cols, lo: float = -3.0, hi: float = 3.0) -> dict:
    """maximum-likelihood Box-Cox λ per column (positive values only).

    The profile log-likelihood (λ − 1)·Σ ln x − n/2 · ln var(y_λ) needs Σ y_λ and
    Σ y_λ² per (column, λ): the values are unpivoted, each row is exploded over
    the λ grid (a literal array) and one aggregate keyed by (column, λ) sums
    them — the partial aggregate leaves one row per key and partition.  A
    coarse grid is followed by a 100× finer grid around each column's best λ.
    """
    import numpy as np
    from .stats import to_long

    long = to_long(df, cols).where(F.col("value") > 0)

    def best(grids: dict) -> dict:
        by_col = F.create_map(*[x for c, g in grids.items()
                                for x in (F.lit(c), F.array(*[F.lit(float(v)) for v in g]))])
        e = long.select("variable", "value", F.explode(F.element_at(by_col, F.col("variable"))).alias("lam"))
        x, lam = F.col("value"), F.col("lam")
        y = F.when(F.abs(lam) < 1e-12, F.log(x)).otherwise((F.pow(x, lam) - 1) / lam)
        rows = (e.groupBy("variable", "lam")
                .agg(F.count(F.lit(1)).alias("n"), F.sum(F.log(x)).alias("sl"),
                     F.sum(y).alias("s"), F.sum(y * y).alias("q")).collect())  # |cols| × |grid| rows
        out = {}
        for c in grids:
            cand = []
            for r in rows:
                if r["variable"] != c:
                    continue
                var = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2
                ll = (r["lam"] - 1) * r["sl"] - r["n"] / 2 * np.log(var) if var > 0 else -np.inf
                cand.append((ll, -abs(r["lam"]), r["lam"]))
            out[c] = max(cand)[2]
        return out

    coarse = list(np.round(np.arange(lo, hi + 1e-9, 0.05), 10))
    b1 = best({c: coarse for c in cols})
    fine = {c: list(np.round(np.arange(b1[c] - 0.05, b1[c] + 0.05 + 1e-9, 0.0005), 10)) for c in cols}
    return {c: float(v) for c, v in best(fine).items()}


def boxcox(df: DataFrame, cols, lambdas: dict | None = None) -> DataFrame:
    """``{c}_boxcox`` = (x^λ − 1)/λ (ln x when λ = 0) with the MLE λ."""
    lambdas = lambdas or boxcox_lambda(df, cols)
    new = {}
    for c, lam in lambdas.items():
        x = F.col(c).cast("double")
        y = F.log(x) if abs(lam) < 1e-12 else (F.pow(x, lam) - 1) / lam
        new[f"{c}_boxcox"] = F.when(x > 0, y)
    return df.withColumns(new)


def auto_transform(df: DataFrame, cols) -> DataFrame:
    """For columns flagged non-normal by R14–R16, append ``_log`` (all > 0),
    ``_sqrt`` (all >= 0) and ``_boxcox`` (all > 0 and n > 10)."""
    from .stats import normality
    rep = {r["variable"]: r["is_normal"] for r in normality(df, cols).select("variable", "is_normal").collect()}
    bad = [c for c in cols if rep.get(c) is False]
    if not bad:
        return df
    st = df.agg(*[F.min(c).alias(f"{c}__min") for c in bad], *[F.count(c).alias(f"{c}__n") for c in bad]).first()
    out = df
    new = {}
    pos = []
    for c in bad:
        mn, n = st[f"{c}__min"], st[f"{c}__n"]
        if mn is not None and mn > 0:
            new[f"{c}_log"] = F.log(F.col(c).cast("double"))
            if n > 10:
                pos.append(c)
        if mn is not None and mn >= 0:
            new[f"{c}_sqrt"] = F.sqrt(F.col(c).cast("double"))
    out = out.withColumns(new) if new else out
    return boxcox(out, pos) if pos else out


def knn_impute(df: DataFrame, cols, id_col: str, k: int = 5) -> DataFrame:
    """kNN imputation (uniform weights) with every donor.  The donors of a row's missing column are all rows that have
    it and share a coordinate with the row; their distance is the NaN-Euclidean one, sqrt(p/|shared| · Σ shared Δ²), ties
    go to the smaller id.

    Rows are grouped by their NULL mask.  A pair of masks (of a row, of a donor) fixes the shared coordinates, so it is
    one group of an exact nearest-neighbour search over these coordinates; the pairs' lists of ``k`` are scaled by
    sqrt(p/|shared|) and merged into the ``k`` nearest of a column.  All pairs are searched in one job of
    :func:`.neighbours.nearest`.  Only masks that occur count: rows are copied once for each mask they can meet.

    A row without a coordinate or without a donor gets the column's mean, so no NULL (or NaN) is left in a column that
    has values.  Ids must be distinct and not null.
    """
    from .graph import _materialize
    from .neighbours import nearest
    cols = list(cols)
    p = len(cols)
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    base = _materialize(df.select(
        F.col(id_col).alias("i"), F.array(*[value[c] for c in cols]).alias("x"),
        F.concat(*[F.when(value[c].isNull(), "0").otherwise("1") for c in cols]).alias("mask")))
    masks = base.select("mask").distinct()
    bits = [(F.substring("mask", j + 1, 1) == "1", F.substring("donor", j + 1, 1) == "1") for j in range(p)]
    shared = sum((a & b).cast("int") for a, b in bits)
    gives = F.lit(False)
    for a, b in bits:
        gives = gives | (~a & b)
    pairs = _materialize(masks.join(masks.withColumnRenamed("mask", "donor"), gives & (shared > 0)).select(
        "mask", "donor", F.concat_ws(":", "mask", "donor").alias("g"), shared.alias("shared")))
    on_both = F.transform("x", lambda x, j: F.when((F.substring(F.col("mask"), j + 1, F.lit(1)) == "1") & (F.substring(F.col("donor"), j + 1, F.lit(1)) == "1"), x)
                          .otherwise(F.lit(0.0)))
    rows = _materialize(base.join(pairs, "mask").select("g", "i", on_both.alias("v"), "mask", "donor", "shared"))
    donors = base.withColumnRenamed("mask", "donor").join(pairs, "donor").select("g", "i", on_both.alias("v"))
    near = nearest(rows, donors, k)
    lists = rows.join(near, ["g", "v"]).select("i", "mask", "shared", F.explode("near").alias("d")).select(
        "i", "mask", (F.col("d.dist") * F.sqrt(F.lit(float(p)) / F.col("shared"))).alias("dist"), F.col("d.i").alias("donor"))
    met = lists.join(base.select(F.col("i").alias("donor"), "x"), "donor").select(
        "i", "dist", "donor", "mask", F.posexplode("x").alias("j", "value"))
    met = met.where((F.substring(F.col("mask"), F.col("j") + 1, F.lit(1)) == "0") & F.col("value").isNotNull())
    w = Window.partitionBy("i", "j").orderBy("dist", "donor")
    fill = met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    wide = fill.groupBy(F.col("i").alias(id_col)).agg(
        *[F.avg(F.when(F.col("j") == j, F.col("value"))).alias(f"_f_{c}") for j, c in enumerate(cols)])
    out = df.withColumns(value).join(wide, id_col, "left").withColumns({c: F.coalesce(c, f"_f_{c}") for c in cols}).drop(*[f"_f_{c}" for c in cols])
    means = base.agg(*[F.avg(F.col("x")[j]).alias(f"{c}__fill") for j, c in enumerate(cols)])
    return _attach(out, means).withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__fill")) for c in cols}).drop(*[f"{c}__fill" for c in cols])


def mice_impute(df: DataFrame, cols, id_col: str, rounds: int = 10, alpha: float = 1e-6) -> DataFrame:
    """Iterative (chained-equation) imputation.  Start from the column means;
    each round, for every column with missing values, fit a ridge regression of
    it on the other columns over the rows where it is observed (one Gramian
    aggregate, (p)² numbers to the driver) and replace its missing entries by
    the prediction.  The working table is checkpointed every round."""
    import numpy as np
    from .graph import _materialize
    cols = list(cols)
    base = df.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols])
    miss = base.select(id_col, *[F.col(c).isNull().alias(f"_m_{c}") for c in cols])
    cur = _materialize(impute(base, cols, "mean").join(miss, id_col))
    todo = [c for c in cols if cur.where(F.col(f"_m_{c}")).limit(1).count() > 0]
    for _ in range(rounds):
        for c in todo:
            xs = [o for o in cols if o != c]
            obs = cur.where(~F.col(f"_m_{c}"))
            terms = ["_one"] + xs
            fr = obs.select(F.lit(1.0).alias("_one"), *xs, c)
            aggs = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(terms)
                    for j, b in enumerate(terms) if j >= i]
            aggs += [F.sum(F.col(a) * F.col(c)).alias(f"r{i}") for i, a in enumerate(terms)]
            row = fr.agg(*aggs).first()
            m = len(terms)
            g = np.zeros((m, m))
            for i in range(m):
                for j in range(i, m):
                    g[i, j] = g[j, i] = row[f"g{i}_{j}"]
            g[1:, 1:] += alpha * np.eye(m - 1)
            beta = np.linalg.solve(g, np.array([row[f"r{i}"] for i in range(m)]))
            pred = float(beta[0]) + sum(F.col(o) * float(b) for o, b in zip(xs, beta[1:]))
            cur = cur.withColumn(c, F.when(F.col(f"_m_{c}"), pred).otherwise(F.col(c)))
        cur = _materialize(cur)
    rest = [c for c in df.columns if c not in cols and c != id_col]
    return df.select(id_col, *rest).join(cur.select(id_col, *cols), id_col)
