"""Panel feature engineering.

All window features share one ``WindowSpec`` (partition by entity, order by
time), so Spark plans a single exchange + sort for lags, rolling statistics
and growth rates together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import interaction_cols, poly_cols, ratio_cols, safe_div
from . import pairs
from .neighbours import nearest_by
from .vectors import points
from .stats import group_stats_back


def lag_features(df: DataFrame, cols, by: str, t: str, lags=(1, 2, 3)) -> DataFrame:
    """``{c}_lag{k}`` = value k periods earlier within the entity."""
    w = Window.partitionBy(by).orderBy(t)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in lags})


def rolling_features(df: DataFrame, cols, by: str, t: str, windows=(3, 5)) -> DataFrame:
    """Trailing k-row mean, sample std and max (min_periods = 1)."""
    base = Window.partitionBy(by).orderBy(t)
    new = {}
    for c in cols:
        for k in windows:
            w = base.rowsBetween(-(k - 1), 0)
            new[f"{c}_rolling_mean_{k}"] = F.avg(c).over(w)
            new[f"{c}_rolling_std_{k}"] = F.stddev_samp(c).over(w)
            new[f"{c}_rolling_max_{k}"] = F.max(c).over(w)
    return df.withColumns(new)


def growth_features(df: DataFrame, cols, by: str, t: str) -> DataFrame:
    """Period-over-period change on forward-filled values (``_growth`` and the
    identical ``_yoy``); a zero previous value gives NULL instead of infinity."""
    w = Window.partitionBy(by).orderBy(t)
    cur_w = w.rowsBetween(Window.unboundedPreceding, 0)
    prev_w = w.rowsBetween(Window.unboundedPreceding, -1)
    new = {}
    for c in cols:
        cur = F.last(c, ignorenulls=True).over(cur_w)
        prev = F.last(c, ignorenulls=True).over(prev_w)
        g = safe_div(cur, prev) - 1
        new[f"{c}_growth"] = g
        new[f"{c}_yoy"] = g
    return df.withColumns(new)


def avg_rank_desc(df: DataFrame, value: str, by=None, out: str = "rank") -> DataFrame:
    """Average (tie-shared) descending rank, truncated to int, within ``by``."""
    from ..functions.ranks import average_rank
    r = average_rank(df, [by] if by else [], value, "_avg_rank", ascending=False)
    return r.withColumn(out, F.col("_avg_rank").cast("int")).drop("_avg_rank")


def interactions(df: DataFrame, pairs_) -> DataFrame:
    """products ``{a}_x_{b}`` for the listed pairs that exist."""
    ok = [(a, b) for a, b in pairs_ if a in df.columns and b in df.columns]
    return df.withColumns(interaction_cols(ok))


def ratios(df: DataFrame, nums, dens) -> DataFrame:
    """``{num}_per_{den}``; a zero denominator gives NULL."""
    return df.withColumns(ratio_cols([n for n in nums if n in df.columns],
                                     [d for d in dens if d in df.columns]))


def polynomial(df: DataFrame, cols, degree: int = 2, interaction_only: bool = False) -> DataFrame:
    """F8: polynomial terms of degree 2..degree (degree-1 terms are the inputs)."""
    return df.withColumns(poly_cols(list(cols), degree, interaction_only))


def nearest_entity(df: DataFrame, cols, id_col: str, t: str, metric: str = "euclidean") -> DataFrame:
    """E1 + J4: on the latest period, distance to and id of the nearest other
    entity (exact, ties → smaller id) under a metric of :func:`.neighbours.nearest_by`, joined back to every period.

    The latest period comes from a 1-row aggregate joined on equality
    (a broadcast scalar subquery).  With fewer than 2 entities the input is
    returned unchanged.
    """
    latest = df.agg(F.max(t).alias(t))
    cur = df.join(F.broadcast(latest), t)
    # first row per entity, deterministic
    w = Window.partitionBy(id_col).orderBy(*[F.col(c).asc_nulls_last() for c in cols])
    cur = cur.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    if metric == "euclidean":
        nn = pairs.knn(cur, id_col, cols, k=1)
    else:
        own = points(cur, cols, [id_col]).withColumnRenamed(id_col, "i")
        nn = nearest_by(own, 1, metric).withColumnRenamed("i", id_col)
    nn = nn.select(id_col, F.col("dist").alias(f"distance_to_nearest_{metric}"), F.col("nbr").alias("nearest_city"))
    return df.join(nn, id_col, "left")


def feature_pipeline(df: DataFrame, by: str, t: str, exclude=("year",), od_features: DataFrame | None = None,
                     n_cols: int = 5) -> DataFrame:
    """Lags, rolling stats, growth, group stats, interactions, ratios and the
    nearest-entity features of the first ``n_cols`` numeric value columns; the
    OD position features are joined when given."""
    from ..sources.loaders import numeric_columns
    value_cols = numeric_columns(df, exclude=set(exclude) | {by})
    cols = value_cols[:n_cols]
    out = lag_features(df, cols, by, t)
    out = rolling_features(out, cols, by, t)
    out = growth_features(out, cols, by, t)
    out = group_stats_back(out, cols, by)
    if len(value_cols) >= 4:
        out = interactions(out, [(value_cols[0], value_cols[1]), (value_cols[2], value_cols[3])])
        out = ratios(out, value_cols[:2], value_cols[2:4])
    out = nearest_entity(out, cols, by, t)
    if od_features is not None:
        out = out.join(od_features.withColumnRenamed("city", by), by, "left")
    return out
