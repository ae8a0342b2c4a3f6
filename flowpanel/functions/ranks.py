"""Global order statistics without a single partition.

``Window.orderBy`` without ``partitionBy`` (and the exact ``percentile``
aggregate, which holds every distinct value of a group in one task) does not
scale.  Everything order-based in this library (exact quantiles, medians,
average ranks, Gini, Lorenz points) goes through :func:`ranked_values`:

1. collapse the input to distinct ``(group, value, cnt)`` rows — a hot value
   that holds a third of all rows becomes one row after the map-side partial
   aggregate;
2. cut each group's value range into ``n_buckets`` ranges at approximate
   quantiles of the distinct values (``percentile_approx``: one small row per
   group, copied to ``SALTS`` salts so that a group's values don't meet in one
   task) — the bucket id is a pure expression of the value, so a lost task
   recomputes the same bucket without any checkpoint;
3. total counts per (group, bucket) — ``groups × n_buckets`` rows — give each
   bucket its offset through a small window;
4. a window partitioned by (group, bucket) and ordered by value adds the
   running count inside the bucket.

The result is exact whatever the approximate boundaries are: they only
balance the buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fewest value ranges of a group; there are as many as shuffle partitions if those are more.
LEAST_BUCKETS = 64
#: Copies of a small table over which the rows of one key spread.
SALTS = 32


def spread_join(df: DataFrame, small: DataFrame, keys, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join a table of one row per key to many rows: each key's rows are dealt to ``salts`` salts by
    their content and meet a copy of the small row there, so a hot key is not one task's work."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def _group_cols(df: DataFrame, group_cols):
    g = list(group_cols or [])
    if not g:
        df = df.withColumn("_g", F.lit(0))
        g = ["_g"]
    return df, g


def ranked_values(df: DataFrame, group_cols, value: str,
                  n_buckets: int | None = None, accuracy: int = 10000) -> DataFrame:
    """Distinct values per group with their exact global position.

    Returns ``group_cols + [value, cnt, below, sum_below, n, total]`` where
    ``below`` is the number of non-null rows of the group with a strictly
    smaller value, ``sum_below`` their sum, ``n`` the group's non-null count
    and ``total`` its sum.
    """
    if n_buckets is None:
        n_buckets = max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    src, g = _group_cols(df, group_cols)
    d = (src.where(F.col(value).isNotNull())
         .groupBy(*g, value).agg(F.count(F.lit(1)).alias("cnt")))
    if n_buckets > 1:
        probs = [i / n_buckets for i in range(1, n_buckets)]
        bounds = d.groupBy(*g).agg(
            F.percentile_approx(value, probs, accuracy).alias("_bounds"))
        v = F.col(value)
        d = (spread_join(d, bounds, g)
             .withColumn("_b", F.size(F.filter("_bounds", lambda b: b < v)))
             .drop("_bounds"))
    else:
        d = d.withColumn("_b", F.lit(0))
    d = d.withColumn("_s", F.col(value) * F.col("cnt"))
    bt = d.groupBy(*g, "_b").agg(F.sum("cnt").alias("_bc"), F.sum("_s").alias("_bs"))
    wg = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*g)
    bt = (bt.withColumn("_off", F.coalesce(F.sum("_bc").over(wg), F.lit(0)))
            .withColumn("_soff", F.coalesce(F.sum("_bs").over(wg), F.lit(0.0)))
            .withColumn("n", F.sum("_bc").over(wall))
            .withColumn("total", F.sum("_bs").over(wall))
            .drop("_bc", "_bs"))
    wb = (Window.partitionBy(*g, "_b").orderBy(value)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (d.join(bt, g + ["_b"])
           .withColumn("below", F.col("_off") + F.sum("cnt").over(wb) - F.col("cnt"))
           .withColumn("sum_below", F.col("_soff") + F.sum("_s").over(wb) - F.col("_s"))
           .select(*g, value, "cnt", "below", "sum_below", "n", "total"))
    if g == ["_g"] and not group_cols:
        out = out.drop("_g")
    return out


def exact_quantiles(df: DataFrame, group_cols, value: str, probs,
                    n_buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy ``linear`` / DuckDB
    ``quantile_cont`` / Spark ``percentile``) per group, long form
    ``group_cols + [p, q]``."""
    g = list(group_cols or [])
    r = ranked_values(df, g, value, n_buckets)
    pr = F.array(*[F.lit(float(p)) for p in probs])

    def covers(pos):
        return (F.col("below") <= pos) & (pos < F.col("below") + F.col("cnt"))

    def lo(p):
        return F.floor((F.col("n") - 1) * p)

    def hi(p):
        return F.ceil((F.col("n") - 1) * p)

    hits = (r.where(F.exists(pr, lambda p: covers(lo(p)) | covers(hi(p))))
            .select(*g, value, "cnt", "below", "n", F.explode(pr).alias("p")))
    p = F.col("p")
    h = (F.col("n") - 1) * p
    return (hits.groupBy(*g, "p")
            .agg(F.max(F.when(covers(lo(p)), F.col(value))).alias("_vlo"),
                 F.max(F.when(covers(hi(p)), F.col(value))).alias("_vhi"),
                 F.max(h - lo(p)).alias("_frac"))
            .select(*g, "p", (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("q")))


def quantiles_wide(df: DataFrame, group_cols, value: str, probs: dict,
                   n_buckets: int | None = None) -> DataFrame:
    """Exact quantiles, one column per entry of ``probs`` ({name: p})."""
    g = list(group_cols or [])
    long = exact_quantiles(df, g, value, list(probs.values()), n_buckets)
    if not g:
        long = long.withColumn("_g", F.lit(0))
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(name)
            for name, p in probs.items()]
    out = long.groupBy(*(g or ["_g"])).agg(*aggs)
    return out if g else out.drop("_g")


def average_rank(df: DataFrame, group_cols, value: str, out: str,
                 ascending: bool = True, n_buckets: int | None = None) -> DataFrame:
    """Append the average (tie-shared) 1-based rank of ``value`` within each group.

    NULL values get a NULL rank.  Descending rank = n + 1 - ascending rank.
    """
    g = list(group_cols or [])
    r = ranked_values(df, g, value, n_buckets)
    asc = F.col("below") + (F.col("cnt") + 1) / 2.0
    expr = asc if ascending else F.col("n") + 1 - asc
    r = r.select(*[F.col(c).alias(f"_rg_{c}") for c in g],
                 F.col(value).alias("_rv"), expr.alias(out))
    conds = [F.col(c) == F.col(f"_rg_{c}") for c in g] + [F.col(value) == F.col("_rv")]
    joined = df.join(r, conds, "left")
    return joined.drop(*[f"_rg_{c}" for c in g], "_rv")
