"""Ranking, top-k and period filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_period(df: DataFrame, t: str, target=None) -> DataFrame:
    """Rows of ``target`` period if present, else of the latest period.

    The period is a 1-row aggregate joined on equality (broadcast scalar), so
    no value goes through the driver.
    """
    mx = df.agg(F.max(t).alias("_latest"))
    if target is not None:
        has = df.where(F.col(t) == target).agg(F.count(F.lit(1)).alias("_has"))
        mx = mx.withColumn("_k", F.lit(1)).join(has.withColumn("_k", F.lit(1)), "_k").select(
            F.when(F.col("_has") > 0, F.lit(target)).otherwise(F.col("_latest")).alias("_latest"))
    return df.join(F.broadcast(mx), F.col(t) == F.col("_latest")).drop("_latest")


def top_entities(df: DataFrame, key: str, metric: str, n: int) -> DataFrame:
    """T1 + T2: entities ranked by the mean of ``metric``, descending (ties by key),
    top ``n`` (``TakeOrderedAndProject``: each partition keeps only n rows)."""
    m = df.groupBy(key).agg(F.avg(metric).alias(f"mean_{metric}"))
    top = m.orderBy(F.col(f"mean_{metric}").desc_nulls_last(), F.col(key)).limit(n)
    # the rank is computed on the n surviving rows only
    w = Window.orderBy(F.col(f"mean_{metric}").desc_nulls_last(), F.col(key))
    return top.withColumn("rank", F.rank().over(w))


def top_nodes(df: DataFrame, id_col: str, score: str, n: int) -> DataFrame:
    """Top-n rows by a score, ties broken by id."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(id_col)).limit(n)


def arg_best(df: DataFrame, metric: str, label: str, maximize: bool = True) -> DataFrame:
    """T5: the label with the best metric (first label on ties), one row."""
    order = F.col(metric).desc_nulls_last() if maximize else F.col(metric).asc_nulls_last()
    return df.orderBy(order, F.col(label)).limit(1)


def time_trend(df: DataFrame, key: str, t: str, metrics, top: int = 5, rank_by: str | None = None) -> DataFrame:
    """Q3 + P7: mean of up to three metrics by (entity, period) for the ``top``
    entities by total of the first metric (a membership semi-join)."""
    metrics = list(metrics)[:3]
    rank_by = rank_by or metrics[0]
    chosen = (df.groupBy(key).agg(F.sum(rank_by).alias("_s"))
              .orderBy(F.col("_s").desc(), F.col(key)).limit(top).select(key))
    return (df.join(F.broadcast(chosen), key, "left_semi")
            .groupBy(key, t).agg(*[F.avg(m).alias(m) for m in metrics]))
