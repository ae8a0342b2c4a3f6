"""Origin–destination flow operators.

Input: a long OD table with columns ``src, dst, year, value`` (plus any extra).
Endpoint statistics are computed with one ``explode`` of the two endpoints
and one ``groupBy`` — a single shuffle whose map-side partial aggregate
shrinks every partition to one row per (city, year) before it moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import safe_div


def _endpoints(od: DataFrame, value: str = "value", extra=("year",)) -> DataFrame:
    """One row per (row, endpoint): city, is_out, is_in, out value, in value."""
    e = F.explode(F.array(
        F.struct(F.col("src").alias("city"), F.lit(1).alias("is_out"), F.lit(0).alias("is_in"),
                 F.col(value).alias("v")),
        F.struct(F.col("dst").alias("city"), F.lit(0).alias("is_out"), F.lit(1).alias("is_in"),
                 F.col(value).alias("v")),
    )).alias("e")
    return od.select(*extra, e).select(*extra, "e.*")


def city_flows(od: DataFrame, by_year: bool = True) -> DataFrame:
    """A9 + J2: total out, total in, net, gross per city (and year), ranked by gross.

    A city with only outflows gets ``inflow = 0`` (the full-join-and-fill rule).
    """
    keys = ["year"] if by_year else []
    ep = _endpoints(od, extra=tuple(keys))
    agg = ep.groupBy("city", *keys).agg(
        F.coalesce(F.sum(F.when(F.col("is_out") == 1, F.col("v"))), F.lit(0.0)).alias("outflow"),
        F.coalesce(F.sum(F.when(F.col("is_in") == 1, F.col("v"))), F.lit(0.0)).alias("inflow"))
    agg = (agg.withColumn("net_flow", F.col("outflow") - F.col("inflow"))
              .withColumn("gross_flow", F.col("outflow") + F.col("inflow")))
    w = Window.partitionBy(*keys) if keys else None
    if w is not None:
        agg = agg.withColumn("gross_rank", F.rank().over(
            w.orderBy(F.col("gross_flow").desc(), F.col("city"))))
    return agg


def full_outer_fill(left: DataFrame, right: DataFrame, keys, fill: float = 0.0) -> DataFrame:
    """Full outer equi-join, missing measures filled with ``fill``."""
    j = left.join(right, list(keys), "full")
    measures = [c for c in j.columns if c not in keys]
    return j.fillna(fill, subset=measures)


def network_features(od: DataFrame, dim: DataFrame, year: int | None = None,
                     dim_key: str = "nation") -> DataFrame:
    """A10: network position features for **every** dimension entity.

    out/in strength, total, net, balance |net|/total (0 when total <= 0),
    out/in/total degree as OD row counts (self loops count on both sides).
    Entities absent from the flows get zeros.
    """
    f = od if year is None else od.where(F.col("year") == year)
    ep = _endpoints(f, extra=())
    agg = ep.groupBy("city").agg(
        F.sum(F.when(F.col("is_out") == 1, F.col("v"))).alias("outflow_strength"),
        F.sum(F.when(F.col("is_in") == 1, F.col("v"))).alias("inflow_strength"),
        F.sum("is_out").alias("out_degree"),
        F.sum("is_in").alias("in_degree"))
    d = dim.select(F.col(dim_key).alias("city"), *[c for c in dim.columns if c != dim_key])
    j = d.join(agg, "city", "left")
    z = F.lit(0.0)
    out_s = F.coalesce(F.col("outflow_strength"), z)
    in_s = F.coalesce(F.col("inflow_strength"), z)
    j = j.select(
        *d.columns,
        out_s.alias("outflow_strength"), in_s.alias("inflow_strength"),
        (out_s + in_s).alias("total_strength"), (out_s - in_s).alias("net_flow"),
        F.coalesce(F.col("out_degree"), F.lit(0)).cast("long").alias("out_degree"),
        F.coalesce(F.col("in_degree"), F.lit(0)).cast("long").alias("in_degree"))
    return (j.withColumn("flow_balance", F.when(
                F.col("total_strength") > 0,
                F.abs(F.col("net_flow")) / F.col("total_strength")).otherwise(z))
             .withColumn("total_degree", F.col("out_degree") + F.col("in_degree")))


def od_position_features(od: DataFrame, value: str = "value") -> DataFrame:
    """A11 + J3: degree counts, strengths and row-share "betweenness" per city.

    ``total_degree``, ``total_strength`` and ``net_flow`` are NULL when the city
    never appears on one side (index-aligned arithmetic); ``betweenness`` is the
    share of OD rows touching the city, a self loop counted once.
    """
    ep = (od.select(F.col("src"), F.col("dst"), F.col(value).alias("v"))
          .select(F.explode(F.array(
              F.struct(F.col("src").alias("city"), F.lit(1).alias("o"), F.lit(0).alias("i"),
                       F.col("v"), F.lit(1).alias("touch")),
              F.struct(F.col("dst").alias("city"), F.lit(0).alias("o"), F.lit(1).alias("i"),
                       F.col("v"), F.when(F.col("dst") != F.col("src"), 1).otherwise(0).alias("touch"))
          )).alias("e")).select("e.*"))
    agg = ep.groupBy("city").agg(
        F.sum("o").alias("_o"), F.sum("i").alias("_i"),
        F.sum(F.when(F.col("o") == 1, F.col("v"))).alias("_os"),
        F.sum(F.when(F.col("i") == 1, F.col("v"))).alias("_is"),
        F.sum("touch").alias("_touch"))
    n_rows = od.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    # 1-row total joined on a constant key (a scalar subquery, broadcast by size 1)
    agg = agg.withColumn("_k", F.lit(1)).join(F.broadcast(n_rows), "_k").drop("_k")
    out_d = F.when(F.col("_o") > 0, F.col("_o"))
    in_d = F.when(F.col("_i") > 0, F.col("_i"))
    out_s = F.when(F.col("_o") > 0, F.coalesce(F.col("_os"), F.lit(0.0)))
    in_s = F.when(F.col("_i") > 0, F.coalesce(F.col("_is"), F.lit(0.0)))
    return agg.select(
        "city",
        out_d.cast("long").alias("out_degree"), in_d.cast("long").alias("in_degree"),
        (out_d + in_d).cast("long").alias("total_degree"),
        out_s.alias("out_strength"), in_s.alias("in_strength"),
        (out_s + in_s).alias("total_strength"), (out_s - in_s).alias("net_flow"),
        (F.col("_touch") / F.col("_n")).alias("betweenness_centrality"))


def yearly_total(od: DataFrame) -> DataFrame:
    """Grand total per year, with the within-entity (diagonal) part."""
    return od.groupBy("year").agg(
        F.sum("value").alias("total"),
        F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("value"))), F.lit(0.0)).alias("diagonal"),
        F.count(F.lit(1)).alias("n_edges"))


def city_year_matrix(od: DataFrame, years, value: str = "value") -> DataFrame:
    """A8 + P11: outflow per (src, year) pivoted wide, missing cells 0.

    Pivot values are passed explicitly, so Spark does not run a distinct job.
    """
    years = list(years)
    return (od.groupBy("src")
            .pivot("year", years).agg(F.sum(value))
            .fillna(0.0)
            .select("src", *[F.col(str(y)).alias(f"y{y}") for y in years]))


def all_nodes(od: DataFrame) -> DataFrame:
    """Every entity that appears as an origin or a destination."""
    return (od.select(F.col("src").alias("city"))
            .union(od.select(F.col("dst").alias("city"))).distinct())


def combined_dataset(od: DataFrame, panel: DataFrame, dim: DataFrame, year: int,
                     key: str = "nation") -> DataFrame:
    """J7 (with J1): network features for a year ⟕ the panel's characteristics that year.

    Joined on the real entity key (the reference's key mismatch is not copied).
    """
    nf = network_features(od, dim, year, dim_key=key)
    chars = (panel.where(F.col("year") == year).drop("year")
             .withColumnRenamed(key, "city"))
    return nf.join(chars, "city", "left")


