"""Derived views on the TPC-H-like test tables.

The analytics operators of this library work on an origin–destination flow
table and an entity × time panel.  The test data is a star schema, so these
views derive the library's inputs from it:

* ``od(src, dst, year, value, n)``      supplier nation → customer nation flows
* ``panel(nation, year, revenue, qty, avg_disc, n_lines, n_cust)``
* ``daily(user_id, d, total, n)``       events per user and day
* ``partfeat(p_partkey, p_size, p_retailprice, qty, revenue, avg_disc, n_lines)``
* ``vec(vec_id, f1..f64, label)`` and ``geo(vec_id, x, y, v)`` from embeddings
* ``dim(nation, name)``                 the nation dimension

Each Spark view has a DuckDB SQL twin (``*_SQL``) used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _rev():
    """Line revenue in exact decimal arithmetic (money sums must not depend on
    the summation order); decimal(12,2) x decimal(4,2) stays long-backed."""
    return F.col("l_extendedprice").cast("decimal(12,2)") * (1 - _disc())


def _disc():
    return F.col("l_discount").cast("decimal(3,2)")


def order_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orderkey → customer nation (orders ⋈ customer on custkey)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return o.join(c, "o_custkey")


def od(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly nation-to-nation revenue flows.

    Plan: lineitem is reduced to (orderkey, suppkey, year) partial sums map-side,
    joined to the order→nation mapping on orderkey, re-aggregated on
    (suppkey, dst, year) so that the supplier join sees one row per supplier
    cell instead of one per line, then summed on (src, dst, year).  Every join
    is an equi-join; AQE picks broadcast or sort-merge from runtime sizes.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey",
        F.year("l_shipdate").alias("year"), _rev().alias("rev"))
    on = order_nation(spark, sf_dir).select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    per_supp = (li.join(on, "l_orderkey")
                .groupBy("l_suppkey", "dst", "year")
                .agg(F.sum("rev").alias("value"), F.count(F.lit(1)).alias("n")))
    return (per_supp.join(s, "l_suppkey")
            .groupBy("src", "dst", "year")
            .agg(F.sum("value").cast("double").alias("value"), F.sum("n").alias("n")))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation × year indicator panel."""
    li = (table(spark, sf_dir, "lineitem")
          .select("l_orderkey", F.year("l_shipdate").alias("year"),
                  _rev().alias("rev"), "l_quantity", _disc().alias("l_discount"))
          .groupBy("l_orderkey", "year")
          .agg(F.sum("rev").alias("rev"), F.sum("l_quantity").alias("qty"),
               F.sum("l_discount").alias("disc"), F.count(F.lit(1)).alias("n")))
    on = order_nation(spark, sf_dir).select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey",
        F.col("c_nationkey").alias("nation"))
    per_cust = (li.join(on, "l_orderkey")
                .groupBy("nation", "o_custkey", "year")
                .agg(F.sum("rev").alias("rev"), F.sum("qty").alias("qty"),
                     F.sum("disc").alias("disc"), F.sum("n").alias("n")))
    return (per_cust.groupBy("nation", "year")
            .agg(F.sum("rev").cast("double").alias("revenue"), F.sum("qty").alias("qty"),
                 (F.sum("disc").cast("double") / F.sum("n")).alias("avg_disc"),
                 F.sum("n").alias("n_lines"),
                 F.count(F.lit(1)).alias("n_cust")))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "events")
            .groupBy("user_id", F.to_date("ts").alias("d"))
            .agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")))


def partfeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = (table(spark, sf_dir, "lineitem")
           .groupBy(F.col("l_partkey").alias("p_partkey"))
           .agg(F.sum("l_quantity").alias("qty"), F.sum(_rev()).cast("double").alias("revenue"),
                (F.sum(_disc()).cast("double") / F.count(F.lit(1))).alias("avg_disc"),
                F.count(F.lit(1)).alias("n_lines")))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return p.join(agg, "p_partkey", "left")


PARTFEAT_COLS = ["p_size", "p_retailprice", "qty", "revenue", "avg_disc", "n_lines"]


def with_nulls(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Inject missing values (the sampled columns hold none): NULL where key % 10 = 3
    (first column), key % 10 = 7 (second), key % 10 = 5 (others).  Rows are kept."""
    out = df
    for i, c in enumerate(cols):
        r = 3 if i == 0 else (7 if i == 1 else 5)
        out = out.withColumn(c, F.when(F.col(key) % 10 != r, F.col(c)))
    return out


PARTFEAT_NULL_COLS = ["p_retailprice", "qty", "revenue"]


def partfeat_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_nulls(partfeat(spark, sf_dir), "p_partkey", PARTFEAT_NULL_COLS)


VEC_DIM = 64


def vec(spark: SparkSession, sf_dir: str, dim: int = VEC_DIM) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[
        F.element_at("embedding", i + 1).cast("double").alias(f"f{i + 1}")
        for i in range(dim)], "label")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id",
                    F.element_at("embedding", 1).cast("double").alias("x"),
                    F.element_at("embedding", 2).cast("double").alias("y"),
                    F.element_at("embedding", 3).cast("double").alias("v"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected trade graph of customers ('c' + key) and suppliers ('s' + key): an edge for each pair with an order line,
    weighted by the number of lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    e = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return e.select(F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), "w")


def dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))


# ---------------------------------------------------------------------------
# DuckDB twins of the views (used only by the oracle SQL)
# ---------------------------------------------------------------------------

OD_SQL = """od AS (
  SELECT s.s_nationkey AS src, c.c_nationkey AS dst,
         CAST(year(l.l_shipdate) AS INTEGER) AS year,
         CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(3,2)))) AS DOUBLE) AS value,
         COUNT(*) AS n
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  GROUP BY 1, 2, 3)"""

PANEL_SQL = """panel AS (
  SELECT c.c_nationkey AS nation, CAST(year(l.l_shipdate) AS INTEGER) AS year,
         CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(3,2)))) AS DOUBLE) AS revenue,
         SUM(l.l_quantity) AS qty,
         CAST(SUM(CAST(l.l_discount AS DECIMAL(3,2))) AS DOUBLE) / COUNT(*) AS avg_disc,
         COUNT(*) AS n_lines, COUNT(DISTINCT o.o_custkey) AS n_cust
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY 1, 2)"""

DAILY_SQL = """daily AS (
  SELECT user_id, CAST(ts AS DATE) AS d, SUM(value) AS total, COUNT(*) AS n
  FROM events GROUP BY 1, 2)"""

PARTFEAT_SQL = """partfeat AS (
  SELECT p.p_partkey, p.p_size, p.p_retailprice, a.qty, a.revenue, a.avg_disc, a.n_lines
  FROM part p LEFT JOIN (
    SELECT l_partkey, SUM(l_quantity) AS qty,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(3,2)))) AS DOUBLE) AS revenue,
           CAST(SUM(CAST(l_discount AS DECIMAL(3,2))) AS DOUBLE) / COUNT(*) AS avg_disc, COUNT(*) AS n_lines
    FROM lineitem GROUP BY 1) a ON p.p_partkey = a.l_partkey)"""

PARTFEAT_NULL_SQL = PARTFEAT_SQL + """,
partfeat_null AS (
  SELECT p_partkey, p_size,
         CASE WHEN p_partkey % 10 <> 3 THEN p_retailprice END AS p_retailprice,
         CASE WHEN p_partkey % 10 <> 7 THEN qty END AS qty,
         CASE WHEN p_partkey % 10 <> 5 THEN revenue END AS revenue,
         avg_disc, n_lines
  FROM partfeat)"""

VEC_SQL = "vec AS (SELECT vec_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i + 1}" for i in range(VEC_DIM)
) + ", label FROM embeddings)"

GEO_SQL = """geo AS (
  SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
         CAST(embedding[3] AS DOUBLE) AS v FROM embeddings)"""

DIM_SQL = "dim AS (SELECT n_nationkey AS nation, n_name AS name FROM nation)"


def with_views(body: str, *views: str) -> str:
    """Prefix a query body with the CTEs it needs."""
    return "WITH " + ",\n".join(views) + "\n" + body
