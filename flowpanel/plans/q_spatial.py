"""Spatial queries (X1–X5, X7, X9, X13, J5, J6) on the embedding point view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import lisa_label
from ..operators import spatial
from ..sources import testviews as tv
from .registry import R, query, rounded

K = 4
BAND = 0.05
MORAN_COLS = ["v", "x", "y"]

PAIRS_SQL = ("pr AS (SELECT a.vec_id AS i, b.vec_id AS j, "
             "sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM geo a JOIN geo b ON a.vec_id <> b.vec_id)")
KNN_W_SQL = (f"w AS (SELECT i, j, 1.0 / {K} AS w FROM (SELECT i, j, "
             f"ROW_NUMBER() OVER (PARTITION BY i ORDER BY d, j) AS rn FROM pr) WHERE rn <= {K})")


def _w(spark, sf):
    return spatial.knn_weights(tv.geo(spark, sf), "vec_id", ["x", "y"], K)


@query("knn_weights", tv.with_views(f"SELECT i, j, {R('w')} AS w FROM w", tv.GEO_SQL, PAIRS_SQL, KNN_W_SQL))
def q_knn_weights(spark, sf):
    return rounded(_w(spark, sf))


BAND_SQL = tv.with_views(f"""
, b AS (SELECT i, j, pow(d, -1.0) AS w0 FROM pr WHERE d > 0 AND d <= {BAND})
SELECT i, j, {R('w0 / SUM(w0) OVER (PARTITION BY i)')} AS w FROM b""", tv.GEO_SQL, PAIRS_SQL)


@query("band_weights", BAND_SQL)
def q_band_weights(spark, sf):
    return rounded(spatial.band_weights(tv.geo(spark, sf), "vec_id", ["x", "y"], BAND))


LAG_SQL = tv.with_views(f"""
SELECT w.i, {R('SUM(w.w * g.v)')} AS lag FROM w JOIN geo g ON w.j = g.vec_id GROUP BY w.i""",
                        tv.GEO_SQL, PAIRS_SQL, KNN_W_SQL)


@query("spatial_lag", LAG_SQL)
def q_spatial_lag(spark, sf):
    return rounded(spatial.spatial_lag(_w(spark, sf), tv.geo(spark, sf), "vec_id", "v"))


def _erfc_sql(x: str) -> str:
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
         0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    z = f"abs({x})"
    t = f"(1.0 / (1.0 + 0.5 * {z}))"
    poly = f"{c[-1]}"
    for coef in reversed(c[1:-1]):
        poly = f"({coef} + {t} * {poly})"
    ans = f"({t} * exp(-{z} * {z} + {c[0]} + {t} * {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def _p(z: str) -> str:
    return _erfc_sql(f"(abs({z}) / sqrt(2.0))")


MORAN_CORE = f"""
, long AS (UNPIVOT (SELECT vec_id, x, y, v FROM geo) ON {', '.join(MORAN_COLS)} INTO NAME variable VALUE value)
, z AS (SELECT variable, vec_id AS id, value - AVG(value) OVER (PARTITION BY variable) AS z,
               COUNT(*) OVER (PARTITION BY variable) AS n FROM long)
, cr AS (SELECT zi.variable, SUM(w.w * zi.z * zj.z) AS zwz, SUM(w.w) AS S0
         FROM w JOIN z zi ON w.i = zi.id JOIN z zj ON w.j = zj.id AND zi.variable = zj.variable GROUP BY 1)
, sym AS (SELECT i, j, SUM(w) AS s FROM (SELECT i, j, w FROM w UNION ALL SELECT j, i, w FROM w) GROUP BY 1, 2)
, s1 AS (SELECT SUM(s * s) / 2 AS S1 FROM sym)
, s2 AS (SELECT SUM(power(COALESCE(r, 0) + COALESCE(c, 0), 2)) AS S2
         FROM (SELECT i AS id, SUM(w) AS r FROM w GROUP BY 1) a FULL JOIN (SELECT j AS id, SUM(w) AS c FROM w GROUP BY 1) b
         USING (id))
, zz AS (SELECT variable, SUM(z * z) AS m2s, SUM(z * z * z * z) AS m4s, MAX(n) AS n FROM z GROUP BY 1)
, st AS (SELECT cr.variable, zz.n, CAST(zz.n AS DOUBLE) AS nd, zwz, S0, S1, S2, m2s, m4s FROM cr, s1, s2, zz
         WHERE cr.variable = zz.variable)
, m AS (SELECT variable, n, nd / S0 * zwz / m2s AS I, -1.0 / (nd - 1) AS EI,
               (nd * nd * S1 - nd * S2 + 3 * S0 * S0) / ((nd * nd - 1) * S0 * S0) - 1.0 / ((nd - 1) * (nd - 1)) AS VI_norm,
               (nd * ((nd * nd - 3 * nd + 3) * S1 - nd * S2 + 3 * S0 * S0)
                - ((m4s / nd) / power(m2s / nd, 2)) * ((nd * nd - nd) * S1 - 2 * nd * S2 + 6 * S0 * S0))
               / ((nd - 1) * (nd - 2) * (nd - 3) * S0 * S0) - 1.0 / ((nd - 1) * (nd - 1)) AS VI_rand
        FROM st)
, mz AS (SELECT *, (I - EI) / sqrt(VI_norm) AS z_norm, (I - EI) / sqrt(VI_rand) AS z_rand FROM m)"""

MORAN_SQL = tv.with_views(MORAN_CORE + f"""
SELECT variable, n, {R('I')} AS I, {R('EI')} AS EI, {R('VI_norm')} AS VI_norm, {R('VI_rand')} AS VI_rand,
       {R('z_norm')} AS z_norm, {R('z_rand')} AS z_rand, {R(_p('z_norm'))} AS p_norm, {R(_p('z_rand'))} AS p_rand
FROM mz""", tv.GEO_SQL, PAIRS_SQL, KNN_W_SQL)


def _moran(spark, sf):
    return spatial.moran_global(_w(spark, sf), tv.geo(spark, sf), "vec_id", MORAN_COLS)


@query("moran_global", MORAN_SQL)
def q_moran(spark, sf):
    return rounded(_moran(spark, sf))


MORAN_RAND_SQL = tv.with_views(MORAN_CORE + f"""
SELECT variable, {R('z_rand')} AS z_rand, {R(_p('z_rand'))} AS p_rand, z_rand > 1.96 OR z_rand < -1.96 AS significant
FROM mz""", tv.GEO_SQL, PAIRS_SQL, KNN_W_SQL)


@query("moran_rand", MORAN_RAND_SQL)
def q_moran_rand(spark, sf):
    m = _moran(spark, sf)
    return rounded(m.select("variable", "z_rand", "p_rand",
                            ((F.col("z_rand") > 1.96) | (F.col("z_rand") < -1.96)).alias("significant")))


LOCAL_SQL = tv.with_views("""
, st AS (SELECT AVG(v) AS mu, STDDEV_POP(v) AS sd, COUNT(*) AS n FROM geo)
, z AS (SELECT vec_id AS id, (v - mu) / sd AS z, n FROM geo, st)
, lg AS (SELECT w.i AS id, SUM(w.w * z.z) AS lag_z FROM w JOIN z ON w.j = z.id GROUP BY 1)
, d AS (SELECT SUM(z * z) AS den FROM z)
, j AS (SELECT z.id, z.z, COALESCE(lg.lag_z, 0.0) AS lag_z, z.n FROM z LEFT JOIN lg ON z.id = lg.id)
SELECT id AS vec_id, """ + R("z") + " AS z, " + R("lag_z") + " AS lag_z, " + R("(n - 1) * z * lag_z / den") + """ AS Is,
       CASE WHEN z > 0 AND lag_z > 0 THEN 1 WHEN z <= 0 AND lag_z > 0 THEN 2
            WHEN z <= 0 AND lag_z <= 0 THEN 3 ELSE 4 END AS q,
       CASE WHEN z > 0 AND lag_z > 0 THEN 'High-High' WHEN z <= 0 AND lag_z > 0 THEN 'Low-High'
            WHEN z <= 0 AND lag_z <= 0 THEN 'Low-Low' ELSE 'High-Low' END AS label
FROM j, d""", tv.GEO_SQL, PAIRS_SQL, KNN_W_SQL)


@query("moran_local", LOCAL_SQL)
def q_moran_local(spark, sf):
    loc = spatial.moran_local(_w(spark, sf), tv.geo(spark, sf), "vec_id", "v")
    # label with p = 0 (significance is the permutation operator's job)
    return rounded(loc.withColumn("label", lisa_label(F.col("q"), F.lit(0.0))))


# --- rows-only: permutation inference ------------------------------------------

@query("moran_perm")
def q_moran_perm(spark, sf):
    return spatial.moran_permutation(_w(spark, sf), tv.geo(spark, sf), "vec_id", "v", permutations=999)


@query("lisa")
def q_lisa(spark, sf):
    return spatial.local_permutation(_w(spark, sf), tv.geo(spark, sf), "vec_id", "v", permutations=999)
