"""Graph queries (G1–G9, G11–G13, P9, T3) on the nation flow graph.

Iterative measures run a fixed number of rounds here (tol = 0) so that the
oracle can unroll the same rounds in SQL (ITER oracle).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators.ranking import top_nodes
from ..sources import testviews as tv
from .registry import R, query, rounded

THRESHOLD = 500000.0
PR_ITERS = 30
EV_ITERS = 30

EDGES_SQL = "e AS (SELECT src, dst, SUM(value) AS w FROM od GROUP BY 1, 2)"
V_SQL = "v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"


def _edges(spark, sf, threshold=None, directed=True):
    return graph.build(tv.od(spark, sf), directed=directed, threshold=threshold)


GRAPH_BASIC_SQL = tv.with_views(f"""
SELECT (SELECT COUNT(*) FROM v) AS n_nodes, (SELECT COUNT(*) FROM e) AS n_edges,
       {R('(SELECT COUNT(*) FROM e) / ((SELECT COUNT(*) FROM v) * ((SELECT COUNT(*) FROM v) - 1.0))')} AS density
""", tv.OD_SQL, EDGES_SQL, V_SQL)


@query("graph_basic", GRAPH_BASIC_SQL)
def q_graph_basic(spark, sf):
    return rounded(graph.basic(_edges(spark, sf)))


THRESHOLD_SQL = tv.with_views(f"""
SELECT src, dst, {R('SUM(value)')} AS w FROM od
WHERE NOT (value < {THRESHOLD}) OR value IS NULL GROUP BY 1, 2""", tv.OD_SQL)


@query("graph_threshold", THRESHOLD_SQL)
def q_graph_threshold(spark, sf):
    return rounded(_edges(spark, sf, THRESHOLD))


DEGREE_SQL = tv.with_views(f"""
, d AS (SELECT id, SUM(i) AS in_degree, SUM(o) AS out_degree FROM (
          SELECT src AS id, w AS o, 0.0 AS i FROM e UNION ALL SELECT dst, 0.0, w FROM e) GROUP BY id)
SELECT id, {R('in_degree')} AS in_degree, {R('out_degree')} AS out_degree,
       {R('in_degree + out_degree')} AS total_degree
FROM d ORDER BY in_degree + out_degree DESC, id LIMIT 5""", tv.OD_SQL, EDGES_SQL)


@query("degree_strength", DEGREE_SQL)
def q_degree(spark, sf):
    return rounded(top_nodes(graph.degrees(_edges(spark, sf)), "id", "total_degree", 5))


CLUSTER_SQL = tv.with_views(f"""
, u0 AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, SUM(w) AS w FROM e GROUP BY 1, 2)
, mx AS (SELECT MAX(w) AS m FROM u0)
, u AS (SELECT a, b, w / m AS w FROM u0, mx WHERE a <> b
        UNION ALL SELECT b, a, w / m FROM u0, mx WHERE a <> b)
, deg AS (SELECT a AS id, COUNT(*) AS deg FROM u GROUP BY 1)
, t AS (SELECT x.a AS id, SUM(cbrt(x.w * y.w * z.w)) AS t
        FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY 1)
, vv AS (SELECT a AS id FROM u0 UNION SELECT b FROM u0)
SELECT vv.id, {R('CASE WHEN COALESCE(deg, 0) < 2 THEN 0.0 ELSE 2 * COALESCE(t, 0.0) / (deg * (deg - 1)) END')}
       AS clustering
FROM vv LEFT JOIN deg ON vv.id = deg.id LEFT JOIN t ON vv.id = t.id""", tv.OD_SQL, EDGES_SQL)


@query("clustering_coef", CLUSTER_SQL)
def q_clustering(spark, sf):
    return rounded(graph.clustering(_edges(spark, sf)))


SMALL_WORLD_SQL = CLUSTER_SQL.replace(
    "SELECT vv.id,", ", cc AS (SELECT vv.id,").rstrip() + f""")
, nm AS (SELECT (SELECT COUNT(*) FROM vv) AS n, (SELECT COUNT(*) FROM u0) AS m)
, s AS (SELECT AVG(clustering) AS c, least(1.0, 2.0 * m / (n * (n - 1.0))) AS r FROM cc, nm GROUP BY m, n)
SELECT {R('c')} AS clustering_coefficient, {R('r')} AS clustering_random,
       {R('c / NULLIF(r, 0)')} AS small_world_ratio, c / NULLIF(r, 0) > 1 AS is_small_world FROM s"""


@query("small_world", SMALL_WORLD_SQL)
def q_small_world(spark, sf):
    return rounded(graph.small_world(_edges(spark, sf)))


def _unrolled(n_iter: int, init: str, step: str, name: str = "x") -> str:
    parts = [f"{name}0 AS MATERIALIZED ({init})"]
    for i in range(1, n_iter + 1):
        parts.append(f"{name}{i} AS MATERIALIZED ({step.format(prev=f'{name}{i - 1}')})")
    return ",\n".join(parts)


def _pagerank_sql(alpha=0.85):
    n = "(SELECT COUNT(*) FROM v)"
    init = f"SELECT id, 1.0 / {n} AS x FROM v"
    step = (f"SELECT v.id, {alpha} * COALESCE(c.c, 0.0) + {1 - alpha} / {n} + {alpha} * "
            f"(SELECT COALESCE(SUM(p.x), 0.0) FROM {{prev}} p WHERE p.id NOT IN (SELECT src FROM e)) / {n} AS x "
            f"FROM v LEFT JOIN (SELECT t.dst AS id, SUM(p.x * t.p) AS c FROM tr t JOIN {{prev}} p ON t.src = p.id "
            f"GROUP BY 1) c ON v.id = c.id")
    tr = "tr AS (SELECT e.src, e.dst, e.w / o.ow AS p FROM e JOIN (SELECT src, SUM(w) AS ow FROM e GROUP BY 1) o ON e.src = o.src)"
    return tv.with_views(f", {_unrolled(PR_ITERS, init, step)}\nSELECT id, {R('x')} AS pagerank FROM x{PR_ITERS}",
                         tv.OD_SQL, EDGES_SQL, V_SQL, tr)


@query("pagerank", _pagerank_sql())
def q_pagerank(spark, sf):
    return rounded(graph.pagerank(_edges(spark, sf), max_iter=PR_ITERS, tol=0.0))


def _eigen_sql():
    init = "SELECT id, 1.0 / (SELECT COUNT(*) FROM v) AS x FROM v"
    step = ("SELECT r.id, r.x / COALESCE(NULLIF(sqrt(SUM(r.x * r.x) OVER ()), 0), 1.0) AS x FROM ("
            "SELECT p.id, p.x + COALESCE(a.a, 0.0) AS x FROM {prev} p LEFT JOIN "
            "(SELECT e.dst AS id, SUM(q.x * e.w) AS a FROM e JOIN {prev} q ON e.src = q.id GROUP BY 1) a "
            "ON p.id = a.id) r")
    return tv.with_views(f", {_unrolled(EV_ITERS, init, step)}\nSELECT id, {R('x')} AS eigenvector FROM x{EV_ITERS}",
                         tv.OD_SQL, EDGES_SQL, V_SQL)


@query("eigenvector", _eigen_sql())
def q_eigenvector(spark, sf):
    return rounded(graph.eigenvector(_edges(spark, sf), max_iter=EV_ITERS, tol=0.0))


COMP_ROUNDS = 25


def _components_sql():
    et = "et AS (SELECT src, dst FROM od GROUP BY 1, 2)"
    vt = "vt AS (SELECT src AS id FROM et UNION SELECT dst FROM et)"
    und = "ue AS (SELECT src, dst FROM et UNION ALL SELECT dst, src FROM et)"
    init = "SELECT id, id AS label FROM vt"
    step = ("SELECT l.id, least(l.label, COALESCE(m.m, l.label)) AS label FROM {prev} l LEFT JOIN "
            "(SELECT ue.dst AS id, MIN(p.label) AS m FROM ue JOIN {prev} p ON ue.src = p.id GROUP BY 1) m "
            "ON l.id = m.id")
    return tv.with_views(f", {_unrolled(COMP_ROUNDS, init, step, 'c')}\nSELECT id, label AS component FROM c{COMP_ROUNDS}",
                         tv.OD_SQL, et, vt, und)


@query("components", _components_sql())
def q_components(spark, sf):
    return graph.components(_edges(spark, sf))


SP_ROUNDS = 25


def _closeness_sql():
    # inward distances: relax along reversed edges, self loops ignored
    re_ = "re AS (SELECT dst AS src, src AS dst, w FROM e WHERE src <> dst)"
    init = "SELECT id AS source, id AS node, 0.0 AS dist FROM v"
    step = ("SELECT source, node, MIN(dist) AS dist FROM (SELECT * FROM {prev} UNION ALL "
            "SELECT d.source, r.dst, d.dist + r.w FROM {prev} d JOIN re r ON d.node = r.src) GROUP BY 1, 2")
    n = "(SELECT COUNT(*) FROM v)"
    return tv.with_views(f""", {_unrolled(SP_ROUNDS, init, step, 'd')}
, a AS (SELECT source, SUM(dist) AS s, COUNT(*) AS r FROM d{SP_ROUNDS} WHERE source <> node GROUP BY 1)
SELECT v.id, {R(f'CASE WHEN a.s > 0 THEN (a.r / a.s) * (a.r / ({n} - 1.0)) ELSE 0.0 END')} AS closeness
FROM v LEFT JOIN a ON v.id = a.source""", tv.OD_SQL, EDGES_SQL, V_SQL, re_)


@query("closeness", _closeness_sql())
def q_closeness(spark, sf):
    return rounded(graph.closeness(_edges(spark, sf)))


def _path_sql():
    et = "et AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM od GROUP BY 1, 2)"
    ue = "ue AS (SELECT a AS src, b AS dst FROM et WHERE a <> b UNION ALL SELECT b, a FROM et WHERE a <> b)"
    vt = "vt AS (SELECT a AS id FROM et UNION SELECT b FROM et)"
    init = "SELECT id AS source, id AS node, 0.0 AS dist FROM vt"
    step = ("SELECT source, node, MIN(dist) AS dist FROM (SELECT * FROM {prev} UNION ALL "
            "SELECT d.source, u.dst, d.dist + 1 FROM {prev} d JOIN ue u ON d.node = u.src) GROUP BY 1, 2")
    n = "(SELECT COUNT(*) FROM vt)"
    return tv.with_views(f""", {_unrolled(SP_ROUNDS, init, step, 'd')}
, s AS (SELECT COUNT(*) AS pairs, AVG(dist) AS av, MAX(dist) AS mx FROM d{SP_ROUNDS} WHERE source <> node)
SELECT {R(f'CASE WHEN pairs = {n} * ({n} - 1) THEN av END')} AS avg_path_length,
       {R(f'CASE WHEN pairs = {n} * ({n} - 1) THEN mx END')} AS diameter,
       pairs = {n} * ({n} - 1) AS is_connected FROM s""", tv.OD_SQL, et, ue, vt)


@query("path_stats", _path_sql())
def q_path_stats(spark, sf):
    e = graph.build(tv.od(spark, sf), directed=False)
    return rounded(graph.path_stats(e))


@query("path_estimates")
def q_path_estimates(spark, sf):
    """G3 for large graphs: path lengths from sketches, over customers, suppliers and the nations' flows."""
    return rounded(graph.path_estimates(tv.trade_edges(spark, sf)))


def _summary_sql():
    return f"""
SELECT 'basic' AS metric, b.*, p.avg_path_length FROM ({GRAPH_BASIC_SQL}) b, ({_path_sql()}) p
UNION ALL BY NAME SELECT 'small_world' AS metric, s.* FROM ({SMALL_WORLD_SQL}) s"""


@query("network_summary", _summary_sql())
def q_network_summary(spark, sf):
    """Basic and small-world rows in one table."""
    return rounded(graph.summary(_edges(spark, sf)))


BC_PIVOTS = 20


def _betweenness_sql():
    """Shortest paths from the pivots, enumerated; each gives its inner nodes a share."""
    le = "le AS (SELECT src, dst, w FROM e WHERE src <> dst AND w > 0)"
    piv = f"piv AS (SELECT id FROM v ORDER BY md5('42:' || id), id LIMIT {BC_PIVOTS})"
    init = "SELECT id AS source, id AS node, 0.0 AS dist FROM piv"
    step = ("SELECT source, node, MIN(dist) AS dist FROM (SELECT * FROM {prev} UNION ALL "
            "SELECT d.source, r.dst, d.dist + r.w FROM {prev} d JOIN le r ON d.node = r.src) GROUP BY 1, 2")
    n = "(SELECT COUNT(*) FROM v)"
    return "WITH RECURSIVE " + tv.with_views(f""", {_unrolled(SP_ROUNDS, init, step, 'd')}
, dag AS MATERIALIZED (SELECT a.source, le.src, le.dst FROM d{SP_ROUNDS} a JOIN le ON a.node = le.src
          JOIN d{SP_ROUNDS} b ON b.source = a.source AND b.node = le.dst WHERE a.dist + le.w = b.dist)
, paths AS (SELECT source, dst AS node, [dst] AS way FROM dag WHERE src = source
            UNION ALL SELECT p.source, g.dst, list_append(p.way, g.dst)
            FROM paths p JOIN dag g ON g.source = p.source AND g.src = p.node)
, sigma AS (SELECT source, node, COUNT(*) AS c FROM paths GROUP BY 1, 2)
, inner_ AS (SELECT p.source, p.node, UNNEST(list_slice(way, 1, len(way) - 1)) AS id FROM paths p)
, bc AS (SELECT i.id, SUM(1.0 / c) AS b FROM inner_ i JOIN sigma s ON s.source = i.source AND s.node = i.node GROUP BY 1)
SELECT v.id, {R(f'COALESCE(b, 0.0) / (({n} - 1.0) * ({n} - 2.0)) * {n} / (SELECT COUNT(*) FROM piv)', 6)} AS betweenness
FROM v LEFT JOIN bc ON v.id = bc.id""", tv.OD_SQL, EDGES_SQL, V_SQL, le, piv)[len("WITH "):]


@query("betweenness", _betweenness_sql())
def q_betweenness(spark, sf):
    return rounded(graph.betweenness(_edges(spark, sf), pivots=BC_PIVOTS), 6)


@query("louvain")
def q_louvain(spark, sf):
    e = _edges(spark, sf)
    lab = graph.louvain(e)
    q = graph.modularity(e, lab)
    n_c = lab.select("community").distinct().count()
    return lab.select("id", "community", F.lit(q).cast("double").alias("modularity"),
                      F.lit(n_c).cast("long").alias("n_communities"))
