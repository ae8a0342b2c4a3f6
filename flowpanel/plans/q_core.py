"""Relational-core queries: sources, reshape, joins, flows (S*, P*, J*, A1, A8–A12, U*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows
from ..sources import loaders
from ..sources import testviews as tv
from .registry import query, rounded

YEARS = list(range(1995, 2002))
YEAR = 1998

# ---------------------------------------------------------------------------

CITY_FLOWS_SQL = tv.with_views("""
, ep AS (SELECT src AS city, year, value AS o, 0.0 AS i FROM od
         UNION ALL SELECT dst AS city, year, 0.0 AS o, value AS i FROM od)
, agg AS (SELECT city, year, SUM(o) AS outflow, SUM(i) AS inflow FROM ep GROUP BY 1, 2)
SELECT city, year, ROUND(outflow, 4) AS outflow, ROUND(inflow, 4) AS inflow,
       ROUND(outflow - inflow, 4) AS net_flow, ROUND(outflow + inflow, 4) AS gross_flow,
       CAST(RANK() OVER (PARTITION BY year ORDER BY outflow + inflow DESC, city) AS INTEGER) AS gross_rank
FROM agg""", tv.OD_SQL)


@query("city_flows", CITY_FLOWS_SQL)
def q_city_flows(spark, sf):
    return rounded(flows.city_flows(tv.od(spark, sf)))


NETWORK_FEATURES_SQL = tv.with_views(f"""
, y AS (SELECT * FROM od WHERE year = {YEAR})
, o AS (SELECT src AS city, SUM(value) AS s, COUNT(*) AS d FROM y GROUP BY 1)
, i AS (SELECT dst AS city, SUM(value) AS s, COUNT(*) AS d FROM y GROUP BY 1)
, j AS (SELECT dim.nation AS city, dim.name, COALESCE(o.s, 0.0) AS os, COALESCE(i.s, 0.0) AS ins,
               COALESCE(o.d, 0) AS od_, COALESCE(i.d, 0) AS id_
        FROM dim LEFT JOIN o ON dim.nation = o.city LEFT JOIN i ON dim.nation = i.city)
SELECT city, name, ROUND(os, 4) AS outflow_strength, ROUND(ins, 4) AS inflow_strength,
       ROUND(os + ins, 4) AS total_strength, ROUND(os - ins, 4) AS net_flow,
       CAST(od_ AS BIGINT) AS out_degree, CAST(id_ AS BIGINT) AS in_degree,
       ROUND(CASE WHEN os + ins > 0 THEN abs(os - ins) / (os + ins) ELSE 0.0 END, 4) AS flow_balance,
       CAST(od_ + id_ AS BIGINT) AS total_degree
FROM j""", tv.OD_SQL, tv.DIM_SQL)


@query("network_features", NETWORK_FEATURES_SQL)
def q_network_features(spark, sf):
    return rounded(flows.network_features(tv.od(spark, sf), tv.dim(spark, sf), YEAR))


OD_POSITION_SQL = tv.with_views("""
, o AS (SELECT src AS city, COUNT(*) AS d, SUM(value) AS s FROM od GROUP BY 1)
, i AS (SELECT dst AS city, COUNT(*) AS d, SUM(value) AS s FROM od GROUP BY 1)
, nodes AS (SELECT city FROM o UNION SELECT city FROM i)
, t AS (SELECT n.city, COUNT(*) AS touch FROM nodes n JOIN od ON od.src = n.city OR od.dst = n.city GROUP BY 1)
SELECT nodes.city, CAST(o.d AS BIGINT) AS out_degree, CAST(i.d AS BIGINT) AS in_degree,
       CAST(o.d + i.d AS BIGINT) AS total_degree,
       ROUND(o.s, 4) AS out_strength, ROUND(i.s, 4) AS in_strength,
       ROUND(o.s + i.s, 4) AS total_strength, ROUND(o.s - i.s, 4) AS net_flow,
       ROUND(t.touch / (SELECT COUNT(*) FROM od), 4) AS betweenness_centrality
FROM nodes LEFT JOIN o ON nodes.city = o.city LEFT JOIN i ON nodes.city = i.city
LEFT JOIN t ON nodes.city = t.city""", tv.OD_SQL)


@query("od_position_features", OD_POSITION_SQL)
def q_od_position(spark, sf):
    return rounded(flows.od_position_features(tv.od(spark, sf)))


YEARLY_TOTAL_SQL = tv.with_views("""
SELECT year, ROUND(SUM(value), 4) AS total,
       ROUND(COALESCE(SUM(CASE WHEN src = dst THEN value END), 0.0), 4) AS diagonal,
       COUNT(*) AS n_edges
FROM od GROUP BY year""", tv.OD_SQL)


@query("yearly_total", YEARLY_TOTAL_SQL)
def q_yearly_total(spark, sf):
    return rounded(flows.yearly_total(tv.od(spark, sf)))


PIVOT_SQL = tv.with_views(
    "SELECT src, " + ", ".join(
        f"ROUND(COALESCE(SUM(CASE WHEN year = {y} THEN value END), 0.0), 4) AS y{y}" for y in YEARS)
    + " FROM od GROUP BY src", tv.OD_SQL)


@query("pivot_city_year", PIVOT_SQL)
def q_pivot(spark, sf):
    return rounded(flows.city_year_matrix(tv.od(spark, sf), YEARS))


ALL_NODES_SQL = tv.with_views("SELECT src AS city FROM od UNION SELECT dst AS city FROM od", tv.OD_SQL)


@query("all_nodes", ALL_NODES_SQL)
def q_all_nodes(spark, sf):
    return flows.all_nodes(tv.od(spark, sf))


COMBINED_SQL = tv.with_views(f"""
, y AS (SELECT * FROM od WHERE year = {YEAR})
, o AS (SELECT src AS city, SUM(value) AS s, COUNT(*) AS d FROM y GROUP BY 1)
, i AS (SELECT dst AS city, SUM(value) AS s, COUNT(*) AS d FROM y GROUP BY 1)
, j AS (SELECT dim.nation AS city, dim.name, COALESCE(o.s, 0.0) AS os, COALESCE(i.s, 0.0) AS ins,
               COALESCE(o.d, 0) AS od_, COALESCE(i.d, 0) AS id_
        FROM dim LEFT JOIN o ON dim.nation = o.city LEFT JOIN i ON dim.nation = i.city)
SELECT j.city, j.name, ROUND(os, 4) AS outflow_strength, ROUND(ins, 4) AS inflow_strength,
       ROUND(os + ins, 4) AS total_strength, ROUND(os - ins, 4) AS net_flow,
       CAST(od_ AS BIGINT) AS out_degree, CAST(id_ AS BIGINT) AS in_degree,
       ROUND(CASE WHEN os + ins > 0 THEN abs(os - ins) / (os + ins) ELSE 0.0 END, 4) AS flow_balance,
       CAST(od_ + id_ AS BIGINT) AS total_degree,
       ROUND(p.revenue, 4) AS revenue, ROUND(p.qty, 4) AS qty, ROUND(p.avg_disc, 4) AS avg_disc,
       p.n_lines, p.n_cust
FROM j LEFT JOIN panel p ON j.city = p.nation AND p.year = {YEAR}""", tv.OD_SQL, tv.DIM_SQL, tv.PANEL_SQL)


@query("combined_dataset", COMBINED_SQL)
def q_combined(spark, sf):
    return rounded(flows.combined_dataset(tv.od(spark, sf), tv.panel(spark, sf), tv.dim(spark, sf), YEAR))


LOAD_OD_SQL = tv.with_views("""
SELECT od.src, od.dst, od.year, ROUND(od.value, 4) AS value, od.n,
       a.name AS src_name, b.name AS dst_name, 'flow' AS kind
FROM od LEFT JOIN dim a ON od.src = a.nation LEFT JOIN dim b ON od.dst = b.nation
WHERE od.value IS NOT NULL""", tv.OD_SQL, tv.DIM_SQL)


@query("load_od", LOAD_OD_SQL)
def q_load_od(spark, sf):
    return rounded(loaders.load_od(tv.od(spark, sf), tv.dim(spark, sf), key="nation", name="name"))


LOAD_PANEL_SQL = tv.with_views("""
SELECT p.nation, d.name AS nation_name, p.year, ROUND(p.revenue, 4) AS revenue, ROUND(p.qty, 4) AS qty,
       ROUND(p.avg_disc, 4) AS avg_disc_pct, p.n_lines, p.n_cust
FROM panel p LEFT JOIN dim d ON p.nation = d.nation""", tv.PANEL_SQL, tv.DIM_SQL)


@query("load_panel", LOAD_PANEL_SQL)
def q_load_panel(spark, sf):
    raw = tv.panel(spark, sf).withColumnRenamed("avg_disc", "avg disc %")
    return rounded(loaders.load_panel(raw, tv.dim(spark, sf), key="nation", name="name"))


UNPIVOT_SQL = tv.with_views("""
SELECT src, year, dst, ROUND(value, 4) AS value FROM od""", tv.OD_SQL)


@query("unpivot_od", UNPIVOT_SQL)
def q_unpivot(spark, sf):
    od = tv.od(spark, sf)
    keys = [r[0] for r in tv.dim(spark, sf).select("nation").orderBy("nation").collect()]
    wide = loaders.od_wide(od, keys)
    return rounded(loaders.unpivot_od(wide, ["src", "year"], [str(k) for k in keys]))


UNION_SQL = tv.with_views("""
SELECT src AS city, year, ROUND(value, 4) AS out_value, NULL::DOUBLE AS in_value, 'out' AS side FROM od
UNION ALL
SELECT dst AS city, year, NULL::DOUBLE AS out_value, ROUND(value, 4) AS in_value, 'in' AS side FROM od""",
                          tv.OD_SQL)


@query("union_missing_cols", UNION_SQL)
def q_union(spark, sf):
    od = tv.od(spark, sf)
    a = od.select(F.col("src").alias("city"), "year", F.col("value").alias("out_value"))
    b = od.select(F.col("dst").alias("city"), "year", F.col("value").alias("in_value"))
    u = loaders.union_by_name([a.withColumns({"side": F.lit("out")}),
                               b.withColumns({"side": F.lit("in")})])
    return rounded(u)


PROFILE_SQL = """
SELECT CAST(year(l_shipdate) AS INTEGER) AS year, COUNT(*) AS n_rows,
       COUNT(DISTINCT l_orderkey) AS n_orders, COUNT(DISTINCT l_suppkey) AS n_suppliers,
       CAST(MIN(l_shipdate) AS DATE) AS first_day, CAST(MAX(l_shipdate) AS DATE) AS last_day
FROM lineitem GROUP BY 1"""


@query("profile", PROFILE_SQL)
def q_profile(spark, sf):
    return loaders.profile_by(tv.table(spark, sf, "lineitem"), "l_shipdate",
                              ["l_orderkey", "l_suppkey"], ["n_orders", "n_suppliers"])
