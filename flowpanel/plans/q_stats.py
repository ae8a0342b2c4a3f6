"""Statistics queries (A2–A7, A13–A22, R16) on the part-feature and panel views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..sources import testviews as tv
from .registry import R, query, rounded

COLS = tv.PARTFEAT_COLS
KENDALL_COLS = ["p_size", "p_retailprice", "qty", "revenue"]
PANEL_COLS = ["revenue", "qty", "avg_disc"]
YEAR = 1998


def _long_sql(src: str, cols, ids=()) -> str:
    sel = ", ".join(list(ids) + [f"CAST({c} AS DOUBLE) AS {c}" for c in cols])
    return (f"long AS (UNPIVOT (SELECT {sel} FROM {src}) ON {', '.join(cols)} "
            f"INTO NAME variable VALUE value)")


DESCRIBE_SQL = tv.with_views("""
SELECT variable, COUNT(value) AS count, ROUND(AVG(value), 4) AS mean,
       ROUND(STDDEV_SAMP(value), 4) AS std, ROUND(MIN(value), 4) AS min,
       ROUND(quantile_cont(value, 0.25), 6) AS p25, ROUND(quantile_cont(value, 0.5), 6) AS p50,
       ROUND(quantile_cont(value, 0.75), 6) AS p75, ROUND(MAX(value), 4) AS max,
       ROUND(STDDEV_SAMP(value) / NULLIF(AVG(value), 0), 4) AS cv
FROM long GROUP BY variable""", tv.PARTFEAT_SQL, _long_sql("partfeat", COLS))


@query("describe_table", DESCRIBE_SQL)
def q_describe(spark, sf):
    return rounded(stats.describe(tv.partfeat(spark, sf), COLS), fine=("p25", "p50", "p75"))


MISSING_SQL = tv.with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS variable, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count, "
    f"ROUND(AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4) AS missing_ratio FROM partfeat_null"
    for c in COLS), tv.PARTFEAT_NULL_SQL)


@query("missing_ratio", MISSING_SQL)
def q_missing(spark, sf):
    return rounded(stats.missing_ratio(tv.partfeat_null(spark, sf), COLS))


SKEW_SQL = tv.with_views("""
SELECT variable, (ROUND(skewness(value), 4) + 0.0) AS skew, (ROUND(kurtosis(value), 4) + 0.0) AS kurtosis
FROM long GROUP BY variable""", tv.PARTFEAT_SQL, _long_sql("partfeat", COLS))


@query("skew_kurt", SKEW_SQL)
def q_skew(spark, sf):
    return rounded(stats.skew_kurt(tv.partfeat(spark, sf), COLS))


def _group_stats_sql():
    stat_sql = {
        "mean": "AVG({c})", "std": "STDDEV_SAMP({c})", "min": "MIN({c})", "max": "MAX({c})",
        "median": "quantile_cont({c}, 0.5)", "skew": "skewness({c})", "kurtosis": "kurtosis({c})"}
    sel = ", ".join(f"ROUND({e.format(c=c)}, {6 if s == 'median' else 4}) + 0.0 AS {c}_{s}"
                    for c in PANEL_COLS for s, e in stat_sql.items())
    base = ", ".join(f"ROUND(p.{c}, 4) AS {c}" if c in ("revenue", "qty", "avg_disc") else f"p.{c}"
                     for c in ["nation", "year", "revenue", "qty", "avg_disc", "n_lines", "n_cust"])
    cols = ", ".join(f"g.{c}_{s}" for c in PANEL_COLS for s in stat_sql)
    return tv.with_views(f"""
, g AS (SELECT nation, {sel} FROM panel GROUP BY nation)
SELECT {base}, {cols} FROM panel p LEFT JOIN g ON p.nation = g.nation""", tv.PANEL_SQL)


@query("group_stats_back", _group_stats_sql())
def q_group_stats(spark, sf):
    return rounded(stats.group_stats_back(tv.panel(spark, sf), PANEL_COLS, "nation"),
                   fine=tuple(f"{c}_median" for c in PANEL_COLS))


def _corr_sql(src: str, expr) -> str:
    parts = []
    for a in COLS:
        for b in COLS:
            if a == b:
                parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, 1.0 AS corr")
            else:
                parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, "
                             f"{R(f'corr({expr(a)}, {expr(b)})')} AS corr FROM {src}")
    return " UNION ALL ".join(parts)


CORR_SQL = tv.with_views(_corr_sql("partfeat", lambda c: c), tv.PARTFEAT_SQL)


@query("corr_pearson", CORR_SQL)
def q_corr(spark, sf):
    return rounded(stats.corr_matrix(tv.partfeat(spark, sf), COLS, "pearson"))


_RANKS = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN RANK() OVER (ORDER BY {c}) + "
    f"(COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}" for c in COLS)
SPEARMAN_SQL = tv.with_views(_corr_sql("r", lambda c: c),
                             tv.PARTFEAT_SQL, f"r AS (SELECT {_RANKS} FROM partfeat)")


@query("corr_spearman", SPEARMAN_SQL)
def q_spearman(spark, sf):
    return rounded(stats.corr_matrix(tv.partfeat(spark, sf), COLS, "spearman", id_col="p_partkey"))


def _kendall_sql():
    parts = []
    for i, a in enumerate(KENDALL_COLS):
        for b in KENDALL_COLS[i + 1:]:
            parts.append(
                f"SELECT '{a}' AS var1, '{b}' AS var2, ROUND(SUM(sign(s.{a} - t.{a}) * sign(s.{b} - t.{b})) / "
                f"sqrt(CAST(COUNT(*) FILTER (WHERE s.{a} <> t.{a}) AS DOUBLE) * "
                f"COUNT(*) FILTER (WHERE s.{b} <> t.{b})), 4) AS tau "
                f"FROM partfeat s JOIN partfeat t ON s.p_partkey < t.p_partkey "
                f"WHERE s.{a} IS NOT NULL AND t.{a} IS NOT NULL AND s.{b} IS NOT NULL AND t.{b} IS NOT NULL")
    return tv.with_views(" UNION ALL ".join(parts), tv.PARTFEAT_SQL)


@query("corr_kendall", _kendall_sql())
def q_kendall(spark, sf):
    return rounded(stats.kendall_tau(tv.partfeat(spark, sf), KENDALL_COLS))


GINI_SQL = tv.with_views("""
, s AS (SELECT variable, value, MIN(value) OVER (PARTITION BY variable) AS mn,
               ROW_NUMBER() OVER (PARTITION BY variable ORDER BY value) AS i,
               COUNT(*) OVER (PARTITION BY variable) AS n,
               AVG(value + 1e-10) OVER (PARTITION BY variable) AS mu
        FROM long WHERE value IS NOT NULL)
, x AS (SELECT *, value + CASE WHEN mn < 0 THEN -mn ELSE 0 END + 1e-10 AS xs,
               (value + 1e-10) / mu AS r FROM s)
SELECT variable, ROUND(SUM((2 * i - n - 1) * xs) / (MAX(n) * SUM(xs)), 4) AS gini,
       ROUND(AVG(r * ln(r + 1e-10)), 4) AS theil
FROM x GROUP BY variable""", tv.PARTFEAT_SQL, _long_sql("partfeat", COLS))


@query("gini_theil", GINI_SQL)
def q_gini(spark, sf):
    return rounded(stats.gini_theil(tv.partfeat(spark, sf), COLS))


LORENZ_SQL = tv.with_views("""
, d AS (SELECT revenue AS value, COUNT(*) AS cnt FROM partfeat WHERE revenue IS NOT NULL GROUP BY 1)
SELECT value,
       ROUND(SUM(cnt) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) / SUM(cnt) OVER (), 4) AS pop_share,
       ROUND(SUM(value * cnt) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) / SUM(value * cnt) OVER (), 4)
         AS value_share
FROM d""", tv.PARTFEAT_SQL)


@query("lorenz", LORENZ_SQL)
def q_lorenz(spark, sf):
    return rounded(stats.lorenz(tv.partfeat(spark, sf), "revenue"))


BOX_SQL = tv.with_views("""
, q AS (SELECT p_size, quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.5) AS median,
               quantile_cont(revenue, 0.75) AS q3 FROM partfeat GROUP BY 1)
, j AS (SELECT p.p_size, p.revenue AS value, q.q1, q.median, q.q3,
               p.revenue >= q.q1 - 1.5 * (q.q3 - q.q1) AND p.revenue <= q.q3 + 1.5 * (q.q3 - q.q1) AS inside
        FROM partfeat p JOIN q ON p.p_size = q.p_size)
SELECT p_size, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
       ROUND(MIN(value) FILTER (WHERE inside), 4) AS whisker_low,
       ROUND(MAX(value) FILTER (WHERE inside), 4) AS whisker_high,
       COUNT(*) FILTER (WHERE NOT inside) AS n_outliers
FROM j GROUP BY p_size, q1, median, q3""", tv.PARTFEAT_SQL)


@query("box_histogram", BOX_SQL)
def q_box(spark, sf):
    return rounded(stats.box_summary(tv.partfeat(spark, sf), "revenue", "p_size"),
                   fine=("q1", "median", "q3"))


HIST_SQL = tv.with_views("""
, r AS (SELECT MIN(p_retailprice) AS lo, MAX(p_retailprice) AS hi FROM partfeat)
, b AS (SELECT CAST(COALESCE(LEAST(FLOOR((p_retailprice - lo) / NULLIF((hi - lo) / 15, 0)), 14), 0) AS INTEGER) AS bin,
               lo, hi FROM partfeat, r WHERE p_retailprice IS NOT NULL)
SELECT bin, ROUND(MIN(lo) + bin * (MIN(hi) - MIN(lo)) / 15, 4) AS bin_start, COUNT(*) AS count
FROM b GROUP BY bin""", tv.PARTFEAT_SQL)


@query("histogram", HIST_SQL)
def q_hist(spark, sf):
    return rounded(stats.histogram(tv.partfeat(spark, sf), "p_retailprice", 15))


SPATIAL_DIST_SQL = tv.with_views(f"""
SELECT d.nation, d.name, ROUND(m.mean_value, 4) AS mean_value
FROM dim d LEFT JOIN (SELECT nation, AVG(revenue) AS mean_value FROM panel WHERE year = {YEAR}
                      GROUP BY 1) m ON d.nation = m.nation""", tv.PANEL_SQL, tv.DIM_SQL)


@query("spatial_distribution", SPATIAL_DIST_SQL)
def q_spatial_dist(spark, sf):
    return rounded(stats.spatial_distribution(tv.panel(spark, sf), tv.dim(spark, sf), "revenue",
                                              "nation", YEAR))


MOMENTS_FLAG_SQL = tv.with_views("""
, m AS (SELECT variable, AVG(value) AS mu FROM long GROUP BY 1)
, c AS (SELECT l.variable, AVG(POWER(value - mu, 2)) AS m2, AVG(POWER(value - mu, 3)) AS m3,
               AVG(POWER(value - mu, 4)) AS m4
        FROM long l JOIN m ON l.variable = m.variable GROUP BY 1)
SELECT variable, ROUND(m3 / POWER(m2, 1.5), 4) AS skewness, ROUND(m4 / (m2 * m2) - 3, 4) AS kurtosis,
       abs(m3 / POWER(m2, 1.5)) < 2 AND abs(m4 / (m2 * m2) - 3) < 7 AS shape_ok
FROM c""", tv.PARTFEAT_SQL, _long_sql("partfeat", COLS))


@query("moments_flag", MOMENTS_FLAG_SQL)
def q_moments_flag(spark, sf):
    return rounded(stats.moments_flag(tv.partfeat(spark, sf), COLS))


# --- rows-only: normality and transforms ---------------------------------------

@query("normality")
def q_normality(spark, sf):
    return stats.normality(tv.partfeat(spark, sf), COLS)


@query("boxcox")
def q_boxcox(spark, sf):
    from ..operators.prep import boxcox
    cols = ["p_retailprice", "qty", "revenue"]
    return boxcox(tv.partfeat(spark, sf).select("p_partkey", *cols), cols)


@query("auto_transform")
def q_auto_transform(spark, sf):
    from ..operators.prep import auto_transform
    return auto_transform(tv.partfeat(spark, sf), COLS)
