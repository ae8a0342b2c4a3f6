"""Window, feature and preprocessing queries (W*, T*, F*, R*, E1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import format_loading, gated_log, gated_sqrt, lisa_label, poly_terms
from ..operators import features, prep
from ..sources import loaders
from ..sources import testviews as tv
from .registry import R, query, rounded

PREP_COLS = ["p_retailprice", "qty", "revenue", "avg_disc"]
NULL_COLS = tv.PARTFEAT_NULL_COLS
DAILY_COLS = ["total", "n"]


# --- windows ---------------------------------------------------------------

def _lag_sql():
    sel = ", ".join(f"LAG({c}, {k}) OVER w AS {c}_lag{k}" if c == "n" else
                    f"{R(f'LAG({c}, {k}) OVER w')} AS {c}_lag{k}"
                    for c in DAILY_COLS for k in (1, 2, 3))
    return tv.with_views(f"""
SELECT user_id, d, {R('total')} AS total, n, {sel}
FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY d)""", tv.DAILY_SQL)


@query("lag_features", _lag_sql())
def q_lags(spark, sf):
    return rounded(features.lag_features(tv.daily(spark, sf), DAILY_COLS, "user_id", "d"))


def _rolling_sql():
    parts = []
    for c in DAILY_COLS:
        for k in (3, 5):
            fr = f"(PARTITION BY user_id ORDER BY d ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
            parts += [f"{R(f'AVG({c}) OVER {fr}')} AS {c}_rolling_mean_{k}",
                      f"{R(f'STDDEV_SAMP({c}) OVER {fr}')} AS {c}_rolling_std_{k}",
                      (f"MAX({c}) OVER {fr} AS {c}_rolling_max_{k}" if c == "n" else
                       f"{R(f'MAX({c}) OVER {fr}')} AS {c}_rolling_max_{k}")]
    return tv.with_views(f"SELECT user_id, d, {R('total')} AS total, n, {', '.join(parts)} FROM daily",
                         tv.DAILY_SQL)


@query("rolling_features", _rolling_sql())
def q_rolling(spark, sf):
    return rounded(features.rolling_features(tv.daily(spark, sf), DAILY_COLS, "user_id", "d"))


GROWTH_COLS = ["revenue", "qty"]


def _growth_sql():
    parts = []
    for c in GROWTH_COLS:
        cur = f"last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        prev = f"last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        g = f"{cur} / NULLIF({prev}, 0) - 1"
        parts += [f"{R(g)} AS {c}_growth", f"{R(g)} AS {c}_yoy"]
    base = ", ".join(["nation", "year", R("revenue") + " AS revenue", R("qty") + " AS qty",
                      R("avg_disc") + " AS avg_disc", "n_lines", "n_cust"])
    return tv.with_views(f"SELECT {base}, {', '.join(parts)} FROM panel "
                         f"WINDOW w AS (PARTITION BY nation ORDER BY year)", tv.PANEL_SQL)


@query("growth", _growth_sql())
def q_growth(spark, sf):
    return rounded(features.growth_features(tv.panel(spark, sf), GROWTH_COLS, "nation", "year"))


AVG_RANK_SQL = tv.with_views("""
SELECT nation, year, """ + R("revenue") + """ AS revenue,
       CAST(TRUNC(RANK() OVER (PARTITION BY year ORDER BY revenue DESC)
            + (COUNT(*) OVER (PARTITION BY year, revenue) - 1) / 2.0) AS INTEGER) AS rank
FROM panel""", tv.PANEL_SQL)


@query("avg_rank", AVG_RANK_SQL)
def q_avg_rank(spark, sf):
    p = tv.panel(spark, sf).select("nation", "year", "revenue")
    return rounded(features.avg_rank_desc(p, "revenue", by="year"))


CITY_RANKING_SQL = tv.with_views("""
SELECT nation, """ + R("mean_revenue") + """ AS mean_revenue,
       CAST(RANK() OVER (ORDER BY mean_revenue DESC, nation) AS INTEGER) AS rank
FROM (SELECT nation, AVG(revenue) AS mean_revenue FROM panel GROUP BY 1)
ORDER BY mean_revenue DESC, nation LIMIT 10""", tv.PANEL_SQL)


@query("city_ranking", CITY_RANKING_SQL)
def q_city_ranking(spark, sf):
    from ..operators.ranking import top_entities
    return rounded(top_entities(tv.panel(spark, sf), "nation", "revenue", 10))


# --- scalar feature builders ----------------------------------------------

POLY_COLS = ["p_size", "p_retailprice", "avg_disc"]


def _poly_sql():
    parts = []
    for name, _ in poly_terms(POLY_COLS, 2):
        terms = []
        for tok in name.split(" "):
            if "^" in tok:
                b, e = tok.split("^")
                terms += [b] * int(e)
            else:
                terms.append(tok)
        parts.append(f'{R("CAST(" + " * ".join(terms) + " AS DOUBLE)")} AS "{name}"')
    return tv.with_views(f"SELECT p_partkey, {', '.join(parts)} FROM partfeat", tv.PARTFEAT_SQL)


@query("poly_features", _poly_sql())
def q_poly(spark, sf):
    p = tv.partfeat(spark, sf).select("p_partkey", *POLY_COLS)
    out = features.polynomial(p, POLY_COLS, 2).drop(*POLY_COLS)
    return rounded(out.select("p_partkey", *[F.col(f"`{c}`").cast("double").alias(c)
                                             for c in out.columns if c != "p_partkey"]))


INTER_PAIRS = [("qty", "revenue"), ("p_size", "p_retailprice")]
RATIO_NUMS, RATIO_DENS = ["revenue", "qty"], ["n_lines", "p_size"]

INTERACTION_SQL = tv.with_views("SELECT p_partkey, " + ", ".join(
    [f"{R(f'{a} * {b}')} AS {a}_x_{b}" for a, b in INTER_PAIRS]
    + [f"{R(f'{n} / NULLIF({d}, 0)')} AS {n}_per_{d}" for n in RATIO_NUMS for d in RATIO_DENS]
    + [f"{R('abs(p_retailprice - revenue / NULLIF(qty, 0))')} AS abs_price_gap",
       f"{R('avg_disc * 100')} AS disc_pct"]) + " FROM partfeat", tv.PARTFEAT_SQL)


@query("interaction_ratio", INTERACTION_SQL)
def q_interaction(spark, sf):
    from ..functions.scalar import safe_div
    p = tv.partfeat(spark, sf)
    out = features.ratios(features.interactions(p, INTER_PAIRS), RATIO_NUMS, RATIO_DENS)
    out = out.withColumns({
        "abs_price_gap": F.abs(F.col("p_retailprice") - safe_div("revenue", "qty")),
        "disc_pct": F.col("avg_disc") * 100})
    keep = [f"{a}_x_{b}" for a, b in INTER_PAIRS] + [f"{n}_per_{d}" for n in RATIO_NUMS for d in RATIO_DENS]
    return rounded(out.select("p_partkey", *[F.col(c).cast("double").alias(c) for c in keep],
                              "abs_price_gap", "disc_pct"))


LOG_COLS = ["revenue", "qty", "avg_disc"]

LOG_SQRT_SQL = tv.with_views("""
, m AS (SELECT """ + ", ".join(f"MIN({c}) AS {c}_min" for c in LOG_COLS) + """ FROM partfeat)
SELECT p_partkey, """ + ", ".join(
    [f"{R(f'CASE WHEN {c}_min > 0 THEN ln({c}) END')} AS log_{c}" for c in LOG_COLS]
    + [f"{R(f'CASE WHEN {c}_min >= 0 THEN sqrt({c}) END')} AS sqrt_{c}" for c in LOG_COLS])
    + " FROM partfeat, m", tv.PARTFEAT_SQL)


@query("log_sqrt", LOG_SQRT_SQL)
def q_log_sqrt(spark, sf):
    p = tv.partfeat(spark, sf)
    mins = p.agg(*[F.min(c).alias(f"{c}_min") for c in LOG_COLS])
    j = prep._attach(p, mins)
    return rounded(j.select("p_partkey",
                            *[gated_log(c, F.col(f"{c}_min")).alias(f"log_{c}") for c in LOG_COLS],
                            *[gated_sqrt(c, F.col(f"{c}_min")).alias(f"sqrt_{c}") for c in LOG_COLS]))


LOG1P_SQL = """
WITH m AS (SELECT MIN(c_acctbal) AS mn, COUNT(c_acctbal) AS n FROM customer)
SELECT c_custkey, """ + R("CASE WHEN n < 10 THEN c_acctbal WHEN mn > 0 THEN ln(1 + c_acctbal) "
                          "ELSE ln(1 + (c_acctbal - mn + 1)) END") + """ AS c_acctbal
FROM customer, m"""


@query("log1p_shift", LOG1P_SQL)
def q_log1p(spark, sf):
    c = tv.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rounded(prep.log_transform(c, ["c_acctbal"]))


FORMAT_SQL = tv.with_views("""
, s AS (SELECT AVG(p_retailprice) AS m1, STDDEV_POP(p_retailprice) AS s1,
               AVG(revenue) AS m2, STDDEV_POP(revenue) AS s2 FROM partfeat)
, z AS (SELECT p_partkey, (p_retailprice - m1) / s1 AS z1, (revenue - m2) / s2 AS z2 FROM partfeat, s)
, q AS (SELECT p_partkey, z1, z2, CASE WHEN z1 > 0 AND z2 > 0 THEN 1 WHEN z1 <= 0 AND z2 > 0 THEN 2
                                      WHEN z1 <= 0 AND z2 <= 0 THEN 3 ELSE 4 END AS quadrant FROM z)
SELECT p_partkey, quadrant,
       CASE WHEN quadrant = 1 THEN 'High-High' WHEN quadrant = 2 THEN 'Low-High'
            WHEN quadrant = 3 THEN 'Low-Low' ELSE 'High-Low' END AS label,
       CASE WHEN abs(z1) >= 0.5 THEN '[' || printf('%.3f', z1) || ']' ELSE printf('%.3f', z1) END AS z_text
FROM q""", tv.PARTFEAT_SQL)


@query("format_flag", FORMAT_SQL)
def q_format(spark, sf):
    p = tv.partfeat(spark, sf)
    z, _ = prep.scale(p.select("p_partkey", "p_retailprice", "revenue"), ["p_retailprice", "revenue"])
    z1, z2 = F.col("p_retailprice"), F.col("revenue")
    q = (F.when((z1 > 0) & (z2 > 0), 1).when((z1 <= 0) & (z2 > 0), 2)
         .when((z1 <= 0) & (z2 <= 0), 3).otherwise(4))
    return z.select("p_partkey", q.alias("quadrant"),
                    lisa_label(q, F.lit(0.0)).alias("label"),
                    format_loading(z1, 3, 0.5).alias("z_text"))


# --- preprocessing -----------------------------------------------------------

def _impute_sql(agg: str, places: int):
    sel = ", ".join(f"{R(f'COALESCE(CAST({c} AS DOUBLE), f.{c}_fill)', places)} AS {c}" for c in NULL_COLS)
    fills = ", ".join(f"{agg.format(c=c)} AS {c}_fill" for c in NULL_COLS)
    return tv.with_views(f"""
, f AS (SELECT {fills} FROM partfeat_null)
SELECT p_partkey, {sel} FROM partfeat_null, f""", tv.PARTFEAT_NULL_SQL)


@query("impute_mean", _impute_sql("AVG({c})", 4))
def q_impute_mean(spark, sf):
    p = tv.partfeat_null(spark, sf).select("p_partkey", *NULL_COLS)
    return rounded(prep.impute(p, NULL_COLS, "mean"))


@query("impute_median", _impute_sql("quantile_cont({c}, 0.5)", 6))
def q_impute_median(spark, sf):
    p = tv.partfeat_null(spark, sf).select("p_partkey", *NULL_COLS)
    return rounded(prep.impute(p, NULL_COLS, "median"), fine=tuple(NULL_COLS))


def _outlier_sql(method: str):
    long = ("long AS (UNPIVOT (SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in PREP_COLS)
            + f" FROM partfeat) ON {', '.join(PREP_COLS)} INTO NAME variable VALUE value)")
    if method == "iqr":
        body = """
, q AS (SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY 1)
, f AS (SELECT l.variable, (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS flag
        FROM long l JOIN q ON l.variable = q.variable)"""
    elif method == "zscore":
        body = """
, q AS (SELECT variable, AVG(value) AS mu, STDDEV_POP(value) AS sd FROM long GROUP BY 1)
, f AS (SELECT l.variable, abs((value - mu) / sd) > 3 AS flag FROM long l JOIN q ON l.variable = q.variable)"""
    else:
        body = """
, q AS (SELECT variable, quantile_cont(value, 0.5) AS med FROM long GROUP BY 1)
, a AS (SELECT l.variable, quantile_cont(abs(value - med), 0.5) AS mad
        FROM long l JOIN q ON l.variable = q.variable GROUP BY 1)
, f AS (SELECT l.variable, abs(CASE WHEN mad <> 0 THEN 0.6745 * (value - med) / mad ELSE 0 END) > 3.5 AS flag
        FROM long l JOIN q ON l.variable = q.variable JOIN a ON l.variable = a.variable)"""
    return tv.with_views(body + f"""
SELECT variable, COUNT(*) FILTER (WHERE flag) AS outliers_count,
       {R('COUNT(*) FILTER (WHERE flag) * 100.0 / COUNT(*)')} AS outliers_pct
FROM f GROUP BY variable""", tv.PARTFEAT_SQL, long)


@query("outliers_iqr", _outlier_sql("iqr"))
def q_out_iqr(spark, sf):
    return rounded(prep.outlier_report(tv.partfeat(spark, sf), PREP_COLS, "iqr", 1.5))


@query("outliers_z", _outlier_sql("zscore"))
def q_out_z(spark, sf):
    return rounded(prep.outlier_report(tv.partfeat(spark, sf), PREP_COLS, "zscore", 3.0))


@query("outliers_modz", _outlier_sql("modz"))
def q_out_modz(spark, sf):
    return rounded(prep.outlier_report(tv.partfeat(spark, sf), PREP_COLS, "modified_zscore", 3.5))


CAP_SQL = tv.with_views("""
, q AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi, COUNT({c}) AS {c}_n"
    for c in PREP_COLS) + """ FROM partfeat)
SELECT p_partkey, """ + ", ".join(
    f"ROUND(CASE WHEN {c}_n < 10 OR {c} IS NULL THEN {c} WHEN {c} < {c}_lo THEN {c}_lo "
    f"WHEN {c} > {c}_hi THEN {c}_hi ELSE {c} END, 6) + 0.0 AS {c}" for c in PREP_COLS)
    + " FROM partfeat, q", tv.PARTFEAT_SQL)


@query("cap_pct", CAP_SQL)
def q_cap(spark, sf):
    p = tv.partfeat(spark, sf).select("p_partkey", *PREP_COLS)
    return rounded(prep.cap_percentiles(p, PREP_COLS), fine=tuple(PREP_COLS))


NULL_OUT_SQL = tv.with_views("""
, q AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3, COUNT({c}) AS {c}_n"
    for c in PREP_COLS) + """ FROM partfeat)
SELECT p_partkey, """ + ", ".join(
    f"{R(f'CASE WHEN {c}_n >= 10 AND ({c} < {c}_q1 - 3 * ({c}_q3 - {c}_q1) OR {c} > {c}_q3 + 3 * ({c}_q3 - {c}_q1)) THEN NULL ELSE CAST({c} AS DOUBLE) END')} AS {c}"
    for c in PREP_COLS) + " FROM partfeat, q", tv.PARTFEAT_SQL)


@query("null_outliers", NULL_OUT_SQL)
def q_null_out(spark, sf):
    p = tv.partfeat(spark, sf).select("p_partkey", *PREP_COLS)
    return rounded(prep.null_outliers(p, PREP_COLS, 3.0))


def _scale_sql(center: str, scale_: str):
    params = ", ".join(f"{center.format(c=c)} AS {c}_c, {scale_.format(c=c)} AS {c}_s" for c in PREP_COLS)
    sel = ", ".join(f"{R(f'CASE WHEN {c}_s <> 0 THEN ({c} - {c}_c) / {c}_s WHEN {c} IS NOT NULL THEN 0.0 END')} AS {c}"
                    for c in PREP_COLS)
    return tv.with_views(f", p AS (SELECT {params} FROM partfeat)\nSELECT p_partkey, {sel} FROM partfeat, p",
                         tv.PARTFEAT_SQL)


@query("scale_standard", _scale_sql("AVG({c})", "STDDEV_POP({c})"))
def q_scale_std(spark, sf):
    p = tv.partfeat(spark, sf).select("p_partkey", *PREP_COLS)
    return rounded(prep.scale(p, PREP_COLS, "standard")[0])


@query("scale_minmax", _scale_sql("MIN({c})", "MAX({c}) - MIN({c})"))
def q_scale_minmax(spark, sf):
    p = tv.partfeat(spark, sf).select("p_partkey", *PREP_COLS)
    return rounded(prep.scale(p, PREP_COLS, "minmax")[0])


@query("scale_robust", _scale_sql("quantile_cont({c}, 0.5)",
                                  "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def q_scale_robust(spark, sf):
    p = tv.partfeat(spark, sf).select("p_partkey", *PREP_COLS)
    return rounded(prep.scale(p, PREP_COLS, "robust")[0])


def _pipeline_sql():
    c_ = NULL_COLS
    fills = ", ".join(f"AVG({c}) AS {c}_f" for c in c_)
    imp = ", ".join(f"COALESCE(CAST({c} AS DOUBLE), {c}_f) AS {c}" for c in c_)
    qs = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi, "
                   f"COUNT({c}) AS {c}_n" for c in c_)
    cap = ", ".join(f"CASE WHEN {c}_n < 10 OR {c} IS NULL THEN {c} WHEN {c} < {c}_lo THEN {c}_lo "
                    f"WHEN {c} > {c}_hi THEN {c}_hi ELSE {c} END AS {c}" for c in c_)
    ps = ", ".join(f"AVG({c}) AS {c}_c, STDDEV_POP({c}) AS {c}_s" for c in c_)
    sc = ", ".join(f"{R(f'CASE WHEN {c}_s <> 0 THEN ({c} - {c}_c) / {c}_s WHEN {c} IS NOT NULL THEN 0.0 END')} AS {c}"
                   for c in c_)
    return tv.with_views(f"""
, f AS (SELECT {fills} FROM partfeat_null)
, i AS (SELECT p_partkey, {imp} FROM partfeat_null, f)
, q AS (SELECT {qs} FROM i)
, c AS (SELECT p_partkey, {cap} FROM i, q)
, p AS (SELECT {ps} FROM c)
SELECT p_partkey, {sc} FROM c, p""", tv.PARTFEAT_NULL_SQL)


@query("prep_pipeline", _pipeline_sql())
def q_prep_pipeline(spark, sf):
    p = tv.partfeat_null(spark, sf).select("p_partkey", *NULL_COLS)
    return rounded(prep.prep_pipeline(p, NULL_COLS, "mean", cap=True, scale_method="standard"))


# --- projection / filter -------------------------------------------------------

SELECT_EXISTING_SQL = tv.with_views("""
SELECT nation, year, """ + R("revenue") + """ AS revenue, """ + R("qty") + """ AS qty, n_lines, n_cust
FROM panel WHERE year = 1998""", tv.PANEL_SQL)


@query("select_existing", SELECT_EXISTING_SQL)
def q_select_existing(spark, sf):
    p = tv.panel(spark, sf)
    picked = loaders.columns_by_keyword(p, ["rev", "qty", "n_"], per_keyword=2, cap=10)
    chars = loaders.select_existing(p, ["nation", "year", *picked, "not_a_column"])
    return rounded(chars.where(F.col("year") == 1998))


LATEST_SQL = tv.with_views("""
SELECT p.nation, p.year, """ + R("p.revenue") + """ AS revenue, d.name,
       replace(d.name, ' ', '_') AS name_key, contains(d.name, 'A') AS has_a
FROM panel p JOIN dim d ON p.nation = d.nation
WHERE p.year = (SELECT MAX(year) FROM panel)""", tv.PANEL_SQL, tv.DIM_SQL)


@query("latest_period", LATEST_SQL)
def q_latest(spark, sf):
    from ..operators.ranking import latest_period
    p = latest_period(tv.panel(spark, sf), "year").select("nation", "year", "revenue")
    d = tv.dim(spark, sf)
    return rounded(p.join(d, "nation").withColumns({
        "name_key": F.replace(F.col("name"), F.lit(" "), F.lit("_")),
        "has_a": F.col("name").contains("A")}))


KEY_IN_LIST_SQL = tv.with_views("""
, top AS (SELECT nation FROM panel GROUP BY nation ORDER BY SUM(revenue) DESC, nation LIMIT 5)
SELECT nation, year, """ + R("AVG(revenue)") + """ AS revenue, """ + R("AVG(qty)") + """ AS qty,
       """ + R("AVG(avg_disc)") + """ AS avg_disc
FROM panel WHERE nation IN (SELECT nation FROM top) GROUP BY nation, year""", tv.PANEL_SQL)


@query("key_in_list", KEY_IN_LIST_SQL)
def q_key_in_list(spark, sf):
    from ..operators.ranking import time_trend
    return rounded(time_trend(tv.panel(spark, sf), "nation", "year", ["revenue", "qty", "avg_disc"], top=5))


NEAREST_SQL = tv.with_views("""
, cur AS (SELECT * FROM panel WHERE year = (SELECT MAX(year) FROM panel))
, pr AS (SELECT a.nation, b.nation AS nb,
                sqrt(power(a.revenue - b.revenue, 2) + power(a.qty - b.qty, 2) + power(a.avg_disc - b.avg_disc, 2)
                     + power(a.n_lines - b.n_lines, 2) + power(a.n_cust - b.n_cust, 2)) AS dist
         FROM cur a JOIN cur b ON a.nation <> b.nation)
, nn AS (SELECT nation, arg_min(nb, (dist, nb)) AS nearest_city, MIN(dist) AS dist FROM pr GROUP BY 1)
SELECT p.nation, p.year, """ + R("p.revenue") + " AS revenue, " + R("p.qty") + " AS qty, " + R("p.avg_disc")
    + """ AS avg_disc, p.n_lines, p.n_cust, """ + R("nn.dist") + """ AS distance_to_nearest_euclidean,
       nn.nearest_city
FROM panel p LEFT JOIN nn ON p.nation = nn.nation""", tv.PANEL_SQL)


@query("nearest_entity", NEAREST_SQL)
def q_nearest(spark, sf):
    p = tv.panel(spark, sf)
    return rounded(features.nearest_entity(p, ["revenue", "qty", "avg_disc", "n_lines", "n_cust"],
                                           "nation", "year"))


def _blocks_sql():
    """The same with the sum of absolute differences."""
    d = " + ".join(f"abs(a.{c} - b.{c})" for c in ("revenue", "qty", "avg_disc", "n_lines", "n_cust"))
    a, b = NEAREST_SQL.index("sqrt(power(a.revenue"), NEAREST_SQL.index(" AS dist\n         FROM cur a")
    return (NEAREST_SQL[:a] + f"({d})" + NEAREST_SQL[b:]).replace("distance_to_nearest_euclidean", "distance_to_nearest_cityblock")


@query("nearest_cityblock", _blocks_sql())
def q_nearest_cityblock(spark, sf):
    """J4 under another metric."""
    p = tv.panel(spark, sf)
    return rounded(features.nearest_entity(p, ["revenue", "qty", "avg_disc", "n_lines", "n_cust"], "nation", "year", "cityblock"))


# --- E2: the full feature pipeline ------------------------------------------------

FP_COLS = ["revenue", "qty", "avg_disc", "n_lines", "n_cust"]
_INT_COLS = {"n_lines", "n_cust"}


def _feature_pipeline_sql():
    w = "(PARTITION BY nation ORDER BY year)"
    wsel = []
    for c in FP_COLS:
        for k in (1, 2, 3):
            e = f"LAG({c}, {k}) OVER {w}"
            wsel.append(f"{e} AS {c}_lag{k}" if c in _INT_COLS else f"{R(e)} AS {c}_lag{k}")
    for c in FP_COLS:
        for k in (3, 5):
            fr = f"(PARTITION BY nation ORDER BY year ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
            wsel.append(f"{R(f'AVG({c}) OVER {fr}')} AS {c}_rolling_mean_{k}")
            wsel.append(f"{R(f'STDDEV_SAMP({c}) OVER {fr}')} AS {c}_rolling_std_{k}")
            mx = f"MAX({c}) OVER {fr}"
            wsel.append(f"{mx} AS {c}_rolling_max_{k}" if c in _INT_COLS else f"{R(mx)} AS {c}_rolling_max_{k}")
    for c in FP_COLS:
        cur = f"last_value({c} IGNORE NULLS) OVER (PARTITION BY nation ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        prev = f"last_value({c} IGNORE NULLS) OVER (PARTITION BY nation ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        g = f"{cur} / NULLIF({prev}, 0) - 1"
        wsel += [f"{R(g)} AS {c}_growth", f"{R(g)} AS {c}_yoy"]
    wnames = [x.rsplit(" AS ", 1)[1] for x in wsel]
    sel = ["p.nation", "p.year"] + [f"p.{c}" if c in _INT_COLS else f"{R('p.' + c)} AS {c}" for c in FP_COLS]
    sel += [f"wf.{n}" for n in wnames]
    stats = {"mean": "AVG(CAST({c} AS DOUBLE))", "std": "STDDEV_SAMP({c})", "min": "CAST(MIN({c}) AS DOUBLE)",
             "max": "CAST(MAX({c}) AS DOUBLE)", "median": "quantile_cont({c}, 0.5)", "skew": "skewness({c})",
             "kurtosis": "kurtosis({c})"}
    gsel = ", ".join(f"ROUND({e.format(c=c)}, {6 if s == 'median' else 4}) AS {c}_{s}"
                     for c in FP_COLS for s, e in stats.items())
    sel += [f"g.{c}_{s}" for c in FP_COLS for s in stats]
    sel += [f"{R('p.revenue * p.qty')} AS revenue_x_qty", f"{R('p.avg_disc * p.n_lines')} AS avg_disc_x_n_lines"]
    sel += [f"{R(f'p.{n} / NULLIF(p.{d}, 0)')} AS {n}_per_{d}" for n in ("revenue", "qty") for d in ("avg_disc", "n_lines")]
    sel += [f"{R('nn.dist')} AS distance_to_nearest_euclidean", "nn.nearest_city"]
    sel += ["pos.out_degree", "pos.in_degree", "pos.total_degree", f"{R('pos.out_strength')} AS out_strength",
            f"{R('pos.in_strength')} AS in_strength", f"{R('pos.total_strength')} AS total_strength",
            f"{R('pos.net_flow')} AS net_flow", f"{R('pos.betweenness_centrality')} AS betweenness_centrality"]
    dist = " + ".join(f"power(a.{c} - b.{c}, 2)" for c in FP_COLS)
    return tv.with_views(f"""
, wf AS (SELECT nation, year, {', '.join(wsel)} FROM panel)
, g AS (SELECT nation, {gsel} FROM panel GROUP BY nation)
, cur AS (SELECT * FROM panel WHERE year = (SELECT MAX(year) FROM panel))
, pr AS (SELECT a.nation, b.nation AS nb, sqrt({dist}) AS dist FROM cur a JOIN cur b ON a.nation <> b.nation)
, nn AS (SELECT nation, arg_min(nb, (dist, nb)) AS nearest_city, MIN(dist) AS dist FROM pr GROUP BY 1)
, o AS (SELECT src AS city, COUNT(*) AS d, SUM(value) AS s FROM od GROUP BY 1)
, i AS (SELECT dst AS city, COUNT(*) AS d, SUM(value) AS s FROM od GROUP BY 1)
, nodes AS (SELECT city FROM o UNION SELECT city FROM i)
, t AS (SELECT n.city, COUNT(*) AS touch FROM nodes n JOIN od ON od.src = n.city OR od.dst = n.city GROUP BY 1)
, pos AS (SELECT nodes.city, CAST(o.d AS BIGINT) AS out_degree, CAST(i.d AS BIGINT) AS in_degree,
                 CAST(o.d + i.d AS BIGINT) AS total_degree, o.s AS out_strength, i.s AS in_strength,
                 o.s + i.s AS total_strength, o.s - i.s AS net_flow,
                 t.touch / (SELECT COUNT(*) FROM od) AS betweenness_centrality
          FROM nodes LEFT JOIN o ON nodes.city = o.city LEFT JOIN i ON nodes.city = i.city
          LEFT JOIN t ON nodes.city = t.city)
SELECT {', '.join(sel)}
FROM panel p JOIN wf ON p.nation = wf.nation AND p.year = wf.year
LEFT JOIN g ON p.nation = g.nation LEFT JOIN nn ON p.nation = nn.nation
LEFT JOIN pos ON p.nation = pos.city""", tv.PANEL_SQL, tv.OD_SQL)


@query("feature_pipeline", _feature_pipeline_sql())
def q_feature_pipeline(spark, sf):
    from ..operators.flows import od_position_features
    out = features.feature_pipeline(tv.panel(spark, sf), "nation", "year", exclude=("year",),
                                    od_features=od_position_features(tv.od(spark, sf)))
    return rounded(out, fine=tuple(f"{c}_median" for c in FP_COLS))


# --- rows-only: model-based imputation ------------------------------------------------

def _knn_sql(k=5):
    """NaN-Euclidean distances to every row that has the column and shares a coordinate."""
    d2 = " + ".join(f"COALESCE((q.{o} - d.{o}) * (q.{o} - d.{o}), 0.0)" for o in NULL_COLS)
    shared = " + ".join(f"CAST(q.{o} IS NOT NULL AND d.{o} IS NOT NULL AS INTEGER)" for o in NULL_COLS)
    fills = []
    for c in NULL_COLS:
        fills.append(f"""
n_{c} AS (SELECT id, AVG(v) AS fill FROM (
    SELECT q.p_partkey AS id, d.{c} AS v,
           ROW_NUMBER() OVER (PARTITION BY q.p_partkey ORDER BY sqrt({d2}) * sqrt({float(len(NULL_COLS))} / ({shared})), d.p_partkey) AS rn
    FROM partfeat_null q JOIN partfeat_null d ON q.p_partkey <> d.p_partkey
    WHERE q.{c} IS NULL AND d.{c} IS NOT NULL AND {shared} > 0) WHERE rn <= {k} GROUP BY 1)""")
    sel = ", ".join(R(f"COALESCE(CAST(p.{c} AS DOUBLE), n_{c}.fill, (SELECT AVG({c}) FROM partfeat_null))") + f" AS {c}"
                    for c in NULL_COLS)
    joins = " ".join(f"LEFT JOIN n_{c} ON n_{c}.id = p.p_partkey" for c in NULL_COLS)
    return tv.with_views(f"SELECT p.p_partkey, {sel} FROM partfeat_null p {joins}", tv.PARTFEAT_NULL_SQL, *fills)


@query("impute_knn", _knn_sql())
def q_impute_knn(spark, sf):
    p = tv.partfeat_null(spark, sf).select("p_partkey", *NULL_COLS)
    return rounded(prep.knn_impute(p, NULL_COLS, "p_partkey", k=5))


@query("impute_mice")
def q_impute_mice(spark, sf):
    p = tv.partfeat_null(spark, sf).select("p_partkey", *NULL_COLS)
    return prep.mice_impute(p, NULL_COLS, "p_partkey", rounds=10)
