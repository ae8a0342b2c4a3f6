"""Model queries: clustering, PCA / adequacy, regression, spatial regression, composites.

Fits whose result is a model summary (eigenvalues, centroids, coefficients)
return small DataFrames built from those summaries; these have no SQL oracle
(rows-only check).  Cluster quality and regression metrics are aggregates and
carry DuckDB oracles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cluster, predict, reduce, spatial, spectral
from ..operators.ranking import arg_best, top_entities
from ..operators.vectors import complete
from ..session import ensure_checkpoint_dir
from ..sources import loaders
from ..sources import testviews as tv
from .registry import R, query, rounded

CL_COLS = [f"f{i}" for i in range(1, tv.VEC_DIM + 1)]
PANEL_VALUES = ["revenue", "qty", "avg_disc", "n_lines", "n_cust"]
PROFILE_COLS = [f"f{i}" for i in range(1, 6)]
PCA_COLS = tv.PARTFEAT_COLS
ML_X = ["qty", "p_retailprice", "avg_disc", "n_lines", "p_size"]


def _vec(spark, sf):
    return tv.vec(spark, sf)


# --- cluster quality (SQL oracles) ------------------------------------------

PROFILE_SQL = tv.with_views("""
SELECT label, COUNT(*) AS n, """ + R("COUNT(*) * 100.0 / SUM(COUNT(*)) OVER ()") + " AS pct, " + ", ".join(
    f"{R(f'AVG({c})')} AS {c}_mean, {R(f'STDDEV_SAMP({c})')} AS {c}_std" for c in PROFILE_COLS)
    + " FROM vec WHERE label <> -1 GROUP BY label", tv.VEC_SQL)


@query("cluster_profile", PROFILE_SQL)
def q_cluster_profile(spark, sf):
    return rounded(cluster.profile(_vec(spark, sf), PROFILE_COLS, "label"))


def _quality_sql():
    m = ", ".join(f"AVG({c}) AS m_{c}" for c in CL_COLS)
    g = ", ".join(f"AVG({c}) AS g_{c}" for c in CL_COLS)
    d2 = " + ".join(f"power(v.{c} - c.m_{c}, 2)" for c in CL_COLS)
    cd = " + ".join(f"power(a.m_{c} - b.m_{c}, 2)" for c in CL_COLS)
    bt = " + ".join(f"power(m_{c} - g_{c}, 2)" for c in CL_COLS)
    return tv.with_views(f"""
, c AS (SELECT label, COUNT(*) AS n, {m} FROM vec GROUP BY label)
, g AS (SELECT COUNT(*) AS nn, {g} FROM vec)
, p AS (SELECT v.label, {d2} AS d2 FROM vec v JOIN c ON v.label = c.label)
, per AS (SELECT label, SUM(d2) AS w, AVG(sqrt(d2)) AS s FROM p GROUP BY label)
, cc AS (SELECT c.*, per.w, per.s FROM c JOIN per ON c.label = per.label)
, db AS (SELECT a.label, MAX((a.s + b.s) / sqrt({cd})) AS r FROM cc a JOIN cc b ON a.label <> b.label GROUP BY 1)
, t AS (SELECT COUNT(*) AS k, MAX(nn) AS n, SUM(w) AS inertia, SUM(cc.n * ({bt})) AS b,
               (SELECT AVG(r) FROM db) AS dbi FROM cc, g)
SELECT k, n, {R('inertia')} AS inertia, {R('(b / (k - 1)) / (inertia / (n - k))')} AS calinski_harabasz,
       {R('dbi')} AS davies_bouldin FROM t""", tv.VEC_SQL)


@query("inertia_ch_db", _quality_sql())
def q_quality(spark, sf):
    return rounded(cluster.quality(_vec(spark, sf), CL_COLS, "label"))


def _silhouette_sql():
    d2 = " + ".join(f"power(a.{c} - b.{c}, 2)" for c in CL_COLS)
    return tv.with_views(f"""
, pr AS (SELECT a.vec_id, a.label AS la, b.label AS lb, {d2} AS d2 FROM vec a JOIN vec b ON a.vec_id <> b.vec_id)
, m AS (SELECT vec_id, la, lb, AVG(d2) AS md FROM pr GROUP BY 1, 2, 3)
, ab AS (SELECT vec_id, la, MAX(CASE WHEN la = lb THEN md END) AS a, MIN(CASE WHEN la <> lb THEN md END) AS b
         FROM m GROUP BY 1, 2)
SELECT v.vec_id, v.label,
       {R('CASE WHEN ab.a IS NULL THEN 0.0 ELSE (ab.b - ab.a) / greatest(ab.a, ab.b) END')} AS silhouette
FROM vec v LEFT JOIN ab ON v.vec_id = ab.vec_id""", tv.VEC_SQL)


@query("silhouette_sq", _silhouette_sql())
def q_silhouette(spark, sf):
    return rounded(cluster.silhouette_sq(_vec(spark, sf), CL_COLS, "label", "vec_id"))


REG_METRICS_SQL = tv.with_views("""
, f AS (SELECT regr_slope(revenue, qty) AS b, regr_intercept(revenue, qty) AS a FROM partfeat
        WHERE revenue IS NOT NULL AND qty IS NOT NULL)
, p AS (SELECT revenue AS y, a + b * qty AS yhat FROM partfeat, f WHERE revenue IS NOT NULL AND qty IS NOT NULL)
SELECT """ + R("AVG((y - yhat) * (y - yhat))", 0) + " AS mse, " + R("sqrt(AVG((y - yhat) * (y - yhat)))") + " AS rmse, "
    + R("AVG(abs(y - yhat))") + " AS mae, " + R("1 - SUM((y - yhat) * (y - yhat)) / (VAR_POP(y) * COUNT(*))")
    + " AS r2, " + R("CASE WHEN COUNT(*) FILTER (WHERE y = 0) = 0 THEN AVG(abs((y - yhat) / y)) * 100 END")
    + " AS mape FROM p", tv.PARTFEAT_SQL)


@query("regression_metrics", REG_METRICS_SQL)
def q_reg_metrics(spark, sf):
    p = complete(tv.partfeat(spark, sf).select(F.col("revenue").alias("label"), "qty"))
    fit = p.agg(F.regr_slope("label", "qty").alias("_b"), F.regr_intercept("label", "qty").alias("_a"))
    pred = (p.withColumn("_k", F.lit(1)).join(F.broadcast(fit.withColumn("_k", F.lit(1))), "_k")
            .withColumn("prediction", F.col("_a") + F.col("_b") * F.col("qty")))
    return rounded(predict.metrics(pred), coarse=("mse",))


SUMMARY_SQL = tv.with_views("""
, t AS (SELECT nation, AVG(revenue) AS m FROM panel GROUP BY 1 ORDER BY m DESC, nation LIMIT 3)
SELECT (SELECT COUNT(*) FROM panel) AS n_rows, (SELECT COUNT(DISTINCT nation) FROM panel) AS n_entities,
       (SELECT COUNT(DISTINCT year) FROM panel) AS n_periods, (SELECT MIN(year) FROM panel) AS first_period,
       (SELECT MAX(year) FROM panel) AS last_period, """ + R("(SELECT AVG(revenue) FROM panel)") + """ AS mean_revenue,
       (SELECT string_agg(CAST(nation AS VARCHAR), ', ' ORDER BY m DESC, nation) FROM t) AS top3""", tv.PANEL_SQL)


@query("simple_summary", SUMMARY_SQL)
def q_simple_summary(spark, sf):
    p = tv.panel(spark, sf)
    base = p.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("nation").alias("n_entities"),
                 F.countDistinct("year").alias("n_periods"), F.min("year").alias("first_period"),
                 F.max("year").alias("last_period"), F.avg("revenue").alias("mean_revenue"))
    top = top_entities(p, "nation", "revenue", 3).agg(
        F.array_sort(F.collect_list(F.struct("rank", "nation"))).alias("_t"))
    top = top.select(F.concat_ws(", ", F.transform("_t", lambda s: s["nation"].cast("string"))).alias("top3"))
    k = F.lit(1)
    return rounded(base.withColumn("_k", k).join(top.withColumn("_k", k), "_k").drop("_k"))


# --- rows-only: clustering ------------------------------------------------------

@query("kmeans")
def q_kmeans(spark, sf):
    lab, _ = cluster.kmeans(_vec(spark, sf), CL_COLS, "vec_id", k=10, restarts=10)
    return lab


@query("kmeans_sweep")
def q_kmeans_sweep(spark, sf):
    return cluster.kmeans_sweep(_vec(spark, sf), CL_COLS, "vec_id", range(2, 11), restarts=10)


@query("gmm_sweep")
def q_gmm_sweep(spark, sf):
    return cluster.gmm_sweep(_vec(spark, sf), CL_COLS, "vec_id", range(1, 11))


DB_EPS, DB_MIN = 0.03, 5
DBSCAN_SQL = "WITH RECURSIVE " + tv.with_views(f"""
, near AS (SELECT a.vec_id AS i, b.vec_id AS j FROM geo a JOIN geo b
           ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= {DB_EPS})
, core AS (SELECT i FROM near GROUP BY i HAVING COUNT(*) >= {DB_MIN})
, link AS (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core))
, reach AS (SELECT i, i AS j FROM core UNION SELECT r.i, l.j FROM reach r JOIN link l ON r.j = l.i)
, lab AS (SELECT i, MIN(j) AS label FROM reach GROUP BY i)
, border AS (SELECT near.i, MIN(lab.label) AS label FROM near JOIN lab ON near.j = lab.i
             WHERE near.i NOT IN (SELECT i FROM core) GROUP BY near.i)
SELECT g.vec_id, CAST(COALESCE(lab.label, border.label, -1) AS BIGINT) AS label
FROM geo g LEFT JOIN lab ON g.vec_id = lab.i LEFT JOIN border ON g.vec_id = border.i""", tv.GEO_SQL)[len("WITH "):]


@query("dbscan", DBSCAN_SQL)
def q_dbscan(spark, sf):
    return cluster.dbscan(tv.geo(spark, sf), "vec_id", ["x", "y"], eps=DB_EPS, min_samples=DB_MIN)


@query("cluster_compare")
def q_cluster_compare(spark, sf):
    """C14: k-means, Ward and Gaussian mixture at the same k, compared by silhouette."""
    return cluster.compare(_vec(spark, sf), CL_COLS, "vec_id", k=10)


@query("cluster_evolution")
def q_cluster_evolution(spark, sf):
    """Per-period k-means (k = 3) of the panel, periods with < 5 rows skipped;
    labels aligned across periods by centroid order."""
    p = tv.panel(spark, sf).withColumn("key", F.col("nation") * 10000 + F.col("year"))
    cols = ["revenue", "qty", "avg_disc", "n_lines", "n_cust"]
    years = [r[0] for r in p.groupBy("year").count().where(F.col("count") >= 5).select("year").orderBy("year").collect()]
    parts = []
    for y in years:
        lab, _ = cluster.kmeans(p.where(F.col("year") == y), cols, "key", k=3, restarts=5)
        parts.append(lab.withColumn("year", F.lit(y)))
    out = loaders.union_by_name(parts)
    return out.select((F.col("key") / 10000).cast("int").alias("nation"), "year", "label")


@query("cluster_table")
def q_cluster_table(spark, sf):
    """The label table, a row for each nation and a column for each year (years of too few rows left out)."""
    lab = q_cluster_evolution(spark, sf)
    years = sorted(r[0] for r in lab.select("year").distinct().collect())
    return lab.groupBy("nation").pivot("year", years).agg(F.first("label")).withColumnsRenamed({str(y): f"y{y}" for y in years})


BEST_SQL = tv.with_views("""
, m AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, regr_r2(CAST(revenue AS DOUBLE), CAST({c} AS DOUBLE)) AS r2 FROM partfeat" for c in ML_X) + """)
SELECT feature, """ + R("r2") + " AS r2 FROM m ORDER BY m.r2 DESC, feature LIMIT 1", tv.PARTFEAT_SQL)


@query("best_predictor", BEST_SQL)
def q_best_predictor(spark, sf):
    """T5: the feature whose own regression explains most of the revenue."""
    wide = tv.partfeat(spark, sf).agg(*[F.regr_r2(F.col("revenue").cast("double"), F.col(c).cast("double")).alias(c) for c in ML_X])
    return rounded(arg_best(wide.unpivot([], ML_X, "feature", "r2"), "r2", "feature"))


# --- rows-only: PCA / factor adequacy --------------------------------------------

def _pca(spark, sf):
    return reduce.pca_fit(tv.partfeat(spark, sf), PCA_COLS)


@query("pca_summary")
def q_pca_summary(spark, sf):
    return reduce.pca_summary(spark, _pca(spark, sf))


@query("pca_loadings")
def q_pca_loadings(spark, sf):
    return reduce.pca_loadings(spark, _pca(spark, sf))


@query("pca_scores")
def q_pca_scores(spark, sf):
    pf = tv.partfeat(spark, sf)
    return reduce.pca_scores(pf, reduce.pca_fit(pf, PCA_COLS), "p_partkey", k=3)


@query("component_rules")
def q_component_rules(spark, sf):
    pf = tv.partfeat(spark, sf)
    p = reduce.parallel_analysis(pf, PCA_COLS, "p_partkey", permutations=100)["n_components"]
    r = reduce.component_rules(_pca(spark, sf), parallel=p)
    return spark.createDataFrame([tuple(r.values())], ", ".join(f"{k} int" for k in r))


@query("kmo_bartlett")
def q_kmo_bartlett(spark, sf):
    r = reduce.kmo_bartlett(tv.partfeat(spark, sf), PCA_COLS)
    rows = [(v, float(k)) for v, k in r["kmo_per_variable"].items()]
    out = spark.createDataFrame(rows, "variable string, kmo_variable double")
    return out.select("*", F.lit(r["kmo"]).alias("kmo"), F.lit(r["bartlett_chi2"]).alias("bartlett_chi2"),
                      F.lit(r["bartlett_df"]).alias("bartlett_df"), F.lit(r["bartlett_p"]).alias("bartlett_p"))


# --- rows-only: regression ------------------------------------------------------------

@query("linear_models")
def q_linear_models(spark, sf):
    return predict.train_all(tv.partfeat(spark, sf), "p_partkey", "revenue", ML_X,
                             ["linear_regression", "ridge", "lasso", "elastic_net"])


@query("tree_models")
def q_tree_models(spark, sf):
    return predict.train_all(tv.partfeat(spark, sf), "p_partkey", "revenue", ML_X,
                             ["decision_tree", "random_forest", "gradient_boosting", "boosted_shallow"])


@query("boosted_trees")
def q_boosted_trees(spark, sf):
    """M9 + M10: the two second-order boosted presets, 100 rounds each: test R² and importances."""
    names = ["boosted_depth_wise", "boosted_leaf_wise"]
    fitted = predict.fit_all(tv.partfeat(spark, sf), "p_partkey", "revenue", ML_X, names)
    scores = spark.createDataFrame([(n, float(m["r2"]), float(m["rmse"])) for n, (_, m) in fitted.items()], "model string, r2 double, rmse double")
    return predict.importances(spark, fitted, ML_X).join(scores, "model")


@query("grid_search")
def q_grid_search(spark, sf):
    return predict.grid_search(tv.partfeat(spark, sf), "p_partkey", "revenue", ML_X)


@query("model_summary")
def q_model_summary(spark, sf):
    return predict.train_all(tv.partfeat(spark, sf), "p_partkey", "revenue", ML_X,
                             ["linear_regression", "ridge", "decision_tree", "random_forest"])


# --- rows-only: spatial regression -------------------------------------------------------

def _slm(spark, sf):
    g = tv.geo(spark, sf)
    w = spatial.knn_weights(g, "vec_id", ["x", "y"], 4)
    lag = spatial.spatial_lag(w, g, "vec_id", "v").withColumnRenamed("i", "vec_id")
    d = g.join(lag, "vec_id")
    return predict.ols(d, "v", ["x", "y", "lag"])


def ols_ctes(source: str, y: str, xs, where: str = "TRUE", tag: str = "") -> tuple[str, dict]:
    """CTEs of an ordinary least-squares fit of a view by sequential orthogonalisation, and the SQL of
    each coefficient.  The last CTE, ``fit{tag}``, is one row with c1.. (slopes on the orthogonal columns),
    r{k}_{j} (projections), means, residual variance."""
    p = len(xs)
    mean = ", ".join([f"AVG({y}) AS my"] + [f"AVG({x}) AS m{k}" for k, x in enumerate(xs, 1)])
    ctes = [f"ols_m{tag} AS (SELECT {mean} FROM {source} WHERE {where})",
            f"ols_0{tag} AS (SELECT {y} - my AS y0, " + ", ".join(f"{x} - m{k} AS a{k}" for k, x in enumerate(xs, 1))
            + f" FROM {source}, ols_m{tag} WHERE {where})"]
    for k in range(1, p + 1):  # residual of every later column, and of y, on column k
        sums = [f"SUM(y0 * a{k}) / SUM(a{k} * a{k}) AS c{k}"] + [
            f"SUM(a{j} * a{k}) / SUM(a{k} * a{k}) AS r{k}_{j}" for j in range(k + 1, p + 1)]
        ctes.append(f"ols_s{k}{tag} AS (SELECT {', '.join(sums)} FROM ols_{k - 1}{tag})")
        keep = [f"y0 - c{k} * a{k} AS y0"] + [f"a{j} - r{k}_{j} * a{k} AS a{j}" for j in range(k + 1, p + 1)]
        ctes.append(f"ols_{k}{tag} AS (SELECT {', '.join(keep)} FROM ols_{k - 1}{tag}, ols_s{k}{tag})")
    ctes.append(f"ols_e{tag} AS (SELECT AVG(y0 * y0) AS mse, COUNT(*) AS n FROM ols_{p}{tag})")
    ctes.append(f"ols_v{tag} AS (SELECT VAR_POP(y0) AS vy FROM ols_0{tag})")
    ctes.append(f"fit{tag} AS (SELECT * FROM ols_m{tag}, ols_e{tag}, ols_v{tag}, "
                + ", ".join(f"ols_s{k}{tag}" for k in range(1, p + 1)) + ")")
    beta: dict[int, str] = {}
    for k in range(p, 0, -1):
        beta[k] = "(c%d%s)" % (k, "".join(f" - r{k}_{j} * {beta[j]}" for j in range(k + 1, p + 1)))
    out = {x: beta[k] for k, x in enumerate(xs, 1)}
    out["intercept"] = "(my" + "".join(f" - m{k} * {beta[k]}" for k in range(1, p + 1)) + ")"
    return ", ".join(ctes), out


def _slm_sql():
    from .q_spatial import KNN_W_SQL, PAIRS_SQL
    ctes, beta = ols_ctes("d", "v", ["x", "y", "lag"])
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS term, {R(beta[t])} AS coef, {R('1 - mse / vy')} AS r2, {R('mse')} AS mse, n FROM fit"
        for t in ("intercept", "x", "y", "lag"))
    d = ("d AS (SELECT g.v, g.x, g.y, l.lag FROM geo g JOIN (SELECT w.i, SUM(w.w * g.v) AS lag FROM w JOIN geo g "
         "ON w.j = g.vec_id GROUP BY w.i) l ON g.vec_id = l.i)")
    return tv.with_views(rows, tv.GEO_SQL, PAIRS_SQL, KNN_W_SQL, d, ctes)


@query("slm", _slm_sql())
def q_slm(spark, sf):
    r = _slm(spark, sf)
    rows = [("intercept", r["intercept"])] + [(k, v) for k, v in r["coefs"].items()]
    return rounded(spark.createDataFrame(rows, "term string, coef double").select(
        "*", F.lit(r["r2"]).alias("r2"), F.lit(r["mse"]).alias("mse"), F.lit(r["n"]).cast("long").alias("n")))


def _ols_coefs_sql():
    """The linear regression on the train part (standardised by it) and its test R²."""
    used = " AND ".join(f"{c} IS NOT NULL" for c in ["revenue", *ML_X])
    h = "CAST('0x' || substr(md5('42:' || p_partkey), 1, 8) AS BIGINT) % 100"
    base = f"pt AS (SELECT *, {h} AS b FROM partfeat WHERE {used})"
    sc = ("sc AS (SELECT " + ", ".join(f"AVG({c}) AS mu_{c}, STDDEV_POP({c}) AS sd_{c}" for c in ML_X)
          + " FROM pt WHERE b < 80)")
    z = ("z AS (SELECT b, CAST(revenue AS DOUBLE) AS revenue, "
         + ", ".join(f"CASE WHEN sd_{c} > 0 THEN ({c} - mu_{c}) / sd_{c} ELSE 0.0 END AS {c}" for c in ML_X) + " FROM pt, sc)")
    ctes, beta = ols_ctes("z", "revenue", ML_X, "b < 80")
    pred = beta["intercept"] + " + " + " + ".join(f"{beta[c]} * z.{c}" for c in ML_X)
    test = (f"t AS (SELECT revenue AS y, {pred} AS yhat FROM z, fit WHERE b >= 80), "
            "q AS (SELECT 1 - SUM(power(y - yhat, 2)) / (VAR_POP(y) * COUNT(*)) AS r2 FROM t)")
    rows = " UNION ALL ".join(f"SELECT '{t}' AS term, {R(beta[t], 2)} AS coef, {R('r2')} AS test_r2 FROM fit, q"
                              for t in ("intercept", *ML_X))
    return tv.with_views(rows, tv.PARTFEAT_SQL, base, sc, z, ctes, test)


@query("ols_coefs", _ols_coefs_sql())
def q_ols_coefs(spark, sf):
    """Split, standardisation, linear regression: coefficients and test R²."""
    fitted = predict.fit_all(tv.partfeat(spark, sf), "p_partkey", "revenue", ML_X, ["linear_regression"])
    r2 = float(fitted["linear_regression"][1]["r2"])
    out = predict.coefficients(spark, fitted, ML_X).drop("model").withColumn("coef", F.round("coef", 2) + F.lit(0.0))
    return out.withColumn("test_r2", F.lit(r2)).select(
        "term", "coef", (F.round(F.col("test_r2") * 1e4, 0) / 1e4).alias("test_r2"))


CV_FOLDS = 5


def _cross_val_sql():
    """Each fold's R² under the least-squares fit of the others."""
    used = " AND ".join(f"{c} IS NOT NULL" for c in ["revenue", *ML_X])
    z = ("z AS (SELECT CAST(revenue AS DOUBLE) AS revenue, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ML_X)
         + f", CAST('0x' || substr(md5('43:' || p_partkey), 1, 8) AS BIGINT) % {CV_FOLDS} AS fold FROM partfeat WHERE {used})")
    parts, rows = [z], []
    for f in range(CV_FOLDS):
        ctes, beta = ols_ctes("z", "revenue", ML_X, f"fold <> {f}", f"_f{f}")
        pred = beta["intercept"] + " + " + " + ".join(f"{beta[c]} * z.{c}" for c in ML_X)
        parts += [ctes, f"t{f} AS (SELECT revenue AS y, {pred} AS yhat FROM z, fit_f{f} WHERE fold = {f})"]
        rows.append(f"SELECT {f} AS fold, 1 - SUM(power(y - yhat, 2)) / (VAR_POP(y) * COUNT(*)) AS r2 FROM t{f}")
    parts.append("folds AS (" + " UNION ALL ".join(rows) + ")")
    return tv.with_views(f"SELECT fold, {R('r2')} AS r2, {R('AVG(r2) OVER ()')} AS mean_r2, "
                         f"{R('STDDEV_POP(r2) OVER ()')} AS std_r2 FROM folds", tv.PARTFEAT_SQL, *parts)


@query("cross_val", _cross_val_sql())
def q_cross_val(spark, sf):
    return rounded(predict.cross_validate(tv.partfeat(spark, sf), "p_partkey", "revenue", ML_X, k=CV_FOLDS))


def _bartlett_sql():
    """The determinant of the correlations is the product of the columns' unexplained shares, one after another."""
    ctes, _ = ols_ctes("pc", PCA_COLS[0], PCA_COLS)
    used = " AND ".join(f"{c} IS NOT NULL" for c in PCA_COLS)
    pc = ("pc AS (SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in PCA_COLS) + f" FROM partfeat WHERE {used})")
    p = len(PCA_COLS)
    logs = " + ".join(f"(SELECT ln(SUM(a{k} * a{k})) FROM ols_{k - 1}) - (SELECT ln(SUM(a{k} * a{k})) FROM ols_0)"
                      for k in range(1, p + 1))
    return tv.with_views(f"SELECT {R(f'-((SELECT COUNT(*) FROM pc) - 1 - (2.0 * {p} + 5) / 6) * ({logs})', 3)} AS bartlett_chi2, "
                         f"CAST({p * (p - 1) // 2} AS BIGINT) AS bartlett_df", tv.PARTFEAT_SQL, pc, ctes)


@query("bartlett", _bartlett_sql())
def q_bartlett(spark, sf):
    """D14 alone: the sphericity statistic and its degrees of freedom."""
    r = reduce.kmo_bartlett(tv.partfeat(spark, sf), PCA_COLS)
    out = spark.createDataFrame([(float(r["bartlett_chi2"]), int(r["bartlett_df"]))], "bartlett_chi2 double, bartlett_df long")
    return rounded(out, 3)


@query("linear_coefs")
def q_linear_coefs(spark, sf):
    fitted = predict.fit_all(tv.partfeat(spark, sf), "p_partkey", "revenue", ML_X, ["ridge", "lasso", "elastic_net"])
    return predict.coefficients(spark, fitted, ML_X)


@query("tree_importances")
def q_tree_importances(spark, sf):
    fitted = predict.fit_all(tv.partfeat(spark, sf), "p_partkey", "revenue", ML_X, ["decision_tree", "boosted_shallow"])
    return predict.importances(spark, fitted, ML_X)


@query("spatial_models")
def q_spatial_models(spark, sf):
    """X11 + X12: summary over the requested models; SEM / SDM are metadata rows
    (as in the analysed project), SLM carries its fit."""
    r = _slm(spark, sf)
    rows = [("SLM", "spatial lag OLS", r["r2"], r["mse"], r["n"], r["k"]),
            ("SEM", "metadata only", None, None, r["n"], r["k"]),
            ("SDM", "metadata only", None, None, r["n"], r["k"])]
    return spark.createDataFrame(rows, "model string, note string, r2 double, mse double, n long, k long")


# --- rows-only: sink, composites ---------------------------------------------------------

def _panel_select():
    return "SELECT nation, year, " + ", ".join(R(f"CAST({c} AS DOUBLE)") + f" AS {c}" for c in PANEL_VALUES) + " FROM panel"


@query("write_read", tv.with_views(_panel_select(), tv.PANEL_SQL))
def q_write_read(spark, sf):
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/flowpanel-out/panel-{uuid.uuid4().hex}"
    loaders.write_table(tv.panel(spark, sf), path, "parquet", partition_by=["year"])
    back = spark.read.parquet(path)
    return rounded(back.select("nation", "year", *[F.col(c).cast("double").alias(c) for c in PANEL_VALUES]))


MISSING_YEAR = 1900
CSV_SQL = tv.with_views(f"""
SELECT src, dst, year, sn.name AS src_name, dn.name AS dst_name, {R('value')} AS value
FROM od LEFT JOIN dim sn ON sn.nation = src LEFT JOIN dim dn ON dn.nation = dst
WHERE value IS NOT NULL""", tv.OD_SQL, tv.DIM_SQL)


@query("csv_od_round_trip", CSV_SQL)
def q_csv_od(spark, sf):
    """Yearly wide CSV matrices and a JSON dimension, written and read back, with one of
    the asked years missing."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    folder = f"{base}/flowpanel-out/od-{uuid.uuid4().hex}"
    od, dim = tv.od(spark, sf), tv.dim(spark, sf)
    years = loaders.write_wide_od(od, folder)
    dim.write.json(f"{folder}/dim.json")
    back = loaders.read_yearly_od(spark, folder, [MISSING_YEAR, *years])
    back = loaders.rename(back, {"value": "flow", "absent": "ignored"})  # load_od finds it under its other name
    entities = loaders.read_dimension(spark, f"{folder}/dim.json")
    out = loaders.load_od(back, entities, "nation", "name")
    return rounded(out.select("src", "dst", "year", "src_name", "dst_name", "value"))


@query("full_pipeline")
def q_full_pipeline(spark, sf):
    """Q1: latest period → cap + standard scale → PCA (components by the max rule)
    → k-means (k = 3) on the component scores."""
    from ..operators.prep import prep_pipeline
    from ..operators.ranking import latest_period
    cols = ["revenue", "qty", "avg_disc", "n_lines", "n_cust"]
    cur = latest_period(tv.panel(spark, sf), "year")
    z = prep_pipeline(cur.select("nation", *cols), cols, impute_method="mean", cap=True,
                      scale_method="standard")
    ensure_checkpoint_dir(spark)
    z = z.checkpoint()  # reused by the PCA aggregate, the scores and every k-means restart
    res = reduce.pca_fit(z, cols)
    k = reduce.component_rules(res)["n_components"]
    sc = reduce.pca_scores(z, res, "nation", k=k)
    lab, _ = cluster.kmeans(sc, [f"PC{i + 1}" for i in range(k)], "nation", k=3, restarts=10)
    return sc.join(lab, "nation")


# --- rows-only: factor analysis, parallel analysis -----------------------------------

@query("factor_scores")
def q_factor_scores(spark, sf):
    return reduce.factor_scores(tv.partfeat(spark, sf), PCA_COLS, "p_partkey")


@query("parallel_analysis")
def q_parallel_analysis(spark, sf):
    r = reduce.parallel_analysis(tv.partfeat(spark, sf), PCA_COLS, "p_partkey", permutations=100)
    rows = [(f"PC{i + 1}", float(a), float(b), bool(a > b)) for i, (a, b) in enumerate(zip(r["real"], r["threshold"]))]
    return spark.createDataFrame(rows, "pc string, eigenvalue double, threshold_95 double, retained boolean")


# --- rows-only: Ward, spectral, kernel / robust PCA ------------------------------------

@query("ward")
def q_ward(spark, sf):
    return cluster.ward_sweep(_vec(spark, sf), CL_COLS, "vec_id", range(2, 11))


@query("spectral")
def q_spectral(spark, sf):
    return spectral.spectral(_vec(spark, sf), CL_COLS, "vec_id", k=5, gamma=1.0 / len(CL_COLS))


@query("kernel_pca")
def q_kernel_pca(spark, sf):
    res, scores = reduce.kernel_pca(_vec(spark, sf), CL_COLS, "vec_id", k=3)
    return scores


@query("robust_pca")
def q_robust_pca(spark, sf):
    rob, cls = reduce.robust_pca(tv.partfeat(spark, sf), PCA_COLS, "p_partkey")
    agree = reduce.loading_agreement(rob, cls, 2)
    rows = [(f"PC{j + 1}", float(rob.eigenvalues[j]), float(rob.ratios[j]), float(cls.eigenvalues[j]),
             agree[j] if j < 2 else None) for j in range(len(PCA_COLS))]
    return spark.createDataFrame(rows, "pc string, robust_eigenvalue double, robust_ratio double, "
                                       "classical_eigenvalue double, loading_corr double")
