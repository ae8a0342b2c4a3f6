"""Clustering and cluster quality.

Points are one array column from the scan on (:mod:`.vectors`); fits of all restarts and all k share their passes
(:mod:`.fits`).  Quality measures are aggregates over per-cluster moments: the only per-cluster state that meets other
clusters is the k × p centroid table (k is a parameter) — never a pairwise join of points.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import spread_join
from ..functions.scalar import safe_div
from . import fits, pairs, vectors
from .graph import _materialize


def _by(df: DataFrame, cols, id_col: str, standardize: bool = True) -> DataFrame:
    """(id, v) of the complete rows, scaled if asked, written once: every pass of a fit reads it."""
    x = vectors.points(df, cols, [id_col])
    return _materialize(vectors.standardised(x) if standardize else x)


def kmeans(df: DataFrame, cols, id_col: str, k: int, restarts: int = 10, seed: int = 42,
           standardize: bool = True, max_iter: int = 300) -> tuple[DataFrame, float]:
    """K-means with ``restarts`` seeded runs, keeping the lowest cost; ``cols`` names the columns, or one array.

    All runs move in the same passes (:mod:`.fits`).  Labels are canonical: clusters are numbered by the order of their
    centroids (lexicographic on the coordinates), so reruns and restarts agree.
    Returns (``id, label`` DataFrame, cost).
    """
    x = _by(df, cols, id_col, standardize)
    centers, cost = fits.kmeans_best(x, id_col, [k], restarts, seed, max_iter)[k]
    return fits.labelled(x, [centers], [id_col]).select(id_col, F.col("labels")[0].alias("label")), cost


def _mean(v: str = "v"):
    """Mean vector of a group, as an array (partial sums on the map side)."""
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(v))))


def _sq(a, b):
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


#: Clusters whose summaries may be broadcast as one row; more raise.
MAX_CLUSTERS = 10_000


def _with_summaries(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add the array ``_all`` of the clusters' summaries to every row, if there are at most ``MAX_CLUSTERS``."""
    if clusters.limit(MAX_CLUSTERS + 1).count() > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    one = clusters.agg(F.collect_list(F.struct(*clusters.columns)).alias("_all")).withColumn("_k", F.lit(1))
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one), "_k").drop("_k")


def quality(df: DataFrame, cols, label: str) -> DataFrame:
    """C10 inertia, C12 Calinski–Harabasz, C13 Davies–Bouldin (one row)."""
    pts = vectors.points(df, cols, [label])
    cent = pts.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), _mean().alias("_m"))
    glob = pts.agg(_mean().alias("_g"), F.count(F.lit(1)).alias("_total"))
    j = spread_join(pts, cent, label).select(label, _sq("v", F.col("_m")).alias("_d2"))
    per = j.groupBy(label).agg(F.sum("_d2").alias("_w"), F.avg(F.sqrt("_d2")).alias("_s"))
    cl = _materialize(cent.join(per, label))
    both = _with_summaries(cl, cl.select(F.col(label).alias("l"), F.col("_s").alias("s"), F.col("_m").alias("m")))
    ratio = F.transform(F.filter("_all", lambda o: o["l"] != F.col(label)),
                        lambda o: safe_div(o["s"] + F.col("_s"), F.sqrt(_sq(o["m"], F.col("_m")))))
    k = F.lit(1)
    s = (both.withColumn("_db", F.array_max(ratio)).withColumn("_k", k).join(F.broadcast(glob.withColumn("_k", k)), "_k")
         .agg(F.sum("_w").alias("inertia"), F.sum(F.col("_n") * _sq("_m", F.col("_g"))).alias("_b"),
              F.avg("_db").alias("davies_bouldin"), F.count(F.lit(1)).alias("k"), F.max("_total").alias("n")))
    return s.select("k", "n", "inertia",
                    safe_div(safe_div(F.col("_b"), F.col("k") - 1), safe_div(F.col("inertia"), F.col("n") - F.col("k")))
                    .alias("calinski_harabasz"), "davies_bouldin")


def silhouette_sq(df: DataFrame, cols, label: str, id_col: str) -> DataFrame:
    """C11 (squared-Euclidean form): per-point silhouette from cluster moments.

    Mean squared distance from x to the points of cluster C is
    |x − m_C|² + Q_C (m_C the centroid, Q_C the mean squared distance to it); for the own cluster
    the point itself is excluded (× n_C / (n_C − 1)).  Exact, O(n·k·p), no pairs of points.
    Returns (id, label, silhouette); a singleton cluster gets 0.
    """
    pts = vectors.points(df, cols, [id_col, label])
    cent = pts.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), _mean().alias("_m"))
    q = spread_join(pts, cent, label).groupBy(label).agg(F.avg(_sq("v", F.col("_m"))).alias("_q"))
    cl = _materialize(cent.join(q, label).select(F.col(label).alias("l"), F.col("_n").alias("n"),
                                                 F.col("_m").alias("m"), F.col("_q").alias("q")))
    d = F.transform("_all", lambda o: F.struct(o["l"].alias("l"), o["n"].alias("n"),
                                               (_sq(F.col("v"), o["m"]) + o["q"]).alias("d")))
    j = _with_summaries(pts, cl).select(id_col, label, d.alias("_d"))
    own = F.filter("_d", lambda o: o["l"] == F.col(label))[0]
    j = j.select(id_col, label, F.when(own["n"] > 1, own["d"] * own["n"] / (own["n"] - 1)).alias("_a"),
                 F.array_min(F.transform(F.filter("_d", lambda o: o["l"] != F.col(label)), lambda o: o["d"])).alias("_b"))
    a, b = F.col("_a"), F.col("_b")
    sil = F.when(a.isNull(), F.lit(0.0)).otherwise(F.coalesce(safe_div(b - a, F.greatest(a, b)), F.lit(0.0)))
    return j.select(id_col, label, sil.alias("silhouette"))


def profile(df: DataFrame, cols, label: str, noise=-1) -> DataFrame:
    """A20 + C16: size, percent, mean and std of each column per cluster (noise skipped)."""
    x = df.where(F.col(label) != noise)
    tot = x.agg(F.count(F.lit(1)).alias("_t"))
    g = x.groupBy(label).agg(F.count(F.lit(1)).alias("n"),
                             *[y for c in cols for y in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])
    g = g.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k")
    return g.select(label, "n", (F.col("n") / F.col("_t") * 100).alias("pct"),
                    *[y for c in cols for y in (f"{c}_mean", f"{c}_std")])


def _sweep_table(spark, ks, rows: list[dict], names) -> DataFrame:
    got = [(int(k), *[None if r[n] is None else float(r[n]) for n in names]) for k, r in zip(ks, rows)]
    return spark.createDataFrame(got, "k int, " + ", ".join(f"{n} double" for n in names))


def _best(out: DataFrame, *order) -> DataFrame:
    """``best`` marks the first row of a sweep's table (a row for each k) by the order."""
    return out.withColumn("best", F.row_number().over(Window.orderBy(*order)) == 1)


def kmeans_sweep(df: DataFrame, cols, id_col: str, k_values=range(2, 11), restarts: int = 10,
                 seed: int = 42) -> DataFrame:
    """C2 + C9: k-means for each k with inertia, squared-Euclidean silhouette,
    Calinski–Harabasz and Davies–Bouldin; ``best`` marks the max silhouette
    (first k on ties).  Every restart of every k moves in the same passes, two more passes score all of them."""
    x, ks = _by(df, cols, id_col), list(k_values)
    found = fits.kmeans_best(x, id_col, ks, restarts, seed)
    rows = fits.evaluate(fits.labelled(x, [found[k][0] for k in ks]), len(ks))
    out = _sweep_table(df.sparkSession, ks, rows, ["inertia", "silhouette", "calinski_harabasz", "davies_bouldin"])
    return _best(out, F.col("silhouette").desc_nulls_last(), "k")


def _mixtures(x: DataFrame, id_col: str, ks, seed: int, restarts: int = 1) -> list:
    """Gaussian mixtures from the k-means solutions of the same seed."""
    found = fits.kmeans_best(x, id_col, ks, restarts, seed)
    return fits.mixtures(x, [found[k][0] for k in ks])


def gmm(df: DataFrame, cols, id_col: str, k: int, seed: int = 42, standardize: bool = True):
    """Gaussian mixture with full covariances; (labels (id, label), :class:`.fits.Mixture`)."""
    x = _by(df, cols, id_col, standardize)
    m = _mixtures(x, id_col, [k], seed)[0]
    return fits.labelled(x, [m], [id_col]).select(id_col, F.col("labels")[0].alias("label")), m


def gmm_sweep(df: DataFrame, cols, id_col: str, k_values=range(1, 11), seed: int = 42) -> DataFrame:
    """C5 + C6: Gaussian mixtures (full covariance) on standardised points for each k, with log-likelihood, BIC, AIC and
    squared-Euclidean silhouette (null for k = 1, whose fit is the points' own mean and covariance);
    params = (k−1) + k·p + k·p(p+1)/2; ``best`` marks the least BIC."""
    x, ks = _by(df, cols, id_col), list(k_values)
    models = _mixtures(x, id_col, ks, seed)
    rows = fits.evaluate(fits.labelled(x, models), len(ks))
    for m, r in zip(models, rows):
        r |= {"log_likelihood": m.loglik, "bic": -2 * m.loglik + m.parameters() * math.log(r["n"]), "aic": -2 * m.loglik + 2 * m.parameters()}
    return _best(_sweep_table(df.sparkSession, ks, rows, ["log_likelihood", "bic", "aic", "silhouette"]), "bic", "k")


def compare(df: DataFrame, cols, id_col: str, k: int, seed: int = 42, n_micro: int = 200) -> DataFrame:
    """C14: k-means, Ward and Gaussian mixture at the same k by mean silhouette (squared-Euclidean form)."""
    x = _by(df, cols, id_col)
    centers = fits.kmeans_best(x, id_col, [k], 10, seed)[k][0]
    tree = _ward_centers(x, id_col, [k], n_micro, seed)[k]
    mixture = _mixtures(x, id_col, [k], seed)[0]
    rows = fits.evaluate(fits.labelled(x, [centers, tree, mixture]), 3)
    got = [(name, r["silhouette"]) for name, r in zip(("kmeans", "ward", "gmm"), rows)]
    out = df.sparkSession.createDataFrame(got, "method string, silhouette double")
    return out.withColumn("best", F.col("silhouette") == max(s for _, s in got if s is not None))


#: Core points of two neighbouring cells whose product is compared directly; beyond it their nearest pair is searched.
DIRECT = 4096


def dbscan(df: DataFrame, id_col: str, cols, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """DBSCAN (the point itself counts towards ``min_samples``; noise = −1).

    Exact duplicates are first collapsed into one weighted point, so a hot location costs one row.  Border points take the
    smallest label of their core neighbours; a cluster's label is the smallest id among its core points.

    In up to three dimensions no list of pairs is formed (:func:`_dbscan_cells`); beyond, neighbourhoods come from the eps
    grid join.  Ids must be distinct.
    """
    cols = list(cols)
    pts = vectors.complete(df.select(F.col(id_col).alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols]))
    grp = _materialize(pts.groupBy(*cols).agg(F.min("_id").alias("i"), F.count(F.lit(1)).alias("_wt")))
    lab = _dbscan_cells(grp, cols, eps, min_samples) if len(cols) <= 3 else _dbscan_pairs(grp, cols, eps, min_samples)
    grp_lab = grp.select("i", *cols).join(lab, "i", "left")
    return (pts.join(grp_lab, cols)
            .select(F.col("_id").alias(id_col), F.coalesce(F.col("label"), F.lit(-1)).cast("long").alias("label")))


def _dbscan_pairs(grp: DataFrame, cols, eps: float, min_samples: int) -> DataFrame:
    """(i, label) of core and border points from all pairs within eps."""
    from .graph import components
    nb = _materialize(pairs.within(grp, "i", cols, eps).select("i", F.col("nbr").alias("j")))
    wt = grp.select(F.col("i").alias("j"), "_wt")
    cnt = nb.join(wt, "j").groupBy("i").agg(F.sum("_wt").alias("_nw"))
    core = _materialize(grp.join(cnt, "i", "left")
                        .where(F.col("_wt") + F.coalesce(F.col("_nw"), F.lit(0)) >= min_samples).select("i"))
    cc = nb.join(core, "i").join(core.withColumnRenamed("i", "j"), "j")
    linked = components(cc.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    lab = _materialize(core.join(linked.withColumnRenamed("id", "i"), "i", "left")
                       .select("i", F.coalesce("component", "i").alias("label")))
    border = (nb.join(lab.withColumnRenamed("i", "j"), "j").join(core, "i", "left_anti")
              .groupBy("i").agg(F.min("label").alias("label")))
    return lab.unionByName(border)


def _dbscan_cells(grp: DataFrame, cols, eps: float, min_samples: int) -> DataFrame:
    """(i, label) of core and border points over cells whose diagonal is eps.

    Points of one cell are neighbours.  A cell of ``min_samples`` points or more has only core points; the others hold
    fewer than that, so comparing their points with the cells around is linear in the points.  Two cells with core points
    are linked if their bounding boxes say so, else if some pair lies within eps: compared directly while the product of
    their sizes is small, otherwise by a nearest-neighbour search of the smaller one's points in the larger one.
    Clusters are the components of the cells' graph.
    """
    from .graph import components
    from .neighbours import distance, nearest
    d = len(cols)
    side = eps / math.sqrt(d) * (1 - 1e-9)
    reach = math.ceil(math.sqrt(d) * (1 + 1e-9))
    v = F.array(*[F.col(c) for c in cols])
    pts = _materialize(grp.select("i", "_wt", v.alias("v"), F.array(*[F.floor(F.col(c) / F.lit(side)).cast("long") for c in cols]).alias("c")))
    weight = pts.groupBy("c").agg(F.sum("_wt").alias("_cw"))
    around = F.array(*[F.array(*[F.lit(o).cast("long") for o in off]) for off in itertools.product(range(-reach, reach + 1), repeat=d)])

    def beside(rows: DataFrame) -> DataFrame:
        """Rows times the cells around their own (its own left out), as ``n``."""
        out = rows.withColumn("_o", F.explode(around)).where(F.exists("_o", lambda x: x != 0))
        return out.withColumn("n", F.zip_with("c", "_o", lambda a, b: a + b)).drop("_o")

    both = pts.join(weight, "c")
    sparse = _materialize(both.where(F.col("_cw") < min_samples))
    near = beside(sparse.select("i", "v", "c")).join(pts.select(F.col("c").alias("n"), F.col("v").alias("_v"), "_wt"), "n") \
        .where(distance(F.col("v"), F.col("_v")) <= eps).groupBy("i").agg(F.sum("_wt").alias("_nw"))
    few = _materialize(sparse.join(near, "i", "left").withColumn("core", F.col("_cw") + F.coalesce("_nw", F.lit(0)) >= min_samples))
    core = _materialize(both.where(F.col("_cw") >= min_samples).select("i", "v", "c").unionByName(few.where("core").select("i", "v", "c")))

    vec = array_to_vector("v")
    cells = _materialize(core.groupBy("c").agg(
        F.min("i").alias("first"), F.count(F.lit(1)).alias("k"),
        vector_to_array(Summarizer.min(vec)).alias("lo"), vector_to_array(Summarizer.max(vec)).alias("hi")))
    other = cells.select(*[F.col(x).alias(f"n_{x}" if x != "c" else "n") for x in cells.columns])
    pair = beside(cells).where(F.col("c") < F.col("n")).join(other, "n")
    least = F.sqrt(F.aggregate(F.zip_with(F.zip_with("n_lo", "hi", lambda a, b: a - b), F.zip_with("lo", "n_hi", lambda a, b: a - b),
                                          lambda a, b: F.greatest(a, b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x))
    most = F.sqrt(F.aggregate(F.zip_with(F.zip_with("n_hi", "lo", lambda a, b: a - b), F.zip_with("hi", "n_lo", lambda a, b: a - b),
                                         lambda a, b: F.greatest(F.abs(a), F.abs(b))), F.lit(0.0), lambda s, x: s + x * x))
    pair = _materialize(pair.withColumn("least", least).where(F.col("least") <= eps * (1 + 1e-9)).withColumn("sure", most <= eps * (1 - 1e-9))
                        .withColumn("large", F.col("k").cast("double") * F.col("n_k") > DIRECT))
    sure = pair.where("sure").select("first", "n_first")
    open_ = pair.where("not sure").select("c", "n", "first", "n_first", "k", "n_k", "large")
    mine, theirs = core.select("c", "v"), core.select(F.col("c").alias("n"), F.col("v").alias("_v"))
    small = open_.where("not large").join(mine, "c").join(theirs, "n") \
        .where(distance(F.col("v"), F.col("_v")) <= eps).select("first", "n_first").distinct()
    links = sure.unionByName(small)
    wide = open_.where("large")
    if not wide.isEmpty():
        g = F.concat_ws(":", "first", "n_first").alias("g")
        less = F.col("k") <= F.col("n_k")
        ends = wide.select(g, "first", "n_first", F.when(less, F.col("c")).otherwise(F.col("n")).alias("a"), F.when(less, F.col("n")).otherwise(F.col("c")).alias("b"))
        one = ends.join(core.select(F.col("c").alias("a"), "i", "v"), "a").select("g", "i", "v")
        two = ends.join(core.select(F.col("c").alias("b"), "i", "v"), "b").select("g", "i", "v")
        hit = nearest(one, two, 1).where(F.col("near")[0]["dist"] <= eps).select("g").distinct()
        links = links.unionByName(ends.join(hit, "g").select("first", "n_first"))
    linked = components(links.select(F.col("first").alias("src"), F.col("n_first").alias("dst")))
    named = cells.join(linked.withColumnRenamed("id", "first"), "first", "left").select("c", F.coalesce("component", "first").alias("label"))
    lab = _materialize(core.join(named, "c").select("i", "label", "v", "c"))
    rest = few.where("not core").select("i", "v", "c")
    own = rest.select("i", "v", F.col("c").alias("n")).unionByName(beside(rest).select("i", "v", "n"))
    border = own.join(lab.select(F.col("c").alias("n"), F.col("v").alias("_v"), "label"), "n") \
        .where(distance(F.col("v"), F.col("_v")) <= eps).groupBy("i").agg(F.min("label").alias("label"))
    return lab.select("i", "label").unionByName(border)


def _ward_tree(cent: np.ndarray, wts: np.ndarray):
    """Weighted Ward agglomeration of m items (driver side, m is bounded).

    Merge cost Δ(A, B) = n_A·n_B/(n_A + n_B)·|μ_A − μ_B|²; returns the merge list
    [(a, b)] in order, items numbered 0..m−1 and merged clusters m, m+1, ..."""
    m = len(wts)
    cen = cent.astype(float).copy()
    cnt = wts.astype(float).copy()
    ids = list(range(m))
    active = np.ones(m, dtype=bool)
    d2 = ((cen[:, None, :] - cen[None, :, :]) ** 2).sum(axis=2)
    cost = (cnt[:, None] * cnt[None, :]) / (cnt[:, None] + cnt[None, :]) * d2
    np.fill_diagonal(cost, np.inf)
    merges = []
    nxt = m
    for _ in range(m - 1):
        idx = np.argmin(cost)
        a, b = divmod(int(idx), m)
        merges.append((ids[a], ids[b]))
        na, nb = cnt[a], cnt[b]
        cen[a] = (na * cen[a] + nb * cen[b]) / (na + nb)
        cnt[a] = na + nb
        ids[a] = nxt
        nxt += 1
        active[b] = False
        cost[b, :] = np.inf
        cost[:, b] = np.inf
        row = (cnt[a] * cnt) / (cnt[a] + cnt) * ((cen - cen[a]) ** 2).sum(axis=1)
        row[~active] = np.inf
        row[a] = np.inf
        cost[a, :] = row
        cost[:, a] = row
    return merges


def _cut(merges, m: int, k: int) -> np.ndarray:
    """Flat labels of the m items when the tree is cut into k clusters."""
    parent = list(range(2 * m))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for t, (a, b) in enumerate(merges[: m - k]):
        new = m + t
        parent[find(a)] = new
        parent[find(b)] = new
    roots = [find(i) for i in range(m)]
    order = {}
    for r in roots:  # canonical: clusters numbered by their first item
        order.setdefault(r, len(order))
    return np.array([order[r] for r in roots])


def _ward_centers(x: DataFrame, id_col: str, k_values, n_micro: int, seed: int) -> dict:
    """{k: model} of one Ward tree over ``n_micro`` micro-clusters of the points, cut at each k."""
    centers, _ = fits.kmeans_best(x, id_col, [n_micro], 1, seed)[n_micro]
    weights = fits.sizes(x, centers)
    centers = centers[weights > 0]
    merges = _ward_tree(centers, weights[weights > 0])
    return {k: fits.Grouped(centers, _cut(merges, len(centers), min(k, len(centers)))) for k in k_values}


def ward(df: DataFrame, cols, id_col: str, k_values=(3,), n_micro: int = 200, seed: int = 42):
    """C3 + C4: Ward hierarchical clustering.

    The points are summarised by ``n_micro`` k-means micro-clusters (the distinct points themselves, if those are fewer),
    and Ward merges their weighted centroids; only those reach the driver, whatever the number of rows.  A point's label
    is its micro-cluster's.  Returns {k: DataFrame(id, label)}.
    """
    x, ks = _by(df, cols, id_col), list(k_values)
    models = _ward_centers(x, id_col, ks, n_micro, seed)
    lab = fits.labelled(x, [models[k] for k in ks], [id_col])
    return {k: lab.select(id_col, F.col("labels")[i].alias("label")) for i, k in enumerate(ks)}


def ward_sweep(df: DataFrame, cols, id_col: str, k_values=range(2, 11), n_micro: int = 200, seed: int = 42) -> DataFrame:
    """C4: one Ward tree, cut at every k, with silhouette (squared), CH and DB."""
    x, ks = _by(df, cols, id_col), list(k_values)
    models = _ward_centers(x, id_col, ks, n_micro, seed)
    rows = fits.evaluate(fits.labelled(x, [models[k] for k in ks]), len(ks))
    out = _sweep_table(df.sparkSession, ks, rows, ["silhouette", "calinski_harabasz", "davies_bouldin"])
    return _best(out, F.col("silhouette").desc_nulls_last(), "k")
