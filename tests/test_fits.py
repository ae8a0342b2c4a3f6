"""Batched cluster fits, boosted trees, adaptive neighbours, imputation and kernel PCA against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowpanel.operators import boosting, cluster, fits, neighbours, pairs, prep, reduce, spectral, vectors


def frame(spark, x, **more):
    rows = [(i, [float(v) for v in r], *[c[i] for c in more.values()]) for i, r in enumerate(x)]
    kinds = "".join(f", {n} {'int' if isinstance(c[0], (int, np.integer)) else 'double'}" for n, c in more.items())
    return spark.createDataFrame([tuple(int(a) if isinstance(a, np.integer) else a for a in r) for r in rows], f"id long, v array<double>{kinds}").repartition(3)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    centers = np.array([[0, 0, 0], [8, 0, 1], [0, 9, -1], [7, 8, 5]])
    truth = rng.integers(0, 4, 240)
    return centers[truth] + rng.normal(size=(240, 3)), truth


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


# --- clusters ------------------------------------------------------------------------

def test_points_leave_incomplete_rows_out(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 0.0, 0.0)], "id long, a double, b double")
    assert {r.id for r in vectors.points(df, ["a", "b"], ["id"]).collect()} == {1, 4}
    assert {r.id for r in vectors.complete(df).collect()} == {1, 4}


def test_covariance_and_scaling(spark, blobs):
    x, _ = blobs
    n, mean, cov = vectors.covariance(vectors.points(frame(spark, x), "v"))
    assert n == len(x) and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T))
    z = np.array([r.v for r in vectors.standardised(vectors.points(frame(spark, np.c_[x, np.ones(len(x))]), "v", ["id"])).orderBy("id").collect()])
    assert np.allclose(z, np.c_[(x - x.mean(axis=0)) / x.std(axis=0), np.zeros(len(x))])


def test_kmeans_finds_planted_groups_in_canonical_order(spark, blobs):
    x, truth = blobs
    lab, cost = cluster.kmeans(frame(spark, x), "v", "id", 4, restarts=3)
    got = {r.id: r.label for r in lab.collect()}
    labels = [got[i] for i in range(len(x))]
    assert same_partition(labels, truth)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    means = np.array([z[np.array(labels) == k].mean(axis=0) for k in range(4)])
    assert [tuple(m) for m in means] == sorted(tuple(m) for m in means)
    assert abs(cost - sum(((z[i] - means[labels[i]]) ** 2).sum() for i in range(len(x)))) < 1e-6 * cost


def test_lloyd_keeps_an_empty_cluster(spark):
    pts = frame(spark, [[0.0], [1.0], [10.0], [11.0]]).select("v")
    (centers, cost), = fits.lloyd(pts, [np.array([[0.5], [10.5], [1000.0]])])
    assert centers.ravel().tolist() == [0.5, 10.5, 1000.0] and abs(cost - 1.0) < 1e-9


def brute_scores(x, labels):
    ids = sorted(set(labels))
    m = {c: x[labels == c].mean(axis=0) for c in ids}
    inertia = sum(((x[labels == c] - m[c]) ** 2).sum() for c in ids)
    between = sum((labels == c).sum() * ((m[c] - x.mean(axis=0)) ** 2).sum() for c in ids)
    k, n = len(ids), len(x)
    s = {c: np.sqrt(((x[labels == c] - m[c]) ** 2).sum(axis=1)).mean() for c in ids}
    db = np.mean([max((s[a] + s[b]) / np.linalg.norm(m[a] - m[b]) for b in ids if b != a) for a in ids])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    sil = []
    for i in range(n):
        own = (labels == labels[i]).sum()
        if own == 1:
            sil.append(0.0)
            continue
        a = d[i, labels == labels[i]].sum() / (own - 1)
        b = min(d[i, labels == c].mean() for c in ids if c != labels[i])
        sil.append((b - a) / max(a, b))
    return inertia, between / (k - 1) / (inertia / (n - k)), db, np.mean(sil)


def test_scores_equal_brute_force(spark, blobs):
    x, truth = blobs
    rng = np.random.default_rng(2)
    other = rng.integers(0, 3, len(x))
    other[0] = 7  # a cluster of one
    one = np.zeros(len(x), int)
    lab = frame(spark, x, a=truth, b=other, c=one).select(F.array("a", "b", "c").alias("labels"), "v")
    got = fits.evaluate(lab, 3)
    for row, labels in zip(got, (truth, other)):
        want = brute_scores(x, labels)
        assert np.allclose([row["inertia"], row["calinski_harabasz"], row["davies_bouldin"], row["silhouette"]], want)
    assert got[2]["k"] == 1 and got[2]["silhouette"] is None


def test_mixture_of_one_is_the_gaussian_of_the_points(spark, blobs):
    x, truth = blobs
    out = {r.k: r for r in cluster.gmm_sweep(frame(spark, x), "v", "id", [1, 4]).collect()}
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    cov = np.cov(z.T, bias=True) + 1e-6 * np.eye(3)
    y = np.linalg.solve(np.linalg.cholesky(cov), z.T)
    ll = -0.5 * ((y ** 2).sum() + len(z) * (np.linalg.slogdet(cov)[1] + 3 * np.log(2 * np.pi)))
    assert abs(out[1].log_likelihood - ll) < 1e-6 * abs(ll)
    assert abs(out[1].bic - (-2 * ll + 9 * np.log(len(z)))) < 1e-6 * abs(ll) and out[1].silhouette is None
    assert out[4].best and out[4].silhouette > 0.5
    lab, m = cluster.gmm(frame(spark, x), "v", "id", 4)
    got = {r.id: r.label for r in lab.collect()}
    assert same_partition([got[i] for i in range(len(x))], truth) and abs(m.weights.sum() - 1) < 1e-9


def test_ward_sweep_and_compare(spark, blobs):
    x, truth = blobs
    rows = {r.k: r for r in cluster.ward_sweep(frame(spark, x), "v", "id", [2, 4], n_micro=500).collect()}
    assert rows[4].silhouette > rows[2].silhouette and rows[4].best
    lab = {r.id: r.label for r in cluster.ward(frame(spark, x), "v", "id", [4], n_micro=40)[4].collect()}
    assert same_partition([lab[i] for i in range(len(x))], truth)
    got = cluster.compare(frame(spark, x), "v", "id", 4, n_micro=40).collect()
    assert {r.method for r in got} == {"kmeans", "ward", "gmm"} and any(r.best for r in got)


def test_kmeans_sweep_of_fewer_runs(spark, blobs):
    x, _ = blobs
    rows = cluster.kmeans_sweep(frame(spark, x), "v", "id", [2, 3, 4, 5], restarts=2).collect()
    assert [r.k for r in rows if r.best] == [4]
    by_k = sorted(rows, key=lambda r: r.k)
    assert all(a.inertia > b.inertia for a, b in zip(by_k, by_k[1:]))


def test_spectral_separates_rings(spark):
    rng = np.random.default_rng(5)
    angle = rng.uniform(0, 2 * np.pi, 160)
    truth = np.arange(160) % 2
    x = np.c_[np.cos(angle), np.sin(angle)] * np.where(truth, 4.0, 1.0)[:, None] + rng.normal(scale=.05, size=(160, 2))
    df = frame(spark, x).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    got = {r.id: r.label for r in spectral.spectral(df, ["x", "y"], "id", 2, n_neighbors=8, gamma=2.0).collect()}
    labels = np.array([got[i] for i in range(160)])
    assert same_partition(labels, truth) and labels[0] == 0


def test_leading_eigenvalues(spark):
    rng = np.random.default_rng(6)
    a = np.triu(rng.random((30, 30)) * (rng.random((30, 30)) < .3), 1)
    a = a + a.T
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "i long, j long, w double")
    top, rows = spectral.leading(edges, spark.range(30).select(F.col("id").alias("i")), 3, tol=1e-9)
    assert np.allclose(top, np.linalg.eigvalsh(a)[::-1][:3], atol=1e-5)
    v = np.array([r.v for r in rows.orderBy("i").collect()])
    assert np.allclose(a @ v, v * top, atol=1e-2) and np.allclose(v.T @ v, np.eye(3), atol=1e-6)


# --- kernel PCA -------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["rbf", "poly", "linear", "cosine"])
def test_kernel_pca_with_all_landmarks_is_exact(spark, blobs, kind):
    x = blobs[0][:60]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    k = reduce.kernel(kind, 1 / 3)(z, z)
    c = np.eye(60) - 1 / 60
    vals, vecs = np.linalg.eigh(c @ k @ c)
    want = (vecs * np.sqrt(np.clip(vals, 0, None)))[:, ::-1][:, :2]
    ratios, scores = reduce.kernel_pca(frame(spark, x), "v", "id", kind=kind, landmarks=60, k=2)
    got = np.array([[r.KPC1, r.KPC2] for r in scores.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert np.allclose(ratios, vals[::-1][:2] / np.clip(vals, 0, None).sum(), atol=1e-6)


def test_kernel_pca_with_few_landmarks_is_near(spark, blobs):
    x, truth = blobs
    _, scores = reduce.kernel_pca(frame(spark, x), "v", "id", landmarks=40, k=2)
    got = np.array([[r.KPC1, r.KPC2] for r in scores.orderBy("id").collect()])
    assert got.shape == (240, 2) and np.abs(got.mean(axis=0)).max() < 1e-9
    with pytest.raises(ValueError):
        reduce.kernel_pca(frame(spark, x), "v", "id", kind="none")


# --- boosted trees -------------------------------------------------------------------------

def brute_tree(x, g, rows, depth, p, out, feature=None):
    """Greedy tree by trying every split of every feature on the rows; appends (feature, threshold, missing left, rows)."""
    def score(r):
        return g[r].sum() ** 2 / (len(r) + p.l2) if len(r) + p.l2 else 0.0
    best = (p.min_gain + 1e-9, None)
    if depth:
        for missing_left in (False, True):
            for f in range(x.shape[1]):
                for t in np.unique(x[rows, f][~np.isnan(x[rows, f])]):
                    nan = np.isnan(x[rows, f])
                    left = np.where(nan, missing_left, x[rows, f] <= t)
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < max(1, p.min_rows, p.min_hessian):
                        continue
                    gain = (score(a) + score(b) - score(rows)) / 2
                    if gain > best[0] + 1e-7:
                        best = (gain, (f, t, missing_left, a, b))
    if best[1] is None:
        out.append((rows, -p.rate * g[rows].sum() / (len(rows) + p.l2)))
        return
    *_, a, b = best[1]
    brute_tree(x, g, a, depth - 1, p, out)
    brute_tree(x, g, b, depth - 1, p, out)


@pytest.mark.parametrize("preset", [boosting.Preset.depth_wise(rounds=12, max_depth=3), boosting.Preset.depth_wise(rounds=3, max_depth=2, l2=0.0, min_gain=1.0),
                                    boosting.Preset.leaf_wise(rounds=12, max_depth=3, min_rows=10)], ids=["depth", "gain", "leaf"])
def test_boosting_equals_greedy_search(spark, preset):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(150, 4)), 1)
    x[rng.random(x.shape) < .1] = np.nan
    y = np.nan_to_num(x[:, 0]) * 3 + np.where(np.nan_to_num(x[:, 1], nan=2.0) > 0, 2, -1) + rng.normal(scale=.1, size=150)
    margin = np.full(150, y.mean())
    for _ in range(preset.rounds):
        leaves = []
        brute_tree(x, margin - y, np.arange(150), preset.max_depth, preset, leaves)
        for rows, w in leaves:
            margin[rows] += w
    df = frame(spark, x, y=[float(v) for v in y])
    cuts = [np.unique(c[~np.isnan(c)]) for c in x.T]
    model = boosting.fit(df, "y", "v", preset, cuts=cuts)
    got = {r.id: r.prediction for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(150)], margin, atol=1e-6)
    share = model.importances()
    assert abs(share.sum() - 1) < 1e-9 and share[:2].sum() > 0.8


def test_leaf_limit_takes_the_best_splits_first(spark):
    x = np.arange(64, dtype=float)[:, None]
    y = np.where(x[:, 0] < 32, 0.0, 100.0) + (x[:, 0] % 32 >= 16) * np.where(x[:, 0] < 32, 1.0, 10.0)
    df = frame(spark, x, y=[float(v) for v in y])
    model = boosting.fit(df, "y", "v", boosting.Preset.leaf_wise(rounds=1, rate=1.0, leaves=3, min_rows=1))
    got = [r.prediction for r in model.transform(df).orderBy("id").collect()]
    assert sorted(set(np.round(got, 6))) == [0.5, 100.0, 110.0]  # the right half was split, the left was not


def test_presets_differ_and_edge_cases(spark):
    assert boosting.Preset.depth_wise() != boosting.Preset.leaf_wise()
    df = frame(spark, np.ones((5, 2)), y=[3.0] * 5)
    model = boosting.fit(df, "y", "v", boosting.Preset.depth_wise(rounds=2))
    assert {r.prediction for r in model.transform(df).collect()} == {3.0}
    with pytest.raises(ValueError):
        boosting.fit(df.where("id < 0"), "y", "v")
    with pytest.raises(ValueError):
        boosting.fit(df, "y", "v", max_bins=1000)


# --- neighbours and imputation ---------------------------------------------------------------

def brute_nearest(q, c, k):
    """Per query row: [(distance, id)] of the k nearest candidates."""
    d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(axis=2))
    return [[(d[i, j], j) for j in sorted(range(len(c)), key=lambda j: (d[i, j], j))[:k]] for i in range(len(q))]


def test_nearest_in_a_dense_cell(spark):
    """Half of the points lie, all different, in what is one cell of a grid over the other half."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.random((400, 2)) * 1000, 500 + rng.random((400, 2)) * 1e-3, [[500.0, 500.0]] * 5])
    df = frame(spark, x).withColumn("g", F.lit("a")).withColumnRenamed("id", "i")
    near = {tuple(r.v): [(n.dist, n.i) for n in r.near] for r in neighbours.nearest(df, df, 4).collect()}
    for v, want in zip(x, brute_nearest(x, x, 4)):
        got = near[tuple(v)]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([d for d, _ in got], [d for d, _ in want])


def test_leaves_stay_small(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.random((1500, 2)), 0.5 + rng.random((1500, 2)) * 1e-6])
    spots = neighbours.spots(frame(spark, x).select(F.lit("a").alias("g"), F.col("id").alias("i"), "v"), 2)
    leaves, levels = neighbours.partition(spots)
    sizes = [r["count"] for r in leaves.groupBy("g", "path").count().collect()]
    assert max(sizes) <= neighbours.LEAF and sum(sizes) == 3000 and len(levels) < 40


def test_groups_do_not_mix_and_few_candidates(spark):
    df = spark.createDataFrame([("a", 1, [0.0]), ("a", 2, [5.0]), ("b", 3, [0.1]), ("c", 4, [1.0])], "g string, i long, v array<double>")
    got = {(r.g, tuple(r.v)): [n.i for n in r.near] for r in neighbours.nearest(df, df.where("g <> 'c'"), 3).collect()}
    assert got == {("a", (0.0,)): [1, 2], ("a", (5.0,)): [2, 1], ("b", (0.1,)): [3]}


def test_knn_of_clustered_points_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.random((100, 2)), 3 + rng.random((200, 2)) * 1e-4, [[50.0, -50.0]]])
    df = frame(spark, x).select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    got = {}
    for r in pairs.knn(df, "id", ["x", "y"], k=3).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.nbr
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert [got[i][k] for k in (1, 2, 3)] == sorted(range(len(x)), key=lambda j: (d[i, j], j))[:3]


def test_knn_imputation_uses_every_donor(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(120, 4)), 2)
    x[rng.random(x.shape) < .25] = np.nan
    x[0] = np.nan  # nothing known
    x[1, 1:], x[2, 0] = np.nan, np.nan
    want = x.copy()
    for i in range(len(x)):
        for j in range(4):
            if np.isnan(x[i, j]):
                cand = []
                for d in range(len(x)):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[d])
                    if not np.isnan(x[d, j]) and both.any():
                        cand.append((np.sqrt(((x[i, both] - x[d, both]) ** 2).sum()) * np.sqrt(4 / both.sum()), d))
                want[i, j] = np.mean([x[d, j] for _, d in sorted(cand)[:3]]) if cand else np.nanmean(x[:, j])
    cols = ["a", "b", "c", "d"]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double").withColumn("donor", F.lit("clash")).repartition(3)
    got = {r.id: [r[c] for c in cols] for r in prep.knn_impute(df, cols, "id", k=3).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_dbscan_of_dense_cells_equals_brute_force(spark, dims):
    """Half of the points, all different, within one cell; chains, border points and noise around."""
    rng = np.random.default_rng(12 + dims)
    x = np.concatenate([rng.random((150, dims)) * 12, 3 + rng.random((150, dims)) * .2, 3.35 + rng.random((120, dims)) * .2, [[3.0] * dims] * 4])
    eps, least = 0.5, 5
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = (d <= eps).sum(axis=1) >= least
    label = {}
    for i in np.flatnonzero(core):
        if i in label:
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero((d[todo.pop()] <= eps) & core):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        label |= {j: min(seen) for j in seen}
    for i in np.flatnonzero(~core):
        label[i] = min((label[j] for j in np.flatnonzero((d[i] <= eps) & core)), default=-1)
    names = [f"x{k}" for k in range(dims)]
    df = frame(spark, x).select("id", *[F.col("v")[k].alias(n) for k, n in enumerate(names)])
    got = {r.id: r.label for r in cluster.dbscan(df, "id", names, eps, least).collect()}
    assert got == {int(i): int(v) for i, v in label.items()}


def test_mcd_ignores_planted_outliers(spark):
    rng = np.random.default_rng(13)
    true = np.array([[2.0, 0.8, 0.0], [0.8, 1.0, 0.3], [0.0, 0.3, 0.5]])
    clean = rng.multivariate_normal([1, 2, 3], true, 260)
    x = np.concatenate([clean, rng.normal([15, -12, 9], .3, size=(100, 3))])
    pts = frame(spark, x)
    est = reduce.mcd(pts, "id", starts=50)
    assert est["h"] == 182 and 235 <= est["used"] <= 260
    assert np.allclose(est["mean"], clean.mean(axis=0), atol=0.15) and np.allclose(est["cov"], np.cov(clean.T), atol=0.35)
    # a fixed point: the h rows nearest to the raw estimate have its determinant
    d = reduce._mahalanobis(x, est["raw_mean"], est["raw_cov"])
    near = x[np.argsort(d)[:182]]
    assert abs(np.linalg.slogdet(np.cov(near.T, bias=True))[1] - np.linalg.slogdet(est["raw_cov"])[1]) < 1e-6
    assert abs(reduce._chi2_ppf(0.975, 3) - 9.3484) < 1e-3


def test_mcd_finds_the_least_determinant_of_few_rows(spark):
    """Against every subset of h rows."""
    import itertools
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(size=(7, 2)), rng.normal(size=(3, 2)) + 8])
    est = reduce.mcd(frame(spark, x), "id", starts=300)
    least = min(np.linalg.slogdet(np.cov(x[list(c)].T, bias=True))[1] for c in itertools.combinations(range(10), est["h"]))
    assert abs(np.linalg.slogdet(est["raw_cov"])[1] - least) < 1e-9


@pytest.mark.parametrize("metric", neighbours.METRICS)
def test_nearest_by_metric_equals_brute_force(spark, metric):
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(size=(60, 3)) * [1, 5, .2], rng.normal(size=(30, 3)) * 1e-3 + 2, [[0.0, 0.0, 0.0]], [[1.0, 1.0, 1.0]]])
    inv = np.linalg.inv(np.cov(x.T))
    live = np.ones(len(x), bool)
    if metric in ("cosine", "correlation"):
        u = x - x.mean(axis=1, keepdims=True) if metric == "correlation" else x
        live = np.linalg.norm(u, axis=1) > 0
        with np.errstate(invalid="ignore"):
            u = u / np.linalg.norm(u, axis=1, keepdims=True)
    diff = x[:, None] - x[None]
    d = {"euclidean": lambda: np.sqrt((diff ** 2).sum(axis=2)), "sqeuclidean": lambda: (diff ** 2).sum(axis=2),
         "cityblock": lambda: np.abs(diff).sum(axis=2), "chebyshev": lambda: np.abs(diff).max(axis=2),
         "seuclidean": lambda: np.sqrt((diff ** 2 / x.var(axis=0, ddof=1)).sum(axis=2)),
         "mahalanobis": lambda: np.sqrt(np.einsum("ijk,kl,ijl->ij", diff, inv, diff)),
         "cosine": lambda: 1 - u @ u.T, "correlation": lambda: 1 - u @ u.T}[metric]()
    d = np.where(live[None] & live[:, None], d, np.inf)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in neighbours.nearest_by(frame(spark, x).select(F.col("id").alias("i"), "v"), 2, metric).collect():
        got.setdefault(r.i, []).append((r["rank"], r.dist, r.nbr))
    assert set(got) == set(np.flatnonzero(live).tolist())
    for i, own in got.items():
        near = np.sort(d[i])[:2]
        assert np.allclose([v for _, v, _ in sorted(own)], near, atol=1e-6)
        assert all(abs(d[i, j] - v) < 1e-6 for _, v, j in own) and len({j for *_, j in own}) == 2


def test_unknown_metric_raises(spark):
    with pytest.raises(ValueError):
        neighbours.nearest_by(frame(spark, [[0.0]]).select(F.col("id").alias("i"), "v"), 1, "canberra")


def test_tree_models_are_fitted_on_no_more_partitions_than_the_rows_need(spark, monkeypatch):
    from flowpanel.operators import predict
    rows = [(i, float(i % 7 + i % 3), float(i % 7), float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y double, a double, b double").repartition(64)
    real, seen = predict.estimators, []

    class Probe:
        def __init__(self, est):
            self.est = est

        def fit(self, train):
            seen.append((train.rdd.getNumPartitions(), train.count()))
            return self.est.fit(train)

    monkeypatch.setattr(predict, "estimators", lambda n: {k: Probe(e) for k, e in real(n).items()})
    got = predict.fit_all(df, "id", "y", ["a", "b"], ["decision_tree", "linear_regression"])
    n = predict.split(df, "id")[0].count()
    assert seen == [(1, n), (1, n)] and got["decision_tree"][1]["r2"] > 0.9
    seen.clear()
    predict.fit_all(df.coalesce(5), "id", "y", ["a", "b"], ["decision_tree"])
    assert seen == [(5, n)]


def test_boosting_passes_read_no_more_partitions_than_the_rows_need(spark, monkeypatch):
    from flowpanel.operators import boosting
    rows = [(float(i % 7 + i % 3), float(i % 7), float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "y double, a double, b double").repartition(64)
    real, seen = boosting.summed, []

    def summed(pts, *rest):
        seen.append(pts.rdd.getNumPartitions())
        return real(pts, *rest)

    monkeypatch.setattr(boosting, "summed", summed)
    model = boosting.fit(df, "y", ["a", "b"], boosting.Preset.depth_wise(rounds=2))
    assert set(seen) == {1} and len(model.trees) == 2


def test_long_sums_of_a_fit_are_added_up_before_the_driver(spark, blobs, monkeypatch):
    real, seen = fits.summed, []

    def summed(pts, step, direct=False):
        got = real(pts, step, direct)
        seen.append((direct, sum(len(a) for a in got.values())))
        return got

    monkeypatch.setattr(fits, "summed", summed)
    pts = frame(spark, blobs[0])
    rng = np.random.default_rng(3)
    wide = frame(spark, rng.normal(size=(90, 40)))
    starts = [blobs[0][:4], blobs[0][5:9]]
    few = fits.lloyd(pts, starts, 5)
    fits.lloyd(wide, [rng.normal(size=(60, 40)) for _ in range(2)], 2)
    fits.mixtures(wide, [rng.normal(size=(4, 40))], 2)
    assert any(d for d, _ in seen) and all(n <= 2 * vectors.DIRECT for d, n in seen if d)
    assert max(n for d, n in seen if not d) > vectors.DIRECT
    monkeypatch.setattr(fits, "DIRECT", 0)
    for (a, x), (b, y) in zip(few, fits.lloyd(pts, starts, 5)):
        assert np.allclose(a, b) and x == pytest.approx(y)


def test_wide_neighbours_compare_blocks_of_pairs(spark, monkeypatch):
    """From 16 coordinates on no tree is searched; copies, ties and candidates of their own as by brute force."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, size=(300, 20)).astype(float)
    x[40:60] = x[0]
    cols = [f"f{j}" for j in range(20)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(900, None, *map(float, x[0][1:]))],
                               "id long, " + ", ".join(f"{c} double" for c in cols)).repartition(3)

    def stop(*_):
        raise AssertionError("a tree was searched")

    monkeypatch.setattr(neighbours, "nearest", stop)
    monkeypatch.setattr(pairs, "SIDE", 90)
    monkeypatch.setattr(pairs, "CHUNK", 32)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {}
    for r in pairs.knn(df, "id", cols, k=4).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nbr"], r["dist"]))
    assert len(got) == 300
    for i in range(300):
        want = sorted((d[i, j], j) for j in range(300) if j != i)[:4]
        assert [(r, n) for r, n, _ in sorted(got[i])] == [(r, j) for r, (_, j) in enumerate(want, 1)]
        assert np.allclose([e for _, _, e in sorted(got[i])], [e for e, _ in want])
    some = pairs.knn(df, "id", cols, k=2, candidates=df.where("id % 50 = 7")).where("id = 3").orderBy("rank").collect()
    assert [r["nbr"] for r in some] == [j for _, j in sorted((d[3, j], j) for j in range(7, 300, 50))[:2]]


def test_first_bounds_come_from_the_own_leaf(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.random((900, 2)), np.repeat([[0.25, 0.25]], 5, axis=0)])
    df = frame(spark, x).select(F.lit("a").alias("g"), F.col("id").alias("i"), "v")
    points, levels = neighbours.partition(neighbours.spots(df, 3), 50)
    got = {tuple(r.v): r.bound for r in neighbours._first_bounds(df.select("g", "v").distinct(), points, levels, 3, "euclidean").collect()}
    least = {tuple(v): want[2][0] for v, want in zip(x, brute_nearest(x, x, 3))}
    assert got.keys() == least.keys() and all(got[v] is None or got[v] >= least[v] for v in got)
    assert sum(got[v] is not None and got[v] < 1.01 * least[v] + 1e-12 for v in got) > len(got) / 2


def _grid_rows(spark, n=3000):
    """(id, a, b, c, y) with at most 20 values in a feature, so that all implementations cut at the same places."""
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, k, n) for k in (20, 9, 3)], axis=1).astype(float)
    y = np.sin(x[:, 0]) * 5 + x[:, 1] * (x[:, 2] > 1) + rng.normal(0, 1, n)
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                                 "id long, a double, b double, c double, y double")


@pytest.mark.parametrize("task_rows", [1 << 20, 200])
def test_trees_grown_on_executors_equal_spark_ml(spark, monkeypatch, task_rows):
    from flowpanel.operators import forest, predict
    df, cols = _grid_rows(spark), ["a", "b", "c"]
    want, wanted = predict.fit_all(df, "id", "y", cols, ["decision_tree"])["decision_tree"]
    monkeypatch.setattr(forest, "LARGE", 0)
    monkeypatch.setattr(forest, "TASK_ROWS", task_rows)
    got, metrics = predict.fit_all(df, "id", "y", cols, ["decision_tree"])["decision_tree"]
    assert isinstance(got, forest.Forest) and not hasattr(got, "toDebugString")
    assert metrics.asDict() == pytest.approx(wanted.asDict(), rel=1e-9)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), rel=1e-9)
    assert (len(got.tops[0].feature) > 1) == (task_rows == 200)


@pytest.mark.parametrize("task_rows", [1 << 20, 500])
def test_forest_grown_on_executors(spark, monkeypatch, task_rows):
    from flowpanel.operators import forest, predict
    df, cols = _grid_rows(spark), ["a", "b", "c"]
    want, wanted = predict.fit_all(df, "id", "y", cols, ["random_forest"])["random_forest"]
    monkeypatch.setattr(forest, "LARGE", 0)
    monkeypatch.setattr(forest, "TASK_ROWS", task_rows)
    got, metrics = predict.fit_all(df, "id", "y", cols, ["random_forest"])["random_forest"]
    assert len(got.tops) == 100 and metrics["r2"] == pytest.approx(wanted["r2"], abs=0.02)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=0.05)
    again, same = predict.fit_all(df, "id", "y", cols, ["random_forest"])["random_forest"]
    assert same.asDict() == pytest.approx(metrics.asDict(), rel=1e-9)


def test_trees_of_awkward_rows():
    from flowpanel.operators import forest
    rng = np.random.default_rng(0)
    nodes, gains = forest.grow(np.zeros((5, 2), np.uint8), np.arange(5.0), np.ones(5), 30, 2, 2, rng)
    assert list(nodes.feature) == [-1] and nodes.value[0] == 2 and not gains.any()  # equal rows
    bins = np.arange(8, dtype=np.uint8)[:, None]
    nodes, gains = forest.grow(bins, np.full(8, 7.0), np.ones(8), 30, 8, 1, rng)
    assert list(nodes.feature) == [-1] and nodes.value[0] == 7  # a constant label
    nodes, gains = forest.grow(bins, np.arange(8.0) ** 2, np.ones(8), 30, 8, 1, rng)
    assert np.array_equal(nodes.value[nodes.at(bins)], np.arange(8.0) ** 2)
    nodes, _ = forest.grow(bins, np.arange(8.0) ** 2, np.ones(8), 1, 8, 1, rng)
    assert len(nodes.feature) == 3
    w = forest._weights(np.arange(100_000), 3, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
