"""Per-operator tests on small literal frames with hand-checked or brute-force values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowpanel.operators import graph, stats


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_exact_quantiles_match_numpy(spark):
    from flowpanel.functions.ranks import quantiles_wide
    rng = np.random.default_rng(7)
    vals = np.round(rng.normal(size=997) * 100, 2)
    vals[:300] = 5.0  # a hot value holding ~a third of the rows
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}
    got = quantiles_wide(df, [], "x", probs, n_buckets=7).first()
    for name, p in probs.items():
        assert got[name] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-9)


def test_average_rank_ties(spark):
    from flowpanel.functions.ranks import average_rank
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 5.0), (5, None)], "id int, v double")
    r = dict(_rows(average_rank(df, [], "v", "rk"), "id", "rk"))
    assert r == {1: 2.0, 2: 3.5, 3: 3.5, 4: 1.0, 5: None}


def test_gini_matches_formula(spark):
    from flowpanel.operators.stats import gini_theil
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, -1.0]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    g = gini_theil(df, ["a"], eps=1e-10).first()
    x = np.sort(np.array(vals) - min(vals) + 1e-10)
    n = len(x)
    expect = np.sum((2 * np.arange(1, n + 1) - n - 1) * x) / (n * x.sum())
    assert g["gini"] == pytest.approx(expect, rel=1e-12)


def test_kendall_tau_b_bruteforce(spark):
    from flowpanel.operators.stats import kendall_tau
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, 60).astype(float)
    y = (x + rng.integers(0, 4, 60)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = kendall_tau(df, ["x", "y"]).first()["tau"]
    s = 0.0
    tx = ty = 0
    for i in range(60):
        for j in range(i + 1, 60):
            dx, dy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s += dx * dy
            tx += dx != 0
            ty += dy != 0
    assert got == pytest.approx(s / math.sqrt(tx * ty), abs=1e-12)


def test_grid_knn_matches_bruteforce(spark):
    from flowpanel.operators.pairs import knn
    rng = np.random.default_rng(11)
    pts = rng.normal(size=(150, 3))
    pts[:40] = pts[0]  # duplicates
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id int, a double, b double, c double")
    got = {(r["id"], r["rank"]): (r["nbr"], r["dist"]) for r in knn(df, "id", ["a", "b", "c"], k=3).collect()}
    for i in range(150):
        d = np.sqrt(((pts - pts[i]) ** 2).sum(axis=1))
        order = sorted((float(d[j]), j) for j in range(150) if j != i)[:3]
        for r, (dist, j) in enumerate(order, start=1):
            assert got[(i, r)][1] == pytest.approx(dist, abs=1e-12)
            assert got[(i, r)][0] == j


def test_clustering_coefficient_triangle(spark):
    from flowpanel.operators.graph import clustering
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 1.0)], "src int, dst int, w double")
    got = dict(_rows(clustering(e, directed=False), "id", "clustering"))
    assert got[1] == pytest.approx(1.0)
    assert got[3] == pytest.approx(1.0 / 3.0)
    assert got[4] == 0.0


def test_pagerank_sums_to_one(spark):
    from flowpanel.operators.graph import pagerank
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 1, 1.0), (3, 4, 1.0)], "src int, dst int, w double")
    pr = pagerank(e, max_iter=60, tol=1e-10)
    assert sum(r["pagerank"] for r in pr.collect()) == pytest.approx(1.0, abs=1e-9)


def test_components(spark):
    from flowpanel.operators.graph import components
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (7, 8, 1.0)], "src int, dst int, w double")
    got = dict(_rows(components(e), "id", "component"))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_scale_standard_population_std(spark):
    from flowpanel.operators.prep import scale
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 7.0)], "id int, a double")
    out, _ = scale(df, ["a"], "standard")
    vals = np.array([1.0, 2, 3, 7])
    expect = (vals - vals.mean()) / vals.std()
    got = [r["a"] for r in out.orderBy("id").collect()]
    assert np.allclose(got, expect)


def test_silhouette_moments_bruteforce(spark):
    from flowpanel.operators.cluster import silhouette_sq
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    lab = np.array([0] * 15 + [1] * 20 + [2] * 5)
    x[lab == 1] += 3
    df = spark.createDataFrame([(i, int(lab[i]), *map(float, x[i])) for i in range(40)], "id int, l int, a double, b double")
    got = dict(_rows(silhouette_sq(df, ["a", "b"], "l", "id"), "id", "silhouette"))
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    for i in range(40):
        own = [j for j in range(40) if lab[j] == lab[i] and j != i]
        a = d2[i, own].mean()
        b = min(d2[i, lab == c].mean() for c in set(lab) if c != lab[i])
        assert got[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)


def test_moran_matches_numpy(spark):
    from flowpanel.operators.spatial import moran_global
    w = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 1, 1.0), (3, 4, 1.0), (4, 3, 1.0)], "i int, j int, w double")
    y = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 5.0), (4, 4.0)], "id int, v double")
    got = moran_global(w, y, "id", ["v"]).first()
    W = np.zeros((4, 4))
    for i, j, v in [(1, 2, .5), (1, 3, .5), (2, 1, 1), (3, 4, 1), (4, 3, 1)]:
        W[i - 1, j - 1] = v
    z = np.array([1.0, 2, 5, 4]) - 3.0
    assert got["I"] == pytest.approx(4 / W.sum() * (z @ W @ z) / (z @ z))


def test_dbscan_two_blobs_and_noise(spark):
    from flowpanel.operators.cluster import dbscan
    pts = [(i, 0.0 + 0.01 * i, 0.0) for i in range(6)] + [(10 + i, 5.0 + 0.01 * i, 5.0) for i in range(6)] + [(99, 9.0, -9.0)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    got = dict(_rows(dbscan(df, "id", ["x", "y"], eps=0.05, min_samples=3), "id", "label"))
    assert got[99] == -1
    assert {got[i] for i in range(6)} == {0}
    assert {got[10 + i] for i in range(6)} == {10}


def test_pca_eigenvalues_sum(spark):
    from flowpanel.operators.reduce import pca_fit
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    res = pca_fit(df, ["a", "b", "c"])
    assert res.eigenvalues.sum() == pytest.approx(3 * 50 / 49)


def test_betweenness_path_graph(spark):
    from flowpanel.operators.graph import betweenness
    # directed path 1→2→3→4 plus a shortcut 1→3 that is longer than 1→2→3
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (1, 3, 5.0)], "src int, dst int, w double")
    got = dict(_rows(betweenness(e, pivots=10, normalized=False), "id", "betweenness"))
    # pairs through 2: (1,3), (1,4); through 3: (1,4), (2,4)
    assert got == {1: 0.0, 2: 2.0, 3: 2.0, 4: 0.0}


def test_louvain_two_cliques(spark):
    from flowpanel.operators.graph import louvain, modularity
    a = [(i, j, 1.0) for i in range(1, 6) for j in range(i + 1, 6)]
    b = [(i, j, 1.0) for i in range(11, 16) for j in range(i + 1, 16)]
    e = spark.createDataFrame(a + b + [(5, 11, 0.1)], "src int, dst int, w double")
    lab = louvain(e)
    got = dict(_rows(lab, "id", "community"))
    assert {got[i] for i in range(1, 6)} == {1}
    assert {got[i] for i in range(11, 16)} == {11}
    assert modularity(e, lab) > 0.45


def test_knn_impute_bruteforce(spark):
    from flowpanel.operators.prep import knn_impute
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3))
    miss = [(5, 0), (17, 1), (33, 2), (40, 0)]
    rows = []
    for i in range(60):
        r = [float(v) for v in x[i]]
        for mi, mc in miss:
            if mi == i:
                r[mc] = None
        rows.append((i, *r))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {r["id"]: r for r in knn_impute(df, ["a", "b", "c"], "id", k=3).collect()}
    known = np.ones((60, 3), bool)
    for mi, mc in miss:
        known[mi, mc] = False
    for i, c in miss:
        d = []
        for j in range(60):  # every row that has the column, over the coordinates both have
            both = known[i] & known[j]
            if known[j, c] and both.any():
                d.append((float(np.sqrt(((x[j, both] - x[i, both]) ** 2).sum() * 3 / both.sum())), j))
        d = sorted(d)[:3]
        expect = np.mean([x[j, c] for _, j in d])
        assert got[i]["abc"[c]] == pytest.approx(expect, abs=1e-12)


def test_components_of_a_long_path(spark):
    import random
    from flowpanel.operators.graph import components
    ids = list(range(1000))
    random.Random(1).shuffle(ids)
    edges = [(a, b, 1.0) for a, b in zip(ids, ids[1:])] + [(5000, 5001, 1.0), (7000, 7000, 1.0)]
    got = dict(_rows(components(spark.createDataFrame(edges, "src long, dst long, w double")), "id", "component"))
    assert got == {**{i: 0 for i in range(1000)}, 5000: 5000, 5001: 5000, 7000: 7000}


def test_dbscan_long_chain(spark):
    from flowpanel.operators.cluster import dbscan
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(300)], "id long, x double, y double")
    assert {r["label"] for r in dbscan(df, "id", ["x", "y"], 1.5, 2).collect()} == {0}


@pytest.fixture(scope="module")
def awkward(spark):
    """A constant, an all-NULL and a usual column."""
    return spark.createDataFrame([(i, 3.0, None, float(i % 5)) for i in range(20)], "id int, k double, n double, v double")


@pytest.mark.parametrize("method", ["iqr", "zscore", "modified_zscore"])
def test_outliers_of_awkward_columns(awkward, method):
    from flowpanel.operators.prep import outlier_report
    got = dict(_rows(outlier_report(awkward, ["k", "n", "v"], method), "variable", "outliers_count"))
    assert got == {"k": 0, "v": 0}
    assert outlier_report(awkward.limit(0), ["k", "v"], method).collect() == []


def test_statistics_of_awkward_columns(awkward):
    from flowpanel.operators import stats
    assert {r["tau"] for r in stats.kendall_tau(awkward, ["k", "v"]).collect()} == {None}
    got = {r["variable"]: r for r in stats.gini_theil(awkward, ["k", "n", "v"]).collect()}
    assert abs(got["k"]["gini"]) < 1e-9 and abs(got["k"]["theil"]) < 1e-6 and "n" not in got
    assert {r["variable"] for r in stats.describe(awkward, ["k", "n", "v"]).collect()} == {"k", "n", "v"}
    assert stats.box_summary(awkward, "k", "v").count() == 5


def test_moran_and_metrics_of_constants(spark):
    from flowpanel.operators import predict, spatial
    pts = spark.createDataFrame([(i, float(i), float(i % 3), 2.0, float(i)) for i in range(12)],
                                "id long, x double, y double, k double, v double")
    w = spatial.knn_weights(pts, "id", ["x", "y"], 3)
    got = {r["variable"]: r["I"] for r in spatial.moran_global(w, pts, "id", ["k", "v"]).collect()}
    assert got["k"] is None and got["v"] > 0
    assert {r["Is"] for r in spatial.moran_local(w, pts, "id", "k").collect()} == {None}
    p = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "label double, prediction double")
    assert predict.metrics(p).first()["r2"] is None


def test_knn_impute_leaves_no_null(spark):
    from flowpanel.operators.prep import knn_impute
    rows = [(0, None, None, None), (1, 1.0, None, 2.0), (2, 2.0, 5.0, None), (3, 3.0, 7.0, 4.0), (4, None, 6.0, 5.0)]
    got = knn_impute(spark.createDataFrame(rows, "id long, a double, b double, c double"), ["a", "b", "c"], "id", k=2)
    got = {r["id"]: r for r in got.collect()}
    assert all(v is not None for r in got.values() for v in r)
    assert got[0]["b"] == pytest.approx(6.0) and got[1]["b"] == pytest.approx(6.0 + 1.0)


def test_permutations_are_bijections_and_many():
    from flowpanel.functions.perms import permute
    for n in (1, 2, 11, 25, 1000):
        for key in (0, -5, 1 << 62):
            assert sorted(permute(np.arange(n), np.full(n, key), n)) == list(range(n))
    assert len({tuple(permute(np.arange(11), np.full(11, k), 11)) for k in range(999)}) == 999
    spread = np.bincount(permute(np.zeros(22000, int), np.arange(22000), 11))
    assert abs(spread - 2000).max() < 250


def test_yearly_csv_with_bom_and_a_missing_year(spark, tmp_path):
    from flowpanel.sources import loaders
    for year, cells in ((2020, "1,2\n10,,3\n20,4,"), (2022, "1,2\n10,5,6")):
        head, *lines = cells.split("\n")
        (tmp_path / f"od_matrix_{year}.csv").write_bytes(("﻿origin," + head + "\n" + "\n".join(lines)).encode())
    got = loaders.read_yearly_od(spark, str(tmp_path), [2020, 2021, 2022])
    assert sorted(_rows(got, "src", "dst", "year", "value")) == [
        (10, 1, 2022, 5.0), (10, 2, 2020, 3.0), (10, 2, 2022, 6.0), (20, 1, 2020, 4.0)]
    with pytest.raises(FileNotFoundError):
        loaders.read_yearly_od(spark, str(tmp_path), [1999])
    (tmp_path / "dim.json").write_text('[{"nation": 1, "name": "a"}, {"nation": 2, "name": "b"}]')
    assert sorted(_rows(loaders.read_dimension(spark, str(tmp_path / "dim.json")), "nation", "name")) == [(1, "a"), (2, "b")]


def test_hot_group_is_spread(spark):
    """One group with nearly all rows: no task of the bounds join reads it whole."""
    from flowpanel.functions.ranks import spread_join
    df = spark.range(20000).selectExpr("if(id % 50 = 0, id % 7, -1) as g", "id as v")
    small = df.groupBy("g").agg(F.max("v").alias("m"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        out = spread_join(df, small, "g").withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in out.groupBy("p").count().collect()]
    finally:
        for k, v in (("adaptive.enabled", "true"), ("autoBroadcastJoinThreshold", "10485760"), ("shuffle.partitions", "8")):
            spark.conf.set(f"spark.sql.{k}", v)
    assert sum(sizes) == 20000 and max(sizes) < 0.12 * 20000


def test_sweeps_with_few_fits(spark):
    from flowpanel.operators import cluster, predict
    rng = np.random.default_rng(5)
    pts = [(i, float(c[0] + rng.normal(0, .2)), float(c[1] + rng.normal(0, .2)))
           for i, c in enumerate([(0, 0), (5, 5), (0, 5)] * 20)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    best = [r for r in cluster.kmeans_sweep(df, ["x", "y"], "id", range(2, 5), restarts=2).collect() if r["best"]]
    assert [r["k"] for r in best] == [3]
    ward = cluster.ward(df, ["x", "y"], "id", (3,), n_micro=12)[3].collect()
    assert {len({r["label"] for r in ward if r["id"] % 3 == k}) for k in range(3)} == {1}
    y = spark.createDataFrame([(i, float(i % 7), 3.0 * (i % 7) + 1) for i in range(120)], "id long, a double, y double")
    grid = predict.grid_search(y, "id", "y", ["a"], "decision_tree", {"maxDepth": [1, 4]}, k=3).collect()
    assert [r["maxDepth"] for r in grid] == [4.0, 1.0]


def test_knn_with_half_of_the_points_on_one_spot(spark):
    from flowpanel.operators.pairs import knn
    rng = np.random.default_rng(6)
    pts = [(i, 1.0, 1.0) for i in range(0, 400, 2)] + [(i, float(rng.random() * 3), float(rng.random() * 3)) for i in range(1, 400, 2)]
    got = {}
    for r in knn(spark.createDataFrame(pts, "id long, x double, y double"), "id", ["x", "y"], k=4).collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["nbr"]
    for i, x, y in pts:
        want = [j for _, j in sorted((math.dist((x, y), (a, b)), j) for j, a, b in pts if j != i)[:4]]
        assert [got[i][k] for k in range(1, 5)] == want


def test_path_estimates_from_sketches(spark):
    """A path graph: counts are small, so the sketches are exact."""
    n = 40
    e = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1)] + [(100, 101, 1.0), (5, 5, 1.0)], "src long, dst long, w double")
    got = {r["hops"]: r["pairs"] for r in graph.neighbourhood(e).collect()}
    assert got == {h: float(sum(min(i, h) + min(n - 1 - i, h) for i in range(n)) + (2 if h else 0)) for h in range(n)}
    r = graph.path_estimates(e).first()
    pairs = [abs(i - j) for i in range(n) for j in range(n) if i != j] + [1, 1]
    assert r["diameter"] == n - 1 and abs(r["avg_path_length"] - np.mean(pairs)) < 1e-9
    assert abs(r["connected_share"] - len(pairs) / ((n + 2) * (n + 1))) < 1e-9


def test_sketches_travel_by_block_not_by_edge(spark, monkeypatch):
    """Few vertices with many neighbours: copies of sketches are far fewer than edges, whatever the blocks, and so are the results."""
    e = spark.range(4800).selectExpr("concat('c', id % 1200) as src", "concat('s', (id * 7 + id div 1200) % 12) as dst", "1.0D as w").distinct()
    want = [tuple(r) for r in graph.neighbourhood(e).collect()]
    both = e.select("src", "dst").unionByName(e.selectExpr("dst as src", "src as dst")).distinct()
    sent = graph._dealt(both)[0].select("dst", "block").distinct().count()
    assert sent <= 1200 + 12 * spark.sparkContext.defaultParallelism < both.count() / 4
    monkeypatch.setattr(graph, "BLOCK", 400)
    dealt, blocks = graph._dealt(both)
    assert blocks >= 3 and dealt.select("src", "dst").exceptAll(both).isEmpty() and dealt.count() == both.count()
    assert dealt.select("block").distinct().count() <= blocks
    got = [tuple(r) for r in graph.neighbourhood(e).collect()]
    assert [h for h, _ in got] == [h for h, _ in want]  # estimates depend a little on the order of unions
    assert all(a == pytest.approx(b, rel=0.01) for (_, a), (_, b) in zip(got, want))


def test_band_weights_shuffle_points_not_pairs(spark):
    """The last join of the plan is the one of the cells; no exchange and no other join stands above it."""
    from flowpanel.operators.spatial import band_weights
    pts = spark.createDataFrame([(i, (i % 7) * 0.03, (i % 5) * 0.03) for i in range(60)], "id long, x double, y double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        w = band_weights(pts, "id", ["x", "y"], 0.05)
        plan = w._jdf.queryExecution().sparkPlan().toString().splitlines()
        got = {(r["i"], r["j"]): r["w"] for r in w.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    top = next(i for i, line in enumerate(plan) if "Join" in line)
    assert "_c0" in plan[top] and not any("Exchange" in line for line in plan[:top])
    at = {i: ((i % 7) * 0.03, (i % 5) * 0.03) for i in range(60)}
    inverse = {(i, j): 1 / math.dist(at[i], at[j]) for i in at for j in at if 0 < math.dist(at[i], at[j]) <= 0.05}
    total = {i: sum(v for (a, _), v in inverse.items() if a == i) for i in at}
    assert got.keys() == inverse.keys() and all(abs(got[k] - v / total[k[0]]) < 1e-12 for k, v in inverse.items())


def test_louvain_finds_a_chain_of_cliques(spark):
    """Every clique is one community, whichever half of the vertices moves first."""
    rows = [(8 * c + i, 8 * c + j, 1.0) for c in range(6) for i in range(8) for j in range(i)]
    rows += [(8 * c, 8 * c + 8, 1.0) for c in range(5)]
    for seed in (1, 2, 3):
        got = {r["id"]: r["community"] for r in graph.louvain(spark.createDataFrame(rows, "src long, dst long, w double"), seed=seed).collect()}
        assert all(got[8 * c + i] == got[8 * c] for c in range(6) for i in range(8))


def test_component_rules_take_the_parallel_count():
    from flowpanel.operators.reduce import PcaResult, component_rules
    res = PcaResult(["a", "b", "c", "d"], np.array([2.5, 1.2, 0.2, 0.1]), np.eye(4), 100)
    r = component_rules(res)
    assert (r["eigenvalue_rule"], r["variance_rule"], r["n_limited"]) == (2, 2, 2) and "parallel_rule" not in r
    assert component_rules(res, parallel=4)["n_components"] == 4


@pytest.mark.parametrize("x, w, p", [
    ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.78881, 0.006704),
    (list(range(1, 11)), 0.97016, 0.8924),
    ([1.0, 2.0, 4.0], 0.96429, 0.6369),
])
def test_shapiro_wilk_published_values(spark, x, w, p):
    """Values that the usual statistics packages give."""
    df = spark.createDataFrame([(float(v),) for v in x], "a double").repartition(2)
    r = stats.shapiro_wilk(df, ["a"]).first()
    assert abs(r["shapiro_w"] - w) < 2e-4 and abs(r["shapiro_p"] - p) < 2e-3


def test_shapiro_wilk_of_awkward_columns(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (1.0, 3.0, 2.0), (1.0, None, 5.0), (1.0, None, 5.0)], "a double, b double, c double")
    got = {r["variable"]: r["shapiro_w"] for r in stats.shapiro_wilk(df, ["a", "b", "c"]).collect()}
    assert got["a"] is None and "b" not in got and 0 < got["c"] < 1


def test_kendall_over_value_ranges_equals_bruteforce(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.where(rng.random(300) < 0.3, 7.0, rng.integers(0, 40, 300)).astype(float)  # a hot value gets its own range
    y = np.round(x / 4 + rng.normal(size=300) * 5)
    w = rng.integers(1, 4, 300)
    less = (x[:, None] < x[None]) & (y[:, None] > y[None])
    assert stats.inversions(x, y, w) == int((less * np.outer(w, w)).sum())
    monkeypatch.setattr(stats, "KENDALL_ROWS", 10)
    got = stats.kendall_tau(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), ["x", "y"]).first()["tau"]
    dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    assert got == pytest.approx((dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum()), rel=1e-12)


def test_shuffled_moments_equal_permuted_columns(spark, monkeypatch):
    from flowpanel.functions.perms import permute
    from flowpanel.operators import reduce
    monkeypatch.setattr(reduce, "PLACES", 16)
    monkeypatch.setattr(reduce, "TOGETHER", 20)
    n, p = 70, 3
    z = np.random.default_rng(5).normal(size=(n, p))
    keys = {(k, j): 1000 * k + j - 3 for k in range(4) for j in range(p)}
    zd = spark.createDataFrame([(d, [float(a) for a in row]) for d, row in enumerate(z)], "d long, v array<double>")
    got = {r["perm"]: np.array(r["s"]).reshape(p, p) for r in reduce._shuffled_moments(zd, keys, n, p).collect()}
    for k in range(4):
        x = np.zeros((n, p))
        for j in range(p):
            x[permute(np.arange(n), np.full(n, keys[k, j]), n), j] = z[:, j]
        assert np.allclose(got[k], x.T @ x)


def test_quantiles_by_digits_are_exact(spark):
    from flowpanel.operators import reduce, vectors
    x = np.random.default_rng(8).normal(size=(501, 2)) * np.array([1.0, 1e-9])
    x[:200, 0] = -0.25
    pts = vectors.points(spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double"), ["a", "b"])
    for share in (0.0, 0.3, 0.5, 251.5 / 500, 1.0):
        got = reduce._quantiles(pts, lambda v: v, 2, len(x), share)
        assert [got[j] for j in range(2)] == pytest.approx(list(np.quantile(x, share, axis=0)), rel=1e-12, abs=0)


def test_permutation_tests_look_values_up_as_the_joins_do(spark, monkeypatch):
    from flowpanel.operators import spatial
    rng = np.random.default_rng(4)
    pts = spark.createDataFrame([(3 * i, float(a), float(b), float(a + c)) for i, (a, b, c) in enumerate(rng.normal(size=(60, 3)))],
                                "id long, x double, y double, v double")
    w = spatial.knn_weights(pts, "id", ["x", "y"], 3).where("i % 7 != 3 or j % 2 = 0").checkpoint()  # unequal numbers of neighbours
    looked = [spatial.local_permutation(w, pts, "id", "v", 49), spatial.moran_permutation(w, pts, "id", "v", 49)]
    got = [sorted(f.collect()) for f in looked]
    monkeypatch.setattr(spatial, "LOOKUP", 0)
    joined = [spatial.local_permutation(w, pts, "id", "v", 49), spatial.moran_permutation(w, pts, "id", "v", 49)]
    for a, f in zip(got, joined):
        b = sorted(f.collect())
        assert len(a) == len(b)
        for r, q in zip(a, b):
            assert [x for x in r if not isinstance(x, float)] == [x for x in q if not isinstance(x, float)]
            assert [x for x in r if isinstance(x, float)] == pytest.approx([x for x in q if isinstance(x, float)])


@pytest.mark.parametrize("least", [1 << 26, 1])
def test_path_estimates_of_large_graphs_take_registers_in_slices(spark, monkeypatch, least):
    """Same hops, and sizes within the error of a sketch, whatever the slices; what a slice weighs follows the edges."""
    from flowpanel.operators import hops
    e = spark.range(9000).selectExpr("concat('c', id % 1500) as src", "concat('s', (id * 7 + id div 1500 * 31 + id % 13) % 300) as dst", "1.0D as w")
    e = e.unionByName(spark.createDataFrame([(f"x{i}", f"x{i + 1}", 1.0) for i in range(5)] + [("c1", "c1", 1.0), ("y", "y", 1.0), ("c2", None, 1.0)], e.schema))
    want = {r["hops"]: r["pairs"] for r in graph.neighbourhood(e, 7).collect()}
    monkeypatch.setattr(graph, "WHOLE", 100)
    monkeypatch.setattr(hops, "PART", 256)
    monkeypatch.setattr(hops, "LEAST", least)
    monkeypatch.setattr(hops, "HUB", 4)
    widths, run = [], hops._started
    monkeypatch.setattr(hops, "_started", lambda own, lo, width: (widths.append(width), run(own, lo, width))[1])
    got = {r["hops"]: r["pairs"] for r in graph.neighbourhood(e, 7).collect()}
    assert sum(widths) == 128 and (len(widths) > 1) == (least == 1) and max(widths) * 1800 <= max(least, 16 * 9008)
    assert got.keys() == want.keys() and got[0] == 0
    assert all(got[h] == pytest.approx(want[h], rel=0.3) for h in got if h)
    last = graph.neighbourhood(e, 7, max_hops=2).orderBy("hops").collect()
    assert [r["hops"] for r in last] == [0, 1, 2] and [r["pairs"] for r in last] == pytest.approx([got[h] for h in range(3)], rel=1e-5)
