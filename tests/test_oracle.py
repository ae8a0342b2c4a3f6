"""Every registered query with an oracle SQL must equal DuckDB on the sf0.001 tables;
the others must keep the invariants stated here."""

import re

import pytest

from tools.oracle_check import TABLES, rows_of

from .conftest import SF_SMALL

import __spark_entry__ as entry_mod  # noqa: E402

QUERIES = entry_mod.queries()
SQL = entry_mod.oracle_sql()
VECTORS, PARTS = 500, 200


def labels(n, low=0):
    """One label in low..n-1 for each distinct id."""
    return lambda rows: len({r[0] for r in rows}) == len(rows) > 0 and all(low <= r["label"] < n for r in rows)


def metrics(*names):
    return lambda rows: {r["model"] for r in rows} == set(names) and all(
        r["mse"] >= 0 and abs(r["rmse"] ** 2 - r["mse"]) <= 1e-6 * r["mse"] and r["r2"] <= 1 for r in rows) and \
        [r["r2"] for r in rows] == sorted((r["r2"] for r in rows), reverse=True)


def sweep(low, high):
    return lambda rows: sorted(r["k"] for r in rows) == list(range(low, high + 1)) and sum(r["best"] for r in rows) == 1


def by_k(rows):
    return sorted(rows, key=lambda r: r["k"])


def falling(name, places=1e-9):
    return lambda rows: all(a[name] >= b[name] - places for a, b in zip(rows, rows[1:]))


INVARIANTS = {
    "boxcox": lambda rows: len(rows) > 0,
    "normality": lambda rows: all(0 < r["shapiro_francia_w"] <= 1 and 0 <= r["shapiro_francia_p"] <= 1
                                  and 0 <= r["ks_p"] <= 1 for r in rows) and len(rows) > 0,
    "auto_transform": lambda rows: len(rows) == PARTS,
    "impute_mice": lambda rows: len(rows) == PARTS and all(v is not None for r in rows for v in r),
    "louvain": lambda rows: len({r["id"] for r in rows}) == 25 and all(
        r["n_communities"] == len({x["community"] for x in rows}) and -0.5 <= r["modularity"] <= 1
        and r["community"] <= r["id"] for r in rows),
    "moran_perm": lambda rows: len(rows) == 1 and 1 / 1000 <= rows[0]["p_sim"] <= 0.501 and abs(rows[0]["EI_sim"]) < 0.02,
    "lisa": lambda rows: len(rows) == VECTORS and all(1 / 1000 <= r["p_sim"] <= 0.501 for r in rows),
    "kmeans": lambda rows: labels(10)(rows) and len(rows) == VECTORS,
    "pca_summary": lambda rows: falling("eigenvalue")(rows) and abs(rows[-1]["cumulative_variance"] - 1) < 1e-9,
    "pca_loadings": lambda rows: len(rows) > 0,
    "pca_scores": lambda rows: len(rows) == PARTS and abs(sum(r["PC1"] for r in rows)) < 1e-6,
    "component_rules": lambda rows: len(rows) == 1 and all(v >= 0 for v in rows[0]),
    "kmo_bartlett": lambda rows: all(0 <= r["kmo_variable"] <= 1 and r["bartlett_chi2"] >= 0 for r in rows),
    "linear_models": metrics("linear_regression", "ridge", "lasso", "elastic_net"),
    "linear_coefs": lambda rows: len(rows) == 18,
    "tree_importances": lambda rows: all(
        abs(sum(r["importance"] for r in rows if r["model"] == m) - 1) < 1e-9 for m in {r["model"] for r in rows}),
    "spatial_models": lambda rows: [r["model"] for r in rows] == ["SLM", "SEM", "SDM"],
    "factor_scores": lambda rows: len(rows) == PARTS,
    "parallel_analysis": lambda rows: falling("eigenvalue")(rows) and all(
        r["retained"] == (r["eigenvalue"] > r["threshold_95"]) for r in rows),
    "path_estimates": lambda rows: len(rows) == 1 and 1 <= rows[0]["avg_path_length"] <= rows[0]["diameter"]
    and rows[0]["effective_diameter"] <= rows[0]["diameter"] and 0.95 <= rows[0]["connected_share"] <= 1.05,
    "spectral": lambda rows: labels(5)(rows) and len(rows) == VECTORS and len({r["label"] for r in rows}) == 5,
    "full_pipeline": lambda rows: labels(3)(rows),
    "kernel_pca": lambda rows: len(rows) == VECTORS and abs(sum(r["KPC1"] for r in rows)) < 1e-6 and
    sum(r["KPC1"] ** 2 for r in rows) >= sum(r["KPC2"] ** 2 for r in rows) >= sum(r["KPC3"] ** 2 for r in rows) > 0,
    "kmeans_sweep": lambda rows: sweep(2, 10)(rows) and all(a["inertia"] > b["inertia"] for a, b in zip(by_k(rows), by_k(rows)[1:])),
    "gmm_sweep": lambda rows: sweep(1, 10)(rows) and all(r["bic"] > r["aic"] for r in rows)
    and [r["k"] for r in rows if r["silhouette"] is None] == [1] and min(rows, key=lambda r: r["bic"])["best"],
    "ward": lambda rows: sweep(2, 10)(rows) and all(-1 <= r["silhouette"] <= 1 for r in rows),
    "cluster_compare": lambda rows: {r["method"] for r in rows} == {"kmeans", "ward", "gmm"} and sum(r["best"] for r in rows) == 1,
    "boosted_trees": lambda rows: {r["model"] for r in rows} == {"boosted_depth_wise", "boosted_leaf_wise"} and all(
        abs(sum(r["importance"] for r in rows if r["model"] == m) - 1) < 1e-9 for m in {r["model"] for r in rows})
    and all(r["r2"] > 0 for r in rows) and len({r["r2"] for r in rows}) == 2,
    "robust_pca": lambda rows: falling("robust_eigenvalue")(rows),
}
#: Sweeps of many fits: their operators are tested with fewer fits in test_operators.py.
MANY_FITS = {"tree_models", "cluster_evolution", "cluster_table", "grid_search", "model_summary"}
#: Tested in tests/llm.
TRAINING_DATA = {n for n in QUERIES if re.match(r"op\d+_|pipeline$", n)}


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_every_other_query_has_an_invariant():
    assert set(QUERIES) - set(SQL) - MANY_FITS - TRAINING_DATA == set(INVARIANTS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert rows_of(scols, srows) == rows_of(dcols, drows)


@pytest.mark.parametrize("name", sorted(INVARIANTS))
def test_invariants(spark, name):
    assert INVARIANTS[name](QUERIES[name](spark, SF_SMALL).collect())
