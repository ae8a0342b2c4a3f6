"""Supervised prediction (M1–M14) and OLS by normal equations.

Models are spark.ml estimators on an assembled vector; the train/test split
and CV folds are deterministic hashes of the row id (no ``rand()``), so a
recomputed partition lands in the same fold.  OLS sums its (k+1)² Gramian in
one aggregate and solves the small system on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_div
from . import forest
from .boosting import BoostedRegressor, Preset
from .graph import packed
from .prep import apply_scale, scale_params
from .vectors import complete


def _hash_mod(id_col: str, seed: int, n: int):
    """Bucket 0..n−1 of an id by a hash that any SQL engine has."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 8)
    return F.pmod(F.conv(h, 16, 10).cast("long"), F.lit(n))


def split(df: DataFrame, id_col: str, test: float = 0.2, seed: int = 42):
    """M1: deterministic hash split (first 32 bits of md5("seed:id") mod 100 < 100·(1 − test) → train)."""
    b = _hash_mod(id_col, seed, 100)
    cut = int(round(100 * (1 - test)))
    return df.where(b < cut), df.where(b >= cut)


def fold_col(df: DataFrame, id_col: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    return df.withColumn(out, _hash_mod(id_col, seed + 1, k).cast("int"))


def _assemble(df: DataFrame, x_cols, out="features"):
    return VectorAssembler(inputCols=list(x_cols), outputCol=out, handleInvalid="skip").transform(df)


def prepare(df: DataFrame, id_col: str, y: str, x_cols, test: float = 0.2):
    """M1: split, then standard-scale with parameters fitted on the train part only."""
    data = complete(df.select(id_col, F.col(y).cast("double").alias("label"),
                              *[F.col(c).cast("double").alias(c) for c in x_cols]))
    train, test_ = split(data, id_col, test)
    p = scale_params(train, list(x_cols), "standard")
    return (_assemble(apply_scale(train, list(x_cols), p), x_cols),
            _assemble(apply_scale(test_, list(x_cols), p), x_cols))


def estimators(n_train: int) -> dict:
    """M2–M10 presets.  spark.ml's objective is (1/2n)·RSS + λ·penalty, so the
    sklearn-style α on (1/2n)·RSS for lasso / elastic net maps to λ = α, and ridge's
    α·|β|² on the plain RSS maps to λ = α / n."""
    return {
        "linear_regression": LinearRegression(regParam=0.0, solver="normal"),
        "ridge": LinearRegression(regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False),
        "lasso": LinearRegression(regParam=1.0, elasticNetParam=1.0, standardization=False),
        "elastic_net": LinearRegression(regParam=1.0, elasticNetParam=0.5, standardization=False),
        "decision_tree": DecisionTreeRegressor(maxDepth=30, seed=42),
        "random_forest": RandomForestRegressor(numTrees=100, maxDepth=15, seed=42),
        "gradient_boosting": GBTRegressor(maxIter=100, seed=42),
        "boosted_shallow": GBTRegressor(maxIter=100, stepSize=0.1, maxDepth=3, seed=42),
        # second-order boosting on histograms: 100 rounds, rate 0.1, depth 3
        "boosted_depth_wise": BoostedRegressor(Preset.depth_wise()),
        "boosted_leaf_wise": BoostedRegressor(Preset.leaf_wise()),
    }


def _fit(est, rows: DataFrame, n: int):
    """A fitted preset; trees and forests of more than :data:`.forest.LARGE` rows don't gather their nodes on the driver."""
    grown = isinstance(est, (DecisionTreeRegressor, RandomForestRegressor)) and n > forest.LARGE
    return forest.fit(est, rows) if grown else est.fit(rows)


def metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MSE, RMSE, MAE, R², MAPE (NULL when any label is 0), one aggregate."""
    y, p = F.col(label), F.col(prediction)
    e = y - p
    s = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
                 F.sum(e * e).alias("_sse"), F.var_pop(y).alias("_vy"), F.count(F.lit(1)).alias("_n"),
                 F.count_if(y == 0).alias("_z"), F.avg(F.abs(e / F.when(y != 0, y))).alias("_mape"))
    return s.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                    (1 - safe_div(F.col("_sse"), F.col("_vy") * F.col("_n"))).alias("r2"),  # NULL for a constant label
                    F.when(F.col("_z") == 0, F.col("_mape") * 100).alias("mape"))


def fit_all(df: DataFrame, id_col: str, y: str, x_cols, names=None) -> dict:
    """Fit each preset on the train split and evaluate it on the test split.

    Returns {name: (fitted model, one-row metrics)}, best R² first: the first is the best model."""
    train, test = prepare(df, id_col, y, x_cols)
    train, test = train.cache(), test.cache()
    n = train.count()
    est = estimators(n)
    got = {}
    # a tree model runs hundreds of passes, and its statistics of every node leave every partition
    own = packed(train, n)
    for name in (names or list(est)):
        model = _fit(est[name], own, n)
        got[name] = (model, metrics(model.transform(test)).first())
    train.unpersist()
    test.unpersist()
    low = float("-inf")
    return dict(sorted(got.items(), key=lambda kv: (-(low if kv[1][1]["r2"] is None else kv[1][1]["r2"]), kv[0])))


def train_all(df: DataFrame, id_col: str, y: str, x_cols, names=None) -> DataFrame:
    """One row of test metrics per model, sorted by R² (best first)."""
    rows = [(name, *[None if m[c] is None else float(m[c]) for c in ("mse", "rmse", "mae", "r2", "mape")], i == 0)
            for i, (name, (_, m)) in enumerate(fit_all(df, id_col, y, x_cols, names).items())]
    return df.sparkSession.createDataFrame(rows, "model string, mse double, rmse double, mae double, r2 double, "
                                                 "mape double, best boolean")


def coefficients(spark, fitted: dict, x_cols) -> DataFrame:
    """M2–M5: intercept and coefficients (on the standardised features) of the linear models of :func:`fit_all`."""
    rows = [(name, term, float(v)) for name, (m, _) in fitted.items() if hasattr(m, "coefficients")
            for term, v in [("intercept", m.intercept), *zip(x_cols, m.coefficients)]]
    return spark.createDataFrame(rows, "model string, term string, coef double")


def importances(spark, fitted: dict, x_cols) -> DataFrame:
    """Feature importances of the tree models of :func:`fit_all`, largest first within a model."""
    rows = [(name, c, float(v)) for name, (m, _) in fitted.items() if hasattr(m, "featureImportances")
            for c, v in sorted(zip(x_cols, m.featureImportances.toArray()), key=lambda t: (-t[1], t[0]))]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def cross_validate(df: DataFrame, id_col: str, y: str, x_cols, name: str = "linear_regression",
                   k: int = 5) -> DataFrame:
    """K-fold R² on hash folds: per-fold score, then mean and population std."""
    data = _assemble(complete(df.select(id_col, F.col(y).cast("double").alias("label"),
                                        *[F.col(c).cast("double").alias(c) for c in x_cols])), x_cols)
    data = fold_col(data, id_col, k).cache()
    est = estimators(data.count())[name]
    rows = []
    for f in range(k):
        model = est.fit(data.where(F.col("fold") != f))
        r2 = metrics(model.transform(data.where(F.col("fold") == f))).first()["r2"]
        rows.append((f, float(r2)))
    data.unpersist()
    scores = np.array([r for _, r in rows])
    out = df.sparkSession.createDataFrame(rows, "fold int, r2 double")
    return out.withColumn("mean_r2", F.lit(float(scores.mean()))).withColumn("std_r2", F.lit(float(scores.std())))


def grid_search(df: DataFrame, id_col: str, y: str, x_cols, name: str = "random_forest", grid: dict | None = None,
                k: int = 5, parallelism: int = 4) -> DataFrame:
    """Grid search of a preset by k-fold R² (CrossValidator with a deterministic fold column).

    ``grid`` maps parameter names of the estimator to lists of values (default: a small forest grid).
    One row per combination, best first."""
    grid = grid or {"numTrees": [20, 50], "maxDepth": [3, 5]}
    data = _assemble(complete(df.select(id_col, F.col(y).cast("double").alias("label"),
                                        *[F.col(c).cast("double").alias(c) for c in x_cols])), x_cols)
    data = fold_col(data, id_col, k).cache()
    est = estimators(data.count())[name]
    build = ParamGridBuilder()
    for p, values in grid.items():
        build = build.addGrid(est.getParam(p), values)
    maps = build.build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=RegressionEvaluator(metricName="r2"),
                        numFolds=k, foldCol="fold", parallelism=parallelism)
    scores = cv.fit(data).avgMetrics
    data.unpersist()
    rows = [(*[float(m[est.getParam(p)]) for p in grid], float(s)) for m, s in zip(maps, scores)]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{p} double" for p in grid) + ", mean_r2 double") \
             .orderBy(F.col("mean_r2").desc(), *grid)


def ols(df: DataFrame, y: str, x_cols) -> dict:
    """Normal-equation OLS with intercept: one Gramian aggregate, driver solve of
    (k+1)²; then R² and MSE from a second aggregate with the coefficients as literals."""
    cols = ["_one"] + list(x_cols)
    d = complete(df.select(F.lit(1.0).alias("_one"), F.col(y).cast("double").alias("_y"),
                           *[F.col(c).cast("double").alias(c) for c in x_cols]))
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(cols)
            for j, b in enumerate(cols) if j >= i]
    aggs += [F.sum(F.col(a) * F.col("_y")).alias(f"r_{i}") for i, a in enumerate(cols)]
    row = d.agg(*aggs).first()
    k = len(cols)
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    r = np.array([row[f"r_{i}"] for i in range(k)])
    beta = np.linalg.solve(g, r)
    pred = sum(F.col(c) * float(b) for c, b in zip(cols, beta))
    s = d.agg(F.avg((F.col("_y") - pred) ** 2).alias("mse"), F.var_pop("_y").alias("vy"),
              F.count(F.lit(1)).alias("n")).first()
    return {"intercept": float(beta[0]), "coefs": dict(zip(x_cols, map(float, beta[1:]))),
            "r2": 1 - s["mse"] / s["vy"], "mse": float(s["mse"]), "n": int(s["n"]), "k": len(x_cols)}
