"""Dimension reduction and factor adequacy (D1–D9, D13, D14, D17-style scores).

The data-sized work is one aggregate: the p×p cross-product of the
standardised columns (p(p+1)/2 sums, map-side combined).  Only that p×p matrix
reaches the driver, where ``numpy.linalg.eigh`` / ``inv`` / ``slogdet`` run on
it — the cost is independent of the row count.  Scores are column expressions
with the p×k coefficients as literals, evaluated on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.perms import permute
from . import fits, vectors
from .graph import _materialize
from .prep import scale
from .vectors import complete

MAX_P = 2000


@dataclass
class PcaResult:
    cols: list
    eigenvalues: np.ndarray
    vectors: np.ndarray     # p × p, column j = component j (sign-normalised)
    n: int

    @property
    def ratios(self):
        return self.eigenvalues / self.eigenvalues.sum()


def cross_products(df: DataFrame, cols):
    """(n, Σ z_i z_j) of the given columns as a numpy matrix (one aggregate)."""
    cols = list(cols)
    if len(cols) > MAX_P:
        raise ValueError(f"p = {len(cols)} exceeds the driver-side bound {MAX_P}")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}"))
    row = df.agg(*aggs).first()
    p = len(cols)
    m = np.zeros((p, p))
    for i, a in enumerate(cols):
        for j in range(i, p):
            v = row[f"{a}__{cols[j]}"]
            m[i, j] = m[j, i] = v
    return int(row["_n"]), m


def pca_fit(df: DataFrame, cols) -> PcaResult:
    """Z-score with the population std, covariance with divisor n − 1, eigen
    decomposition (descending); each component's sign makes its largest
    |loading| positive."""
    z, _ = scale(complete(df.select(*cols)), list(cols), "standard")
    n, xtx = cross_products(z, cols)
    cov = xtx / (n - 1)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    for j in range(vecs.shape[1]):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    return PcaResult(list(cols), np.clip(vals, 0, None), vecs, n)


def pca_summary(spark, res: PcaResult, k: int | None = None) -> DataFrame:
    """D4 + T4: PC, eigenvalue, variance ratio, cumulative ratio, top-3 variables by |loading|."""
    k = k or len(res.cols)
    load = res.vectors * np.sqrt(res.eigenvalues)
    cum = np.cumsum(res.ratios)
    rows = []
    for j in range(k):
        top = [res.cols[i] for i in np.argsort(-np.abs(load[:, j]), kind="stable")[:3]]
        rows.append((f"PC{j + 1}", float(res.eigenvalues[j]), float(res.ratios[j]), float(cum[j]), ", ".join(top)))
    return spark.createDataFrame(rows, "PC string, eigenvalue double, variance_explained double, "
                                       "cumulative_variance double, top_variables string")


def pca_loadings(spark, res: PcaResult, k: int | None = None) -> DataFrame:
    """loadings = eigenvector × √eigenvalue, long form (pc, variable, loading)."""
    k = k or len(res.cols)
    load = res.vectors * np.sqrt(res.eigenvalues)
    rows = [(f"PC{j + 1}", v, float(load[i, j])) for j in range(k) for i, v in enumerate(res.cols)]
    return spark.createDataFrame(rows, "pc string, variable string, loading double")


def pca_scores(df: DataFrame, res: PcaResult, id_col: str, k: int = 3) -> DataFrame:
    """D3: scores of every row — k dot products as column expressions."""
    z, _ = scale(complete(df.select(id_col, *res.cols)), res.cols, "standard")
    exprs = []
    for j in range(k):
        e = None
        for i, c in enumerate(res.cols):
            t = F.col(c) * float(res.vectors[i, j])
            e = t if e is None else e + t
        exprs.append(e.alias(f"PC{j + 1}"))
    return z.select(id_col, *exprs)


def component_rules(res: PcaResult, var_target: float = 0.85, parallel: int | None = None) -> dict:
    """Eigenvalue > 1, cumulative ≥ target, scree elbow, and their max, with the count of
    :func:`parallel_analysis` as the fourth rule if it is given; ``n_limited`` is the variant max(2, min(eigenvalue,
    variance, 4))."""
    ev = res.eigenvalues
    p = len(ev)
    kaiser = int((ev > 1).sum())
    cum = np.cumsum(res.ratios)
    var_rule = int(np.argmax(cum >= var_target) + 1) if (cum >= var_target).any() else p
    if p >= 3:
        d2 = np.diff(ev, 2)
        scree = int(min(max(int(np.argmax(d2)) + 2, 1), p))
    else:
        scree = 1
    return {"eigenvalue_rule": kaiser, "variance_rule": var_rule, "scree_rule": scree} | (
        {} if parallel is None else {"parallel_rule": parallel}) | {
        "n_components": max(kaiser, var_rule, scree, parallel or 0), "n_limited": max(2, min(kaiser, var_rule, 4))}


def correlation_matrix(df: DataFrame, cols):
    z, _ = scale(complete(df.select(*cols)), list(cols), "standard")
    n, xtx = cross_products(z, cols)
    d = np.sqrt(np.diag(xtx))
    d[d == 0] = 1.0
    return n, xtx / np.outer(d, d)


def _chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution (regularised gamma Q(k/2, x/2))."""
    a, xx = k / 2.0, x / 2.0
    if xx <= 0:
        return 1.0
    if xx < a + 1:  # series for P
        term = s = 1.0 / a
        ap = a
        for _ in range(1000):
            ap += 1
            term *= xx / ap
            s += term
            if abs(term) < abs(s) * 1e-15:
                break
        return max(0.0, 1.0 - s * math.exp(-xx + a * math.log(xx) - math.lgamma(a)))
    # continued fraction for Q (modified Lentz)
    b = xx + 1 - a
    c = 1 / 1e-300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-xx + a * math.log(xx) - math.lgamma(a)) * h


def kmo_bartlett(df: DataFrame, cols) -> dict:
    """D13 + D14: KMO (overall and per variable) and Bartlett's sphericity test."""
    n, r = correlation_matrix(df, cols)
    p = len(cols)
    inv = np.linalg.inv(r)
    dd = np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    partial = -inv / dd
    np.fill_diagonal(partial, 0.0)
    r0 = r.copy()
    np.fill_diagonal(r0, 0.0)
    r2, p2 = (r0 ** 2), (partial ** 2)
    kmo_all = float(r2.sum() / (r2.sum() + p2.sum()))
    kmo_var = r2.sum(axis=0) / (r2.sum(axis=0) + p2.sum(axis=0))
    sign, logdet = np.linalg.slogdet(r)
    chi2 = float(-(n - 1 - (2 * p + 5) / 6.0) * logdet)
    dof = p * (p - 1) / 2
    return {"kmo": kmo_all, "kmo_per_variable": dict(zip(cols, map(float, kmo_var))),
            "bartlett_chi2": chi2, "bartlett_df": dof, "bartlett_p": _chi2_sf(chi2, dof), "n": n}


# --- factor analysis (D15–D18) ------------------------------------------------------

def factor_fit(df: DataFrame, cols, k: int, max_iter: int = 500, tol: float = 1e-9, rotate: bool = True):
    """Minimum-residual (ULS) factor extraction by iterated principal axes
    on the correlation matrix (the fixed point of the iteration minimises the
    off-diagonal residuals), then varimax with Kaiser normalisation.

    Only the p×p correlation matrix comes from the data (one aggregate).
    Returns (loadings p×k, correlation matrix, n).
    """
    n, r = correlation_matrix(df, cols)
    p = len(cols)
    inv = np.linalg.pinv(r)
    h2 = np.clip(1 - 1 / np.diag(inv), 0.005, 1.0)  # squared multiple correlations
    for _ in range(max_iter):
        rr = r.copy()
        np.fill_diagonal(rr, h2)
        vals, vecs = np.linalg.eigh(rr)
        order = np.argsort(vals)[::-1][:k]
        lam = np.clip(vals[order], 0, None)
        load = vecs[:, order] * np.sqrt(lam)
        new = np.clip((load ** 2).sum(axis=1), 0.0, 1.0)
        if np.max(np.abs(new - h2)) < tol:
            h2 = new
            break
        h2 = new
    if rotate and k > 1:
        load = varimax(load)
    for j in range(k):
        if load[np.argmax(np.abs(load[:, j])), j] < 0:
            load[:, j] = -load[:, j]
    return load, r, n


def varimax(load: np.ndarray, max_iter: int = 1000, tol: float = 1e-8) -> np.ndarray:
    """Varimax rotation with Kaiser normalisation (p×k, driver side)."""
    h = np.sqrt((load ** 2).sum(axis=1))
    h[h == 0] = 1.0
    a = load / h[:, None]
    p, k = a.shape
    rot = np.eye(k)
    d = 0.0
    for _ in range(max_iter):
        lam = a @ rot
        u, s, vt = np.linalg.svd(a.T @ (lam ** 3 - lam @ np.diag((lam ** 2).sum(axis=0)) / p))
        rot = u @ vt
        d_new = s.sum()
        if d_new < d * (1 + tol):
            break
        d = d_new
    return (a @ rot) * h[:, None]


def factor_count(df: DataFrame, cols) -> int:
    """Number of correlation-matrix eigenvalues above 1 (at least 1)."""
    _, r = correlation_matrix(df, cols)
    return max(1, int((np.linalg.eigvalsh(r) > 1).sum()))


def factor_scores(df: DataFrame, cols, id_col: str, k: int | None = None, weights: str = "variance") -> DataFrame:
    """D17 + D18: regression factor scores Z·R⁻¹·L (population z-scores) as k
    column expressions, the composite score (variance-weighted or simple mean of
    the factor scores) and its average descending rank (truncated to int)."""
    from ..operators.features import avg_rank_desc
    k = k or factor_count(df, cols)
    load, r, _ = factor_fit(df, cols, k)
    coef = np.linalg.solve(r, load)  # R⁻¹ L
    z, _ = scale(complete(df.select(id_col, *cols)), list(cols), "standard")
    exprs = []
    for j in range(k):
        e = None
        for i, c in enumerate(cols):
            t = F.col(c) * float(coef[i, j])
            e = t if e is None else e + t
        exprs.append(e.alias(f"Factor{j + 1}_Score"))
    sc = z.select(id_col, *exprs)
    var = (load ** 2).sum(axis=0)
    wts = var / var.sum() if weights == "variance" else np.full(k, 1.0 / k)
    comp = sum(F.col(f"Factor{j + 1}_Score") * float(wts[j]) for j in range(k))
    sc = sc.withColumn("composite_score", comp)
    return avg_rank_desc(sc, "composite_score", out="rank")


#: Places of a permuted table that one task fills at a time, and rows whose values travel together.
PLACES, TOGETHER = 1 << 15, 1 << 16


def _shuffled_moments(zd: DataFrame, keys: dict, n: int, p: int) -> DataFrame:
    """(perm, s): the p×p cross-products (flat) of rows (d, v) whose columns were permuted, for each draw.

    ``keys`` maps (draw, column) to the key of its permutation of 0..n−1.  Values travel as one binary for each draw,
    column, chunk of ``TOGETHER`` rows and ``PLACES`` places (10 bytes a value); a place without a value counts as zero."""
    parts = max(zd.sparkSession.sparkContext.defaultParallelism, -(-n // TOGETHER))
    blocks = -(-n // PLACES)

    def sent(d, z):
        for (perm, j), key in keys.items():
            q = permute(d, np.full(len(d), key), n)
            block = q // PLACES
            order = np.argsort(block, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))])
            there = np.flatnonzero(np.diff(ends))
            ends = ends[[*there, blocks]] if len(there) else ends[:1]

            def binary(a):
                return pa.Array.from_buffers(pa.binary(), len(there), [
                    None, pa.py_buffer((ends * a.itemsize).astype(np.int32)), pa.py_buffer(a)])

            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(there), perm), pa.int32()), pa.array(there, pa.int32()), pa.array(np.full(len(there), j), pa.int32()),
                 binary((q[order] % PLACES).astype(np.uint16)), binary(z[order, j])], ["perm", "block", "j", "at", "z"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), vectors.matrix(batch.column(1))))
            rows += batch.num_rows
            if rows >= TOGETHER:
                yield from sent(*map(np.concatenate, zip(*held)))
                held, rows = [], 0
        if held and rows:
            yield from sent(*map(np.concatenate, zip(*held)))

    def products(rows: pa.Table) -> pa.Table:
        x = np.zeros((PLACES, p))
        for j, at, z in zip(rows["j"].to_pylist(), rows["at"], rows["z"]):
            x[np.frombuffer(at.as_buffer(), np.uint16), j] = np.frombuffer(z.as_buffer(), np.float64)
        return pa.table({"perm": rows["perm"].slice(0, 1), "s": pa.array([(x.T @ x).ravel()], pa.list_(pa.float64()))})

    moved = zd.repartition(parts, "d").mapInArrow(run, "perm int, block int, j int, at binary, z binary")
    return moved.groupBy("perm", "block").applyInArrow(products, "perm int, s array<double>") \
        .groupBy("perm").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))


def parallel_analysis(df: DataFrame, cols, id_col: str, permutations: int = 100, seed: int = 42,
                      percentile: float = 95.0) -> dict:
    """Horn's parallel analysis.  Each draw permutes every column
    independently with a keyed random permutation of the dense row index
    (:mod:`flowpanel.functions.perms`, per draw and column), so a value's place needs no sort; the
    p×p cross-products of all draws come from one shuffle of the values as packed arrays.
    Returns the count of real eigenvalues above the percentile of the
    permuted ones, plus both eigenvalue lists."""
    from ..operators.spatial import _dense_ids
    cols = list(cols)
    z, _ = scale(complete(df.select(id_col, *cols)), cols, "standard")
    z = _materialize(z)
    n = z.count()
    dense = _dense_ids(z, id_col)
    # rows of one id go to one place, where the largest value counts
    zd = z.join(dense, id_col).groupBy("d").agg(*[F.max(c).alias(c) for c in cols])
    zd = zd.select("d", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias("v"))
    named = df.sparkSession.createDataFrame([(k, j, c) for k in range(permutations) for j, c in enumerate(cols)], "perm int, j int, col string")
    keys = {(r["perm"], r["j"]): r["key"] for r in named.select("perm", "j", F.xxhash64(F.lit(seed), F.col("perm"), F.col("col")).alias("key")).collect()}
    p = len(cols)
    sims = [np.sort(np.linalg.eigvalsh(np.array(r["s"]).reshape(p, p) / (n - 1)))[::-1] for r in _shuffled_moments(zd, keys, n, p).collect()]
    thr = np.percentile(np.array(sims), percentile, axis=0)
    real = pca_fit(df, cols).eigenvalues
    return {"n_components": int((real > thr).sum()), "real": real.tolist(), "threshold": thr.tolist()}


# --- kernel and robust PCA (D10–D12) -----------------------------------------------

def kernel(name: str, gamma: float, degree: int = 3, coef0: float = 1.0):
    """Kernel matrix function of two point matrices."""
    def unit(x):
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)

    kinds = {
        "linear": lambda a, b: a @ b.T,
        "poly": lambda a, b: (gamma * (a @ b.T) + coef0) ** degree,
        "rbf": lambda a, b: np.exp(-gamma * np.maximum((a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1), 0)),
        "sigmoid": lambda a, b: np.tanh(gamma * (a @ b.T) + coef0),
        "cosine": lambda a, b: unit(a) @ unit(b).T,
    }
    if name not in kinds:
        raise ValueError(f"unknown kernel {name}")
    return kinds[name]


#: Landmarks of :func:`kernel_pca`.
LANDMARKS = 256


def kernel_pca(df: DataFrame, cols, id_col: str, kind: str = "rbf", gamma: float | None = None, degree: int = 3,
               coef0: float = 1.0, landmarks: int = LANDMARKS, k: int = 3, seed: int = 42):
    """Kernel PCA of the standardised points through ``landmarks`` hash-chosen ones (Nyström).

    A point's features are its kernel values to the landmarks times K_mm^(-1/2) (positive eigenvalues only, so an
    indefinite kernel keeps its positive part); their covariance is summed in one pass, landmarks squared numbers a task.
    With as many landmarks as points this is kernel PCA itself.  ``gamma`` defaults to 1/p.
    Returns (shares of the features' variance, scores (id, KPC1..KPCk)); scores are 0 beyond the features' rank."""
    x = vectors.standardised(vectors.points(df, cols, [id_col]))
    x = _materialize(x)
    marks = np.unique(fits.seed_pool(x, id_col, seed, landmarks), axis=0)
    if not len(marks):
        raise ValueError("no complete row")
    fn = kernel(kind, gamma or 1.0 / marks.shape[1], degree, coef0)
    vals, vecs = np.linalg.eigh(fn(marks, marks))
    keep = vals > max(vals.max(), 0) * 1e-12
    root = vecs[:, keep] / np.sqrt(vals[keep])
    m = root.shape[1]

    def moments(z, _):
        f = fn(z, marks) @ root
        return {0: np.concatenate([[len(z)], f.sum(axis=0), (f.T @ f).ravel()])}

    s = vectors.summed(x, moments)[0]
    n, mean = s[0], s[1:m + 1] / s[0]
    spread = s[m + 1:].reshape(m, m) - n * np.outer(mean, mean)
    vals, vecs = np.linalg.eigh(spread)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0, None), vecs[:, order]
    for j in range(m):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    axes = np.zeros((m, k))
    axes[:, :min(m, k)] = vecs[:, :k]
    scores = vectors.mapped(x, lambda z: [vectors.lists((fn(z, marks) @ root - mean) @ axes)], "s array<double>", [id_col])
    total = vals.sum()
    return [float(v / total) if total else 0.0 for v in vals[:k]], scores.select(id_col, *[F.col("s")[j].alias(f"KPC{j + 1}") for j in range(k)])


#: Rows on which the first steps of :func:`mcd` are made, and the disjoint parts they are dealt to.
MCD_SAMPLE, MCD_PARTS = 1500, 5


def _chi2_ppf(q: float, k: float) -> float:
    lo, hi = 0.0, 10.0 * k + 100.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - _chi2_sf(mid, k) < q else (lo, mid)
    return (lo + hi) / 2


def _mahalanobis(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    c = x - mean
    return ((c @ np.linalg.pinv(cov)) * c).sum(axis=1)


def _logdet(cov: np.ndarray) -> float:
    sign, value = np.linalg.slogdet(cov)
    return value if sign > 0 else -np.inf


def _concentrated(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int, steps: int = 2):
    """(log determinant, mean, covariance) after steps that keep the ``h`` rows nearest to the estimate."""
    for _ in range(steps):
        near = x[np.argsort(_mahalanobis(x, mean, cov), kind="stable")[:h]]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True).reshape(x.shape[1], -1)
    return _logdet(cov), mean, cov


def _first_candidates(pool: np.ndarray, share: float, starts: int, best: int, seed: int):
    """The ``best`` estimates of many random starts: two steps each on disjoint parts of the pool, the best of each part
    two more on the whole pool."""
    n, p = pool.shape
    rng = np.random.default_rng(seed)
    parts = np.array_split(np.arange(n), MCD_PARTS if n >= 2 * MCD_PARTS * (p + 1) else 1)
    kept = []
    for rows in parts:
        x, got = pool[rows], []
        for _ in range(max(1, starts // len(parts))):
            few = x[rng.choice(len(x), min(len(x), p + 1), replace=False)]
            got.append(_concentrated(x, few.mean(axis=0), np.cov(few.T, bias=True).reshape(p, p), max(p + 1, math.ceil(share * len(x)))))
        kept += sorted(got, key=lambda t: t[0])[:best]
    whole = [_concentrated(pool, m, c, max(p + 1, math.ceil(share * n))) for _, m, c in kept]
    return sorted(whole, key=lambda t: t[0])[:best]


#: Bits of a value that one pass of :func:`_quantiles` settles.
DIGIT = 16


def _ordered(a: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = (a + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _quantiles(pts: DataFrame, fn, m: int, n: int, share: float) -> dict[int, float]:
    """{j: exact linear quantile of column j of ``fn(points)``}, n rows and m columns, without a sort.

    Each pass counts the next ``DIGIT`` bits of the values that begin as the two wanted ones do; four passes give all
    64 bits.  A task sends 2^DIGIT counts for each wanted value, whatever the number of rows."""
    pos = (n - 1) * share
    asked = sorted({math.floor(pos), math.ceil(pos)})
    found = {(j, r): 0 for j in range(m) for r in asked}
    rank = {t: t[1] for t in found}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        heads = sorted({(j, found[j, r]) for j, r in found})

        def counts(x, _, shift=shift, heads=heads):
            values = _ordered(np.ascontiguousarray(fn(x).T))
            out = {}
            for i, (j, head) in enumerate(heads):
                of = values[j] >> np.uint64(shift)
                if shift + DIGIT < 64:
                    of = of[of >> np.uint64(DIGIT) == np.uint64(head)]
                if len(of):
                    out[i] = np.bincount((of & np.uint64((1 << DIGIT) - 1)).astype(np.int64), minlength=1 << DIGIT).astype(float)
            return out

        got = vectors.summed(pts, counts)
        for t in found:
            below = np.cumsum(got[heads.index((t[0], found[t]))])
            digit = int(np.searchsorted(below, rank[t], side="right"))
            rank[t] -= int(below[digit - 1]) if digit else 0
            found[t] = found[t] << DIGIT | digit
    bits = np.array([found[j, r] for j in range(m) for r in asked], np.uint64)
    value = np.where(bits >> np.uint64(63), bits & np.uint64((1 << 63) - 1), ~bits).view(np.float64).reshape(m, -1)
    return {j: float(value[j, 0] + (pos - asked[0]) * (value[j, -1] - value[j, 0])) for j in range(m)}


def mcd(pts: DataFrame, id_col: str, support: float | None = None, starts: int = 500, best: int = 10, seed: int = 42,
        max_steps: int = 30) -> dict:
    """Minimum covariance determinant of points (id, v): the ``h`` rows whose covariance has the least determinant.

    ``starts`` random starts take two concentration steps each on disjoint parts of ``MCD_SAMPLE`` hash-chosen rows, the
    ``best`` go on over all rows: two steps for all of them together, then the best one until its determinant no longer
    falls.  A step over all rows cuts at the exact h-th smallest distance.  The covariance is made consistent by the
    median distance over the chi-square median, and mean and covariance are estimated once more from the rows within the
    97.5 % point.  Returns raw and reweighted estimates: ``raw_mean``, ``raw_cov``, ``mean``, ``cov``, ``h``, ``used``.
    """
    pool = fits.seed_pool(pts, id_col, seed, MCD_SAMPLE)
    n, p = pts.count(), pool.shape[1]
    h = max(p + 1, min(n, int(support * n) if support else (n + p + 1) // 2))
    own = pts.select("v")

    def cut(cands, share):
        """Exact quantile of every candidate's distances."""
        return _quantiles(own, lambda x: np.stack([_mahalanobis(x, m, c) for _, m, c in cands], axis=1), len(cands), n, share)

    def estimated(cands, limits):
        def step(x, _):
            out = {}
            for j, (_, m, c) in enumerate(cands):
                near = x[_mahalanobis(x, m, c) <= limits[j]]
                out[j] = np.concatenate([[len(near)], near.sum(axis=0), (near.T @ near).ravel()])
            return out
        got = []
        for j, s in sorted(vectors.summed(own, step).items()):
            mean = s[1:p + 1] / s[0]
            cov = s[p + 1:].reshape(p, p) / s[0] - np.outer(mean, mean)
            got.append((_logdet(cov), mean, cov, int(s[0])))
        return got

    share = (h - 1) / max(n - 1, 1)
    cands = _first_candidates(pool, h / n, starts, best, seed)
    for _ in range(2):
        cands = [t[:3] for t in estimated(cands, cut(cands, share))]
    top = min(cands, key=lambda t: t[0])
    for _ in range(max_steps):
        after = estimated([top], cut([top], share))[0][:3]
        if not after[0] < top[0] - 1e-10:
            break
        top = after
    _, raw_mean, raw_cov = top
    middle = cut([top], 0.5)[0]
    consistent = raw_cov * (middle / _chi2_ppf(0.5, p)) if middle > 0 else raw_cov
    _, mean, cov, used = estimated([(0.0, raw_mean, consistent)], {0: _chi2_ppf(0.975, p)})[0]
    return {"raw_mean": raw_mean, "raw_cov": raw_cov, "mean": mean, "cov": cov, "h": h, "used": used}


def robust_pca(df: DataFrame, cols, id_col: str | None = None, support: float | None = None, seed: int = 42) -> tuple:
    """PCA of the reweighted minimum covariance determinant estimate (:func:`mcd`) of the standardised columns.

    Returns (PcaResult on the robust correlation, classical PcaResult)."""
    cols = list(cols)
    own = df if id_col else df.withColumn("_id", F.xxhash64(*cols))
    x = _materialize(vectors.standardised(vectors.points(own, cols, [id_col or "_id"])))
    est = mcd(x, id_col or "_id", support, seed=seed)
    cov = est["cov"]
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    vals, vecs = np.linalg.eigh(corr)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0, None), vecs[:, order]
    for j in range(len(cols)):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    return PcaResult(cols, vals, vecs, est["used"]), pca_fit(df, cols)


def loading_agreement(a: PcaResult, b: PcaResult, k: int = 2) -> list:
    """Correlation of the PC loadings of two fits, per component."""
    la = a.vectors * np.sqrt(a.eigenvalues)
    lb = b.vectors * np.sqrt(b.eigenvalues)
    return [float(np.corrcoef(la[:, j], lb[:, j])[0, 1]) for j in range(k)]
