"""Spatial weights and spatial autocorrelation.

Weights are a long DataFrame ``(i, j, w)``.  Neighbour search is the grid
join of :mod:`flowpanel.operators.pairs` (no all-pairs product).  Global
Moran statistics are sums over W and over the values — a handful of
aggregates — and the scalar formulas are column expressions, so the result
is a DataFrame computed on the executors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.perms import permute, permuted
from ..functions.ranks import spread_join
from ..functions.scalar import safe_div
from . import pairs
from .graph import _materialize

#: Permutation draws that travel together as one array.
DRAWS = 50
#: Values (8 bytes each) up to which a task of a permutation test looks them up in an array; more are joined.
LOOKUP = 1 << 21
#: Points of a part that looks its values up, at least.
PART = 1 << 14


def knn_weights(pts: DataFrame, id_col: str, coords, k: int = 4) -> DataFrame:
    """K-nearest-neighbour weights, row-standardised (w = 1/k); ties → smaller id."""
    nn = pairs.knn(pts, id_col, coords, k=k)
    cnt = nn.groupBy(id_col).agg(F.count(F.lit(1)).alias("_k"))
    return nn.join(cnt, id_col).select(F.col(id_col).alias("i"), F.col("nbr").alias("j"),
                                        (1.0 / F.col("_k")).alias("w"))


def band_weights(pts: DataFrame, id_col: str, coords, threshold: float, alpha: float = -1.0) -> DataFrame:
    """Inverse-distance weights d^alpha for 0 < d <= threshold, row-standardised.

    Pairs are listed twice and never shuffled: first for each point's sum, then with that sum beside the point."""
    raw = F.pow(F.col("dist"), alpha)
    tot = pairs.within(pts, id_col, coords, threshold).groupBy(id_col).agg(F.sum(raw).alias("_t"))
    b = pairs.within(pts, id_col, coords, threshold, also=tot)
    return b.select(F.col(id_col).alias("i"), F.col("nbr").alias("j"), (raw / F.col("_t")).alias("w"))


def spatial_lag(w: DataFrame, values: DataFrame, id_col: str, value: str) -> DataFrame:
    """(Wy)_i = Σ_j w_ij y_j."""
    y = values.select(F.col(id_col).alias("j"), F.col(value).alias("_y"))
    return w.join(y, "j").groupBy("i").agg(F.sum(F.col("w") * F.col("_y")).alias("lag"))


def erfc(x) -> F.Column:
    """Complementary error function as a column expression (Chebyshev fit,
    fractional error < 1.2e-7 everywhere)."""
    # fixed coefficients of the published erfc Chebyshev approximation
    c = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
         0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * z)
    poly = F.lit(c[-1])
    for coef in reversed(c[1:-1]):
        poly = coef + t * poly
    ans = t * F.exp(-z * z + c[0] + t * poly)
    return F.when(x >= 0, ans).otherwise(2.0 - ans)


def two_sided_p(z) -> F.Column:
    return erfc(F.abs(z) / math.sqrt(2.0))


def moran_global(w: DataFrame, df: DataFrame, id_col: str, cols) -> DataFrame:
    """X4 + X5 + X13: global Moran's I for each variable, with the normal and
    randomisation inference (EI, VI, z, two-sided p).

    Variables are unpivoted and processed together, partitioned by variable.
    Points with a NULL value are dropped and W is re-standardised over the rest.
    """
    long = (df.select(id_col, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([id_col], list(cols), "variable", "value").where(F.col("value").isNotNull()))
    mom = long.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("_mu"))
    z = spread_join(long, mom, "variable").select("variable", F.col(id_col).alias("id"),
                                          (F.col("value") - F.col("_mu")).alias("z"), "n")
    # W restricted to points present for the variable, re-row-standardised
    wv = (w.join(z.select("variable", F.col("id").alias("i")), "i")
          .join(z.select("variable", F.col("id").alias("j")), ["variable", "j"]))
    rs = wv.groupBy("variable", "i").agg(F.sum("w").alias("_rs"))
    wv = wv.join(rs, ["variable", "i"]).select("variable", "i", "j", (F.col("w") / F.col("_rs")).alias("w"))
    zi = z.select("variable", F.col("id").alias("i"), F.col("z").alias("zi"))
    zj = z.select("variable", F.col("id").alias("j"), F.col("z").alias("zj"))
    cross = (wv.join(zi, ["variable", "i"]).join(zj, ["variable", "j"])
             .groupBy("variable").agg(F.sum(F.col("w") * F.col("zi") * F.col("zj")).alias("zwz"),
                                      F.sum("w").alias("S0")))
    # S1, S2 per variable
    sym = (wv.unionByName(wv.select("variable", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
           .groupBy("variable", "i", "j").agg(F.sum("w").alias("_s")))
    s1 = sym.groupBy("variable").agg((F.sum(F.col("_s") ** 2) / 2).alias("S1"))
    rows = wv.groupBy("variable", F.col("i").alias("id")).agg(F.sum("w").alias("_r"))
    colz = wv.groupBy("variable", F.col("j").alias("id")).agg(F.sum("w").alias("_c"))
    s2 = rows.join(colz, ["variable", "id"], "full").groupBy("variable").agg(
        F.sum((F.coalesce("_r", F.lit(0.0)) + F.coalesce("_c", F.lit(0.0))) ** 2).alias("S2"))
    zz = z.groupBy("variable").agg(F.sum(F.col("z") ** 2).alias("m2s"), F.sum(F.col("z") ** 4).alias("m4s"),
                                   F.max("n").alias("n"))
    s = cross.join(s1, "variable").join(s2, "variable").join(zz, "variable")
    n = F.col("n").cast("double")
    S0, S1, S2 = F.col("S0"), F.col("S1"), F.col("S2")
    # a constant variable, or too few points for a moment, gives NULL
    I = safe_div(n * F.col("zwz"), S0 * F.col("m2s"))
    EI = safe_div(F.lit(-1.0), n - 1)
    vnorm = safe_div(n * n * S1 - n * S2 + 3 * S0 * S0, (n * n - 1) * S0 * S0) - EI * EI
    kk = safe_div(F.col("m4s") / n, (F.col("m2s") / n) ** 2)
    vrand = (safe_div(n * ((n * n - 3 * n + 3) * S1 - n * S2 + 3 * S0 * S0)
                      - kk * ((n * n - n) * S1 - 2 * n * S2 + 6 * S0 * S0),
                      (n - 1) * (n - 2) * (n - 3) * S0 * S0) - EI * EI)
    out = s.select("variable", F.col("n").alias("n"), I.alias("I"), EI.alias("EI"),
                   vnorm.alias("VI_norm"), vrand.alias("VI_rand"))
    return out.select("*",
                      safe_div(F.col("I") - F.col("EI"), F.sqrt("VI_norm")).alias("z_norm"),
                      safe_div(F.col("I") - F.col("EI"), F.sqrt("VI_rand")).alias("z_rand")) \
              .withColumn("p_norm", two_sided_p(F.col("z_norm"))) \
              .withColumn("p_rand", two_sided_p(F.col("z_rand")))


def moran_local(w: DataFrame, df: DataFrame, id_col: str, value: str) -> DataFrame:
    """Local Moran I_i = (n − 1) z_i (Wz)_i / Σz², z standardised by the
    population std, and the quadrant q (1 HH, 2 LH, 3 LL, 4 HL)."""
    y = df.select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("y")).where(F.col("y").isNotNull())
    st = y.agg(F.avg("y").alias("_mu"), F.stddev_pop("y").alias("_sd"), F.count(F.lit(1)).alias("_n"))
    z = (y.withColumn("_k", F.lit(1)).join(F.broadcast(st.withColumn("_k", F.lit(1))), "_k")
         .select("id", safe_div(F.col("y") - F.col("_mu"), F.col("_sd")).alias("z"), "_n"))
    lag = (w.join(z.select(F.col("id").alias("j"), F.col("z").alias("zj")), "j")
           .groupBy(F.col("i").alias("id")).agg(F.sum(F.col("w") * F.col("zj")).alias("lag_z")))
    j = z.join(lag, "id", "left").withColumn("lag_z", F.coalesce("lag_z", F.lit(0.0)))
    den = z.agg(F.sum(F.col("z") ** 2).alias("_den"))
    j = j.withColumn("_k", F.lit(1)).join(F.broadcast(den.withColumn("_k", F.lit(1))), "_k").drop("_k")
    zp, lp = F.col("z") > 0, F.col("lag_z") > 0
    q = F.when(zp & lp, 1).when(~zp & lp, 2).when(~zp & ~lp, 3).otherwise(4)
    return j.select(F.col("id").alias(id_col), "z", "lag_z",
                    safe_div((F.col("_n") - 1) * F.col("z") * F.col("lag_z"), F.col("_den")).alias("Is"),
                    q.alias("q"))


def _dense_ids(df: DataFrame, id_col: str) -> DataFrame:
    """id → dense index 0..n−1 in id order (distributed ranking, no single partition)."""
    from ..functions.ranks import ranked_values
    return ranked_values(df.select(id_col), [], id_col).select(id_col, F.col("below").alias("d"))


def _looked_up(rows: DataFrame, by: str, z: DataFrame, n: int, step, out: str) -> DataFrame:
    """``step(rows, values)`` on parts of the rows, each beside the array of all values (d, z); d is 0..n−1, at most
    ``LOOKUP`` of them.  There are four parts a core, or one for ``PART`` points if those are more; each has a copy."""
    parts = max(4 * rows.sparkSession.sparkContext.defaultParallelism, n // PART)
    left = rows.withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    right = z.select("d", "z", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(mine: pa.Table, values: pa.Table) -> pa.Table:
        at = np.empty(values.num_rows)
        at[values["d"].to_numpy()] = values["z"].to_numpy()
        return step(mine, at)

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, out)


def _moran_draws(wd: DataFrame, z: DataFrame, n: int, permutations: int, seed: int) -> DataFrame:
    """(perm, _s): Σ w z z of every draw over edges (di, dj, w) of dense points."""
    named = wd.sparkSession.createDataFrame([(k,) for k in range(permutations)], "perm int")
    keys = {r["perm"]: r["key"] for r in named.select("perm", F.xxhash64(F.lit(seed), F.col("perm")).alias("key")).collect()}

    def step(edges: pa.Table, at: np.ndarray) -> pa.Table:
        w = edges["w"].to_numpy()
        ends, place = np.unique(np.concatenate([edges["di"].to_numpy(), edges["dj"].to_numpy()]), return_inverse=True)
        i, j = place[:len(w)], place[len(w):]
        sums = []
        for key in keys.values() if len(w) else ():
            v = at[permute(ends, np.full(len(ends), key), n)]
            sums.append(float((w * v[i] * v[j]).sum()))
        return pa.table({"perm": pa.array(list(keys) if sums else [], pa.int32()), "s": pa.array(sums, pa.float64())})

    return _looked_up(wd, "di", z, n, step, "perm int, s double").groupBy("perm").agg(F.sum("s").alias("_s"))


def moran_permutation(w: DataFrame, df: DataFrame, id_col: str, value: str,
                      permutations: int = 999, seed: int = 42) -> DataFrame:
    """Permutation inference for global Moran's I (z_sim, p_sim, significant).

    Each draw moves the value of dense point d to its place in a keyed random permutation
    (:mod:`flowpanel.functions.perms`, one value at a time: no sort).  Parts of the weights look
    the moved values up in the array of all values and send one sum a draw.  Beyond ``LOOKUP`` values,
    or if ids repeat, ``DRAWS`` draws go together as an array per point, so the weights join
    n·(draws / DRAWS) rows, not n·draws; the statistic of each draw is an aggregate over the arrays' slots.
    p_sim = (min(#sim ≥ I, draws − #sim ≥ I) + 1) / (draws + 1).
    """
    y = df.select(id_col, F.col(value).cast("double").alias("y")).where(F.col("y").isNotNull())
    st = y.agg(F.avg("y").alias("_mu"), F.count(F.lit(1)).alias("_n")).first()
    n, mu = int(st["_n"]), float(st["_mu"])
    dense = _dense_ids(y, id_col)
    z = y.join(dense, id_col).select(id_col, "d", (F.col("y") - mu).alias("z"))
    wd = (w.join(dense.select(F.col(id_col).alias("i"), F.col("d").alias("di")), "i")
          .join(dense.select(F.col(id_col).alias("j"), F.col("d").alias("dj")), "j").select("di", "dj", "w"))
    s = wd.agg(F.sum("w").alias("S0")).first()["S0"]
    zz = z.agg(F.sum(F.col("z") ** 2)).first()[0]
    if n <= LOOKUP and dense.count() == n:
        draws = _moran_draws(wd, z.select("d", "z"), n, permutations, seed)
    else:
        # the value at point q in draw p is z at the point that p's permutation moves q to
        draws = F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm")
        at = z.select(F.col("d").alias("q"), draws).withColumn(
            "d", permuted(F.col("q"), F.xxhash64(F.lit(seed), F.col("perm")), n))
        moved = at.join(z.select("d", "z"), "d").withColumn("b", F.floor(F.col("perm") / DRAWS).cast("int"))
        moved = _materialize(moved.groupBy("q", "b").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("perm", "z"))), lambda s_: s_["z"]).alias("z")))
        zi = moved.select("b", F.col("q").alias("di"), F.col("z").alias("zi"))
        zj = moved.select("b", F.col("q").alias("dj"), F.col("z").alias("zj"))
        both = wd.join(zi, "di").join(zj, ["b", "dj"])
        draws = both.groupBy("b").agg(*[F.sum(F.col("w") * F.get("zi", F.lit(k)) * F.get("zj", F.lit(k))).alias(f"s{k}")
                                        for k in range(DRAWS)]).select(F.explode(F.array(*[f"s{k}" for k in range(DRAWS)])).alias("_s"))
    sims = draws.where("_s is not null").select((n / s * F.col("_s") / zz).alias("I_sim"))
    obs = moran_global(w, df, id_col, [value]).select("I")
    j = sims.withColumn("_k", F.lit(1)).join(F.broadcast(obs.withColumn("_k", F.lit(1))), "_k")
    agg = j.agg(F.first("I").alias("I"), F.avg("I_sim").alias("EI_sim"), F.stddev_pop("I_sim").alias("seI_sim"),
                F.count_if(F.col("I_sim") >= F.col("I")).alias("_larger"), F.count(F.lit(1)).alias("_m"))
    larger = F.least(F.col("_larger"), F.col("_m") - F.col("_larger"))
    return agg.select("I", "EI_sim", "seI_sim",
                      safe_div(F.col("I") - F.col("EI_sim"), F.col("seI_sim")).alias("z_sim"),
                      ((larger + 1) / (F.col("_m") + 1)).alias("p_sim")) \
              .withColumn("significant", F.col("p_sim") < 0.05)


def _lisa_counts(n: int, den: float, permutations: int, kind):
    """Step of :func:`_looked_up`: (i, draws whose I_i is at least the observed one, draws) of each point."""
    kind = to_arrow_type(kind)

    def step(points: pa.Table, at: np.ndarray) -> pa.Table:
        larger = []
        for rows in points.select(["di", "w", "z", "Is", "keys"]).to_batches(max_chunksize=512):
            here, slots = rows.column(0).to_numpy(), rows.column(1)
            z, seen, keys = rows.column(2).to_numpy(), rows.column(3).to_numpy(), rows.column(4).flatten().to_numpy()
            count, flat = slots.value_lengths().to_numpy(), slots.flatten().to_numpy()
            first, lag = np.cumsum(count) - count, np.zeros((len(here), permutations))
            keys = keys.reshape(len(here), permutations)
            for s in range(int(count.max())):
                who = np.flatnonzero(count > s)
                raw = permute(np.full(who.size * permutations, s), keys[who].ravel(), n - 1).reshape(len(who), -1)
                lag[who] += flat[first[who] + s][:, None] * at[raw + (raw >= here[who][:, None])]
            larger.append((((n - 1) * z[:, None] * lag / den) >= seen[:, None]).sum(axis=1))
        got = np.concatenate(larger) if larger else np.zeros(0, np.int64)
        return pa.table({"i": points["i"].cast(kind), "_larger": pa.array(got, pa.int64()), "_m": pa.array(np.full(len(got), permutations), pa.int64())})

    return step


def local_permutation(w: DataFrame, df: DataFrame, id_col: str, value: str,
                      permutations: int = 999, seed: int = 42) -> DataFrame:
    """X8 + X9: conditional-permutation p-values for local Moran and LISA labels.

    For draw p and point i, slot s of i's neighbours receives the value of the s-th point of a
    keyed random permutation of the other n − 1 points: a draw without replacement that
    leaves i out.  The simulated I_i uses i's own weights.  Up to ``LOOKUP`` points a part of the points looks
    all its draws' values up in one array; beyond that, or if ids repeat, draws are joined with the values.
    """
    from ..functions.scalar import lisa_label
    loc = moran_local(w, df, id_col, value)
    n = loc.count()
    dense = _dense_ids(loc, id_col)
    zt = loc.join(dense, id_col).select(F.col("d").alias("r"), F.col("z").alias("zr"))
    den = loc.agg(F.sum(F.col("z") ** 2)).first()[0]
    slot = Window.partitionBy("i").orderBy("j")
    ws = (w.withColumn("s", F.row_number().over(slot))
          .join(dense.select(F.col(id_col).alias("i"), F.col("d").alias("di")), "i"))
    obs = loc.select(F.col(id_col).alias("i"), "z", "Is", "q")
    if 1 < n <= LOOKUP and dense.count() == n and den and den == den:
        own = ws.groupBy("i", "di").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "w"))), lambda x: x["w"]).alias("w")).join(obs, "i")
        keys = F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda k: F.xxhash64(F.lit(seed), k, F.col("i")))
        agg = _looked_up(own.select("i", "di", "w", "z", "Is", keys.alias("keys")), "i", zt.select(F.col("r").alias("d"), F.col("zr").alias("z")), n,
                         _lisa_counts(n, float(den), permutations, own.schema["i"].dataType), f"i {own.schema['i'].dataType.simpleString()}, _larger long, _m long")
    else:
        pr = F.array(*[F.lit(k) for k in range(permutations)])
        draw = ws.select("i", "di", "s", "w", F.explode(pr).alias("perm"))
        draw = draw.withColumn("raw", permuted(
            (F.col("s") - 1).cast("long"), F.xxhash64(F.lit(seed), F.col("perm"), F.col("i")), max(n - 1, 1)))
        draw = draw.withColumn("r", F.when(F.col("raw") >= F.col("di"), F.col("raw") + 1).otherwise(F.col("raw")))
        lag = (draw.join(zt, "r").groupBy("i", "perm").agg(F.sum(F.col("w") * F.col("zr")).alias("lag_sim")))
        j = lag.join(obs, "i").withColumn("I_sim", (n - 1) * F.col("z") * F.col("lag_sim") / den)
        agg = j.groupBy("i").agg(F.count_if(F.col("I_sim") >= F.col("Is")).alias("_larger"),
                                 F.count(F.lit(1)).alias("_m"))
    larger = F.least(F.col("_larger"), F.col("_m") - F.col("_larger"))
    res = agg.select("i", ((larger + 1) / (F.col("_m") + 1)).alias("p_sim"))
    return (obs.join(res, "i", "left")
            .select(F.col("i").alias(id_col), "z", "Is", "q", "p_sim",
                    lisa_label(F.col("q"), F.col("p_sim")).alias("label")))
