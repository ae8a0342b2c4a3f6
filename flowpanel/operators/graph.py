"""Graph analytics on edge DataFrames.

A graph is an edge DataFrame ``(src, dst, w)``; vertices are the distinct
endpoints.  Everything is joins and aggregates:

* degrees / strengths: one exploded-endpoint aggregate;
* triangles (clustering): degree-ordered wedge join — every edge is oriented
  from the lower to the higher (degree, id) endpoint, so no vertex expands more
  than O(√m) out-neighbours;
* iterative measures (PageRank, eigenvector, components, shortest paths):
  one join + aggregate per round over the edge list, with the state
  checkpointed to the reliable checkpoint directory every few rounds.
"""

from __future__ import annotations

import contextlib
import gc
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_div
from ..session import ensure_checkpoint_dir
from .vectors import few

#: Edges of a task in the rounds of :func:`components`.
EDGES_PER_TASK = 100_000
CHECKPOINT_EVERY = 1  # state is referenced twice per round: cut lineage every round


def build(od: DataFrame, directed: bool = True, threshold: float | None = None,
          src: str = "src", dst: str = "dst", weight: str = "value") -> DataFrame:
    """G1 + P9: weighted edges from rows; rows with weight < threshold dropped
    **before** parallel edges are summed; undirected merges a→b with b→a (sum)."""
    e = od.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(weight).cast("double").alias("w"))
    if threshold is not None:
        e = e.where(~(F.col("w") < threshold) | F.col("w").isNull())
    if not directed:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return e.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def basic(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Node count, edge count (self loops included), density."""
    v = vertices(edges).agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    j = v.withColumn("_k", F.lit(1)).join(m.withColumn("_k", F.lit(1)), "_k").drop("_k")
    n, e = F.col("n_nodes"), F.col("n_edges")
    dens = e / (n * (n - 1)) if directed else 2 * e / (n * (n - 1))
    return j.withColumn("density", F.when(n > 1, dens).otherwise(F.lit(0.0)))


def degrees(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Weighted in / out / total degree (directed) or degree (undirected,
    a self loop counts twice)."""
    ep = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.col("w").alias("out_w"), F.lit(0.0).alias("in_w")),
        F.struct(F.col("dst").alias("id"), F.lit(0.0).alias("out_w"), F.col("w").alias("in_w")))).alias("e")) \
        .select("e.*")
    agg = ep.groupBy("id").agg(F.sum("in_w").alias("in_degree"), F.sum("out_w").alias("out_degree"))
    if directed:
        return agg.withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))
    return agg.select("id", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


def to_undirected(edges: DataFrame) -> DataFrame:
    """Directed → undirected: a→b and b→a merge into one edge with the summed weight."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w") \
                .groupBy("src", "dst").agg(F.sum("w").alias("w"))


def clustering(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Weighted clustering coefficient per node (geometric mean of the
    normalised triangle weights, w / max w), 0 for nodes with < 2 neighbours.

    Directed graphs are first made undirected (summed weights).
    """
    und = to_undirected(edges) if directed else edges
    wmax = und.agg(F.max("w").alias("_wmax"))
    e = (und.withColumn("_k", F.lit(1)).join(F.broadcast(wmax.withColumn("_k", F.lit(1))), "_k")
         .select("src", "dst", F.coalesce(safe_div("w", "_wmax"), F.lit(0.0)).alias("w")))
    simple = e.where(F.col("src") != F.col("dst"))
    both = simple.union(simple.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    deg = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    # orient each edge low → high by (degree, id)
    o = (simple.join(deg.withColumnRenamed("id", "src").withColumnRenamed("deg", "ds"), "src")
         .join(deg.withColumnRenamed("id", "dst").withColumnRenamed("deg", "dd"), "dst"))
    fwd = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    oe = o.select(F.when(fwd, F.col("src")).otherwise(F.col("dst")).alias("a"),
                  F.when(fwd, F.col("dst")).otherwise(F.col("src")).alias("b"), "w")
    e1 = oe.select(F.col("a"), F.col("b").alias("b1"), F.col("w").alias("w1"))
    e2 = oe.select(F.col("a"), F.col("b").alias("b2"), F.col("w").alias("w2"))
    wedges = e1.join(e2, "a").where(F.col("b1") < F.col("b2"))
    # closing edge looked up by its unordered endpoint pair (an equi-join)
    close = oe.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("w").alias("w3"))
    tri = wedges.join(close, (F.col("b1") == F.col("lo")) & (F.col("b2") == F.col("hi")))
    g = F.pow(F.col("w1") * F.col("w2") * F.col("w3"), 1.0 / 3.0)
    per_tri = tri.select("a", "b1", "b2", g.alias("g"))
    corners = per_tri.select(F.explode(F.array("a", "b1", "b2")).alias("id"), "g")
    t = corners.groupBy("id").agg(F.sum("g").alias("t"))
    v = vertices(und)
    return (v.join(deg, "id", "left").join(t, "id", "left")
            .select("id", F.when(F.coalesce(F.col("deg"), F.lit(0)) < 2, F.lit(0.0))
                    .otherwise(2 * F.coalesce(F.col("t"), F.lit(0.0)) / (F.col("deg") * (F.col("deg") - 1)))
                    .alias("clustering")))


def small_world(edges: DataFrame, directed: bool = True) -> DataFrame:
    """G12 (+ G13 row): average weighted clustering against the expected
    clustering of a same-size random graph, min(1, 2m / (n(n − 1)))."""
    und = to_undirected(edges) if directed else edges
    c = clustering(edges, directed).agg(F.avg("clustering").alias("clustering_coefficient"))
    b = basic(und, directed=False)
    j = c.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
    n, m = F.col("n_nodes"), F.col("n_edges")
    rnd = F.least(F.lit(1.0), 2 * m / (n * (n - 1)))
    return j.select("clustering_coefficient", rnd.alias("clustering_random"),
                    (F.col("clustering_coefficient") / F.when(rnd > 0, rnd)).alias("small_world_ratio"),
                    (F.col("clustering_coefficient") / F.when(rnd > 0, rnd) > 1).alias("is_small_world"))


#: Rows of a task in frames that many passes read: too few to use every core below the first, never more than the second.
FEWEST_ROWS, MOST_ROWS = 10_000, 250_000


def tasks_for(spark, rows: int) -> int:
    """Partitions for so many rows of a frame that is read again and again: a pass costs each partition a task and a
    result, so a small frame in the hundreds of partitions of a shuffle spends its time on them."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(cores, -(-rows // FEWEST_ROWS)), -(-rows // MOST_ROWS))


def packed(df: DataFrame, rows: int) -> DataFrame:
    """The frame in no more partitions than its rows need; one of few partitions stays as it is."""
    return df if few(df) else df.coalesce(tasks_for(df.sparkSession, rows))


def _materialize(df: DataFrame) -> DataFrame:
    """Cut lineage before an iteration: write to the reliable checkpoint dir.

    The frame is cached first so that the checkpoint write reads the cached
    blocks instead of recomputing the plan a second time."""
    ensure_checkpoint_dir(df.sparkSession)
    c = df.cache()
    out = c.checkpoint()
    c.unpersist()
    return out


def _packed(df: DataFrame) -> DataFrame:
    """As :func:`_materialize`, in no more partitions than the rows need: for state that many passes read."""
    ensure_checkpoint_dir(df.sparkSession)
    c = df.cache()
    out = packed(c, c.count()).checkpoint()
    c.unpersist()
    return out


def _maybe_checkpoint(df: DataFrame, i: int) -> DataFrame:
    if (i + 1) % CHECKPOINT_EVERY == 0:
        return _materialize(df)
    return df


def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """Weighted PageRank with uniform teleport and uniform redistribution of
    dangling mass; stops when Σ|Δ| < n·tol (tol=0 runs ``max_iter`` rounds)."""
    edges = _materialize(edges)
    v = _materialize(vertices(edges))
    n = v.count()
    if not n:
        return v.select("id", F.lit(0.0).alias("pagerank"))
    outw = edges.groupBy("src").agg(F.sum("w").alias("_ow"))
    tr = edges.join(outw, "src").select("src", "dst", F.coalesce(safe_div("w", "_ow"), F.lit(0.0)).alias("p"))
    tr = _materialize(tr.repartition("src"))  # once: a round joins only the state to it
    x = v.select("id", F.lit(1.0 / n).alias("x"))
    dangling_ids = _materialize(v.join(outw.withColumnRenamed("src", "id"), "id", "left_anti"))
    has_dangling = not dangling_ids.isEmpty()
    for i in range(max_iter):
        contrib = (tr.join(x.withColumnRenamed("id", "src"), "src")
                   .groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("p")).alias("_c")))
        base = v.join(contrib, "id", "left")
        if has_dangling:
            dm = x.join(dangling_ids, "id").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("_dm"))
            base = base.withColumn("_k", F.lit(1)).join(F.broadcast(dm.withColumn("_k", F.lit(1))), "_k")
            dterm = alpha * F.col("_dm") / n
        else:
            dterm = F.lit(0.0)
        nx = base.select("id", (alpha * F.coalesce(F.col("_c"), F.lit(0.0)) + (1 - alpha) / n + dterm).alias("x"))
        # the state is read twice per round only when there is dangling mass
        every = CHECKPOINT_EVERY if has_dangling else 5
        nx = _materialize(nx) if (i + 1) % every == 0 or tol > 0 else nx
        if tol > 0:
            err = nx.join(x.withColumnRenamed("x", "_old"), "id").agg(
                F.sum(F.abs(F.col("x") - F.col("_old")))).first()[0]
            x = nx
            if err < n * tol:
                break
            if i == max_iter - 1:
                warnings.warn(f"pagerank: not converged after {max_iter} rounds")
        else:
            x = nx
    return x.withColumnRenamed("x", "pagerank")


def eigenvector(edges: DataFrame, max_iter: int = 500, tol: float = 1e-6) -> DataFrame:
    """Weighted eigenvector centrality by power iteration on (Aᵀ + I),
    L2-normalised each round; in-edges accumulate (x[dst] += x[src]·w)."""
    edges = _materialize(edges)
    v = _materialize(vertices(edges))
    n = v.count()
    x = v.select("id", F.lit(1.0 / max(n, 1)).alias("x"))
    for i in range(max_iter):
        acc = (edges.join(x.withColumnRenamed("id", "src"), "src")
               .groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") * F.col("w")).alias("_a")))
        raw = _materialize(x.join(acc, "id", "left")
                           .select("id", (F.col("x") + F.coalesce(F.col("_a"), F.lit(0.0))).alias("x")))
        norm = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"))
        nx = (raw.withColumn("_k", F.lit(1)).join(F.broadcast(norm.withColumn("_k", F.lit(1))), "_k")
              .select("id", (F.col("x") / F.when(F.col("_n") != 0, F.col("_n")).otherwise(1.0)).alias("x")))
        if tol > 0:
            err = nx.join(x.withColumnRenamed("x", "_old"), "id").agg(
                F.sum(F.abs(F.col("x") - F.col("_old")))).first()[0]
            x = nx
            if err < n * tol:
                break
            if i == max_iter - 1:
                warnings.warn(f"eigenvector: not converged after {max_iter} rounds")
        else:
            x = nx
    return x.withColumnRenamed("x", "eigenvector")


def components(edges: DataFrame) -> DataFrame:
    """Weakly connected components; the label is the smallest vertex id of the component.

    Alternating large-star and small-star rounds (every larger neighbour, then every smaller one, is
    rewired to the smallest vertex of the neighbourhood) until the edges no longer change: O(log² n)
    rounds whatever the diameter, and no bound that could stop them early."""
    edges = _materialize(edges.select("src", "dst"))
    star = _materialize(edges.where("src != dst").select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    # partitions follow the edges: a small graph's rounds are a few tasks, not one for each shuffle partition
    parts = max(1, min(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), star.count() // EDGES_PER_TASK + 1))
    mark = None
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("_m", "u").alias("_m"))
        large = _materialize(both.where("v > u").join(low, "u")
                             .select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct().coalesce(parts))
        low = large.groupBy("u").agg(F.min("v").alias("_m"))
        star = _materialize(large.join(low, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).where("u != v")
                            .union(low).distinct().coalesce(parts))
        new = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == mark:
            break
        mark = new
    return vertices(edges).join(star.withColumnRenamed("u", "id"), "id", "left").select(
        "id", F.coalesce("v", "id").alias("component"))


def shortest_distances(edges: DataFrame, reverse: bool = False, hop: bool = False) -> DataFrame:
    """All-pairs shortest paths by synchronous Bellman–Ford relaxation on
    (source, node) rows — one join + min-aggregate per round until no distance
    improves.  ``reverse`` follows edges backwards (distances *to* a node);
    ``hop`` counts edges instead of summing weights.  State is O(n · reachable):
    meant for the graphs this library builds from entity flows."""
    edges = _materialize(edges)
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w") if reverse else edges
    e = e.where(F.col("src") != F.col("dst")).select("src", "dst", (F.lit(1.0) if hop else F.col("w")).alias("w"))
    d = vertices(edges).select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("dist"))
    while True:
        step = (d.join(e, d.node == e.src).select("source", F.col("dst").alias("node"),
                                                  (F.col("dist") + F.col("w")).alias("dist")))
        nd = _materialize(d.unionByName(step).groupBy("source", "node").agg(F.min("dist").alias("dist")))
        stable = (nd.join(d.withColumnRenamed("dist", "_old"), ["source", "node"], "left")
                  .where(F.col("_old").isNull() | (F.col("dist") < F.col("_old"))).isEmpty())
        d = nd
        if stable:
            break
    return d


def closeness(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Closeness with edge weight as distance; inward distances for digraphs;
    scaled by the reachable share ((r−1)/(n−1))·((r−1)/Σd)."""
    d = shortest_distances(edges, reverse=directed)
    n = vertices(edges).count()
    agg = d.where(F.col("source") != F.col("node")).groupBy("source").agg(
        F.sum("dist").alias("_s"), F.count(F.lit(1)).alias("_r"))
    v = vertices(edges).withColumnRenamed("id", "source")
    j = v.join(agg, "source", "left")
    r = F.coalesce(F.col("_r"), F.lit(0)).cast("double")
    val = F.when((F.col("_s") > 0) & (n > 1), (r / F.col("_s")) * (r / (n - 1))).otherwise(F.lit(0.0))
    return j.select(F.col("source").alias("id"), val.alias("closeness"))


def path_stats(edges: DataFrame) -> DataFrame:
    """Hop-based average shortest path length and diameter of an undirected
    graph (NULL when it is not connected)."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    d = shortest_distances(both, hop=True)
    n = vertices(edges).count()
    s = d.where(F.col("source") != F.col("node")).agg(
        F.count(F.lit(1)).alias("_pairs"), F.avg("dist").alias("_avg"), F.max("dist").alias("_max"))
    connected = F.col("_pairs") == n * (n - 1)
    return s.select(F.when(connected, F.col("_avg")).alias("avg_path_length"),
                    F.when(connected, F.col("_max")).alias("diameter"),
                    connected.alias("is_connected"))


#: Vertices of either side whose sketches a task of a hop holds; graphs of more are dealt out to more blocks.
BLOCK = 1 << 16
#: Vertices up to which whole sketches travel.
WHOLE = 1 << 16


@contextlib.contextmanager
def _settings(spark, values: dict):
    """Session settings that hold for some jobs only."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _dealt(both: DataFrame) -> tuple[DataFrame, int]:
    """(src, dst, block) of directed edges, and the number of blocks.  A block has the edges of one part of the vertices
    with more neighbours (on their edges) and one part of those with fewer, parts of ``BLOCK`` vertices; so a vertex of few
    neighbours is in a block or two, and one of many in as many as the others have parts."""
    spark = both.sparkSession
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("_s"))
    e = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("_s").alias("_d")), "dst")
    first = (F.col("_s") < F.col("_d")) | ((F.col("_s") == F.col("_d")) & (F.col("src") < F.col("dst")))
    ends = _materialize(e.select("src", "dst", F.when(first, F.col("src")).otherwise(F.col("dst")).alias("few"),
                                 F.when(first, F.col("dst")).otherwise(F.col("src")).alias("many")))
    few_n, many_n = ends.agg(F.approx_count_distinct("few"), F.approx_count_distinct("many")).first()
    cores = min(spark.sparkContext.defaultParallelism, -(-few_n // 1024))
    a = max(1, -(-many_n // BLOCK))
    b = max(1, -(-few_n // BLOCK), -(-cores // a))
    # labels that repartition() deals to a partition each
    own = spark.range(64 * a * b).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(a * b))).agg(F.min("x"))
    labels = [r[1] for r in own.collect()]
    place = F.pmod(F.xxhash64("many"), F.lit(a)) * b + F.pmod(F.xxhash64("few"), F.lit(b))
    block = F.lit(labels)[F.pmod(place, F.lit(len(labels)))]
    return _materialize(ends.select("src", "dst", block.cast("int").alias("block"))), a * b


def _size(edges: DataFrame) -> tuple[int, int]:
    """Numbers of vertices and of rows of edges, in one pass."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("_d"))
    n, ends = ends.agg(F.count(F.lit(1)), F.sum("_d")).first()
    return n, (ends or 0) // 2


def neighbourhood(edges: DataFrame, lg_k: int = 12, max_hops: int = 1000, n: tuple[int, int] | None = None) -> DataFrame:
    """G3 for large graphs: (hops, pairs) — ordered pairs of different vertices within so many hops — of an undirected
    graph, from one HyperLogLog sketch for each vertex.

    A vertex's sketch of the vertices within h + 1 hops is the union of its neighbours' sketches for h hops, so the state
    is one sketch a vertex (at most 2^lg_k registers) instead of all (source, node) pairs; the relative error of a sketch
    is about 0.83 / sqrt(2^lg_k), and small counts are exact.  Ends once no sketch grows (``max_hops`` warns).

    In a hop a sketch that grew in the one before travels once to each block of edges that needs it, and a block sends on one
    union for each vertex it reaches, so what is shuffled grows with the vertices' blocks, not with the edges.  Graphs of
    more than ``WHOLE`` vertices go through :mod:`.hops`, a slice of all registers after the other (there a small count can be
    off by the error of a sketch).  ``n``: numbers of vertices and edge rows, if they are known.
    """
    spark = edges.sparkSession
    size, n_edges = n or _size(edges)
    if size > WHOLE:
        from . import hops
        return spark.createDataFrame(hops.neighbourhood(edges, lg_k, max_hops, size, n_edges), "hops int, pairs double")
    own = _materialize(edges.where(F.col("src") != F.col("dst")).select("src", "dst"))
    both = _materialize(own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    dealt, blocks = _dealt(both)
    wanted = dealt.groupBy(F.col("dst").alias("id")).agg(F.collect_set("block").alias("blocks"))
    state = vertices(edges).groupBy("id").agg(F.hll_sketch_agg(F.col("id").cast("string"), F.lit(lg_k)).alias("s"))
    state = _materialize(state.join(wanted, "id", "left").withColumn("grown", F.lit(True)))
    rows, before = [], None
    for hop in range(max_hops + 1):
        n, within = state.agg(F.count(F.lit(1)), F.sum(F.hll_sketch_estimate("s") - 1).cast("double")).first()
        within = within or 0.0
        rows.append((hop, float(within)))
        if before is not None and within <= before:
            rows.pop()
            break
        before = within
        sent = state.where("grown").select(F.explode("blocks").alias("block"), F.col("id").alias("dst"), "s")
        # a block's edges and sketches meet in its task, which unites them in memory: at most its parts' vertices
        with _settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false",
                               "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(4 * BLOCK)}):
            met = dealt.repartition(blocks, "block").join(sent.repartition(blocks, "block"), ["block", "dst"]) \
                .groupBy(F.col("src").alias("id")).agg(F.hll_union_agg("s").alias("met"))
            union = F.when(F.col("met").isNull(), F.col("s")).otherwise(F.hll_union("s", "met"))
            state = _materialize(state.join(met, "id", "left").withColumn("union", union)
                                 .select("id", F.col("union").alias("s"), "blocks", (F.col("union") != F.col("s")).alias("grown")))
        if n > BLOCK:  # the last hop's shuffles and state go before the next one's come
            del sent, met
            gc.collect()
            spark.sparkContext._jvm.System.gc()
    else:
        warnings.warn(f"neighbourhood: still growing after {max_hops} hops")
    return edges.sparkSession.createDataFrame(rows, "hops int, pairs double")


def path_estimates(edges: DataFrame, lg_k: int = 12) -> DataFrame:
    """G3 for large graphs: estimated mean path length over connected pairs, diameter, effective diameter (90 % of the
    pairs, interpolated) and share of connected pairs, from :func:`neighbourhood`; the exact form is :func:`path_stats`."""
    n, rows = _size(edges)
    got = [(r["hops"], r["pairs"]) for r in neighbourhood(edges, lg_k, n=(n, rows)).orderBy("hops").collect()]  # one row a hop
    total = got[-1][1]
    mean = sum(h * (b - a) for (_, a), (h, b) in zip(got, got[1:])) / total if total else None
    effective = None
    for (h0, a), (_, b) in zip(got, got[1:]):
        if b >= 0.9 * total > a:
            effective = h0 + (0.9 * total - a) / (b - a)
    return edges.sparkSession.createDataFrame(
        [(mean, got[-1][0], effective, total / (n * (n - 1)) if n > 1 else None)],
        "avg_path_length double, diameter int, effective_diameter double, connected_share double")


def summary(edges: DataFrame, directed: bool = True) -> DataFrame:
    """One row of basic statistics with the mean path length, one of the small-world measures."""
    k = F.lit(1)
    paths = path_stats(to_undirected(edges) if directed else edges).select("avg_path_length", k.alias("_k"))
    first = basic(edges, directed).withColumn("_k", k).join(paths, "_k").drop("_k").withColumn("metric", F.lit("basic"))
    second = small_world(edges, directed).withColumn("metric", F.lit("small_world"))
    return first.unionByName(second, allowMissingColumns=True)


def betweenness(edges: DataFrame, pivots: int = 20, normalized: bool = True, seed: int = 42) -> DataFrame:
    """Weighted betweenness (edge weight as distance) by Brandes'
    accumulation from ``min(pivots, n)`` source pivots chosen by a seeded hash
    order, all pivots processed together as (source, node) rows:

    1. distances from the pivots (synchronous Bellman–Ford relaxation);
    2. shortest-path DAG edges u→v with d(s,u) + w = d(s,v);
    3. path counts σ propagated down the DAG, dependencies δ back up it, one
       join + aggregate per round until nothing changes;
    4. bc(v) = Σ_s δ(s, v), scaled by 1/((n−1)(n−2)) and n/k when normalised.

    Edges must have a positive length (others would make the shortest paths cyclic): the rest and
    self loops are left out.  All loops run until nothing changes.
    """
    v = _materialize(vertices(edges))
    edges = _materialize(edges.where((F.col("src") != F.col("dst")) & (F.col("w") > 0)))
    n = v.count()
    k = min(pivots, n)
    piv = v.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(k).select(F.col("id").alias("source"))
    d = v.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0.0).alias("dist")) \
        .join(piv, "source", "left_semi")
    while True:
        step = d.join(edges, d.node == edges.src).select("source", F.col("dst").alias("node"),
                                                         (F.col("dist") + F.col("w")).alias("dist"))
        nd = _materialize(d.unionByName(step).groupBy("source", "node").agg(F.min("dist").alias("dist")))
        stable = (nd.join(d.withColumnRenamed("dist", "_old"), ["source", "node"], "left")
                  .where(F.col("_old").isNull() | (F.col("dist") < F.col("_old"))).isEmpty())
        d = nd
        if stable:
            break
    du = d.select("source", F.col("node").alias("src"), F.col("dist").alias("du"))
    dv = d.select("source", F.col("node").alias("dst"), F.col("dist").alias("dv"))
    dag = _materialize(edges.join(du, "src").join(dv, ["source", "dst"])
                       .where(F.col("du") + F.col("w") == F.col("dv")).select("source", "src", "dst"))
    sigma = d.select("source", "node", F.when(F.col("node") == F.col("source"), F.lit(1.0))
                     .otherwise(F.lit(0.0)).alias("sigma"))
    while True:
        inc = (dag.join(sigma.select("source", F.col("node").alias("src"), F.col("sigma").alias("_s")), ["source", "src"])
               .groupBy("source", F.col("dst").alias("node")).agg(F.sum("_s").alias("_in")))
        ns = _materialize(sigma.join(inc, ["source", "node"], "left").select(
            "source", "node", F.when(F.col("node") == F.col("source"), F.lit(1.0))
            .otherwise(F.coalesce(F.col("_in"), F.lit(0.0))).alias("sigma")))
        stable = ns.join(sigma.withColumnRenamed("sigma", "_o"), ["source", "node"]) \
                   .where(F.col("sigma") != F.col("_o")).isEmpty()
        sigma = ns
        if stable:
            break
    delta = sigma.select("source", "node", F.lit(0.0).alias("delta"))
    while True:
        back = (dag.join(sigma.select("source", F.col("node").alias("src"), F.col("sigma").alias("sv")), ["source", "src"])
                .join(sigma.select("source", F.col("node").alias("dst"), F.col("sigma").alias("sw")), ["source", "dst"])
                .join(delta.select("source", F.col("node").alias("dst"), F.col("delta").alias("dw")), ["source", "dst"])
                .groupBy("source", F.col("src").alias("node"))
                .agg(F.sum(F.col("sv") / F.col("sw") * (1 + F.col("dw"))).alias("_d")))
        nd = _materialize(delta.join(back, ["source", "node"], "left")
                          .select("source", "node", F.coalesce(F.col("_d"), F.lit(0.0)).alias("delta")))
        stable = nd.join(delta.withColumnRenamed("delta", "_o"), ["source", "node"]) \
                   .where(F.abs(F.col("delta") - F.col("_o")) > 1e-12).isEmpty()
        delta = nd
        if stable:
            break
    bc = (delta.where(F.col("node") != F.col("source")).groupBy(F.col("node").alias("id"))
          .agg(F.sum("delta").alias("_b")))
    scale = 1.0
    if normalized and n > 2:
        scale = 1.0 / ((n - 1) * (n - 2)) * (n / k)
    return v.join(bc, "id", "left").select("id", (F.coalesce(F.col("_b"), F.lit(0.0)) * scale).alias("betweenness"))


def _undirected_both(edges: DataFrame) -> DataFrame:
    """Undirected weighted graph as both-direction rows (self loops once)."""
    u = to_undirected(edges)
    return u.unionByName(u.where(F.col("src") != F.col("dst"))
                         .select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def modularity(edges: DataFrame, labels: DataFrame) -> float | None:
    """Weighted modularity of a partition (labels: id, community) on the undirected
    graph; None for a graph without edge weight."""
    b = _undirected_both(edges)
    deg = b.groupBy(F.col("src").alias("id")).agg(
        F.sum(F.when(F.col("src") == F.col("dst"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k"))
    two_m = deg.agg(F.sum("k")).first()[0]
    if not two_m:
        return None
    lab = labels.select("id", "community")
    inside = (b.join(lab.withColumnRenamed("id", "src").withColumnRenamed("community", "cs"), "src")
              .join(lab.withColumnRenamed("id", "dst").withColumnRenamed("community", "cd"), "dst")
              .where(F.col("cs") == F.col("cd"))
              .groupBy("cs").agg(F.sum(F.when(F.col("src") == F.col("dst"), 2 * F.col("w"))
                                       .otherwise(F.col("w"))).alias("_in")))
    tot = deg.join(lab, "id").groupBy(F.col("community").alias("cs")).agg(F.sum("k").alias("_tot"))
    q = tot.join(inside, "cs", "left").agg(
        F.sum(F.coalesce(F.col("_in"), F.lit(0.0)) / two_m - (F.col("_tot") / two_m) ** 2)).first()[0]
    return float(q)


def louvain(edges: DataFrame, max_levels: int = 50, max_rounds: int = 100, seed: int = 42) -> DataFrame:
    """Louvain communities on the undirected weighted graph.

    Local moving is synchronous but split by a seeded hash parity per round (only
    half of the nodes may move in a round, so two neighbours never swap into
    each other's community at once); a node moves to the neighbouring community
    with the largest positive modularity gain (ties → smaller community id).
    After a level converges the graph is contracted by ``groupBy`` of community
    pairs and the next level starts; a level that still moves after ``max_rounds`` warns.  Returns (id, community) with communities
    named by their smallest member id.
    """
    g = _materialize(to_undirected(edges))
    labels = _materialize(vertices(g).select("id", F.col("id").alias("community")))  # original id → community
    for level in range(max_levels):
        b = _materialize(_undirected_both(g))
        deg = _materialize(b.groupBy(F.col("src").alias("id")).agg(
            F.sum(F.when(F.col("src") == F.col("dst"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k")))
        two_m = deg.agg(F.sum("k")).first()[0]
        if not two_m:
            break
        m = two_m / 2.0
        comm = deg.select("id", F.col("id").alias("c"))
        moved_any, quiet = False, 0
        for rnd in range(max_rounds):
            tot = deg.join(comm, "id").groupBy("c").agg(F.sum("k").alias("tot"))
            nb = (b.where(F.col("src") != F.col("dst"))
                  .join(comm.withColumnRenamed("id", "dst").withColumnRenamed("c", "cj"), "dst")
                  .groupBy(F.col("src").alias("id"), "cj").agg(F.sum("w").alias("k_ic")))
            me = comm.join(deg, "id")
            cand = (nb.join(me, "id").join(tot.withColumnRenamed("c", "cj").withColumnRenamed("tot", "tot_c"), "cj")
                    .join(tot.withColumnRenamed("tot", "tot_d"), "c"))
            own = (nb.join(comm, "id").where(F.col("cj") == F.col("c"))
                   .select("id", F.col("k_ic").alias("k_id")))
            cand = cand.join(own, "id", "left").withColumn("k_id", F.coalesce("k_id", F.lit(0.0)))
            tot_d_wo = F.col("tot_d") - F.col("k")
            gain = ((F.col("k_ic") - F.col("k_id")) / m
                    - F.col("k") * (F.col("tot_c") - tot_d_wo) / (2 * m * m))
            cand = cand.where(F.col("cj") != F.col("c")).withColumn("gain", gain).where(F.col("gain") > 1e-12)
            # the two rounds of a pair let the two halves move in turn
            parity = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.lit(rnd // 2), F.col("id")), F.lit(2)) == rnd % 2
            best = (cand.where(parity).groupBy("id")
                    .agg(F.min_by("cj", F.struct(-F.col("gain"), F.col("cj"))).alias("new_c")))
            nc = _materialize(comm.join(best, "id", "left")
                              .select("id", F.coalesce("new_c", "c").alias("c")))
            changed = not nc.join(comm.withColumnRenamed("c", "_o"), "id").where(F.col("c") != F.col("_o")).isEmpty()
            comm = nc
            quiet = 0 if changed else quiet + 1
            if changed:
                moved_any = True
                if rnd == max_rounds - 1:
                    warnings.warn(f"louvain: level {level} still moved after {max_rounds} rounds")
            elif quiet >= 2 and rnd % 2:  # both halves of a pair had nothing to move
                break
        if not moved_any:
            break
        # name communities by their smallest node, compose with the original labels, contract
        name = comm.groupBy("c").agg(F.min("id").alias("cn"))
        comm = _materialize(comm.join(name, "c").select("id", F.col("cn").alias("c")))
        labels = _materialize(labels.join(comm.withColumnRenamed("id", "community"), "community")
                              .select("id", F.col("c").alias("community")))
        g = _materialize(g.join(comm.withColumnRenamed("id", "src").withColumnRenamed("c", "cs"), "src")
                         .join(comm.withColumnRenamed("id", "dst").withColumnRenamed("c", "cd"), "dst")
                         .select(F.least("cs", "cd").alias("src"), F.greatest("cs", "cd").alias("dst"), "w")
                         .groupBy("src", "dst").agg(F.sum("w").alias("w")))
    name = labels.groupBy("community").agg(F.min("id").alias("_n"))
    return labels.join(name, "community").select("id", F.col("_n").alias("community"))
