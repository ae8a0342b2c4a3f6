"""Approximate nearest neighbours by cross-polytope hashing.

A table hashes a unit vector to the signed axis nearest to its pseudo-random rotation: three rounds of
random signs and a fast Hadamard transform.  Stored vectors go to one bucket of each table; a query
probes, in each table, the axes its rotation is nearest to.  Candidates are ranked by the exact cosine
in double precision.  Queries come in blocks of bounded size; each task hashes its vectors, ranks the
candidates of every query of the block and keeps the nearest few; Spark merges those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Tables, and axes that a query probes in each.
TABLES, PROBES = 24, 8
#: Query vectors of a block.
BLOCK = 8192
#: Candidates of a query that a task ranks exactly beyond those it returns: cosines of equal vectors differ in
#: the last bits of a matrix product.
MARGIN = 16
SEED = 29


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([(y[:, :, 0] + y[:, :, 1])[:, :, None], (y[:, :, 0] - y[:, :, 1])[:, :, None]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotate(unit: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-random rotation of a table: (signs, Hadamard) three times, over the next power of two."""
    n, d = unit.shape
    size = 1 << max(0, d - 1).bit_length()
    x = np.zeros((n, size), np.float32)
    x[:, :d] = unit
    rng = np.random.default_rng([seed, table, size])
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1, 1], np.float32), size)) / np.float32(np.sqrt(size))
    return x


def buckets(y: np.ndarray) -> np.ndarray:
    """The nearest signed axis: 2 * axis + (1 if negative)."""
    at = np.abs(y).argmax(axis=1)
    return 2 * at + (y[np.arange(len(y)), at] < 0)


def probes(y: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` signed axes nearest to each row."""
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    count = min(count, both.shape[1])
    return np.argpartition(-both, count - 1, axis=1)[:, :count]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision, the same for equal rows wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, keep: int, tables: int, count: int):
    """(query row, id, cosine) of the candidates nearest to each query among one task's vectors."""
    qu, xu = _unit(q), _unit(x)
    cand: list[tuple[np.ndarray, np.ndarray]] = []
    met = np.zeros((len(q), len(x)), bool)  # the same pair meets in several tables
    for t in range(tables):
        own = buckets(rotate(xu, t))
        order = np.argsort(own, kind="stable")
        probe = probes(rotate(qu, t), count)
        sizes = np.bincount(own, minlength=probe.max() + 1)
        ends = np.cumsum(sizes)
        # rows of the probed buckets, bucket by bucket: all queries that probe it against all its vectors
        flat = probe.ravel()
        by = np.argsort(flat, kind="stable")
        asked, first = np.unique(flat[by], return_index=True)
        for b, lo, hi in zip(asked, first, [*first[1:], len(by)]):
            if sizes[b]:
                met[np.ix_(by[lo:hi] // probe.shape[1], order[ends[b] - sizes[b]:ends[b]])] = True
    for lo in range(0, len(q), 256):
        s = np.where(met[lo:lo + 256], qu[lo:lo + 256] @ xu.T, -np.inf)
        few = min(keep + MARGIN, s.shape[1])
        top = np.argpartition(-s, few - 1, axis=1)[:, :few]
        row, col = np.nonzero(np.take_along_axis(s, top, 1) > -np.inf)
        cand.append((row + lo, top[row, col]))
    row, col = (np.concatenate([c[i] for c in cand]) for i in (0, 1))
    score = cosine(q[row], x[col])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep_ = rank < keep
    return row[keep_], ids[col[keep_]], score[keep_]


def _search(block: np.ndarray, keys: np.ndarray, keep: int, tables: int, count: int, rows: int = 4096):
    def run(batches):
        found: list[pa.RecordBatch] = []
        names = ["query_id", "vec_id", "score"]
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1).astype(np.float64)
                for qlo in range(0, len(block), 2048):
                    r, i, s = _nearest(block[qlo:qlo + 2048], x, part.column(0).to_numpy(), keep, tables, count)
                    found.append(pa.RecordBatch.from_arrays([pa.array(keys[qlo:qlo + 2048][r]), pa.array(i), pa.array(s)], names))
            if len(found) > 64:
                found = _merge(found, keep)
        yield from _merge(found, keep)
    return run


def _merge(found: list[pa.RecordBatch], keep: int) -> list[pa.RecordBatch]:
    """The nearest ``keep`` of each query over several results."""
    if not found:
        return []
    t = pa.Table.from_batches(found)
    q, i, s = (t.column(k).to_numpy() for k in range(3))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    ok = np.arange(len(q)) - np.searchsorted(q, q) < keep
    return [pa.RecordBatch.from_arrays([pa.array(q[ok]), pa.array(i[ok]), pa.array(s[ok])], t.schema.names)]


def search(vectors: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
           tables: int = TABLES, count: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which the column ``queries`` holds.

    Candidates are all rows but the query's own (all candidates found, if fewer than ``k``), nearest first,
    ties to the smaller id.  Rows with a null id, and vectors that are null, zero or hold null or non-finite
    components take no part; vectors of another length than the query's aren't its candidates.  Of equal
    vectors only the ``k + 1`` smallest ids can be an answer, so the others are left out before the search
    (exactly); equal query vectors are searched once.  Rows that repeat an id count once.
    """
    spark = vectors.sparkSession
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"),
                         F.coalesce(queries, F.lit(False)).alias("asked"))
    usable = own.where("vec_id is not null and size(v) > 0") \
        .where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)") \
        .dropDuplicates(["vec_id"])
    usable = materialize(usable, "ann-vectors")
    place = Window.partitionBy("v").orderBy("vec_id")
    stored = materialize(usable.withColumn("n", F.row_number().over(place)).where(F.col("n") <= k + 1).drop("n", "asked"), "ann-stored")
    asked = materialize(usable.where("asked").select(F.col("vec_id").alias("own_id"), "v"), "ann-queries")
    distinct = materialize(asked.groupBy("v").agg(F.min("own_id").alias("query_id")), "ann-distinct")
    best = None
    dims = [r[0] for r in distinct.select(F.size("v")).distinct().collect()]
    for dim in sorted(dims):
        mine = stored.where(F.size("v") == dim).select("vec_id", "v")
        for keys, q in _blocks(distinct.where(F.size("v") == dim), block):
            got = mine.mapInArrow(_search(q, keys, k + 1, tables, count), "query_id long, vec_id long, score double")
            best = got if best is None else best.unionByName(got)
    if best is None:
        best = spark.createDataFrame([], "query_id long, vec_id long, score double")
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k + 1).drop("rank")
    # back to every query row of a vector, without itself
    groups = asked.join(distinct, "v").select("query_id", "own_id")
    out = groups.join(best, "query_id").where("own_id != vec_id").drop("query_id").withColumnRenamed("own_id", "query_id")
    return out.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks(distinct: DataFrame, block: int):
    """The query vectors in blocks of bounded size."""
    keys, rows = [], []
    for r in distinct.select("query_id", "v").toLocalIterator():
        keys.append(r[0])
        rows.append(r[1])
        if len(keys) == block:
            yield np.array(keys, np.int64), np.array(rows, np.float64)
            keys, rows = [], []
    if keys:
        yield np.array(keys, np.int64), np.array(rows, np.float64)
