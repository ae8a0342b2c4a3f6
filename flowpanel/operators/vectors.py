"""Points as one ``array<double>`` column, and passes that sum matrices over them.

A frame of points has the column ``v`` whatever the dimension, so plans stay small: 64 aliased columns under one
condition make Catalyst infer constraints for every subset of aliases.  Fits read the points in passes: each task works
on blocks of rows with numpy and adds up its own sums (:func:`summed`); Spark adds up the tasks' arrays.  What reaches the
driver has the size of the model (clusters x dimensions, or dimensions squared), never of the data.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one matrix operation of a task works on.
BLOCK = 2048


def complete(df: DataFrame, cols=None) -> DataFrame:
    """Rows without a NULL or NaN in ``cols`` (default: all), as a plain conjunction: ``dropna`` over many columns is
    one condition that the optimiser rewrites for every alias of a nested column."""
    cols = list(df.columns if cols is None else cols)
    floats = {f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")}
    tests = [F.col(c).isNotNull() & ~F.isnan(c) if c in floats else F.col(c).isNotNull() for c in cols]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def points(df: DataFrame, cols, keep=()) -> DataFrame:
    """(keep..., v array<double>) of the rows without a missing coordinate; ``cols`` names the columns, or one array."""
    v = F.col(cols).cast("array<double>") if isinstance(cols, str) else F.array(*[F.col(c).cast("double") for c in cols])
    own = df.select(*keep, v.alias("v"))
    return own.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))


def literal(values) -> F.Column:
    return F.array(*[F.lit(float(x)) for x in values])


def moments(pts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, population standard deviation) of the points."""
    s = Summarizer.metrics("count", "mean", "variance").summary(array_to_vector("v"))
    row = pts.agg(s.alias("s")).select("s.*").first()
    n = int(row["count"] or 0)
    if not n:
        return 0, np.zeros(0), np.zeros(0)
    return n, row["mean"].toArray(), np.sqrt(row["variance"].toArray() * (n - 1) / n)


def standardised(pts: DataFrame) -> DataFrame:
    """Points scaled to mean 0 and population deviation 1; a constant coordinate becomes 0."""
    n, mean, sd = moments(pts)
    if not n:
        return pts
    z = F.zip_with(F.zip_with("v", literal(mean), lambda x, m: x - m), literal(sd), lambda x, s: F.when(s > 0, x / s).otherwise(F.lit(0.0)))
    return pts.withColumn("v", z)


def matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def blocks(batches):
    """(matrix of v, batch) in pieces of ``BLOCK`` rows; ``v`` is the last column."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            yield matrix(part.columns[-1]), part


#: Tasks whose sums the driver adds up itself; beyond that Spark does.
FEW = 16


#: Numbers a task may send to the driver itself in each pass of a fit; longer sums are added up by Spark first.
DIRECT = 4096


def few(pts: DataFrame) -> bool:
    return pts.rdd.getNumPartitions() <= FEW


def summed(pts: DataFrame, step, direct: bool = False) -> dict[int, np.ndarray]:
    """{key: sum of arrays}: ``step(matrix, batch)`` gives {key: flat array} for a block of points.

    ``direct`` (for points of :func:`few` tasks) leaves out the shuffle: each task's sums come to the driver."""
    own = pts.select(*[c for c in pts.columns if c != "v"], "v")

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for x, part in blocks(batches):
            for key, a in step(x, part).items():
                if key in total:
                    total[key] += a
                else:
                    total[key] = np.array(a, float)
        for key, a in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a))], ["key", "s"])

    parts = own.mapInArrow(run, "key int, s array<double>")
    if direct:
        out: dict[int, np.ndarray] = {}
        for r in parts.toArrow().to_batches():
            for key, a in zip(r.column(0).to_pylist(), r.column(1)):
                a = a.values.to_numpy(zero_copy_only=False)
                out[key] = out[key] + a if key in out else a.copy()
        return out
    got = parts.groupBy("key") \
        .agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")).collect()
    return {r["key"]: np.array(r["s"]) for r in got}


def mapped(pts: DataFrame, step, out: str, keep=()) -> DataFrame:
    """(keep..., columns of ``out``) for every point; ``step(matrix)`` gives the Arrow arrays of ``out``."""
    own = pts.select(*keep, "v")
    names = [f"k{i}" for i in range(len(keep))]
    kinds = [f"{n} {own.schema[c].dataType.simpleString()}" for n, c in zip(names, keep)]
    fields = [x.split()[0] for x in out.split(", ")]

    def run(batches):
        for x, part in blocks(batches):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *step(x)], [*names, *fields])

    return own.mapInArrow(run, ", ".join([*kinds, out])).withColumnsRenamed(dict(zip(names, keep)))


def lists(a: np.ndarray, kind=None) -> pa.ListArray:
    """Rows of a matrix as an Arrow list column."""
    n, m = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(a.ravel(), kind))


def covariance(pts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance with divisor n - 1) of the points: one pass, p squared numbers a task."""
    n, mean, _ = moments(pts)
    if n < 2:
        return n, mean, np.zeros((len(mean), len(mean)))

    def step(x, _):
        c = x - mean
        return {0: (c.T @ c).ravel()}

    s = summed(pts, step)[0].reshape(len(mean), -1)
    return n, mean, s / (n - 1)
