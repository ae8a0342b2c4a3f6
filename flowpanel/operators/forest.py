"""Regression trees and forests of spark.ml's kind (M6, M7) on large frames: no node of a deep tree reaches the driver.

spark.ml keeps all nodes on the driver and reads all rows once for each group of nodes that fits its memory.  Here features
are cut into bins once.  The top of a tree is grown level by level, one pass over the rows a level for all trees, until
no open node has more rows than a task may hold.  Then every row travels once to the open node it lies in, of each tree
that drew it, and a task grows everything below that node with numpy.  A split maximises the decrease of the variance;
a forest's rows are weighted by Poisson(1) numbers and a node looks at a third of the features, as in spark.ml.

A subtree is one row of a table; predictions send the rows to their subtrees.  The driver holds the tops and the sums of
the gains.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import MAX_BINS, cut_points, feature_array, to_bins
from .graph import _materialize
from .vectors import complete, matrix

#: Train rows beyond which a tree or forest is grown here; up to them spark.ml's is fitted.
LARGE = 1 << 16
#: Rows of an open node that a task grows further on its own; a tree alone is divided among the cores.
TASK_ROWS = 1 << 20
#: Cells (nodes x features x bins) of the histograms that are worked on at once.
CELLS = 1 << 21


class Nodes:
    """A tree in arrays: feature (-1 for a leaf), last bin that goes left, left child (the right one follows it), mean."""

    def __init__(self, feature, cut, left, value):
        self.feature, self.cut, self.left, self.value = feature, cut, left, value

    def at(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row."""
        out = np.zeros(len(bins), np.int64)
        live = np.arange(len(bins)) if self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(live):
            node = out[live]
            goes = bins[live, self.feature[node]] > self.cut[node]
            out[live] = self.left[node] + goes
            live = live[self.feature[out[live]] >= 0]
        return out


def splits(count: np.ndarray, total: np.ndarray):
    """(gain, feature's place, bin, left count, left sum) for each node from its histograms (nodes x features x bins) of weights and
    label sums; gain 0 where no split lowers the variance.  Ties go to the first feature, the smallest bin."""
    lc, ls = np.cumsum(count, axis=2)[:, :, :-1], np.cumsum(total, axis=2)[:, :, :-1]
    n, s = count[:, :1].sum(axis=2, keepdims=True), total[:, :1].sum(axis=2, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        base = s * s / n
        score = ls * ls / lc + (s - ls) ** 2 / (n - lc)
        score = np.where((lc > 0) & (n - lc > 0), score, -np.inf).reshape(len(count), -1)
    best, rows = score.argmax(axis=1), np.arange(len(count))
    top, base, n = score[rows, best], base[:, 0, 0], n[:, 0, 0]
    with np.errstate(invalid="ignore"):
        gain = np.where(top - base > 1e-12 * np.abs(top), (top - base) / n, 0.0)
    f, b = np.divmod(best, count.shape[2] - 1)
    return gain, f, b, lc.reshape(len(count), -1)[rows, best], ls.reshape(len(count), -1)[rows, best]


def drawn(rng, nodes: int, width: int, few: int) -> np.ndarray:
    """Features that each node looks at, in their order."""
    if few >= width:
        return np.tile(np.arange(width), (nodes, 1))
    return np.sort(np.argsort(rng.random((nodes, width)), axis=1)[:, :few], axis=1)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, size: int, few: int, rng) -> tuple[Nodes, np.ndarray]:
    """(tree of at most ``depth`` levels of splits, Σ gain · weight of each feature) of rows with bins below ``size``."""
    width = bins.shape[1]
    if width * math.log2(size) < 62:  # rows of equal bins are one row
        key = np.zeros(len(bins), np.int64)
        for j in range(width):
            key = key * size + bins[:, j]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        bins, y, w = bins[first], np.bincount(back, w * y, len(first)), np.bincount(back, w, len(first))
    else:
        y = w * y
    feature, cut, left = [np.array([-1], np.int8 if width < 128 else np.int32)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)]
    value = [np.array([y.sum() / w.sum()])]
    gains, made, start = np.zeros(width), 1, 0  # start: number of the level's first node
    at = np.zeros(len(bins), np.int64)
    kind = feature[0].dtype
    for _ in range(depth):
        nodes = len(feature[-1])
        chosen = drawn(rng, nodes, width, few)
        per = max(1, CELLS // (few * size))
        gain, f, b = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        ends = np.searchsorted(at, np.arange(0, nodes + per, per))  # rows lie in the order of their nodes
        child = np.zeros((nodes, 2, 2))
        for c, lo in enumerate(range(0, nodes, per)):
            rows, k = slice(ends[c], ends[c + 1]), min(per, nodes - lo)
            here = at[rows] - lo
            hist = np.zeros((2, k, few, size))
            for j in range(few):
                cell = here * size + bins[rows][np.arange(len(here)), chosen[at[rows], j]]
                for i, x in enumerate((w[rows], y[rows])):
                    hist[i, :, j] = np.bincount(cell, x, k * size).reshape(k, size)
            part = slice(lo, lo + k)
            gain[part], place, b[part], lc, ls = splits(hist[0], hist[1])
            f[part] = chosen[np.arange(lo, lo + k), place]
            n, s = hist[0, :, 0].sum(axis=1), hist[1, :, 0].sum(axis=1)
            child[part, 0, 0], child[part, 1, 0], child[part, 0, 1], child[part, 1, 1] = lc, n - lc, ls, s - ls
        split = gain > 0
        if not split.any():
            break
        place = np.cumsum(split) - 1
        feature[-1][split], cut[-1][split] = f[split].astype(kind), b[split]
        left[-1][split] = made + 2 * place[split]
        np.add.at(gains, f[split], gain[split] * child[split][:, :, 0].sum(axis=1))
        more = 2 * int(split.sum())
        feature.append(np.full(more, -1, kind))
        cut.append(np.zeros(more, np.uint8))
        left.append(np.zeros(more, np.int32))
        value.append((child[split][:, :, 1] / child[split][:, :, 0]).ravel())
        made += more
        live = split[at]
        bins, y, w, at = bins[live], y[live], w[live], at[live]
        at = 2 * place[at] + (bins[np.arange(len(at)), f[at]] > b[at])
        order = np.argsort(at, kind="stable")
        bins, y, w, at = bins[order], y[order], w[order], at[order]
    return Nodes(*(np.concatenate(x) for x in (feature, cut, left, value))), gains


def _weights(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) numbers of rows (their numbers) in a tree."""
    with np.errstate(over="ignore"):
        z = (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree + 1) * 0xD1342543DE82EF95 % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        z = z ^ (z >> np.uint64(31))
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
    return np.searchsorted(steps, (z >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


def cuts_of(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Cuts of every feature: all its values if they are no more than bins, else distinct quantiles of all rows."""
    def values(batches):
        seen = [np.zeros(0)] * width
        for batch in batches:
            x = matrix(batch.column(0))
            for j in range(width if len(x) else 0):
                if len(seen[j]) <= bins:
                    seen[j] = np.unique(np.concatenate([seen[j], x[:, j]]))[:bins + 1]
        for j, a in enumerate(seen):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), j), pa.int32()), pa.array(a)], ["j", "x"])

    few = [set() for _ in range(width)]
    for r in rows.select("v").mapInArrow(values, "j int, x double").distinct().toLocalIterator():
        if len(few[r["j"]]) <= bins:
            few[r["j"]].add(r["x"])
    quantiles = cut_points(rows, width, bins)
    return [np.array(sorted(a)[:-1]) if len(a) <= bins else q for a, q in zip(few, quantiles)]


class Forest:
    """Trees over bins: ``tops`` on the driver, a row of ``table`` (tree, top, nodes) for each of their leaves."""

    def __init__(self, features, cuts, tops: list[Nodes], table: DataFrame, importance: np.ndarray):
        self.features, self.cuts, self.tops, self.table, self.importance = features, cuts, tops, table, importance

    @property
    def featureImportances(self):
        """As spark.ml's tree models have it."""
        return Vectors.dense(self.importance)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Rows with the prediction; a vector column of features is left out."""
        keep = [c for c in df.columns if df.schema[c].dataType.typeName() != "vectorudt"]
        own = _materialize(df.select(*keep, feature_array(df, self.features).alias("_v"), F.monotonically_increasing_id().alias("_row")))
        cuts, tops = self.cuts, self.tops
        missing = max(len(c) for c in cuts) + 1
        shares = max(1, -(-own.count() // TASK_ROWS))  # a task predicts that many rows with a subtree

        def sent(batches):
            for batch in batches:
                rows, bins = batch.column(0).to_numpy(), to_bins(matrix(batch.column(1)), cuts, missing)
                for share in range(shares):
                    mine = rows % shares == share
                    if mine.any():
                        yield from _dealt(tops, lambda t, mine=mine: (bins[mine], {"rows": rows[mine]}), {"share": share})

        parts = own.select("_row", "_v").mapInArrow(sent, "tree int, top int, share int, bins binary, rows binary")
        table = self.table.drop("gains").crossJoin(df.sparkSession.range(shares).select(F.col("id").cast("int").alias("share")))
        width = len(cuts)

        def predicted(rows: pa.Table, tree: pa.Table) -> pa.Table:
            if not rows.num_rows or not tree.num_rows:
                return empty
            bins = _joined(rows["bins"], np.uint8).reshape(-1, width)
            nodes = Nodes(*(np.frombuffer(tree[c][0].as_py(), k) for c, k in zip(("feature", "cut", "left", "value"), KINDS)))
            return pa.table({"_row": _joined(rows["rows"], np.int64), "_value": nodes.value[nodes.at(bins)]})

        empty = pa.table({"_row": pa.array([], pa.int64()), "_value": pa.array([], pa.float64())})
        keys = ["tree", "top", "share"]
        got = parts.groupBy(*keys).cogroup(table.groupBy(*keys)).applyInArrow(predicted, "_row long, _value double")
        mean = got.groupBy("_row").agg(F.avg("_value").alias(out))
        return own.drop("_v").join(mean, "_row").drop("_row")


#: Types of a subtree's arrays.
KINDS = (np.int32, np.uint8, np.int32, np.float64)


def _joined(col: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in col), kind)


def _dealt(tops: list[Nodes], of_tree, also: dict):
    """A batch row (tree, top, ...) for each leaf of a top that rows of ``of_tree(tree)`` = (bins, {name: array}) lie in."""
    for t, top in enumerate(tops):
        bins, arrays = of_tree(t)
        leaf = top.at(bins)
        order = np.argsort(leaf, kind="stable")
        leaves, starts = np.unique(leaf[order], return_index=True)
        for x, rows in zip(leaves, np.split(order, starts[1:])):
            values = {"tree": pa.array([t], pa.int32()), "top": pa.array([x], pa.int32())} | {k: pa.array([v], pa.int32()) for k, v in also.items()}
            values |= {k: pa.array([a[rows].tobytes()], pa.binary()) for k, a in ({"bins": bins} | arrays).items()}
            yield pa.RecordBatch.from_pydict(values)


def fit(est, df: DataFrame, label: str = "label", features: str = "features") -> Forest:
    """The model that ``est``, a DecisionTreeRegressor or RandomForestRegressor, stands for, grown on all rows of ``df`` with a label
    and all features.  A constant label gives leaves only.  Without rows this raises."""
    if not isinstance(est, (DecisionTreeRegressor, RandomForestRegressor)):
        raise ValueError(f"not a tree or forest: {est}")
    spark = df.sparkSession
    alone = isinstance(est, DecisionTreeRegressor)
    trees, depth, seed = 1 if alone else est.getNumTrees(), est.getMaxDepth(), est.getSeed()
    start = complete(df.select(F.col(label).cast("double").alias("y"), feature_array(df, features).alias("v")), ["y"]) \
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    mean, n, width = start.agg(F.avg("y"), F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        raise ValueError("no row with a label and all features")
    few = width if alone else max(1, math.ceil(width / 3))
    if est.getMaxBins() > MAX_BINS:
        raise ValueError(f"at most {MAX_BINS} bins")
    cuts = cuts_of(start, width, est.getMaxBins())
    size = max(len(c) for c in cuts) + 1

    def binned(batches):
        for i, batch in enumerate(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([(TaskContext.get().partitionId() << 20) + i], pa.int64()),
                    "bins": pa.array([to_bins(matrix(batch.column(1)), cuts, size).tobytes()], pa.binary()),
                    "y": pa.array([(batch.column(0).to_numpy() - mean).tobytes()], pa.binary())})

    blocks = _materialize(start.mapInArrow(binned, "block long, bins binary, y binary"))

    def read(batches):
        """(bins, label, weights of a tree) of each block."""
        for batch in batches:
            for block, bins, y in zip(*(c.to_pylist() for c in batch.columns)):
                bins, y = np.frombuffer(bins, np.uint8).reshape(-1, width), np.frombuffer(y)
                rows = (block << 20) + np.arange(len(y))
                yield bins, y, (lambda t, k=len(y): np.ones(k)) if alone else (lambda t, rows=rows: _weights(rows, t, seed))

    cores = spark.sparkContext.defaultParallelism
    most = TASK_ROWS // max(1, -(-cores // trees))
    tops = [Nodes(np.array([-1], np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1)) for _ in range(trees)]
    gains = np.zeros((trees, width))
    todo = {t: [0] for t in range(trees)} if n > most else {}
    shut = {t: set() for t in range(trees)}
    for level in range(depth):
        if not todo:
            break

        def sums(batches, todo=todo, tops=tops):
            total = {}
            for bins, y, weights in read(batches):
                for t, nodes in todo.items():
                    place = np.full(len(tops[t].feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    at = place[tops[t].at(bins)]
                    use = at >= 0
                    w = weights(t)[use]
                    cell = (at[use, None] * width + np.arange(width)) * size + bins[use]
                    cells, length = cell.ravel(), len(nodes) * width * size
                    got = np.concatenate([np.bincount(cells, np.repeat(w, width), length), np.bincount(cells, np.repeat(w * y[use], width), length)])
                    total[t] = total[t] + got if t in total else got
            for t, a in total.items():
                yield pa.RecordBatch.from_pydict({"t": pa.array([t], pa.int32()), "s": pa.array([a], pa.list_(pa.float64()))})

        got = blocks.mapInArrow(sums, "t int, s array<double>").groupBy("t").agg(
            vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
        following = {}
        for r in got.toLocalIterator():
            t, nodes, top = r["t"], todo[r["t"]], tops[r["t"]]
            hist = np.array(r["s"]).reshape(2, len(nodes), width, size)
            rng = np.random.default_rng((seed % (1 << 32), t, level, 1))
            chosen = drawn(rng, len(nodes), width, few)
            mine = np.take_along_axis(hist, chosen[None, :, :, None], axis=2)
            count, total = hist[0, :, 0].sum(axis=1), hist[1, :, 0].sum(axis=1)
            gain, place, cut, lc, ls = splits(mine[0], mine[1])
            for i, node in enumerate(nodes):
                if not gain[i] > 0:
                    top.value[node] = mean + total[i] / count[i] if count[i] else mean
                    shut[t].add(node)
                    continue
                f, a = int(chosen[i, place[i]]), len(top.feature)
                top.feature[node], top.cut[node], top.left[node] = f, cut[i], a
                gains[t, f] += gain[i] * count[i]
                top.feature = np.append(top.feature, [-1, -1]).astype(np.int32)
                top.cut, top.left = np.append(top.cut, [0, 0]), np.append(top.left, [0, 0])
                top.value = np.append(top.value, mean + np.array([ls[i] / lc[i], (total[i] - ls[i]) / (count[i] - lc[i])]))
                for child, rows in ((a, lc[i]), (a + 1, count[i] - lc[i])):
                    if level + 1 == depth:
                        shut[t].add(child)
                    elif rows > most:
                        following.setdefault(t, []).append(child)
        todo = following
    levels = [_levels(top) for top in tops]

    def sent(batches):
        for bins, y, weights in read(batches):
            def of_tree(t, bins=bins, y=y, weights=weights):
                w = weights(t)
                use = w > 0
                if shut[t]:
                    use &= ~np.isin(tops[t].at(bins), list(shut[t]))
                return bins[use], {"y": y[use], "w": w[use].astype(np.uint8)}
            yield from _dealt(tops, of_tree, {})

    def grown(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        t, top = key[0].as_py(), key[1].as_py()
        bins = _joined(rows["bins"], np.uint8).reshape(-1, width)
        rng = np.random.default_rng((seed % (1 << 32), t, top, 0))
        nodes, gain = grow(bins, _joined(rows["y"], np.float64), _joined(rows["w"], np.uint8).astype(float), depth - int(levels[t][top]), size, few, rng)
        nodes.value = nodes.value + mean
        return pa.table({"tree": pa.array([t], pa.int32()), "top": pa.array([top], pa.int32()), "gains": pa.array([gain], pa.list_(pa.float64()))}
                        | {c: pa.array([getattr(nodes, c).astype(k).tobytes()], pa.binary()) for c, k in zip(("feature", "cut", "left", "value"), KINDS)})

    fields = "tree int, top int, gains array<double>, feature binary, cut binary, left binary, value binary"
    parts = blocks.mapInArrow(sent, "tree int, top int, bins binary, y binary, w binary")
    table = parts.groupBy("tree", "top").applyInArrow(grown, fields)
    ended = [(t, x, [0.0] * width, *(np.array([v], k).tobytes() for v, k in zip((-1, 0, 0, tops[t].value[x]), KINDS))) for t in shut for x in sorted(shut[t])]
    if ended:
        table = table.unionByName(spark.createDataFrame(ended, fields))
    table = _materialize(table)
    for r in table.groupBy("tree").agg(vector_to_array(Summarizer.sum(array_to_vector("gains"))).alias("s")).collect():
        gains[r["tree"]] += np.array(r["s"])
    total = gains.sum(axis=1, keepdims=True)
    share = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).sum(axis=0)
    return Forest(features, cuts, tops, table, share / share.sum() if share.sum() else share)


def _levels(top: Nodes) -> np.ndarray:
    """Splits above each node of a top."""
    out = np.zeros(len(top.feature), np.int64)
    for node in np.nonzero(top.feature >= 0)[0]:  # children come after their parents
        out[top.left[node]] = out[top.left[node] + 1] = out[node] + 1
    return out
