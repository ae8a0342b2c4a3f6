"""Second-order gradient-boosted regression trees on binned features.

Features are cut into quantile bins once, and the bins are written as a byte string for each row.  A tree grows level by
level: one pass over the rows sums gradients and hessians for every (node, feature, bin) that must be looked at; of two
siblings only the smaller is summed, the other is the parent less it.  The best split of a node maximises

    GL²/(HL + λ) + GR²/(HR + λ) − G²/(H + λ)

with missing values tried on either side, a leaf's weight is −G/(H + λ) times the learning rate.  ``growth="level"``
splits every node that gains; ``growth="leaf"`` takes the splits in order of gain until ``leaves`` leaves are reached:
as a node's split doesn't depend on its siblings, picking best first from the tree grown to ``max_depth`` gives the
same tree as growing it one leaf at a time.

A task reads bins, label and margin, adds the trees since the margin was last written, and finds each row's node; the
margin is written again every ``WRITE_EVERY`` trees.  The driver holds histograms (nodes x features x bins) and trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _materialize, _packed
from .vectors import few, lists, mapped, summed

#: Trees after which the rows' margins are written anew.
WRITE_EVERY = 10
#: Bins of a feature; one more, the last, holds missing values.
MAX_BINS = 255


@dataclass
class Preset:
    """Settings of a boosted model; the two constructors give the usual defaults of the two kinds."""
    rounds: int = 100
    rate: float = 0.1
    max_depth: int = 3
    growth: str = "level"
    leaves: int = 1 << 30
    l2: float = 1.0
    min_gain: float = 0.0
    min_hessian: float = 1.0
    min_rows: int = 1
    importance: str = "gain"

    @staticmethod
    def depth_wise(**changes) -> "Preset":
        """Level by level, λ = 1, a hessian of 1 at least in a child; importance by mean gain."""
        return Preset(**changes)

    @staticmethod
    def leaf_wise(**changes) -> "Preset":
        """Best leaf first, up to 31 leaves, no λ, 20 rows at least in a leaf; importance by number of splits."""
        return Preset(**({"growth": "leaf", "leaves": 31, "l2": 0.0, "min_hessian": 1e-3, "min_rows": 20, "importance": "split"} | changes))


@dataclass
class Tree:
    """Nodes in arrays: feature (-1 for a leaf), last bin that goes left, side of missing values, children, weight, gain."""
    feature: list = field(default_factory=list)
    bin: list = field(default_factory=list)
    missing_left: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    weight: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, weight: float) -> int:
        for a, x in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.weight, weight), (self.gain, 0.0)):
            a.append(x)
        return len(self.feature) - 1

    def nodes(self, bins: np.ndarray, missing: int, steps: int) -> np.ndarray:
        """Node of each row after at most ``steps`` splits."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, side = np.array(self.feature), np.array(self.bin), np.array(self.missing_left)
        left, right, rows = np.array(self.left), np.array(self.right), np.arange(len(bins))
        for _ in range(steps):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            b = bins[rows, np.where(inner, f, 0)]
            goes = np.where(b == missing, side[at], b <= cut[at])
            at = np.where(inner, np.where(goes, left[at], right[at]), at)
        return at

    def predict(self, bins: np.ndarray, missing: int) -> np.ndarray:
        return np.array(self.weight)[self.nodes(bins, missing, len(self.feature))]


def cut_points(rows: DataFrame, width: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Upper bounds of every feature's bins: distinct quantiles of its values in ``v`` (``percentile_approx`` with an error
    of 1/10,000; exact on fewer distinct values)."""
    probs = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
    value = lambda i: F.when(~F.isnan(F.col("v")[i]), F.col("v")[i])
    row = rows.agg(*[F.percentile_approx(value(i), probs, F.lit(10_000)).alias(f"q{i}") for i in range(width)]).first()
    return [np.unique([x for x in (row[f"q{i}"] or []) if x is not None]).astype(float) for i in range(width)]


def feature_array(df: DataFrame, features):
    """Features as one array column: from names of columns, or the name of one vector or array column."""
    if not isinstance(features, str):
        return F.array(*[F.col(c).cast("double") for c in features])
    if df.schema[features].dataType.typeName() == "vectorudt":
        from pyspark.ml.functions import vector_to_array
        return vector_to_array(features)
    return F.col(features).cast("array<double>")


def to_bins(x: np.ndarray, cuts: list[np.ndarray], missing: int) -> np.ndarray:
    """Bin of each value: the first whose bound isn't smaller; NaN is ``missing``."""
    out = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(x) else np.zeros(x.shape, int)
    out[np.isnan(x)] = missing
    return out.astype(np.uint8)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Preset):
    """(gain, feature, bin, missing left, left sums (G, H, n)) of a node's histograms (features x bins, the last bin for
    missing values), or None.  Ties go to the first feature, the smallest bin, missing values to the right."""
    total = g[0].sum(), h[0].sum(), n[0].sum()
    score = lambda a, b: a * a / (b + p.l2)
    best, found = p.min_gain, None
    with np.errstate(divide="ignore", invalid="ignore"):
        base = score(total[0], total[1])
        for missing_left in (False, True):
            left = [np.cumsum(a[:, :-1], axis=1) + (a[:, -1:] if missing_left else 0) for a in (g, h, n)]
            right = [t - a for t, a in zip(total, left)]
            ok = (left[2] >= p.min_rows) & (right[2] >= p.min_rows) & (left[1] >= p.min_hessian) & (right[1] >= p.min_hessian)
            gain = np.where(ok, (score(left[0], left[1]) + score(right[0], right[1]) - base) / 2, -np.inf)
            gain[np.isnan(gain)] = -np.inf
            at = int(gain.argmax())
            if gain.flat[at] > best + 1e-9 * max(1.0, abs(best)):
                f, b = divmod(at, gain.shape[1])
                best, found = float(gain.flat[at]), (float(gain.flat[at]), f, b, missing_left, tuple(float(a[f, b]) for a in left))
    return found


def _weight(sums, p: Preset) -> float:
    return -p.rate * sums[0] / (sums[1] + p.l2) if sums[1] + p.l2 > 0 else 0.0


class Boosted:
    """Trees over bins; ``base`` is the mean label."""

    def __init__(self, features, cuts, base: float, trees: list[Tree], preset: Preset, missing: int):
        self.features, self.cuts, self.base, self.trees, self.preset, self.missing = features, cuts, base, trees, preset, missing

    def margin(self, bins: np.ndarray, trees=None) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees if trees is None else trees:
            out += t.predict(bins, self.missing)
        return out

    @property
    def featureImportances(self):
        """As spark.ml's tree models have it."""
        return Vectors.dense(self.importances())

    def importances(self) -> np.ndarray:
        """Share of each feature: mean gain of its splits or their number, by the preset."""
        gain, count = np.zeros(len(self.cuts)), np.zeros(len(self.cuts))
        for t in self.trees:
            for f, a in zip(t.feature, t.gain):
                if f >= 0:
                    gain[f] += a
                    count[f] += 1
        v = count if self.preset.importance == "split" else gain / np.maximum(count, 1)
        return v / v.sum() if v.sum() else v

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Rows with the prediction; a vector column of features is left out."""
        keep = [c for c in df.columns if df.schema[c].dataType.typeName() != "vectorudt"]
        names = [f"_k{i}" for i in range(len(keep))]
        own = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], feature_array(df, self.features).alias("v"))
        got = mapped(_filled(own), lambda x: [pa.array(self.base + self.margin(to_bins(x, self.cuts, self.missing)))],
                     "_prediction double", names)
        return got.withColumnsRenamed(dict(zip(names, keep)) | {"_prediction": out})


def _filled(df: DataFrame) -> DataFrame:
    """``v`` with NaN for NULL, as arrays of a block become one matrix."""
    return df.withColumn("v", F.transform("v", lambda x: F.coalesce(x, F.lit(float("nan")))))


def fit(df: DataFrame, label: str, features, preset: Preset | None = None, max_bins: int = MAX_BINS, cuts=None) -> Boosted:
    """Boosted trees for squared error on the rows with a label (missing features allowed).

    ``features`` names the columns, or one array or vector column.  A constant label, or no gain anywhere, gives leaves
    only.  Without rows this raises.
    """
    p = preset or Preset()
    if max_bins > MAX_BINS:
        raise ValueError(f"at most {MAX_BINS} bins")
    start = _filled(df.select(F.col(label).cast("double").alias("y"), feature_array(df, features).alias("v"))
                    .where(F.col("y").isNotNull() & ~F.isnan("y")))
    base, n, count = start.agg(F.avg("y"), F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        raise ValueError("no row with a label")
    cuts = cut_points(start, count, max_bins) if cuts is None else cuts
    missing = max(len(c) for c in cuts) + 1
    width = missing + 1

    # bins and state of a row as one array: label, margin, bins
    rows = _packed(mapped(start, lambda x: [lists(to_bins(x, cuts, missing).astype(float))], "b array<double>", ["y"])
                        .select(F.concat(F.array("y", F.lit(float(base))), "b").alias("v")))
    model = Boosted(features, cuts, float(base), [], p, missing)
    written, direct = 0, few(rows)

    def split_state(x):
        return x[:, 0], x[:, 1], x[:, 2:].astype(np.uint8)

    for _ in range(p.rounds):
        tree, recent = Tree(), model.trees[written:]
        tree.add(0.0)
        hist: dict[int, tuple] = {}
        todo, parents = [0], {}
        sums: dict[int, tuple] = {}
        splits: dict[int, tuple] = {}
        for depth in range(p.max_depth):
            if not todo:
                break

            def step(x, _, tree=tree, todo=tuple(todo), recent=recent, depth=depth):
                y, margin, bins = split_state(x)
                g = margin + model.margin(bins, recent) - y
                at = tree.nodes(bins, missing, depth)
                place = np.full(len(tree.feature), -1)
                place[list(todo)] = range(len(todo))
                node = place[at]
                use = node >= 0
                flat = (node[use, None] * count + np.arange(count)) * width + bins[use]
                size = len(todo) * count * width
                weights = np.repeat(g[use], count)
                return {0: np.concatenate([np.bincount(flat.ravel(), weights, size), np.bincount(flat.ravel(), minlength=size).astype(float)])}

            got = summed(rows, step, direct)[0].reshape(2, len(todo), count, width)
            for i, node in enumerate(todo):
                hist[node] = (got[0, i], got[1, i])
                if node in parents:  # the sibling is the parent less this one
                    parent, other = parents[node]
                    hist[other] = (hist[parent][0] - got[0, i], hist[parent][1] - got[1, i])
            level = [x for x in hist if x not in splits and (x == 0 or x in sums)]
            todo, parents = [], {}
            for node in sorted(level):
                g, h = hist[node]
                if node == 0:
                    sums[0] = (float(g[0].sum()), float(h[0].sum()), float(h[0].sum()))
                    tree.weight[0] = _weight(sums[0], p)
                found = best_split(g, h, h, p)
                splits[node] = found
                if found is None:
                    continue
                gain, f, b, side, left = found
                right = tuple(t - a for t, a in zip(sums[node], left))
                a, c = tree.add(_weight(left, p)), tree.add(_weight(right, p))
                sums[a], sums[c] = left, right
                tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node] = f, b, side, gain
                tree.left[node], tree.right[node] = a, c
                small, other = (a, c) if left[2] <= right[2] else (c, a)
                todo.append(small)
                parents[small] = (node, other)
        model.trees.append(_best_first(tree, p.leaves) if p.growth == "leaf" else tree)
        if len(model.trees) - written == WRITE_EVERY and len(model.trees) < p.rounds:
            fresh = model.trees[written:]

            def raised(x, fresh=fresh):
                _, margin, bins = split_state(x)
                out = x.copy()
                out[:, 1] = margin + model.margin(bins, fresh)
                return [lists(out)]

            rows = _materialize(mapped(rows, raised, "w array<double>").select(F.col("w").alias("v")))
            written = len(model.trees)
    return model


def _best_first(tree: Tree, leaves: int) -> Tree:
    """The tree with only the ``leaves`` - 1 splits that best-first growth takes."""
    out = Tree()
    out.add(tree.weight[0])
    open_, place = [(-tree.gain[0], 0)] if tree.feature[0] >= 0 else [], {0: 0}
    taken = 1
    while open_ and taken < leaves:
        open_.sort()
        _, node = open_.pop(0)
        at = place[node]
        a, c = out.add(tree.weight[tree.left[node]]), out.add(tree.weight[tree.right[node]])
        out.feature[at], out.bin[at], out.missing_left[at], out.gain[at] = tree.feature[node], tree.bin[node], tree.missing_left[node], tree.gain[node]
        out.left[at], out.right[at] = a, c
        place[tree.left[node]], place[tree.right[node]] = a, c
        open_ += [(-tree.gain[x], x) for x in (tree.left[node], tree.right[node]) if tree.feature[x] >= 0]
        taken += 1
    return out


class BoostedRegressor:
    """A preset as an estimator over a vector column, beside spark.ml's."""

    def __init__(self, preset: Preset, features: str = "features", label: str = "label"):
        self.preset, self.features, self.label = preset, features, label

    def fit(self, df: DataFrame) -> Boosted:
        return fit(df, self.label, self.features, self.preset)
