"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of every whole text are taken once.  Random Fourier features approximate a Gaussian
kernel over the standardised statistics; the normal equations are summed within partitions, then by
Spark, and solved on the driver (features x features).  A second fold of the labelled rows, reduced
to a histogram of scores, fits an isotonic map from score to probability.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Random features, kernel width (in standard deviations of a statistic), ridge weight, seed.
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 17
#: Bins of the calibration histogram.
BINS = 2000

_sentences = re.compile(r"[.!?…]+").split


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; a null or empty text has zeros."""
    if not text:
        return [0.0] * N_STATISTICS
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    by = np.bincount(raw, minlength=256)
    words = text.split()
    m = max(1, len(words))
    kinds = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    upper, lower = by[65:91].sum(), by[97:123].sum()
    high = by[192:].sum()
    p = by[by > 0] / n
    top = 0
    if words:
        codes = np.fromiter(map(hash, words), np.int64, len(words))
        top = np.unique(codes, return_counts=True)[1].max()
    same = sum(map(str.__eq__, words, words[1:]))
    sentences = [s for s in _sentences(text) if s.strip()]
    return [
        np.log1p(n), np.log1p(m), n / m, max(map(len, words), default=0) ** 0.5,
        len(kinds) / m, len(pairs) / m, top / m, same / m,
        upper / n, upper / (upper + lower + 1), high / n, by[48:58].sum() / n,
        (by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum()) / m,
        (by[33] + by[63]) / m, (by[44] + by[46]) / m, by[124] / m,
        by[[35, 36, 37, 38, 42, 64, 94, 126]].sum() / m, by[[60, 62, 91, 93, 123, 125]].sum() / m,
        by[10] / m, len(set(lines)) / max(1, len(lines)), m / max(1, len(sentences)) / 50,
        -(p * np.log2(p)).sum(), sum(w.isupper() for w in words) / m, sum(w.istitle() for w in words) / m,
        sum(w.isalpha() for w in words) / m]


N_STATISTICS = 25


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<double>) for every row."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [statistics(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "stats"])

    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, stats array<double>").withColumnRenamed("id", id_col)


class Model:
    """Means and deviations of the statistics, random frequencies, ridge weights, calibration steps."""

    def __init__(self, mean, deviation, seed: int = SEED, features: int = FEATURES):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, deviation
        self.w = rng.normal(size=(len(mean), features)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.steps, self.values = np.zeros(1), np.full(1, 0.5)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.deviation, -8, 8)
        f = np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)
        return np.concatenate([f, np.ones((len(f), 1))], axis=1)

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.ridge(stats), self.steps, self.values)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in order of x: means that never fall."""
    blocks: list[list[float]] = []
    for a, s, c in zip(x, y, n):
        blocks.append([a * c, s, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(batch.num_rows, -1)


def train(stats: DataFrame, fit: str = "fold = 0", calibrate: str = "fold = 1", features: int = FEATURES) -> Model:
    """Fit on rows (stats, label 0/1, fold); rows without a label take no part.  Without labelled rows
    every score is 0.5."""
    rows = stats.where("label is not null")
    sums = rows.where(fit).mapInArrow(_moments, "n long, s array<double>, q array<double>").collect()
    width = N_STATISTICS
    n = sum(r.n for r in sums)
    if not n:
        return Model(np.zeros(width), np.ones(width), features=features)
    mean = sum(np.array(r.s) for r in sums) / n
    spread = np.sqrt(np.maximum(sum(np.array(r.q) for r in sums) / n - mean ** 2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), features=features)
    # partial normal equations of each partition, summed by row of the matrix
    parts = rows.where(fit).mapInArrow(_equations(model), "i int, row array<double>")
    size = features + 2
    got = parts.groupBy("i").agg(*[F.sum(F.col("row")[k]).alias(f"c{k}") for k in range(size)]).toPandas()
    got = got.sort_values("i").drop(columns="i").to_numpy()
    gram, right = got[:, :-1], got[:, -1]
    penalty = RIDGE * n * np.eye(len(gram))
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(gram + penalty, right)
    bins = rows.where(calibrate).mapInArrow(_bins(model), "bin int, x double, y double, n double").groupBy("bin").agg(
        F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum("n").alias("n")).toPandas().sort_values("bin")
    if len(bins):
        model.steps, model.values = isotonic((bins["x"] / bins["n"]).to_numpy(), bins["y"].to_numpy(), bins["n"].to_numpy())
    else:
        model.steps, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def _moments(batches):
    """(rows, sums, sums of squares) of the partition."""
    n, s, q = 0, np.zeros(N_STATISTICS), np.zeros(N_STATISTICS)
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch, batch.schema.get_field_index("stats"))
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x ** 2).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([q.tolist()])], ["n", "s", "q"])


def _equations(model: Model):
    def run(batches):
        total = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                f = model.features(_matrix(part, part.schema.get_field_index("stats")))
                y = part.column("label").to_numpy(zero_copy_only=False).astype(float)
                total = total + f.T @ np.concatenate([f, y[:, None]], axis=1)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist())], ["i", "row"])
    return run


def _bins(model: Model):
    def run(batches):
        total = np.zeros((3, BINS))
        for batch in batches:
            if batch.num_rows:
                x = model.ridge(_matrix(batch, batch.schema.get_field_index("stats")))
                y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
                at = np.clip(((x + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                total += [np.bincount(at, v, BINS) for v in (x, y, np.ones_like(y))]
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(t[at]) for t in total)], ["bin", "x", "y", "n"])
    return run


def score(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score in 0..1) for every row of :func:`describe`'s result; higher: label 1 is likelier."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = np.clip(model.probability(_matrix(batch, 1)), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["id", "score"])

    own = stats.select(stats[id_col].alias("id"), "stats")
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, held_out, fold, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) for every row of ``docs``, learned from the labelled rows that ``held_out`` (a column of
    the id) doesn't name; ``fold`` (0 or 1) deals those to fitting and calibration.

    A null or empty text has a score too; labels other than 0 and 1 and ids without a label take no part;
    an id labelled twice counts once, by its smaller label; repeated documents are scored each.
    """
    own = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")) \
        .where("label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    stats = materialize(describe(docs, id_col, text_col).withColumnRenamed(id_col, "id"), "quality-stats")
    learn = stats.where(~F.coalesce(held_out("id"), F.lit(True))).join(own, "id").withColumn("fold", fold("id"))
    model = train(materialize(learn, "quality-train"))
    return score(stats, model, "id").withColumnRenamed("id", id_col)
