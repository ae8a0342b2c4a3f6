"""Helpers of the operators: scratch tables, bounded text slices, word hashing on byte arrays."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy pass works on; intermediate arrays take 8 bytes for each.
SLICE_BYTES = 2 << 20

#: Rows of an Arrow batch in passes over whole texts: their bytes lie in the JVM and in the Python worker at once.
TEXT_ROWS = 1024

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of its own only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = tempfile.mkdtemp(prefix="flowpanel-llm-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor
    costs no recomputation.  ``batch_rows`` bounds the Arrow batches of this job's Python passes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, str(min(batch_rows, int(before)) if int(before) > 0 else batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of frames that are no longer referenced: the first round frees
    the frames, the second what they referred to."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(n: int) -> np.ndarray:
    p = np.full(n, BASE, U)
    p[:1] = 1
    return np.multiply.accumulate(p)


_POWERS = powers(1 << 12)


def utf8(texts: list) -> list[bytes]:
    """UTF-8 of each text; a null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def slices(sizes, limit: int = SLICE_BYTES):
    """Ranges of consecutive rows that hold about ``limit`` bytes, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batches, limit: int = SLICE_BYTES):
    """(ids, list of bytes) of bounded size from Arrow batches whose columns are id and text."""
    for batch in batches:
        ids, col = batch.column(0), batch.column(1)
        for lo in range(0, batch.num_rows, 256):
            part = utf8(col.slice(lo, 256).to_pylist())
            own = ids.slice(lo, 256).to_pylist()
            for a, b in slices([len(x) for x in part], limit):
                yield own[a:b], part[a:b]


class Words:
    """The words of a list of byte strings as arrays.

    ``data`` all bytes, ``start``/``end`` of each word, ``doc`` its row, ``first`` the index of each
    row's first word (one more entry than rows).  A word is a maximal run of bytes that ``table``
    maps to a non-zero byte; the mapped byte (lower-cased, say) is what is hashed.
    """

    def __init__(self, rows: list[bytes], table: np.ndarray):
        data = np.frombuffer(b"".join(rows), np.uint8)
        self.offset = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=self.offset[1:])
        self.data, self.mapped = data, table[data]
        inside = self.mapped != 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = self.offset[:-1][self.offset[:-1] < len(data)]
        begins[cut] = inside[cut]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(rows)), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each mapped word."""
        n = len(self.start)
        if not n:
            return np.zeros(0, U)
        length = self.end - self.start
        power = _POWERS if length.max() <= len(_POWERS) else powers(int(length.max()))
        total = np.zeros(n, U)
        # the k-th byte of every word that has one: as many rounds as a usual word has bytes
        live = np.arange(n)
        k = 0
        while k < 24 and len(live):
            total[live] += self.mapped[self.start[live] + k].astype(U) * power[k]
            k += 1
            live = live[length[live] > k]
        for i in live:  # long words, one by one
            rest = self.mapped[self.start[i] + k:self.end[i]].astype(U)
            total[i:i + 1] += (rest * power[k:k + len(rest)]).sum(dtype=U)
        return mix(total + length.astype(U))


def word_table(lower: bool, breaks) -> np.ndarray:
    """Byte map for :class:`Words`: 0 for bytes that ``breaks`` holds, A-Z lower-cased if asked."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[0x41:0x5B] += 0x20
    for b in breaks:
        t[b] = 0
    return t


#: ``[^\x20\x09-\x0D]+``.  A NUL byte belongs to words, so it maps to 0xFF, which UTF-8 never uses.
BLANKS = [0x20, *range(0x09, 0x0E)]


def blank_words(lower: bool) -> np.ndarray:
    t = word_table(lower, BLANKS)
    t[0] = 0xFF
    return t
