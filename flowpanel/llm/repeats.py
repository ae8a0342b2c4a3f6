"""Windows of a fixed number of symbols that repeat across a corpus, without a shuffle of all positions.

The smallest hash among a window's q-grams is its key: equal windows have equal keys, wherever they
stand.  Consecutive windows of one key form a context (a piece of text, about 13 windows).

1. Documents are packed into chunks (a written table, compressed).
2. Each chunk sends the 32 low bits of its distinct keys to buckets, dealt by the high bits, and their
   numbers of distinct contexts; a bucket answers two bits for each key: does another chunk have it, and has
   it more than ``HOT_CONTEXTS`` contexts?  Contexts of such hot keys are divided into windows, whose keys are
   the hashes of their whole content, and step 2 is done once more for these.
3. Each chunk sends the distinct contexts of repeated keys (equal ones within a chunk once, with their
   number or smallest id) to the buckets; a bucket, the shard of the operators, decides each window
   exactly from the contexts' symbols and answers one bit for each window.
4. Each chunk spreads the bits over its documents.

A passage that a third of the documents share reaches its bucket once for each chunk, not once for each
document; so does each window around a phrase that many documents hold between different neighbours, if the
window repeats at all.  Buckets are as many as keys need at ``BUCKET_KEYS`` each, chunks hold ``CHUNK_BYTES`` of text.
Repeated keys that differ in symbols (32-bit collisions included) cost time only, for step 3 compares symbols.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BASE, TEXT_ROWS, Words, blank_words, materialize, mix, release, slices, utf8

U = np.uint64
CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 1 << 17
#: Contexts of a key (distinct within a chunk, over all chunks) up to which they go to one bucket.
HOT_CONTEXTS = 1 << 12
#: An id that stands for null: the largest.
NULL_ID = (1 << 63) - 1


def pack(data) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(bytes(data))


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


@dataclass(frozen=True)
class Spec:
    """``window`` symbols (words or bytes), keys from grams of ``gram``; contexts have up to ``longest`` windows
    (at most ``window``).  ``weigh`` is what is kept of equal contexts in a chunk: their number or the smallest id.
    ``decide(contexts)`` says of each window of a bucket's contexts whether it is to go."""

    window: int
    gram: int
    words: bool
    weigh: str
    decide: object

    @property
    def longest(self) -> int:
        return self.window


def chunks(docs: DataFrame, id_col: str, text_col: str, name: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of documents: (chunk, ids, sizes, blob, bytes of text)."""
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def flush():
            nonlocal ids, texts, size, seq
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + seq]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                     pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()),
                     pa.array([pack(b"".join(texts))], pa.binary()), pa.array([size])],
                    ["chunk", "ids", "sizes", "blob", "bytes"])
                ids, texts, size, seq = [], [], 0, seq + 1

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                own = utf8(batch.column(1).slice(lo, 256).to_pylist())
                for i, t in zip(batch.column(0).slice(lo, 256).to_pylist(), own):
                    if size and size + len(t) > chunk_bytes:
                        yield from flush()
                    ids.append(NULL_ID if i is None else i)
                    texts.append(t)
                    size += len(t)
        yield from flush()

    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return materialize(own.mapInArrow(run, "chunk long, ids binary, sizes binary, blob binary, bytes long"), name, TEXT_ROWS)


class Chunk:
    """The documents of a chunk as one sequence of symbols."""

    def __init__(self, spec: Spec, ids: bytes, sizes: bytes, blob: bytes):
        self.spec = spec
        self.ids = np.frombuffer(ids, np.int64)
        size = np.frombuffer(sizes, np.int64)
        raw = unpack(blob)
        ends = np.cumsum(size)
        self.rows = [raw[e - n:e] for e, n in zip(ends.tolist(), size.tolist())]
        if not spec.words:
            self.symbols = np.frombuffer(raw, np.uint8)
            self.first = np.concatenate([[0], ends])
        else:
            table, parts, counts = blank_words(False), [], []
            for a, b in slices(size.tolist()):
                w = Words(self.rows[a:b], table)
                parts.append(w.hashes())
                counts.append(w.counts())
            self.symbols = np.concatenate(parts) if parts else np.zeros(0, U)
            self.first = np.concatenate([[0], np.cumsum(np.concatenate(counts) if counts else [])]).astype(np.int64)
        self._runs()

    def _runs(self) -> None:
        """Contexts: start, windows, key, document, and a hash of the content."""
        start, count, key, content, twice = [], [], [], [], []
        for a, b in slices(np.diff(self.first).tolist(), 1 << 19):
            lo, hi = self.first[a], self.first[b]
            for out, x in zip((start, count, key, content, twice), _runs(self.spec, self.symbols[lo:hi], self.first[a:b + 1] - lo)):
                out.append(x + lo if out is start else x)
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.start, self.count = cat(start, np.int64), cat(count, np.int64)
        self.key, self.content, self.twice = cat(key, U), cat(content, U), cat(twice, bool)
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1
        self._index = None

    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct keys, index of every context's key, contexts of each key), sorted once."""
        if self._index is None:
            self._index = np.unique(self.key, return_inverse=True, return_counts=True)
        return self._index

    def keys(self) -> np.ndarray:
        return self.index()[0]

    def _order(self, own: np.ndarray) -> np.ndarray:
        """Contexts ``own`` in the order of their keys, equal contents next to each other: one sort by the key's index
        and as many bits of the content as fit.  Contents that agree in these bits may come mixed."""
        keys, inverse, _ = self.index()
        bits = max(1, len(keys).bit_length())
        return own[np.argsort((inverse[own].astype(U) << U(64 - bits)) | (self.content[own] >> U(bits)), kind="stable")]

    def _new(self, own: np.ndarray) -> np.ndarray:
        """Of ordered contexts: differs from the one before."""
        new = np.ones(len(own), bool)
        new[1:] = (self.content[own[1:]] != self.content[own[:-1]]) | (self.key[own[1:]] != self.key[own[:-1]])
        return new

    def distinct(self) -> np.ndarray:
        """Number of distinct contexts of each key, in the order of ``keys``."""
        own = self._order(np.arange(len(self.key)))
        return np.bincount(self.index()[1][own[self._new(own)]], minlength=len(self.keys()))

    def divide(self, hot: np.ndarray) -> np.ndarray:
        """Contexts of the keys that ``hot`` marks (in the order of ``keys``) become single windows with keys of
        their own, which are returned sorted."""
        if not hot.any():
            return np.zeros(0, U)
        keys, inverse, n = self.index()
        many = hot[inverse]
        at = spread(self.start[many], self.count[many])
        own = mix(window_hashes(self.symbols, at, self.spec.window) + U(1))
        doc = np.searchsorted(self.first, at, side="right") - 1
        for name, new in (("start", at), ("count", np.ones(len(at), np.int64)), ("key", own), ("content", own),
                          ("twice", np.zeros(len(at), bool)), ("doc", doc)):
            setattr(self, name, np.concatenate([getattr(self, name)[~many], new]))
        # the index of what stays is known, only the windows' keys are sorted
        fresh, fresh_inverse, fresh_n = np.unique(own, return_inverse=True, return_counts=True)
        stay = keys[~hot]
        every = np.concatenate([stay, fresh])
        every.sort(kind="stable")  # merges the two sorted parts
        every = every[np.concatenate([every[:1] == every[:1], every[1:] != every[:-1]])]
        a, b = np.searchsorted(every, stay), np.searchsorted(every, fresh)
        total = np.zeros(len(every), np.int64)
        total[a] = n[~hot]
        total[b] += fresh_n
        place = np.cumsum(~hot) - 1
        self._index = every, np.concatenate([a[place[inverse[~many]]], b[fresh_inverse]]), total
        return fresh

    def candidates(self, answer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of repeated keys (in another chunk by ``answer``, or here; also twice in one context, where
        repeats within a document count): (their indices, index of the distinct content of each, an example of each
        content in the order of bucket and hash, its weight)."""
        keys, inverse, n = self.index()
        live = np.flatnonzero((answer | (n > 1))[inverse] | self.twice) if len(keys) else np.zeros(0, np.int64)
        own = self._order(live)
        new = self._new(own)
        which = np.cumsum(new) - 1
        example = own[new]
        if self.spec.weigh == "count":
            weight = np.bincount(which, minlength=len(example)).astype(np.int64)
        else:
            ids = self.ids[self.doc[own]]
            weight = np.minimum.reduceat(ids, np.flatnonzero(new)) if len(own) else np.zeros(0, np.int64)
        return own, which, example, weight


def _doubling(h: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Polynomial hashes of the 1, 2, 4, ... symbols from each position."""
    out, width, power = {1: h}, 1, BASE
    while width * 2 <= upto and len(h) > width:
        h = h[:-width] * power + h[width:]
        width *= 2
        power = power * power
        out[width] = h
    return out


def _hash_at(levels: dict[int, np.ndarray], length: int, at=None) -> np.ndarray:
    """Hash of ``length`` symbols from each position (or the positions ``at``)."""
    total, done = None, 0
    for width in sorted(levels, reverse=True):
        if length - done >= width:
            level = levels[width]
            part = level[done:] if at is None else level[at + done]
            with np.errstate(over="ignore"):
                total = part if total is None else total[:len(part)] * _power(width) + part
            done += width
            if done == length:
                break
    return total


def _power(n: int) -> np.uint64:
    return U(pow(int(BASE), n, 1 << 64))


#: Symbols up to which the tables of powers are kept.
PIECE = 1 << 19
_INVERSE = U(pow(int(BASE), -1, 1 << 64))


def _accumulated(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[:1] = 1
    return np.multiply.accumulate(p)


_TABLES = [_accumulated(b, PIECE + (1 << 10)) for b in (BASE, _INVERSE)]


class Sums:
    """Polynomial hashes of any length from prefix sums: sum of s[i + j] B^j is the prefixes' difference over B^i, and an
    odd base has an inverse modulo 2^64."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        power, self.inverse = (t if n < len(t) else _accumulated(b, n + 1) for t, b in zip(_TABLES, (BASE, _INVERSE)))
        self.prefix = np.zeros(n + 1, U)
        np.cumsum(h * power[:n], out=self.prefix[1:])

    def every(self, length: int) -> np.ndarray:
        """Hash of the ``length`` symbols from each position that has so many."""
        out = self.prefix[length:] - self.prefix[:-length]
        out *= self.inverse[:len(out)]
        return out

    def at(self, length: int, at: np.ndarray) -> np.ndarray:
        return (self.prefix[at + length] - self.prefix[at]) * self.inverse[at]


def window_hashes(symbols: np.ndarray, at: np.ndarray, length: int, piece: int = PIECE) -> np.ndarray:
    """Hashes of the ``length`` symbols from each position in ``at`` (ascending), piece by piece of the symbols."""
    out = np.empty(len(at), U)
    for lo in range(0, len(symbols), piece):
        a, b = np.searchsorted(at, [lo, lo + piece])
        if a < b:
            out[a:b] = Sums(_symbol_hash(symbols[lo:lo + piece + length])).at(length, at[a:b] - lo)
    return out


_BYTE_HASH = mix(np.arange(1, 257, dtype=U) * BASE)


def _symbol_hash(symbols: np.ndarray) -> np.ndarray:
    return _BYTE_HASH[symbols] if symbols.dtype == np.uint8 else symbols


def _runs(spec: Spec, symbols: np.ndarray, first: np.ndarray):
    n, w, q = len(symbols), spec.window, spec.gram
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool)
    if n < w:
        return none
    sums = Sums(_symbol_hash(symbols))
    low = grams = mix(sums.every(q))
    # smallest of w - q + 1 neighbouring grams
    span, width = w - q + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    valid = np.ones(n - w + 1, bool)
    for e in first[1:-1].tolist():
        valid[max(0, e - w + 1):e] = False
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (low[1:] != low[:-1])
    start = np.flatnonzero(new)
    count = np.flatnonzero(last) + 1 - start
    if not len(start):
        return none
    # long runs (periodic text) are cut
    pieces = -(-count // spec.longest)
    if pieces.max() > 1:
        rank = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        count = np.minimum(np.repeat(count, pieces) - rank * spec.longest, spec.longest)
        start = np.repeat(start, pieces) + rank * spec.longest
    a, b = sums.at(w, start), sums.at(w, start + count - 1)
    with np.errstate(over="ignore"):
        content = mix(a + mix(b + U(1)) * BASE + count.astype(U))
    twice = np.zeros(len(start), bool)
    if spec.weigh == "count":  # can a window repeat within the context? only if its key's gram does
        many = np.flatnonzero(count > 1)
        size = count[many] + span - 1
        if len(many):
            equal = grams[spread(start[many], size)] == np.repeat(low[start[many]], size)
            twice[many] = np.add.reduceat(equal, np.cumsum(size) - size, dtype=np.int64) > 1
    return start, count, mix(low[start]), content, twice  # minima are small numbers: spread them over all buckets


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets grow with the key, so sorted keys are sorted by bucket."""
    return ((keys >> U(32)) * U(buckets)) >> U(32)


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, first, end) over sorted keys."""
    own = bucket_of(keys, buckets).astype(np.int64)
    ids, first = np.unique(own, return_index=True)
    return zip(ids.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)])


def _batches(rows, names, types):
    """Record batches of a few MB from rows of (values)."""
    block, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in block], t) for i, t in enumerate(types)], names)

    for r in rows:
        block.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, bytes))
        if size > 4 << 20:
            yield out()
            block, size = [], 0
    if block:
        yield out()


_MESSAGE = "bucket long, chunk long, body binary", ["bucket", "chunk", "body"], [pa.int64(), pa.int64(), pa.binary()]


def _rows(batches, columns: int):
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(k)[i].as_py() for k in range(columns))


def _send_keys(spec: Spec, buckets: int):
    def run(batches):
        def rows():
            for number, ids, sizes, blob in _rows(batches, 4):
                chunk = Chunk(spec, ids, sizes, blob)
                keys = chunk.keys()
                low = (keys & U(0xFFFFFFFF)).astype("<u4")
                count = np.minimum(chunk.distinct(), 65535).astype("<u2")
                for b, lo, hi in _by_bucket(keys, buckets):
                    yield b, number, np.array([hi - lo], "<u4").tobytes() + low[lo:hi].tobytes() + pack(count[lo:hi].tobytes())
        yield from _batches(rows(), *_MESSAGE[1:])
    return run


def _send_windows(spec: Spec, buckets: int):
    """The keys of the windows into which contexts of hot keys are divided."""
    def run(batches):
        def rows():
            for number, ids, sizes, blob, parts in _rows(batches, 5):
                chunk = Chunk(spec, ids, sizes, blob)
                keys = chunk.divide(_known(chunk, parts, buckets)[1])
                low = (keys & U(0xFFFFFFFF)).astype("<u4")
                for b, lo, hi in _by_bucket(keys, buckets):
                    yield b, number, low[lo:hi].tobytes()
        yield from _batches(rows(), *_MESSAGE[1:])
    return run


def _elsewhere(bodies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the distinct key, another chunk has it) of each key in turn."""
    _, inverse, n = np.unique(np.concatenate(bodies), return_inverse=True, return_counts=True)
    return inverse, (n > 1)[inverse]


def _answer_keys(most: int):
    """Two bits for each key of each chunk: another chunk has it too; it has more than ``most`` contexts."""
    def run(table: pa.Table) -> pa.Table:
        low, count = [], []
        for body in table.column("body").to_pylist():
            n = int(np.frombuffer(body, "<u4", 1)[0])
            low.append(np.frombuffer(body, "<u4", n, 4))
            count.append(np.frombuffer(unpack(body[4 + 4 * n:]), "<u2"))
        inverse, many = _elsewhere(low)
        hot = (np.bincount(inverse, np.concatenate(count)) > most)[inverse]
        ends = np.cumsum([len(b) for b in low])
        own = [slice(e - len(b), e) for b, e in zip(low, ends)]
        bits = [np.packbits(np.concatenate([many[x], hot[x]])).tobytes() for x in own]
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array(bits, pa.binary())], names=_MESSAGE[1])
    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    """One bit for each window's key of each chunk: another chunk has it too."""
    bodies = [np.frombuffer(b, "<u4") for b in table.column("body").to_pylist()]
    _, many = _elsewhere(bodies)
    ends = np.cumsum([len(b) for b in bodies])
    bits = [np.packbits(many[e - len(b):e]).tobytes() for b, e in zip(bodies, ends)]
    return pa.table([table.column("bucket"), table.column("chunk"), pa.array(bits, pa.binary())], names=_MESSAGE[1])


def _gather(answers: DataFrame, name: str) -> DataFrame:
    """The answers for each chunk in the order of buckets: one row per chunk, a few bits for each key."""
    got = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "body"))).alias("parts"))
    return got.withColumn("parts", F.col("parts.body")).withColumnRenamed("parts", name)


def _bits(parts, sizes) -> np.ndarray:
    out = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p, n in zip(parts, sizes)]
    return np.concatenate(out).astype(bool) if out else np.zeros(0, bool)


def _known(chunk: Chunk, parts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the chunk's sorted keys those that another chunk has, and those that are hot."""
    keys = chunk.keys()
    if not len(keys):
        return np.zeros(0, bool), np.zeros(0, bool)
    sizes = [hi - lo for _, lo, hi in _by_bucket(keys, buckets)]
    both = [_bits([p], [2 * n]) for p, n in zip(parts, sizes)]
    return np.concatenate([x[:n] for x, n in zip(both, sizes)]), np.concatenate([x[n:] for x, n in zip(both, sizes)])


def _divided(chunk: Chunk, parts, windows, buckets: int) -> np.ndarray:
    """Divides the contexts of hot keys; of the chunk's sorted keys after that those that another chunk has."""
    before = chunk.keys()
    known, hot = _known(chunk, parts, buckets)
    own = chunk.divide(hot)
    if not len(own):
        return known
    keys = chunk.keys()
    out = np.zeros(len(keys), bool)
    out[np.searchsorted(keys, before[~hot])] = known[~hot]
    out[np.searchsorted(keys, own)] |= _bits(windows, [hi - lo for _, lo, hi in _by_bucket(own, buckets)])
    return out


@dataclass
class Contexts:
    """Contexts of a bucket: their windows, weights, and symbols one after another."""

    spec: Spec
    count: np.ndarray
    weight: np.ndarray
    symbols: np.ndarray

    def encode(self) -> bytes:
        return pack(np.array([len(self.count)], "<i4").tobytes() + self.count.astype(np.uint8).tobytes()
                    + self.weight.astype("<i8").tobytes() + self.symbols.tobytes())

    @staticmethod
    def decode(spec: Spec, body: bytes) -> "Contexts":
        raw = unpack(body)
        n = int(np.frombuffer(raw, "<i4", 1)[0])
        return Contexts(spec, np.frombuffer(raw, np.uint8, n, 4).astype(np.int64), np.frombuffer(raw, "<i8", n, 4 + n),
                        np.frombuffer(raw, U if spec.words else np.uint8, offset=4 + 9 * n))

    @staticmethod
    def join(parts: list["Contexts"]) -> "Contexts":
        return Contexts(parts[0].spec, *(np.concatenate([getattr(p, k) for p in parts]) for k in ("count", "weight", "symbols")))

    def offsets(self) -> np.ndarray:
        """Where each context's symbols begin."""
        size = self.count + self.spec.window - 1
        return np.cumsum(size) - size


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ..., ``count[i]`` of them, for each i in turn."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


def _send_contexts(spec: Spec, buckets: int):
    def run(batches):
        def rows():
            for number, ids, sizes, blob, parts, windows in _rows(batches, 6):
                chunk = Chunk(spec, ids, sizes, blob)
                _, _, example, weight = chunk.candidates(_divided(chunk, parts, windows, buckets))
                for b, lo, hi in _by_bucket(chunk.key[example], buckets):
                    own = example[lo:hi]
                    at = spread(chunk.start[own], chunk.count[own] + spec.window - 1)
                    yield b, number, Contexts(spec, chunk.count[own], weight[lo:hi], chunk.symbols[at]).encode()
        yield from _batches(rows(), *_MESSAGE[1:])
    return run


def _answer_contexts(spec: Spec):
    def run(table: pa.Table) -> pa.Table:
        parts = [Contexts.decode(spec, b) for b in table.column("body").to_pylist()]
        gone = spec.decide(Contexts.join(parts))
        ends = np.cumsum([int(p.count.sum()) for p in parts])
        bits = [np.packbits(gone[e - int(p.count.sum()):e]).tobytes() for p, e in zip(parts, ends)]
        return pa.table([table.column("bucket"), table.column("chunk"), pa.array(bits, pa.binary())], names=_MESSAGE[1])
    return run


def covered(chunk: Chunk, known: np.ndarray, parts, buckets: int) -> np.ndarray:
    """Symbols of the chunk that lie in a window that is to go."""
    own, which, example, weight = chunk.candidates(known)
    size = chunk.count[example]
    flags = _bits(parts or (), [int(size[lo:hi].sum()) for _, lo, hi in _by_bucket(chunk.key[example], buckets)]) \
        if len(example) else np.zeros(0, bool)
    first = np.cumsum(size) - size
    n = chunk.count[own]
    gone = flags[spread(first[which], n)]
    if chunk.spec.weigh == "first":  # a later document with the same context has all its windows from an earlier one
        gone |= np.repeat(chunk.ids[chunk.doc[own]] != weight[which], n)
    at = spread(chunk.start[own], n)[gone]
    step = np.zeros(len(chunk.symbols) + 1, np.int32)
    np.add.at(step, at, 1)
    at += chunk.spec.window
    np.add.at(step, at, -1)
    np.cumsum(step, out=step)  # in place: sums of their own would take 8 bytes a symbol
    return step[:-1] > 0


def remove(docs: DataFrame, spec: Spec, finish, schema: str, id_col: str, text_col: str) -> DataFrame:
    """Run the four steps; ``finish(chunk, covered)`` yields record batches of ``schema``."""
    spark = docs.sparkSession
    table = chunks(docs, id_col, text_col, "repeats-chunks")
    total = table.agg(F.sum("bytes")).first()[0] or 0
    keys = 2 * total / (spec.window - spec.gram + 2) / (6 if spec.words else 1)
    buckets = max(1, int(keys / BUCKET_KEYS) + 1)
    text = table.select("chunk", "ids", "sizes", "blob")
    sent = text.mapInArrow(_send_keys(spec, buckets), _MESSAGE[0])
    known = materialize(_gather(sent.groupBy("bucket").applyInArrow(_answer_keys(HOT_CONTEXTS), _MESSAGE[0]), "known"), "repeats-keys")
    del sent
    release(spark)
    # every large corpus has hot keys, so this step isn't left out where a small one has none: it costs alike at every size
    both = text.join(known.hint("merge"), "chunk").select("chunk", "ids", "sizes", "blob", "known")
    sent = both.mapInArrow(_send_windows(spec, buckets), _MESSAGE[0])
    windows = _gather(sent.groupBy("bucket").applyInArrow(_answer_windows, _MESSAGE[0]), "windows")
    known = materialize(known.select("chunk", "known").join(windows.hint("merge"), "chunk", "left"), "repeats-hot")
    del sent, both, windows
    release(spark)
    # the answers grow with the corpus: they meet their chunks by a shuffle at every size, never by broadcast
    both = text.join(known.hint("merge"), "chunk", "left").select("chunk", "ids", "sizes", "blob", "known", "windows")
    sent = both.mapInArrow(_send_contexts(spec, buckets), _MESSAGE[0])
    gone = sent.groupBy("bucket").applyInArrow(_answer_contexts(spec), _MESSAGE[0])
    answers = materialize(known.join(_gather(gone, "gone").hint("merge"), "chunk", "left"), "repeats-windows")
    del sent, gone, both
    release(spark)

    def last(batches):
        for _, ids, sizes, blob, known_, windows_, gone_ in _rows(batches, 7):
            chunk = Chunk(spec, ids, sizes, blob)
            yield from finish(chunk, covered(chunk, _divided(chunk, known_, windows_, buckets), gone_, buckets))

    return text.join(answers.hint("merge"), "chunk", "left") \
        .select("chunk", "ids", "sizes", "blob", "known", "windows", "gone").mapInArrow(last, schema)
