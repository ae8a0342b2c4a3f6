"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

Every document is the set of hashes of its word n-grams.  Sets within the threshold share a gram among
the first few of each (a prefix in any fixed order of grams); here rarer grams come first, by exact
counts over all sets, so text that many documents share rarely makes a candidate, and a set whose
prefix holds only grams of its own is linked with nothing.

1. Chunks of documents send their grams to buckets, which answer how many sets have each (in powers
   of two); equal sets of a chunk count once.
2. Sets that have a shared prefix gram go on; equal ones become one.
3. A tile holds the sets with one prefix gram in one size band, and those of the next smaller band.
   Within a tile, neighbours in size are candidates first; bitmap signatures bound the overlap from
   above, and the sorted arrays are intersected exactly.  The links give components.
4. Only tiles with sets of several components are left: the nearest pair by signature of each two
   components is verified; after that every pair of sets of different components that the signatures
   let pass.  No link between components is lost, and a group of near copies never becomes all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import spread_join
from ..operators.graph import components
from .repeats import _MESSAGE, NULL_ID, _batches, _by_bucket, _gather, _rows, chunks, pack, unpack
from .repeats import _doubling, _hash_at
from .shared import Words, blank_words, materialize, mix, partitions, release, slices

U = np.uint64
#: Words of a gram, and the similarity in hundredths from which two sets are linked.
GRAM, PERCENT = 5, 80
#: Bytes of text in a chunk.
CHUNK_BYTES = 8 << 20
#: Grams of a bucket; rows of a tile that meet in one block; bits of the widest signature.
BUCKET_GRAMS, TILE_ROWS, WIDEST = 1 << 18, 2048, 1 << 13
#: A size band's upper end against its lower end.
BAND = 1.25


def required(na, nb, percent: int = PERCENT):
    """The smallest intersection that links sets of these sizes."""
    return -(-percent * (na + nb) // (100 + percent))


class Sets:
    """The distinct gram hashes of documents: ``grams`` sorted within each, ``first`` their offsets."""

    def __init__(self, rows: list[bytes], n: int):
        table, grams, sizes = blank_words(True), [], []
        for a, b in slices([len(r) for r in rows], 1 << 20):
            w = Words(rows[a:b], table)
            g, d = _grams(w, n)
            order = np.lexsort((g, d))
            g, d = g[order], d[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
            grams.append(g[new])
            sizes.append(np.bincount(d[new], minlength=b - a))
        self.grams = np.concatenate(grams) if grams else np.zeros(0, U)
        self.size = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.doc = np.repeat(np.arange(len(self.size)), self.size)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.grams[self.first[i]:self.first[i] + self.size[i]]

    def content(self) -> np.ndarray:
        """128 bits that name a set: equal for equal sets."""
        out = np.zeros((len(self.size), 2), U)
        for k, salt in enumerate((U(1), U(0x51ED270B))):
            total = np.concatenate([[U(0)], np.cumsum(mix(self.grams ^ salt), dtype=U)])
            out[:, k] = total[self.first + self.size] - total[self.first]
        out[:, 0] += self.size.astype(U) * U(0x9E3779B97F4A7C15)
        return out


def _grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each n-gram; a row with fewer words, but not none, has its whole sequence."""
    h, counts = w.hashes(), w.counts()
    full = np.zeros(len(h), bool)
    if len(h) >= n:
        at = np.arange(len(h) - n + 1)
        at = at[w.doc[at] == w.doc[at + n - 1]]
        full[at] = True
        with np.errstate(over="ignore"):
            g = mix(_hash_at(_doubling(h, n), n, at) + U(n))
    else:
        at, g = np.zeros(0, np.int64), np.zeros(0, U)
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = np.zeros(len(short), U)
    with np.errstate(over="ignore"):
        for k in range(n - 1):
            live = counts[short] > k
            whole[live] = mix(whole[live] + h[w.first[short[live]] + k] + U(k + 1))
        whole = mix(whole + counts[short].astype(U))
    return np.concatenate([g, whole]), np.concatenate([w.doc[at], short])


class Chunk:
    """Sets of a chunk's documents, and the row that stands for each set (its smallest id)."""

    def __init__(self, ids: bytes, sizes: bytes, blob: bytes, n: int):
        self.ids = np.frombuffer(ids, np.int64)
        size = np.frombuffer(sizes, np.int64)
        raw, ends = unpack(blob), np.cumsum(size)
        self.sets = Sets([raw[e - k:e] for e, k in zip(ends.tolist(), size.tolist())], n)
        self.content = self.sets.content()
        order = np.lexsort((self.ids, self.content[:, 1], self.content[:, 0]))
        own = self.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (own[1:] != own[:-1]).any(axis=1)
        self.stands = np.empty(len(order), np.int64)
        self.stands[order] = order[new][np.cumsum(new) - 1]
        empty = self.sets.size == 0  # empty sets are linked with nothing
        self.stands[empty] = np.flatnonzero(empty)
        self.alone = self.stands == np.arange(len(order))

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted grams, index of each gram of the standing sets, number of standing sets that have each)."""
        live = self.alone[self.sets.doc]
        grams, inverse, n = np.unique(self.sets.grams[live], return_inverse=True, return_counts=True)
        return grams, inverse, n


def _send(n: int, buckets: int):
    def run(batches):
        def rows():
            for number, ids, sizes, blob in _rows(batches, 4):
                grams, _, count = Chunk(ids, sizes, blob, n).distinct()
                low = (grams & U(0xFFFFFFFF)).astype("<u4")
                count = np.minimum(count, 65535).astype("<u2")
                for b, lo, hi in _by_bucket(grams, buckets):
                    yield b, number, np.array([hi - lo], "<u4").tobytes() + low[lo:hi].tobytes() + pack(count[lo:hi].tobytes())
        yield from _batches(rows(), *_MESSAGE[1:])
    return run


def _answer(table: pa.Table) -> pa.Table:
    """For each gram of each chunk: 0 if one set has it, else the number's power of two (1: two or three)."""
    low, count, sizes = [], [], []
    for body in table.column("body").to_pylist():
        n = int(np.frombuffer(body, "<u4", 1)[0])
        sizes.append(n)
        low.append(np.frombuffer(body, "<u4", n, 4))
        count.append(np.frombuffer(unpack(body[4 + 4 * n:]), "<u2"))
    _, inverse = np.unique(np.concatenate(low), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(count).astype(np.float64))
    level = np.floor(np.log2(total)).astype(np.uint8)[inverse]
    ends = np.cumsum(sizes)
    bodies = [pack(level[e - n:e].tobytes()) for n, e in zip(sizes, ends)]
    return pa.table([table.column("bucket"), table.column("chunk"), pa.array(bodies, pa.binary())], names=_MESSAGE[1])


_SETS = "doc_id long, n long, stands long, content binary, prefix array<long>, grams binary"


def _prefixes(n: int, percent: int):
    """Every document's size and standing row; of standing sets that share a prefix gram the prefix and grams."""
    def run(batches):
        for number, ids, sizes, blob, parts in _rows(batches, 5):
            c = Chunk(ids, sizes, blob, n)
            _, inverse, _ = c.distinct()
            level = np.frombuffer(b"".join(map(unpack, parts or ())), np.uint8)
            s = c.sets
            levels = np.zeros(len(s.grams), np.uint8)
            levels[c.alone[s.doc]] = level[inverse]
            # the first size - required + 1 grams, rarer first: nothing to do if so many are a set's own
            prefix = s.size - -(-percent * s.size // 100) + 1
            own = np.bincount(s.doc, levels == 0, len(s.size)).astype(np.int64)
            live = c.alone & (s.size > 0) & (own < prefix)
            heads: list = [None] * len(s.size)
            bodies: list = [None] * len(s.size)
            for i in np.flatnonzero(live).tolist():
                g, v = s[i], levels[s.first[i]:s.first[i] + s.size[i]]
                head = np.lexsort((g, v))[:prefix[i]]
                heads[i] = g[head[v[head] > 0]].view(np.int64).tolist()
                bodies[i] = g.tobytes()
            stands = c.ids[c.stands]
            for lo in range(0, len(s.size), 2048):
                hi = min(lo + 2048, len(s.size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids[lo:hi]), pa.array(s.size[lo:hi]), pa.array(stands[lo:hi]),
                     pa.array([x.tobytes() for x in c.content[lo:hi]], pa.binary()),
                     pa.array(heads[lo:hi], pa.list_(pa.int64())), pa.array(bodies[lo:hi], pa.binary())],
                    ["doc_id", "n", "stands", "content", "prefix", "grams"])
    return run


def signature(grams: np.ndarray, widest: int = WIDEST) -> np.ndarray:
    """Parity bitmap of a set: a power of two of bits, about four for each gram."""
    bits = min(widest, max(64, 1 << int(4 * len(grams) - 1).bit_length()))
    return np.packbits(np.bincount((grams & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(U)


def fold(sig: np.ndarray, words: int) -> np.ndarray:
    """The narrower signature of the same sets (rows)."""
    width = sig.shape[-1]
    while width > words:
        # bit i and i + width/2 fall together, for positions are gram modulo width
        width //= 2
        sig = sig[..., :width] ^ sig[..., width:]
    return sig


def bound(a: np.ndarray, na, b: np.ndarray, nb) -> np.ndarray:
    """Overlap from above: bits that differ belong to different grams of the two sets."""
    words = min(a.shape[-1], b.shape[-1])
    differ = np.bitwise_count(fold(a, words) ^ fold(b, words)).sum(axis=-1, dtype=np.int64)
    return (na + nb - differ) // 2


def _sign(batches):
    for batch in batches:
        grams = [np.frombuffer(g, U) for g in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(g) for g in grams], pa.int64()),
             pa.array([signature(g).tobytes() for g in grams], pa.binary())], ["doc_id", "n", "sig"])


def tiles(sets: DataFrame, extra: list[str] = ()) -> DataFrame:
    """(gram, band, own, doc_id, n): each set in the tile of its band and, as a guest, in that of the next."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))).cast("int")
    t = sets.select("doc_id", "n", *extra, F.explode("prefix").alias("gram")).withColumn("band", band)
    return t.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))) \
        .withColumn("band", F.col("band") + F.when(F.col("own"), 0).otherwise(1))


def _fits(na, nb, percent):
    """Sizes alone let the sets be linked."""
    return 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)


def _neighbours(percent: int):
    """Candidate pairs of rows next to each other in a tile (sorted by gram, band, size), and with its first own row."""
    def run(batches):
        for batch in batches:
            gram, band, own, doc, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if len(gram) < 2:
                continue
            same = (gram[1:] == gram[:-1]) & (band[1:] == band[:-1])
            head = np.zeros(len(gram), np.int64)
            head[1:] = np.where(same, 0, np.arange(1, len(gram)))
            head = np.maximum.accumulate(head)
            a = np.concatenate([np.flatnonzero(same), head])
            b = np.concatenate([np.flatnonzero(same) + 1, np.arange(len(gram))])
            ok = (own[a] | own[b]) & (doc[a] != doc[b]) & _fits(n[a], n[b], percent)
            x, y = np.minimum(doc[a], doc[b])[ok], np.maximum(doc[a], doc[b])[ok]
            pairs, count = np.unique(np.stack([x, y], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(count)], ["a", "b", "tiles"])
    return run


def _across(percent: int, nearest: bool):
    """Pairs of a tile's rows with different labels that signatures let pass; ``nearest``: the best one of each two labels."""
    def run(batches):
        for batch in batches:  # one tile a row: parallel lists
            for row in batch.to_pylist():
                yield from _cross(row["rows"], row["split"], percent, nearest)
    return run


def _cross(rows: list[dict], split: bool, percent: int, nearest: bool):
    n = np.array([r["n"] for r in rows], np.int64)
    doc = np.array([r["doc_id"] for r in rows], np.int64)
    label = np.array([r["label"] for r in rows], np.int64)
    own = np.array([r["own"] for r in rows], bool)
    side = np.array([r["side"] for r in rows], np.int64)
    words = min(len(r["sig"]) for r in rows) // 8
    sig = np.stack([fold(np.frombuffer(r["sig"], U), words) for r in rows])
    found = []
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        ok = (label[j] != label[i]) & (own[j] | own[i]) & (doc[j] != doc[i]) & _fits(n[j], n[i], percent)
        if split:
            ok &= side[j] != side[i]
        j = j[ok]
        if not len(j):
            continue
        most = bound(sig[j], n[j], sig[i], n[i])
        need = required(n[j], n[i], percent)
        j, gap = j[most >= need], (most - need)[most >= need]
        if len(j):
            found.append(np.stack([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), gap * 1000 // (n[i] + n[j]),
                                   np.minimum(label[i], label[j]), np.maximum(label[i], label[j])], axis=1))
    if not found:
        return
    p = np.concatenate(found)
    if nearest:
        p = p[np.lexsort((p[:, 0], p[:, 1], -p[:, 2], p[:, 4], p[:, 3]))]
        first = np.ones(len(p), bool)
        first[1:] = (p[1:, 3:] != p[:-1, 3:]).any(axis=1)
        p = p[first]
    for lo in range(0, len(p), 8192):
        yield pa.RecordBatch.from_arrays([pa.array(p[lo:lo + 8192, k]) for k in range(3)], ["a", "b", "gap"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by exact intersection of their grams."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                keep.append(int((q[at] == p).sum()) >= required(len(p), len(q), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    return materialize(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
                       .select(F.col("id").alias("doc_id"), F.col("component").alias("label")), "join-labels")


def _crossing(sets: DataFrame, signs: DataFrame, labels: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Candidate pairs between components, from the tiles that hold several.  A tile of many rows meets block by block."""
    named = sets.select("doc_id", "n", "prefix").join(labels, "doc_id", "left") \
        .withColumn("label", F.coalesce("label", "doc_id"))
    rows = tiles(named, ["label"])
    several = rows.groupBy("gram", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                               F.max("own").alias("any"), F.count(F.lit(1)).alias("c"))
    several = several.where("lo != hi and any").withColumn("blocks", F.ceil(F.col("c") / TILE_ROWS).cast("int"))
    rows = rows.join(several.select("gram", "band", "blocks"), ["gram", "band"])
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = rows.withColumn("side", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("p", F.least("side", "other")).withColumn("q", F.greatest("side", "other"))
    rows = rows.join(signs.select("doc_id", "sig"), "doc_id")
    met = rows.groupBy("gram", "band", "p", "q").agg(
        F.collect_list(F.struct("doc_id", "n", "label", "own", "side", "sig")).alias("rows"))
    met = met.select("rows", (F.col("p") != F.col("q")).alias("split"))
    return met.mapInArrow(_across(percent, nearest), "a long, b long, gap long").groupBy("a", "b").agg(F.max("gap").alias("gap"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set holds its distinct ``n``-word
    shingles (64-bit hashes), or the whole sequence if it has fewer words.  Sets link when 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest id reachable by links, the row's own included.  A
    null or empty text has an empty set and is linked with nothing.  Rows that share an id are one node of the
    graph; a null id counts as the largest id and is given back as null.  Other columns are left out.
    """
    spark = docs.sparkSession
    table = chunks(docs, id_col, text_col, "join-chunks", CHUNK_BYTES)
    total = table.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, int(total / 6 / BUCKET_GRAMS) + 1)
    text = table.select("chunk", "ids", "sizes", "blob")
    answers = text.mapInArrow(_send(n, buckets), _MESSAGE[0]).groupBy("bucket").applyInArrow(_answer, _MESSAGE[0])
    levels = materialize(_gather(answers, "levels"), "join-levels")
    del answers
    release(spark)
    rows = materialize(text.join(levels.hint("merge"), "chunk", "left").select("chunk", "ids", "sizes", "blob", "levels")
                       .mapInArrow(_prefixes(n, percent), _SETS), "join-sets")
    release(spark)
    # equal sets of several chunks become one, under the smallest id
    standing = rows.where("prefix is not null")
    first = materialize(standing.groupBy("content").agg(F.min("doc_id").alias("first")), "join-first")
    sets = materialize(standing.join(first, "content").where("doc_id = first").dropDuplicates(["content"])
                       .select("doc_id", "n", "prefix", "grams"), "join-distinct")
    signs = materialize(sets.select("doc_id", "grams").mapInArrow(_sign, "doc_id long, n long, sig binary"), "join-signs")
    # a row's node: the first copy of its set, or else the row that stands for it in its chunk
    nodes = spread_join(rows.select("doc_id", "n", "stands", "content"), first, "content", "left") \
        .select("doc_id", "n", "content", F.coalesce("first", "stands").alias("node"))
    ids = _shared_ids(rows, nodes)
    labels = _linked(sets, signs, percent, ids)
    named = first.join(labels.withColumnRenamed("doc_id", "first"), "first", "left")
    out = spread_join(rows.select("doc_id", "n", "stands", "content"), named, "content", "left").select(
        "doc_id", "n", F.coalesce("first", "stands").alias("node"), F.coalesce("label", "first", "stands").alias("component"))
    if ids is not None:  # sets without a partner whose row shares its id
        own = labels.join(ids.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_semi")
        out = out.join(own.select(F.col("doc_id").alias("node"), "label"), "node", "left") \
            .withColumn("component", F.coalesce("label", "component"))
    null = lambda c: F.when(c != NULL_ID, c)
    return out.select(null(F.col("doc_id")).alias(id_col), F.col("n").alias("n_shingles"),
                      null(F.col("component")).alias("component_id"))


def _shared_ids(rows: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """Links (a, b) between an id and the nodes of its rows, for ids whose rows differ; None if there is no such id."""
    several = rows.groupBy("doc_id").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo != hi")
    several = materialize(several.select("doc_id"), "join-ids")
    if several.isEmpty():
        return None
    links = nodes.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    return materialize(links.distinct(), "join-ids")


def _linked(sets: DataFrame, signs: DataFrame, percent: int, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, label) of the sets that have links; ``known`` are links from the start."""
    spark = sets.sparkSession
    parts = partitions(spark)
    near = tiles(sets.select("doc_id", "n", "prefix")).select("gram", "band", "own", "doc_id", "n") \
        .repartitionByRange(parts, "gram", "band", "n", "doc_id").sortWithinPartitions("gram", "band", "n", "doc_id")
    near = near.mapInArrow(_neighbours(percent), "a long, b long, tiles long").groupBy("a", "b").agg(F.sum("tiles").alias("tiles"))
    one = signs.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = signs.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    near = near.join(one, "a").join(two, "b").select("a", "b", "tiles", "na", "sa", "nb", "sb") \
        .mapInArrow(_passing(percent), "a long, b long, tiles long")
    # each set's likeliest two partners are enough for a start; the later rounds see every tile
    best = Window.partitionBy("b").orderBy(F.desc("tiles"), "a")
    near = near.withColumn("k", F.row_number().over(best)).where("k <= 2")
    links = materialize(_verify(near, sets, percent), "join-links")
    links = links if known is None else links.unionByName(known)
    labels = _labels(links)
    for nearest in (True, False):
        release(spark)
        pairs = _crossing(sets, signs, labels, percent, nearest)
        more = materialize(_verify(pairs, sets, percent), "join-links")
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = _labels(links)
    return labels


def _passing(percent: int):
    def run(batches):
        for batch in batches:
            na, nb = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            most = [int(bound(np.frombuffer(x.as_buffer(), U), a, np.frombuffer(y.as_buffer(), U), b))
                    for x, a, y, b in zip(batch.column(4), na.tolist(), batch.column(6), nb.tolist())]
            keep = np.array(most, np.int64) >= required(na, nb, percent)
            yield batch.select([0, 1, 2]).filter(pa.array(keep))
    return run
