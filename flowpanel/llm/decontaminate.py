"""Benchmark decontamination: an FM-index per training shard, searched for test phrases.

Each task gathers its documents into shards of bounded size, indexes them (suffix array, BWT,
wavelet matrix, sampled suffix positions), searches every benchmark window backwards, locates
the occurrences and merges them to removal spans.  Words that no benchmark item has can't be part
of an occurrence: they fold into the separator, and runs shorter than the shortest window are
left out, so a shard holds many documents.  Benchmark items come in blocks of bounded size, one
pass over the documents for each block; the passes chain without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex
from .shared import Words, text_slices, utf8, word_table

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 8 << 20
#: Symbols of a shard's index, and documents that wait for it.
SHARD_SYMBOLS, SHARD_DOCS = 1 << 19, 1 << 14

#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
_TABLE = word_table(True, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


class Windows:
    """The distinct windows of a block of items: vocabulary, padded patterns, items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        w = Words([t for _, t in items], _TABLE)
        h = w.hashes()
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        ids = ids + 1
        found: dict[bytes, set[str]] = {}
        for k, (item, _) in enumerate(items):
            own = ids[w.first[k]:w.first[k + 1]].astype(np.int32)
            for i in range(max(1, len(own) - window + 1) if len(own) else 0):
                found.setdefault(own[i:i + window].tobytes(), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(k) // 4 for k in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for row, k in enumerate(found):
            own = np.frombuffer(k, np.int32)
            self.patterns[row, window - len(own):] = own
        self.shortest = int(self.lengths.min()) if len(found) else window

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """1.. for words of the vocabulary, else 0."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Benchmark items in blocks of at most ``block_bytes`` (one item at least)."""
    block, total = [], 0
    own = items.select(items[id_col].cast("string"), items[text_col])
    for item, text in own.where(items[id_col].isNotNull()).toLocalIterator():
        raw = (text or "").encode()
        if block and total + len(raw) > block_bytes:
            yield block
            block, total = [], 0
        block.append((item, raw))
        total += len(raw)
    if block:
        yield block


def _runs(symbols: np.ndarray, first: np.ndarray, shortest: int) -> np.ndarray:
    """Which words lie in runs of vocabulary words, within a document, of ``shortest`` at least."""
    n = len(symbols)
    live = symbols > 0
    new = np.ones(n + 1, bool)
    new[1:n] = live[1:] != live[:-1]
    new[first[first < n]] = True
    edges = np.flatnonzero(new)
    long = np.diff(edges) >= shortest
    return live & np.repeat(long, np.diff(edges))


class _Shard:
    """Symbols of a shard's documents: their words' places, and separators between runs."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.symbols, self.doc, self.word, self.size, self.docs = [], [], [], 0, 0

    def add(self, symbols: np.ndarray, keep: np.ndarray, w: Words) -> None:
        at = np.flatnonzero(keep)
        cut = np.ones(len(at), bool)  # a separator before the first word of each run
        cut[1:] = (np.diff(at) > 1) | (w.doc[at[1:]] != w.doc[at[:-1]])
        place = np.arange(len(at)) + np.cumsum(cut)
        n = len(at) + int(cut.sum())
        for out, values in ((self.symbols, symbols[at]), (self.doc, w.doc[at] + self.docs), (self.word, at - w.first[w.doc[at]])):
            own = np.zeros(n, np.int64)
            own[place] = values
            out.append(own)
        self.size += n
        self.docs += len(w.first) - 1

    def occurrences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of each occurrence."""
        none = np.zeros(0, np.int64)
        if not self.size or not len(self.windows.items):
            return none, none, none
        text = np.concatenate([*self.symbols, [0]])
        index = FMIndex(text, len(self.windows.vocabulary) + 1)
        lo, hi = index.search(self.windows.patterns, self.windows.lengths)
        count = hi - lo
        which = np.repeat(np.arange(len(lo)), count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        at = index.locate(rows)
        doc, word = np.concatenate(self.doc), np.concatenate(self.word)
        return doc[at], word[at], which


def _mark(covered: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Set the words of the spans."""
    step = np.zeros(len(covered) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    covered |= np.cumsum(step[:-1]) > 0


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
         text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, text, n_words, n_hit, items array<string> sorted, spans array<struct<start,end>>) per document row.

    A span is a maximal run of neighbouring hit words, as byte offsets into the text's UTF-8.  A null
    text has no words; items with a null id or no words are not searched; items of fewer than
    ``window`` words are one window; repeated rows are judged each; without items nothing is hit.
    Other columns are left out.
    """
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    own = own.selectExpr("id", "text", "cast(null as binary) as hit", "cast(array() as array<string>) as items")
    blocks = list(_blocks(items, item_id_col, item_text_col, block_bytes))

    def run(batches):  # one Python pass whatever the number of blocks: every further one would be a worker more a task
        for block in blocks:
            batches = _searched(batches, Windows(block, window))
        yield from _finish(batches)

    return own.mapInArrow(run, f"id {kind}, text string, n_words long, n_hit long, items array<string>, "
                          "spans array<struct<start: long, end: long>>").withColumnRenamed("id", id_col)


def _searched(batches, windows: Windows):
    for batch in batches:
        yield from _search(batch, windows)


def _search(batch: pa.RecordBatch, windows: Windows):
    """Add a block's hits to the rows of a batch, shard by shard."""
    texts = batch.column(1)
    shard, words, begin = _Shard(windows), [], 0

    def flush(end: int):
        nonlocal shard, words, begin
        rows = batch.slice(begin, end - begin)
        hits, found = _hits(shard, words)
        old_hits, old_items = rows.column(2).to_pylist(), rows.column(3).to_pylist()
        for i, h in enumerate(old_hits):
            if h is not None:
                was = np.frombuffer(h, np.uint8).astype(bool)
                hits[i] = was if hits[i] is None else hits[i] | was
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1),
             pa.array([None if h is None else h.astype(np.uint8).tobytes() for h in hits], pa.binary()),
             pa.array([sorted({*a, *found.get(i, ())}) for i, a in enumerate(old_items)], pa.list_(pa.string()))],
            ["id", "text", "hit", "items"])
        shard, words, begin = _Shard(windows), [], end

    at = 0
    for _, part in text_slices([pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "text"])]):
        w = Words(part, _TABLE)
        symbols = windows.symbols(w.hashes())
        shard.add(symbols, _runs(symbols, w.first, windows.shortest), w)
        words.extend(w.counts().tolist())
        at += len(part)
        if shard.size >= SHARD_SYMBOLS or shard.docs >= SHARD_DOCS:
            yield from flush(at)
    if begin < batch.num_rows:
        yield from flush(batch.num_rows)


def _hits(shard: _Shard, words: list[int]) -> tuple[list, dict[int, set[str]]]:
    """Hit words of each document of a shard (None: none), and the items found in it."""
    doc, word, which = shard.occurrences()
    hits: list = [None] * len(words)
    found: dict[int, set[str]] = {}
    order = np.argsort(doc, kind="stable")
    doc, word, which = doc[order], word[order], which[order]
    ids, first = np.unique(doc, return_index=True)
    for d, a, b in zip(ids.tolist(), first, [*first[1:], len(doc)]):
        covered = np.zeros(words[d], bool)
        _mark(covered, word[a:b], shard.windows.lengths[which[a:b]])
        hits[d] = covered
        found[d] = {i for k in np.unique(which[a:b]).tolist() for i in shard.windows.items[k]}
    return hits, found


def _finish(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        lo = 0
        for _, part in text_slices([batch.select([0, 1])]):
            rows = batch.slice(lo, len(part))
            lo += len(part)
            w = Words(part, _TABLE)
            counts, hits = w.counts(), rows.column(2).to_pylist()
            n_hit, spans = [], []
            for i, h in enumerate(hits):
                own: list = []
                covered = np.frombuffer(h or b"", np.uint8).astype(bool)
                if covered.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8)))
                    base, first = w.offset[i], w.first[i]
                    own = [{"start": int(w.start[first + a] - base), "end": int(w.end[first + b - 1] - base)}
                           for a, b in zip(edges[::2], edges[1::2])]
                n_hit.append(int(covered.sum()))
                spans.append(own)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()),
                 rows.column(3), pa.array(spans, kind)],
                ["id", "text", "n_words", "n_hit", "items", "spans"])


def without(text: str = "text", spans: str = "spans"):
    """Column of the text without the byte spans of :func:`find`, which lie between characters; the text itself without
    spans."""
    raw = F.encode(F.col(text), "UTF-8")
    piece = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    start = F.struct(F.lit(b"").alias("out"), F.lit(0).cast("long").alias("at"))
    left = F.aggregate(spans, start, lambda s, x: F.struct(F.concat(s["out"], piece(s["at"], x["start"])).alias("out"), x["end"].alias("at")),
                       lambda s: F.concat(s["out"], piece(s["at"], F.octet_length(raw).cast("long"))))
    return F.when(F.size(spans) > 0, left.cast("string")).otherwise(F.col(text))


def cut(text: str, spans) -> str:
    """``text`` without the byte spans."""
    raw, out, at = utf8([text])[0], [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
