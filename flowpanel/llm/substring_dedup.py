"""Repeated word passages: compressed FM-index per shard, matching statistics of streamed documents.

A shard (a bucket of :mod:`.repeats`) indexes its contexts: suffix array, BWT and wavelet matrix over word
symbols.  The contexts of the documents are streamed through it from the right: backward search extends
a match by one word to the left, and once it has the threshold's length the interval is first widened to
its prefix of one word less.  A window whose interval holds more than its own occurrence repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .fmindex import FMIndex, dense
from .repeats import NULL_ID, Chunk, Contexts, Spec, spread
from .shared import Words, blank_words

#: Words of a passage, and of the grams whose hashes deal it out.
LENGTH, GRAM = 35, 8


class Shard:
    """FM-index of the distinct contexts of a bucket, and what each row of it weighs."""

    def __init__(self, symbols: np.ndarray, size: np.ndarray, weight: np.ndarray, length: int):
        n, self.length = len(size), length
        self.first = np.cumsum(size + 1) - size - 1
        self.size = size
        text = np.zeros(len(symbols) + n, np.int64)
        text[spread(self.first, size)] = dense(symbols) + 1
        self.text = text
        sigma = int(text.max()) + 1 if len(text) else 1
        index = self.index = FMIndex(text, sigma, depth=length)
        owner = np.repeat(np.arange(n), size + 1)
        self.weight = np.concatenate([[0], np.cumsum(weight[owner[index.sa]])])
        # of each row the first and last row that share length - 1 symbols with it
        same = self._shared(index.sa, length - 1)
        rows = np.arange(len(text))
        self.lo = np.maximum.accumulate(np.where(same, 0, rows))
        end = np.where(np.append(~same[1:], True), rows + 1, len(text))
        self.hi = np.minimum.accumulate(end[::-1])[::-1]

    def _shared(self, sa: np.ndarray, length: int) -> np.ndarray:
        """Does each row share ``length`` symbols with the row before it?"""
        out = np.zeros(len(sa), bool)
        n = len(self.text)
        fits = (sa[1:] + length <= n) & (sa[:-1] + length <= n)
        at = np.flatnonzero(fits)
        for k in range(length):
            if not len(at):
                break
            at = at[self.text[sa[at + 1] + k] == self.text[sa[at] + k]]
        out[at + 1] = True
        return out

    def matches(self) -> np.ndarray:
        """For each window of each context, in turn, the weight of all its occurrences."""
        n, length = len(self.size), self.length
        windows = self.size - length + 1
        out = np.zeros(int(windows.sum()), np.int64)
        base = np.cumsum(windows) - windows
        lo, hi = np.zeros(n, np.int64), np.full(n, len(self.text), np.int64)
        for k in range(int(self.size.max()) if n else 0):
            live = np.flatnonzero(self.size > k)
            a, b = lo[live], hi[live]
            if k >= length:  # drop the last word of the match
                a, b = self.lo[a], self.hi[a]
            at = self.size[live] - 1 - k
            lo[live], hi[live] = self.index.extend(self.text[self.first[live] + at], a, b)
            if k >= length - 1:
                out[base[live] + at] = self.weight[hi[live]] - self.weight[lo[live]]
        return out


def decide(c: Contexts) -> np.ndarray:
    """Of each window: it occurs more than once, over all contexts and their numbers."""
    size = c.count + c.spec.window - 1
    first = c.offsets()
    # equal contexts of several chunks are indexed once
    head = repeats.window_hashes(c.symbols, first, c.spec.window)
    tail = repeats.window_hashes(c.symbols, first + c.count - 1, c.spec.window)
    _, example, inverse = np.unique(np.stack([head, tail, c.count.astype(np.uint64)], axis=1), axis=0,
                                    return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    weight = np.bincount(inverse, c.weight, len(example)).astype(np.int64)
    own = size[example]
    shard = Shard(c.symbols[spread(first[example], own)], own, weight, c.spec.window)
    many = shard.matches() > 1
    count = c.count[example]
    base = np.cumsum(count) - count
    return many[spread(base[inverse], c.count)]


_SCHEMA = "doc_id long, n_words long, n_removed long, kept string"


def _finish(chunk: Chunk, gone: np.ndarray):
    table = blank_words(False)
    for lo in range(0, len(chunk.rows), 256):
        part = chunk.rows[lo:lo + 256]
        w = Words(part, table)
        rows = []
        for i, raw in enumerate(part):
            a, b = chunk.first[lo + i], chunk.first[lo + i + 1]
            own, f = gone[a:b], w.first[i]
            keep = np.flatnonzero(~own) + f
            data, base = raw, int(w.offset[i])
            kept = b" ".join([data[s - base:e - base] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist())])
            ident = int(chunk.ids[lo + i])
            rows.append((None if ident == NULL_ID else ident, int(b - a), int(own.sum()), kept.decode("utf-8", "surrogatepass")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), [*[pa.int64()] * 3, pa.string()])],
            ["doc_id", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word is removed if ``length`` consecutive words that cover it also start
    anywhere else, in the same row or another; windows are judged on the input.  ``kept`` joins the other
    words with one space.  A null text has no words; rows that repeat an id, or have a null id, are rows like others
    (equal texts of ``length`` words remove each other); other columns are left out.
    """
    spec = Spec(window=length, gram=min(GRAM, max(1, length // 2)), words=True, weigh="count", decide=decide)
    return repeats.remove(docs, spec, _finish, _SCHEMA, id_col, text_col)
