"""Exact substring removal: later copies of passages go, the first stays.

A bucket of :mod:`.repeats` holds all contexts in which some windows may be equal.  It sorts the suffixes
that start a window (a suffix array, compared over the window's bytes), takes the longest common
prefixes of neighbours, and finds for each suffix the previous and next one in suffix order that
belongs to a smaller document: the longer of the two common prefixes is its longest previous factor.
Where that reaches the window's length, an earlier document has the passage.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .repeats import NULL_ID, Chunk, Contexts, Spec, spread

#: Bytes of a passage, and of the grams whose hashes deal it out.
LENGTH, GRAM = 50, 24


def suffix_order(symbols: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at ``at`` by their first ``length`` bytes, common prefix with the one before, up to that)."""
    n = len(at)
    view = np.lib.stride_tricks.sliding_window_view(symbols, length)
    # equal suffixes are sorted once: classes by a hash of their bytes, then the classes' strings
    h = repeats.window_hashes(symbols, at, length)
    _, example, inverse = np.unique(h, return_index=True, return_inverse=True)
    del h
    strings = np.ascontiguousarray(view[at[example]])
    by = np.argsort(strings.view(f"S{length}").ravel(), kind="stable")
    strings = strings[by]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    differ = np.zeros(len(by), np.int64)
    for lo in range(1, len(by), 1 << 16):
        hi = min(len(by), lo + (1 << 16))
        unequal = strings[lo:hi] != strings[lo - 1:hi - 1]
        differ[lo:hi] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), length)
    own = rank[inverse]
    order = np.argsort(own, kind="stable")
    lcp = np.full(n, length, np.int64)
    new = np.ones(n, bool)
    new[1:] = own[order[1:]] != own[order[:-1]]
    lcp[new] = differ[own[order[new]]]
    return order, lcp


def longest_previous(doc: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factors in suffix order (0 where below ``least``): for each suffix the longer of its common
    prefixes with the nearest suffixes before and after it that have a smaller document."""
    def side(doc, lcp):
        # jump[i]: nearest place before i not yet ruled out; low[i]: common prefix of i with it.  All jumps double at once.
        n = len(doc)
        jump = np.arange(n) - 1
        low = lcp.copy()
        low[:1] = 0
        live = np.flatnonzero(low >= least)
        while len(live):
            live = live[doc[jump[live]] >= doc[live]]
            over = jump[live]
            low[live], jump[live] = np.minimum(low[live], low[over]), jump[over]
            stop = low[live] < least
            low[live[stop]] = 0
            live = live[~stop]
        return np.where(low >= least, low, 0)

    before = side(doc, lcp)
    back = np.zeros_like(lcp)
    back[1:] = lcp[:0:-1]
    return np.maximum(before, side(doc[::-1], back)[::-1])


def decide(c: Contexts) -> np.ndarray:
    """Of each window: a document smaller than its context's has it."""
    at = spread(c.offsets(), c.count)
    doc = np.repeat(c.weight, c.count)
    order, lcp = suffix_order(c.symbols, at, c.spec.window)
    out = np.zeros(len(at), bool)
    out[order] = longest_previous(doc[order], lcp, c.spec.window) >= c.spec.window
    return out


_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
_TEXT_SCHEMA = _SCHEMA.replace("kept binary", "kept string")


def _finish(chunk: Chunk, gone: np.ndarray, as_text: bool = False):
    for lo in range(0, len(chunk.rows), 1024):
        rows = []
        for i in range(lo, min(lo + 1024, len(chunk.rows))):
            a, b = chunk.first[i], chunk.first[i + 1]
            own = gone[a:b]
            n = int(own.sum())
            spans = int((own[1:] & ~own[:-1]).sum() + own[:1].sum()) if n else 0
            kept = chunk.symbols[a:b][~own].tobytes() if n else chunk.rows[i]
            ident = int(chunk.ids[i])
            rows.append((None if ident == NULL_ID else ident, int(b - a), n, spans, kept.decode("utf-8", "ignore") if as_text else kept))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), [*[pa.int64()] * 4, pa.string() if as_text else pa.binary()])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of ``docs``; with ``as_text`` ``kept`` is a string,
    from which characters cut in part are left out.

    A byte is removed if a string of ``length`` bytes that covers it also starts in a row with a smaller id;
    strings are judged on the input.  ``n_spans`` counts maximal removed runs; ``kept`` is what is left, in
    order (it may begin or end within a character).  A null text is empty; a null id counts as the largest; rows
    with equal ids don't take from each other; an empty table gives an empty result; other columns are left out.
    """
    spec = Spec(window=length, gram=min(GRAM, max(1, length // 2)), words=False, weigh="first", decide=decide)
    finish = functools.partial(_finish, as_text=as_text)
    return repeats.remove(docs, spec, finish, _TEXT_SCHEMA if as_text else _SCHEMA, id_col, text_col)
