"""Byte-level BPE: encoding by contiguous rank arrays, decoding by byte concatenation.

Executors split text with the vocabulary's public pattern and merge each distinct piece once: a
short piece keeps its part boundaries and the ranks of adjacent parts in contiguous arrays; the
minimum is found by a scan, one boundary is deleted and the two neighbouring ranks are refreshed.
Pieces longer than ``SHORT`` use a heap over the same ranks, for the scan is quadratic.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters of a piece up to which the rank array is scanned.
SHORT = 64
#: Pieces whose ids a task remembers, in each of two generations: a full young one becomes the old one.
REMEMBERED = 100_000
NO_RANK = 1 << 60


def byte_chars() -> dict[str, int]:
    """The published byte-level alphabet: printable Latin-1 stands for itself, the other bytes
    take the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges, tokens and special tokens of a public byte-level BPE file."""

    #: White space is spelled out: the engines differ on U+001C to U+001F.
    PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
               r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = byte_chars(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(chars[c] for c in t) for t, i in vocab.items()}
        self.byte_id = [0] * 256
        for c, b in chars.items():
            self.byte_id[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.pieces = regex.compile(self.PATTERN).findall
        self.cut = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        parts = [self.byte_id[b] for b in raw]
        if len(parts) > SHORT:
            return self.merge_long(parts)
        rank_of = lambda i: self.merges.get((parts[i], parts[i + 1]), (NO_RANK,))[0]
        ranks = [rank_of(i) for i in range(len(parts) - 1)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            parts[i:i + 2] = [self.merges[parts[i], parts[i + 1]][1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(i)
            if i:
                ranks[i - 1] = rank_of(i - 1)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, lowest rank and leftmost first, from a heap over linked parts."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and after[i] < n and (m := self.merges.get((parts[i], parts[after[i]]))):
                heapq.heappush(heap, (m[0], i, parts[i], parts[after[i]]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [p for p in parts if p >= 0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.pieces(part):
                ids = known.get(piece)
                if ids is None:
                    ids = self.old.get(piece) or tuple(self.merge(piece.encode()))
                    if len(known) >= REMEMBERED:
                        self.old, self.known = known, {}
                        known = self.known
                    known[piece] = ids
                out += ids
        return out

    def decode(self, ids) -> str:
        """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row.

    A null or empty text has no ids; repeated rows are encoded each; an empty table gives none.
    Special tokens in a text get their own ids.  Other columns are left out.
    """
    def run(batches):
        v = vocabulary(vocab_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [v.encode(t or "") for t in part.column(1).to_pylist()]
                flat = np.fromiter((i for x in ids for i in x), np.int32)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    return _run(docs, id_col, text_col, run, "ids array<int>")


def _run(df: DataFrame, id_col: str, col: str, fn, out: str) -> DataFrame:
    own = df.select(df[id_col].alias("id"), df[col].alias("value"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(fn, f"id {kind}, {out}").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for every row of :func:`encode`'s result; null ids give an empty text, an id out of
    the vocabulary raises KeyError."""
    def run(batches):
        v = vocabulary(vocab_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [v.decode(x or ()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return _run(tokens, id_col, ids_col, run, "text string")


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit, n_tokens, text: decoded from those ids) in one pass
    over whole texts, for tables too large to send the ids through the engine twice."""
    def run(batches):
        v = vocabulary(vocab_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [np.array(v.encode(t or ""), "<u4") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([x.tobytes() for x in ids], pa.binary()),
                     pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([v.decode(x.tolist()) for x in ids], pa.string())],
                    ["id", "ids", "n_tokens", "text"])

    return _run(docs, id_col, text_col, run, "ids binary, n_tokens long, text string")
