"""Language ID by segmentation-marginalised unigrams.

A fixed public piece vocabulary cuts a word in many ways; a language gives each piece a probability,
and a forward algorithm sums over all segmentations of the word.  A text's log-likelihood is the sum
over its words.  Piece probabilities are learned by expectation maximisation: word counts by language
come from all training texts, each round spreads a word's count over its segmentations
(forward-backward) on the executors and sums expected piece counts.  Only the probabilities
(vocabulary x languages) reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import TEXT_ROWS, materialize

#: Characters up to which sums are formed as plain products; longer words are rescaled at every step.
LONGEST = 32
#: Rounds of expectation maximisation and the pseudo-count of every piece.
ROUNDS, SMOOTHING = 2, 0.1
#: Probability of a character that no piece has.
UNKNOWN = 1e-7
#: Words whose scores a task remembers.
REMEMBERED = 1 << 18
#: Sums of products below this are formed again with rescaling: nothing that counts has underflowed above it.
TINY = 1e-250
UNDECIDED = "und"

_words = re.compile(r"[^\W\d_]+").findall
_B = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, each with the vocabulary's word mark before it."""
    found = _words(text.lower()) if text else []
    return found if any(map(str.isalpha, found)) else []


def public_pieces(path: str) -> list[str]:
    """Pieces of a public sentencepiece model that consist of letters and the word mark."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p.strip("▁").isalpha() and p == p.lower()})


class Pieces:
    """Piece lookup over arrays of characters, and sums over all segmentations."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        self.n = len(pieces)

    @staticmethod
    def _hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(_B) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def table(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece at each start of every row of characters: the piece count + 1 where none
        is, the piece count where a single character has none."""
        n, m = codes.shape
        out, h = [], np.zeros((n, m), np.uint64)
        for size in range(1, min(self.longest, m) + 1):
            h = h[:, :m - size + 1] * _B + codes[:, size - 1:] + np.uint64(1)
            at = np.minimum(np.searchsorted(self.keys, h), max(self.n - 1, 0))
            none = self.n if size == 1 else self.n + 1
            out.append(np.where(self.keys[at] == h, self.ids[at], none) if self.n else np.full(h.shape, none))
        return out

    def forward(self, table: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """Sums over segmentations of every prefix: rows x (length + 1) x languages.  ``p`` has the languages'
        probabilities of each piece, of an unknown character and 0."""
        n, m = table[0].shape
        a = np.zeros((n, m + 1, p.shape[1]))
        a[:, 0] = 1
        for e in range(1, m + 1):
            for size in range(1, min(e, len(table)) + 1):
                a[:, e] += a[:, e - size] * p[table[size - 1][:, e - size]]
        return a

    def backward(self, table: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        n, m = table[0].shape
        b = np.zeros((n, m + 1, p.shape[1]))
        b[:, m] = 1
        for s in range(m - 1, -1, -1):
            for size in range(1, min(m - s, len(table)) + 1):
                b[:, s] += p[table[size - 1][:, s]] * b[:, s + size]
        return b


    def forward_log(self, table: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        """Logarithm of ``forward`` for words of any length: only the last columns are held, relative to the newest, so
        that nothing underflows."""
        n, m = table[0].shape
        out = np.zeros((n, m + 1, p.shape[1]))
        last = [np.ones((n, p.shape[1]))]  # the columns before e, newest first, divided by the newest
        for e in range(1, m + 1):
            new = sum(last[size - 1] * p[table[size - 1][:, e - size]] for size in range(1, min(e, len(table)) + 1))
            out[:, e] = out[:, e - 1] + np.log(new)
            last = [np.ones_like(new), *[c / new for c in last[:len(table) - 1]]]
        return out

    def backward_log(self, table: list[np.ndarray], p: np.ndarray) -> np.ndarray:
        n, m = table[0].shape
        out = np.zeros((n, m + 1, p.shape[1]))
        last = [np.ones((n, p.shape[1]))]
        for s in range(m - 1, -1, -1):
            new = sum(p[table[size - 1][:, s]] * last[size - 1] for size in range(1, min(m - s, len(table)) + 1))
            out[:, s] = out[:, s + 1] + np.log(new)
            last = [np.ones_like(new), *[c / new for c in last[:len(table) - 1]]]
        return out


def _by_length(words: list[str], cells: int = 4096 * LONGEST):
    """(indices into words, array of characters) for words of the same length, the mark first, in blocks of so many
    characters (one word at least)."""
    groups: dict[int, tuple[list[int], list[str]]] = {}
    for i, w in enumerate(words):
        own = groups.setdefault(len(w) + 1, ([], []))
        own[0].append(i)
        own[1].append("▁" + w)
    for m, (at, own) in groups.items():
        rows = max(1, cells // m)
        for lo in range(0, len(own), rows):
            part = own[lo:lo + rows]
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            yield np.array(at[lo:lo + rows]), codes.reshape(len(part), m)


def score_words(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word under each language, summed over all its segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    for at, codes in _by_length(words):
        table = pieces.table(codes)
        if codes.shape[1] > LONGEST:
            out[at] = pieces.forward_log(table, p)[:, -1]
            continue
        total = pieces.forward(table, p)[:, -1]
        low = (total < TINY).any(axis=1)
        out[at] = np.log(np.where(low[:, None], 1.0, total))
        if low.any():
            out[at[low]] = pieces.forward_log([t[low] for t in table], p)[:, -1]
    return out


class Model:
    """Languages, pieces and their probabilities (pieces + unknown + none, by language)."""

    def __init__(self, langs: list[str], pieces: list[str], p: np.ndarray):
        self.langs, self.pieces, self.p = langs, pieces, p


def word_counts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, word, n) over all rows with a language: counted in each task, summed by Spark."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                by: dict[str, Counter] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(lang, Counter()).update(words_of(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, c in by.items() for _ in c], pa.string()),
                     pa.array([w for c in by.values() for w in c], pa.string()),
                     pa.array([n for c in by.values() for n in c.values()], pa.int64())], ["lang", "word", "n"])

    own = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")).where("lang is not null")
    return own.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, pieces: list[str], lang_col: str = "lang", text_col: str = "text",
          rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language that has words; none if no row has both."""
    counts = materialize(word_counts(docs, lang_col, text_col), "lang-words", TEXT_ROWS)
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    p = np.zeros((len(pieces) + 2, len(langs)))
    p[:len(pieces)] = 1.0 / max(1, len(pieces))
    p[len(pieces)] = UNKNOWN
    for _ in range(rounds if langs else 0):
        got = counts.mapInArrow(_expectation(langs, pieces, p), "lang int, piece int, n double") \
            .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.full((len(pieces), len(langs)), SMOOTHING)
        np.add.at(n, (got["piece"].to_numpy(np.int64), got["lang"].to_numpy(np.int64)), got["n"].to_numpy())
        p[:len(pieces)] = n / n.sum(axis=0)
    return Model(langs, pieces, p)


def _expectation(langs: list[str], names: list[str], p: np.ndarray):
    def run(batches):
        pieces, total = Pieces(names), np.zeros((len(langs), len(names) + 2))
        place = {k: i for i, k in enumerate(langs)}
        for batch in batches:
            lang, n = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            words = batch.column(1).to_pylist()
            for k in set(lang):
                own = [i for i, x in enumerate(lang) if x == k]
                q, weight = p[:, [place[k]]], n[own]
                for at, codes in _by_length([words[i] for i in own]):
                    table, long = pieces.table(codes), codes.shape[1] > LONGEST
                    low = np.ones(len(at), bool)
                    if not long:
                        a, b = pieces.forward(table, q)[..., 0], pieces.backward(table, q)[..., 0]
                        low = a[:, -1] < TINY
                        scale = np.where(low, 0.0, weight[at]) / np.where(low, 1.0, a[:, -1])
                        for size, ids in enumerate(table, 1):
                            ends = a.shape[1] - size
                            mass = a[:, :ends] * q[ids, 0] * b[:, size:] * scale[:, None]
                            total[place[k]] += np.bincount(ids.ravel(), mass.ravel(), len(names) + 2)
                    if low.any():
                        own_table, own_weight = [t[low] for t in table], weight[at][low]
                        la, lb = pieces.forward_log(own_table, q)[..., 0], pieces.backward_log(own_table, q)[..., 0]
                        with np.errstate(divide="ignore"):
                            lq = np.log(q[:, 0])
                        for size, ids in enumerate(own_table, 1):
                            share = np.exp(la[:, :la.shape[1] - size] + lq[ids] + lb[:, size:] - la[:, -1:])
                            mass = share * own_weight[:, None]
                            total[place[k]] += np.bincount(ids.ravel(), mass.ravel(), len(names) + 2)
        at, piece = np.nonzero(total[:, :len(names)])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(piece, pa.int32()),
                                          pa.array(total[at, piece])], ["lang", "piece", "n"])
    return run


class Scorer:
    """Posterior of a text's languages; word scores are remembered over a task."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, Pieces(model.pieces)
        self.place: dict[str, int] = {}
        self.score = np.zeros((1 << 14, len(model.langs)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        words = [words_of(t) for t in texts]
        if len(self.place) > REMEMBERED:
            self.place.clear()
        fresh = list(dict.fromkeys(w for x in words for w in x if w not in self.place)) if self.model.langs else []
        if fresh:
            base = len(self.place)
            while base + len(fresh) > len(self.score):
                self.score = np.concatenate([self.score, np.zeros_like(self.score)])
            self.score[base:base + len(fresh)] = score_words(fresh, self.pieces, self.model.p)
            self.place.update(zip(fresh, range(base, base + len(fresh))))
        out = []
        for x in words:
            if not x or not self.model.langs:
                out.append((UNDECIDED, 0.0))
                continue
            ll = self.score[[self.place[w] for w in x]].sum(axis=0)
            best = int(ll.argmax())
            out.append((self.model.langs[best], float(1.0 / np.exp(ll - ll[best]).sum())))
        return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            others: list[str] | None = None) -> DataFrame:
    """(id, lang_pred, score) for every row: the likeliest learned language of the whole text and its
    posterior under equal priors.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned.  Equal
    likelihoods go to the first language in order of name.  Repeated rows are scored each.  With a
    list of ``others`` the text and these columns follow; else other columns are left out.
    """
    more = [] if others is None else [text_col, *others]

    def run(batches):
        score = Scorer(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.float64()), *part.columns[2:]], ["id", "lang_pred", "score", *kept])

    kept = [f"_{k}" for k in range(len(more))]
    own = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[docs[c].alias(k) for c, k in zip(more, kept)])
    kind = own.schema["id"].dataType.simpleString()
    types = [f", {k} {own.schema[k].dataType.simpleString()}" for k in kept]
    return own.mapInArrow(run, f"id {kind}, lang_pred string, score double{''.join(types)}") \
        .withColumnsRenamed({"id": id_col} | dict(zip(kept, more)))
