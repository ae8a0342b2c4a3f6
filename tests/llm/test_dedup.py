"""Operators 1, 2, 3 and 10 against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowpanel.llm import decontaminate, ngram_join, repeats, substring_dedup, suffix_dedup
from flowpanel.llm.fmindex import FMIndex, WaveletMatrix, suffix_array

from . import brute
from .conftest import prose


def some(rows):
    return sorted(rows, key=repr)


@pytest.fixture
def small_pieces(monkeypatch):
    """Many chunks, buckets and blocks on a small table (the tasks are told through arguments and closures)."""
    monkeypatch.setattr(repeats, "BUCKET_KEYS", 200)
    monkeypatch.setattr(ngram_join, "BUCKET_GRAMS", 500)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 4)


def test_ngram_join(docs, rows, small_pieces):
    got = ngram_join.join(docs)
    assert got.columns[:3] == ["doc_id", "n_shingles", "component_id"]
    top = repeats.NULL_ID
    component, sizes = brute.jaccard_components([(top if i is None else i, t) for i, t in rows])
    back = lambda x: None if x == top else x
    want = [(i, n, back(component[top if i is None else i])) for (i, _), n in zip(rows, sizes)]
    assert some(map(tuple, got.collect())) == some(want)


def test_ngram_join_near_threshold(spark):
    """Pairs at exactly 0.8 link, just below don't; a chain is one component."""
    base = [f"t{i}" for i in range(104)]  # 100 shingles

    def changed(k, tag):  # the last k words replaced: k shingles differ
        return " ".join(base[:104 - k] + [f"{tag}{i}" for i in range(k)])

    # 100 - k shared of 100 + k: linked up to k = 11 (89 / 111 = 0.8018)
    table = [(0, " ".join(base)), (1, changed(11, "a")), (2, changed(12, "b")), (3, changed(11, "c"))]
    got = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    component, _ = brute.jaccard_components(table)
    assert got == component


def test_ngram_join_rows_that_share_an_id(spark):
    """An id with two texts joins the groups of both, also through texts that have no partner."""
    rng = random.Random(3)
    texts = [" ".join(f"q{rng.randrange(500)}" for _ in range(50)) for _ in range(6)]
    table = [(9, texts[0]), (2, texts[0]), (9, texts[1]), (4, texts[1]), (9, texts[2]), (7, texts[3]), (7, texts[4]),
             (4, texts[5]), (1, "a b"), (8, "a b"), (8, "")]
    got = {(r.doc_id, r.component_id) for r in
           ngram_join.join(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    component, _ = brute.jaccard_components(table)
    assert got == set(component.items())


def test_bound_never_below_intersection():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, m, c = rng.integers(1, 400, 3)
        both = rng.integers(0, 1 << 63, c, dtype=np.uint64)
        a = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n, dtype=np.uint64)]))
        b = np.unique(np.concatenate([both, rng.integers(0, 1 << 63, m, dtype=np.uint64)]))
        most = ngram_join.bound(ngram_join.signature(a), len(a), ngram_join.signature(b), len(b))
        assert most >= len(np.intersect1d(a, b))


def test_decontaminate(spark, docs, rows):
    rng = random.Random(9)
    texts = [t for _, t in rows if t and len(brute.alnum_words(t)) > 40]
    items = [(None, texts[0]), (1, None), (2, ""), (3, "two words"), (4, "%%%"), (5, "To to TO to")]
    items += [(10 + k, " ".join(rng.choice(texts).split(" ")[3:3 + 9 + k])) for k in range(12)] + [(10, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = some((i, n, h, x) for i, n, h, x in brute.contamination(rows, items))
    for block in (decontaminate.BLOCK_BYTES, 200):  # one block, and several passes
        got = decontaminate.find(docs, bench, block_bytes=block)
        assert some((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()) == want
    for r in got.where("n_hit > 0").collect():
        inside = "\n".join(r.text.encode()[a:b].decode() for a, b in r.spans)
        assert len(brute.alnum_words(inside)) == r.n_hit
        assert len(brute.alnum_words(decontaminate.cut(r.text, [tuple(s) for s in r.spans]))) <= r.n_words - r.n_hit


def test_decontaminate_without_items(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find(docs, none).collect()
    assert len(got) == len(rows) and not any(r.n_hit or r["items"] or r.spans for r in got)


def test_suffix_dedup(docs, rows, small_pieces):
    got = suffix_dedup.dedup(docs)
    assert some((*tuple(r)[:4], bytes(r.kept)) for r in got.collect()) == some(brute.earlier_bytes(rows))


def test_substring_dedup(docs, rows, small_pieces):
    got = substring_dedup.dedup(docs)
    assert some(map(tuple, got.collect())) == some(brute.repeated_words(rows))


@pytest.mark.parametrize("length", [3, 8])
def test_short_windows(spark, length):
    rng = random.Random(length)
    table = [(i, "".join(rng.choice("ab \n") for _ in range(rng.randrange(120)))) for i in range(40)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    assert some((*tuple(r)[:4], bytes(r.kept)) for r in suffix_dedup.dedup(df, length=length).collect()) == \
        some(brute.earlier_bytes(table, length))
    assert some(map(tuple, substring_dedup.dedup(df, length=length).collect())) == some(brute.repeated_words(table, length))


@pytest.mark.parametrize("most", [0, 2])
def test_contexts_divided_into_windows(docs, rows, small_pieces, monkeypatch, most):
    """All keys hot, or many."""
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", most)
    assert some((*tuple(r)[:4], bytes(r.kept)) for r in suffix_dedup.dedup(docs).collect()) == some(brute.earlier_bytes(rows))
    assert some(map(tuple, substring_dedup.dedup(docs).collect())) == some(brute.repeated_words(rows))


@pytest.mark.parametrize("words", [True, False])
def test_hot_phrase_between_unique_neighbours(spark, monkeypatch, words):
    """A phrase shorter than a window, in each document between other words: no bucket gets all its windows."""
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", 5, raising=False)
    rng = random.Random(8)
    phrase = prose(rng, 32 if words else 8)[:1000 if words else 46]
    table = [(i, f"{prose(rng, 40, 10 ** 9)} {phrase} {prose(rng, 40, 10 ** 9)}") for i in range(600)]
    table.append((1000, table[0][1]))
    module = substring_dedup if words else suffix_dedup

    def bounded(contexts):
        assert contexts.count.sum() < 4000, "a bucket holds a window for each document"
        return module.decide(contexts)

    spec = repeats.Spec(module.LENGTH, module.GRAM, words, "count" if words else "first", bounded)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = repeats.remove(df, spec, module._finish, module._SCHEMA, "doc_id", "text").collect()
    if words:
        assert some(map(tuple, got)) == some(brute.repeated_words(table))
    else:
        assert some((*tuple(r)[:4], bytes(r.kept)) for r in got) == some(brute.earlier_bytes(table))


def test_empty_tables(empty):
    bench = empty.selectExpr("doc_id as item_id", "text")
    assert ngram_join.join(empty).collect() == []
    assert decontaminate.find(empty, bench).collect() == []
    assert suffix_dedup.dedup(empty).collect() == []
    assert substring_dedup.dedup(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60))
def test_suffix_array(symbols):
    s = np.array(symbols)
    assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: symbols[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=200))
def test_wavelet_rank_and_access(symbols):
    s = np.array(symbols)
    w = WaveletMatrix(s, 7)
    assert w.access(np.arange(len(s))).tolist() == symbols
    for c in range(7):
        at = np.arange(len(s) + 1)
        assert w.rank(np.full(len(at), c), at).tolist() == [symbols[:i].count(c) for i in at]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_search_and_locate(text, pattern):
    s = np.array([*text, 0])
    lo, hi = FMIndex(s, 4, sample=3).search(np.array([pattern]), np.array([len(pattern)]))
    found = FMIndex(s, 4, sample=3).locate(np.arange(lo[0], hi[0]))
    assert sorted(found.tolist()) == [i for i in range(len(text)) if text[i:i + len(pattern)] == pattern]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=40))
def test_longest_previous(pairs):
    doc, lcp = (np.array(x) for x in zip(*pairs))
    lcp[0] = 0
    want = []
    for i in range(len(doc)):
        best = 0
        for step in (-1, 1):
            low, j = 99, i
            while 0 <= j + step < len(doc):
                low = min(low, lcp[j] if step < 0 else lcp[j + 1])
                j += step
                if doc[j] < doc[i]:
                    best = max(best, low)
                    break
        want.append(best if best >= 4 else 0)
    assert suffix_dedup.longest_previous(doc, lcp, 4).tolist() == want


def test_covered_takes_few_bytes_a_symbol():
    """What is removed is found in 32-bit sums, in place."""
    import tracemalloc
    rng = np.random.default_rng(5)
    spec = repeats.Spec(window=50, gram=24, words=False, weigh="first", decide=suffix_dedup.decide)
    text = rng.integers(97, 123, 1 << 20, dtype=np.uint8).tobytes()
    chunk = repeats.Chunk(spec, np.array([1, 2], np.int64).tobytes(), np.array([len(text), 100], np.int64).tobytes(), repeats.pack(text + text[:100]))
    known = np.zeros(len(chunk.keys()), bool)
    size = chunk.count[chunk.candidates(known)[2]]
    parts = [np.packbits(np.zeros(int(size.sum()), bool)).tobytes()]
    tracemalloc.start()
    gone = repeats.covered(chunk, known, parts, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert gone[-100:].sum() >= 50 and not gone[:-100].any()
    assert peak < 11 * len(text)
