"""Operators 4 to 7: shards, language ID, BPE, quality."""

import hashlib
import itertools
import math
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowpanel.llm import bpe, langid, quality, queries, sharding

SF = "/root/testdata/sf0.01"


def test_shards_fit_and_split_only_if_needed(docs, rows):
    limit = 4000
    got = sharding.shard(docs, limit).collect()
    assert sorted((repr(r.doc_id), r.n_bytes) for r in got) == sorted((repr(i), len((t or "").encode())) for i, t in rows)
    size, count = Counter(), Counter()
    for r in got:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
        assert len(r.shard) == r.depth
    for r in got:
        assert (r.shard_bytes, r.shard_rows) == (size[r.shard], count[r.shard])
        assert r.oversized == (r.shard_bytes > limit)
        parent = r.shard[:-1]
        assert not r.shard or sum(b for s, b in size.items() if s.startswith(parent)) > limit
    # an oversized shard holds rows that no bit tells apart
    for s in {r.shard for r in got if r.oversized}:
        assert len({(r.doc_id, r.n_bytes) for r in got if r.shard == s}) == 1 and len(s) == sharding.MAX_BITS
    assert not any(a != b and b.startswith(a) for a, b in itertools.permutations(size, 2))


def test_one_shard_and_empty(docs, empty, rows):
    got = sharding.shard(docs, 1 << 30).collect()
    assert {(r.shard, r.depth, r.shard_rows) for r in got} == {("", 0, len(rows))}
    assert sharding.shard(empty, 10).collect() == []


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "bb"]
    table = langid.Pieces(pieces)
    p = np.zeros((len(pieces) + 2, 2))
    p[:len(pieces)] = np.random.default_rng(1).random((len(pieces), 2))
    p[len(pieces)] = langid.UNKNOWN
    of = {x: p[i] for i, x in enumerate(pieces)}

    def total(word):
        if not word:
            return np.ones(2)
        got = sum((of[word[:k]] * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in of), np.zeros(2))
        return got + (0 if word[0] in of else langid.UNKNOWN * total(word[1:]))

    words = ["abab", "bba", "abcab", "c", "aaaa", "", "babbab"]
    got = np.exp(langid.score_words(words, table, p))
    assert np.allclose(got, [total("▁" + w) for w in words])


def test_expected_counts_raise_the_likelihood(spark):
    learn = spark.createDataFrame([("x", "aba abb ab"), ("y", "bab bbb"), (None, "zzz"), ("z", None)], "lang string, text string")
    pieces = ["▁", "a", "b", "ab", "bb"]
    before = langid.train(learn, pieces, rounds=1)
    after = langid.train(learn, pieces, rounds=4)
    assert after.langs == ["x", "y"]
    assert np.allclose(after.p[:5].sum(axis=0), 1)
    ll = [sum(langid.score_words(["aba", "abb", "ab"], langid.Pieces(pieces), m.p)[:, 0]) for m in (before, after)]
    assert ll[1] >= ll[0] - 1e-6


def test_language_edge_cases(docs, empty, rows):
    model = langid.train(docs, ["▁", *"abcdefghijklmnopqrstuvwxyz"])
    got = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    for i, t in rows:
        letters = any(map(str.isalpha, t or ""))
        own = [(p, s) for d, p, s in got if d == i]
        assert own and all(0 <= s <= 1 for _, s in own)
        if not letters:
            assert (langid.UNDECIDED, 0.0) in own
    none = langid.train(empty, ["a"])
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {langid.UNDECIDED}
    assert langid.predict(empty, model).collect() == []


def test_long_word_is_summed_whole():
    """A word of any length is one sum over all its segmentations."""
    p = np.array([[.2, .1], [.5, .3], [.3, .6], [1e-7, 1e-7], [0, 0]])
    model = langid.Model(["x", "y"], ["▁", "a", "aa"], p)
    n = 5000
    for k in range(2):  # sums relative to the last one: f(m) = f(m - 1) p(a) + f(m - 2) p(aa)
        log, ratio = np.log(p[0, k]), 0.0
        for _ in range(n):
            step = p[1, k] + (p[2, k] * ratio)
            log, ratio = log + np.log(step), 1 / step
        got = langid.score_words(["a" * n], langid.Pieces(model.pieces), p)[0, k]
        assert abs(got - log) < 1e-6 * abs(log)
    (lang, score), = langid.Scorer(model)(["a" * n])
    assert lang == "y" and score == 1.0


def test_long_words_raise_expected_counts(spark):
    learn = spark.createDataFrame([("x", "ab" * 60 + " a"), ("y", "b" * 90)], "lang string, text string")
    model = langid.train(learn, ["▁", "a", "b", "ab", "bb"], rounds=3)
    assert np.allclose(model.p[:5].sum(axis=0), 1)
    assert model.p[3, 0] > model.p[4, 0] and model.p[4, 1] > model.p[3, 1]


def test_language_accuracy(spark):
    truth = {r.doc_id: r.lang for r in queries.table(spark, SF, "documents").collect()}
    got = [r for r in queries.QUERIES["op5_language_id"](spark, SF).collect() if r.held_out]
    assert len(got) > 200
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.97


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(queries.vocab_path("byte_bpe_50k.json"))


def test_bpe_equals_library(docs, rows, empty, library):
    path = queries.vocab_path("byte_bpe_50k.json")
    texts = [t or "" for _, t in rows] + ["<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "thers" * 900, "don't we'll I'm"]
    v = bpe.vocabulary(path)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert v.encode(t) == ids
        assert v.decode(ids) == library.decode(ids, skip_special_tokens=False) == t
    got = bpe.encode(docs, path)
    back = bpe.decode(got, path)
    key = lambda x: sorted(x, key=repr)
    assert key((r.doc_id, list(r.ids)) for r in got.collect()) == key((i, v.encode(t or "")) for i, t in rows)
    assert key(map(tuple, back.collect())) == key((i, t or "") for i, t in rows)
    once = bpe.round_trip(docs, path)
    assert key((r.doc_id, bytes(r.ids), r.text) for r in once.collect()) == \
        key((i, struct.pack(f"<{len(v.encode(t or ''))}I", *v.encode(t or "")), t or "") for i, t in rows)
    assert bpe.encode(empty, path).collect() == []


def test_bpe_decodes_broken_bytes(library):
    v = bpe.vocabulary(queries.vocab_path("byte_bpe_50k.json"))
    ids = library.encode("日本é", add_special_tokens=False).ids
    for cut in range(len(ids)):
        assert v.decode(ids[cut:]) == library.decode(ids[cut:], skip_special_tokens=False)


def test_bpe_query(spark, library):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op6_bpe"](spark, d).collect()}
    for r in queries.table(spark, d, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    got = [(labels[r.doc_id], r.score, r.predicted) for r in queries.QUERIES["op7_quality"](spark, SF).collect()
           if r.held_out and r.doc_id in labels]
    assert len(got) > 60 and all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in got)
    good, bad = ([s for y, s, _ in got if y == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.95  # area under the curve


def test_quality_edge_cases(spark, docs, empty, rows):
    no = lambda c: F.lit(False)
    fold = lambda c: F.lit(0)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none, no, fold).collect()} == {0.5}
    some = spark.createDataFrame([(7, 1), (7, 0), (14, 1), (None, 1), (21, None), (28, 5), (35, 0)], "doc_id long, quality int")
    got = quality.classify(docs, some, no, fold).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and math.isfinite(r.score) for r in got)
    assert quality.classify(empty, some, no, fold).collect() == []


def test_isotonic_means():
    x, y = quality.isotonic(np.arange(5.0), np.array([1, 0, 2, 1, 3.0]), np.array([2, 1, 2, 2, 3.0]))
    assert (np.diff(y) >= 0).all() and np.isclose(y[-1], 1)


def test_normal_equations_by_partition(spark):
    """Summed partition by partition or at once: the same weights."""
    rng = np.random.default_rng(3)
    data = [(rng.normal(size=quality.N_STATISTICS).tolist(), int(rng.random() < .5), k % 2) for k in range(300)]
    df = spark.createDataFrame(data, "stats array<double>, label int, fold int")
    a, b = (quality.train(df.repartition(k), features=16) for k in (1, 7))
    assert np.allclose(a.weights, b.weights)


def test_language_of_pieces_too_rare_for_a_product():
    """32 letters of pieces that a large corpus never held: the product underflows, the likelihood doesn't."""
    p = np.array([[1e-12, 1e-11], [1e-7, 1e-7], [0, 0]])
    model = langid.Model(["a", "b"], ["ж"], p)
    got = langid.score_words(["ж" * 64, "ж"], langid.Pieces(model.pieces), p)
    assert np.allclose(got, [np.log(1e-7) + 64 * np.log(p[0]), np.log(1e-7) + np.log(p[0])])
    (lang, score), = langid.Scorer(model)(["ж" * 64])
    assert lang == "b" and 0 <= score <= 1
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "a"]), pa.array(["ж" * 64, "ж"]), pa.array([3, 1])], ["lang", "word", "n"])
    (out,) = langid._expectation(["a"], ["ж"], p[:, :1])([batch])
    assert out.column(1).to_pylist() == [0] and np.isclose(out.column(2)[0].as_py(), 3 * 64 + 1)
