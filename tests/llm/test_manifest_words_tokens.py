"""Merkle manifest, spelling variants and token counts against plain Python."""

import random
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowpanel.llm import merkle, queries, spelling, tokencount

SF = "/root/testdata/sf0.001"


# --- Merkle manifest ---------------------------------------------------------------

def hexed(text):
    return sha256(text.encode()).hexdigest()


def brute_tree(nodes):
    """Levels of a tree, the leaves first."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([hexed("".join(row[k:k + 2])) for k in range(0, len(row), 2)])
    return levels


def brute_manifest(rows):
    """rows: (group, order, digest, other or None) -> sorted [(digest, subroot, root, proof, folded)]."""
    groups = sorted({g for g, *_ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        trees[g] = own, brute_tree([r[2] for r in own])
    top = brute_tree([trees[g][1][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        own, tree = trees[g]
        for i, r in enumerate(own):
            value, seen = r[3] or r[2], []
            for levels, at in ((tree, i), (top, k)):
                for row in levels[:-1]:
                    other = row[at ^ 1] if at ^ 1 < len(row) else ""
                    seen.append(other)
                    value = hexed(value + other if at % 2 == 0 else other + value)
                    at //= 2
            out.append((r[2], tree[-1][0], top[-1][0], hexed("".join(seen)), value))
    return sorted(out)


@pytest.mark.parametrize("height", [1, 2, 3, 10])
def test_layout_is_a_bijection_of_contiguous_subtrees(height):
    places = [merkle.address(d, np.arange(1 << d), height) for d in range(height)]
    assert sorted(np.concatenate(places).tolist()) == list(range((1 << height) - 1))
    top = height // 2
    for j in range(1 << top if height > 1 else 0):  # every lower subtree lies together, after the upper half
        own = np.concatenate([places[d][(j << (d - top)):((j + 1) << (d - top))] for d in range(top, height)])
        size = (1 << (height - top)) - 1
        assert own.min() == (1 << top) - 1 + j * size and own.max() == own.min() + size - 1


@pytest.mark.parametrize("height", [2, 10])
def test_manifest_equals_brute_force(spark, height):
    rng = random.Random(3)
    rows = []
    for g, n in ((None, 7), ("", 1), ("a", 33), ("é", 5), ("z", 64), ("b", 2)):
        for k in range(n):
            digest = hexed(f"{g}{k}")
            rows.append((g, None if k == 3 else rng.randrange(40), digest, hexed("x" + digest) if rng.random() < .3 else None))
    rows += [rows[10]] * 3  # equal rows are leaves each
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string, other string").withColumn("grp", F.lit("clash")).repartition(5)
    m = merkle.manifest(df, "leaf", "lang", ["doc_id"], height)
    got = merkle.prove(m, "other", ["doc_id"]).select("leaf", "subroot", "root", "proof", "folded").collect()
    want = brute_manifest(rows)
    assert sorted(map(tuple, got)) == want
    assert m.root() == want[0][2]


def test_manifest_of_documents_with_awkward_rows(docs, rows):
    own = docs.withColumn("leaf", merkle.field_digest(["doc_id", "lang", "text", "n_chars"])).select("doc_id", "lang", "leaf", "key", "n")
    got = merkle.prove(merkle.manifest(own, "leaf", "lang", ["doc_id"], 3), keep=["doc_id"]).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = brute_manifest([("en" if k % 2 else "de", i, hexed(field(i) + field("en" if k % 2 else "de") + field(t) + "-"), None)
                           for k, (i, t) in enumerate(rows)])
    assert sorted((r.leaf, r.subroot, r.root, r.proof, r.folded) for r in got) == want
    assert all(r.folded == r.root for r in got)


def test_empty_manifest(empty):
    own = empty.withColumn("leaf", merkle.field_digest(["doc_id", "text"]))
    m = merkle.manifest(own, "leaf", "lang", ["doc_id"])
    assert m.root() is None and merkle.prove(m, keep=["doc_id"]).collect() == []


# --- spelling variants ----------------------------------------------------------------

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_forms(counts, ratio=5):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.fixture(scope="module")
def words():
    rng = random.Random(9)
    out = {"", "a", "aa", "aaa", "aaab", "aab", "ab", "ba", "é", "éa", "a" * 300, "a" * 299 + "b", "a" * 301, "b" + "a" * 299}
    out |= {"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 7))) for _ in range(400)}
    return sorted(out)


@pytest.mark.parametrize("bucket", [3, 32])
def test_neighbours_are_the_words_one_edit_away(spark, words, bucket):
    own = words
    df = spark.createDataFrame([(w,) for w in own] + [(None,), (own[3],)], "word string").withColumn("node", F.lit("clash"))
    got = [tuple(sorted(r)) for r in spelling.neighbours(df, bucket=bucket).collect()]
    assert len(got) == len(set(got))  # every pair once
    assert set(got) == {(a, b) for k, a in enumerate(own) for b in own[k + 1:] if one_edit(a, b)}


def test_forms_and_roots(spark, words):
    rng = random.Random(4)
    counts = {w: 5 ** rng.randrange(5) + rng.randrange(3) for w in words if len(w) < 100}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.forms(df, bucket=4).select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_forms(counts)


def test_variants_of_documents(docs, rows, empty):
    import re
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 5 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 2:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}
    got = spelling.variants(docs, least_length=2, least_count=3, slips=5).select("word", "form", "root", "n", "n_near", "form_n")
    # runs of at least two characters are looked at; a run of one can't become a word of two
    assert {tuple(r) for r in got.collect()} == brute_forms(counts)
    assert spelling.variants(empty).collect() == []


# --- token counts -------------------------------------------------------------------------

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=queries.vocab_path(MODEL))


def test_counts_equal_the_library(spark, docs, rows, empty, library):
    path = queries.vocab_path(MODEL)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows), key=repr)
    for chunk, overlap in ((64, 16), (200, 8), (1 << 15, 256)):
        got = tokencount.count(docs, path, chunk=chunk, overlap=overlap).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
        assert (chunk > 1000) or max(r.n_chunks for r in got) > 2
    assert tokencount.count(empty, path).collect() == []


def test_unproven_junctions_are_widened(spark, library):
    """Periodic texts, whose chunks agree on no boundary, end as the library has them."""
    rng = random.Random(2)
    texts = ["a" * 997, "ab" * 700 + "c", "=" * 1500, " " * 800 + "x", "\n" * 500, "日本" * 400, "😀" * 300, "▁" * 400, "x\x00" * 300,
             "".join(rng.choice("the an") for _ in range(3000)), "word " * 600, "aaaa bbbb" * 200 + "=" * 700 + "end of it " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in tokencount.count(df, queries.vocab_path(MODEL), chunk=64, overlap=4).collect()}
    assert got == {i: len(library.encode(t)) for i, t in enumerate(texts)}


def test_splice_needs_two_common_boundaries():
    a, b = np.array([2, 2, 2, 2], np.uint8), np.array([1, 2, 2, 2], np.uint8)
    assert tokencount.splice(a, 0, np.array([2, 2, 3], np.uint8), 4) == 1  # 4, 6 and 8 against 4, 6, 8, 11
    assert tokencount.splice(a, 0, b, 4) is None or tokencount.splice(a, 0, b, 5) is not None
    assert tokencount.splice(np.array([3, 3], np.uint8), 0, np.array([2, 4], np.uint8), 3) is None


def test_query_columns(spark):
    got = queries.QUERIES["op13_token_counts"](spark, SF)
    assert got.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
