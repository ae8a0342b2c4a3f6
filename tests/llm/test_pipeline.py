"""The pipeline's stages against plain Python on the smallest tables."""

import numpy as np
import pytest

import corpus_pipeline as pipeline
from flowpanel.llm import langid, queries
from flowpanel.llm.shared import materialize

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = queries.table(spark, SF, "documents")
    out = [docs]
    for name, f in pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], SF), name))
    return [d.collect() for d in out]


def pairs(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_columns(stages):
    assert all(set(rows[0].asDict()) == set(pipeline.COLUMNS) for rows in stages[:5])


def test_language(spark, stages):
    model = queries.language_model(queries.table(spark, SF, "documents"))
    keep = {i for (i, _), (lang, s) in zip(pairs(stages[0]), langid.Scorer(model)([t for _, t in pairs(stages[0])]))
            if lang != "und" and s >= pipeline.LEAST_SCORE}
    assert {r.doc_id for r in stages[1]} == keep and len(keep) == len(stages[1])


def test_near_duplicates(stages):
    component, _ = brute.jaccard_components(pairs(stages[1]))
    assert sorted(r.doc_id for r in stages[2]) == sorted(i for i, c in component.items() if i == c)


def test_passages(stages):
    want = {}
    for i, n, removed, _, kept in brute.earlier_bytes(pairs(stages[2])):
        text = kept.decode("utf-8", "ignore")
        if not removed or text.strip(" "):
            want[i] = text
    assert dict(pairs(stages[3])) == want
    assert all(r.n_chars == len(r.text) for r in stages[3])


def test_benchmarks(spark, stages):
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    before = brute.contamination(pairs(stages[3]), items)
    assert {r.doc_id for r in stages[4]} == {i for i, n, h, _ in before if not h or h < n}
    old, new = dict(pairs(stages[3])), dict(pairs(stages[4]))
    for i, n, h, _ in before:
        if i in new:
            assert new[i] == old[i] if not h else len(new[i]) < len(old[i])


def test_tokens(stages):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(queries.vocab_path("byte_bpe_50k.json"))
    texts = dict(pairs(stages[4]))
    assert sorted(r.doc_id for r in stages[5]) == sorted(texts)
    for r in stages[5]:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded_sha256 == brute.sha(texts[r.doc_id])


def test_rows_without_an_id_of_their_own(spark, stages):
    """Clean texts with a null or a shared id stay, each with its own text; a rejected text of the same id goes."""
    clean = [r.text for r in stages[4] if len(r.text) > 500 and r.lang][:6]
    lang = {r.text: r.lang for r in stages[4]}
    rows = [(None, clean[0]), (None, clean[1]), (None, clean[0]), (5, clean[2]), (5, clean[3]), (5, "12 34"), (7, clean[4]),
            (None, "%%%"), (8, clean[5])]
    start = spark.createDataFrame([(i, t, lang.get(t, "en"), "s", len(t)) for i, t in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    d, out = start, []
    for name, f in pipeline.STAGES[:4]:
        d = materialize(f(spark, d, SF), "ids")
        out.append(sorted(((r.doc_id, r.text) for r in d.collect()), key=repr))
    good = sorted([r for r in rows if r[1] in clean], key=repr)
    assert out[0] == good
    assert out[1] == sorted(set(good), key=repr)
    assert [i for i, _ in out[3]] == [i for i, _ in out[1]]


def test_edge_rows(spark, docs, empty):
    """Nulls, repeated rows and empty tables go through every stage."""
    for start in (docs.select(*pipeline.COLUMNS), empty):
        d = start
        for _, f in pipeline.STAGES:
            d = materialize(f(spark, d, SF), "edge")
        assert d.count() <= start.count()
