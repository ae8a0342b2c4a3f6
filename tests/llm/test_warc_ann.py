"""Operators 8 and 9: archives and nearest neighbours."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowpanel.llm import ann, queries, warc

PAGES = "page_id long, url string, html string, refers_to string, path string, kind string"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    body = ["<p>" + "x" * rng.randrange(3000) + "é</p>" for _ in range(20)]
    table = [(i, f"http://a/{i} b\r\nc", rng.choice(body)) for i in range(100)]
    table += [(100, None, None), (101, "", ""), (102, "u", ""), (3, "http://again", table[3][2]), (103, "big", "y" * 3_000_000),
              (104, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "no id", body[0])]
    return [(*r, "clash", None, "x") for r in table]


def expected(pages, least=0):
    first = {}
    for i, _, h, *_ in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h, *_ in pages:
        raw = (h or "").encode()
        revisit = len(raw) >= least and first[h or ""] != i
        out.append((None if i is None else str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if revisit else "response", str(first[h or ""]) if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 1000])
def test_write_and_read(spark, pages, least):
    manifest = warc.write(spark.createDataFrame(pages, PAGES).repartition(3), least_bytes=least, archive_bytes=3_000)
    assert manifest.count() > 3
    got = warc.read(manifest).collect()
    assert all(r.kind == "record" for r in got)
    assert sorted([(r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == expected(pages, least)
    for r in got:
        if r.record_type == "response":
            assert warc.digest(bytes(r.payload)) == r.payload_digest
    # by Spark's own file source too
    paths = [r.path for r in manifest.collect()]
    again = warc.read_files(spark.read.format("binaryFile").load(paths)).where("kind = 'record'").count()
    assert again == len(pages)


def test_empty_table(spark):
    manifest = warc.write(spark.createDataFrame([], PAGES))
    assert manifest.collect() == [] and warc.read(manifest).collect() == []


def records(n=8, gz=True):
    rng = random.Random(1)
    raw = [warc.record("response", i, f"http://x/{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(10, 400)))) for i in range(n)]
    return [warc.member(r) if gz else r for r in raw]


def idents(found):
    return [warc._ident(r["headers"]["warc-record-id"]) for kind, _, _, r in found if kind == "record"]


@pytest.mark.parametrize("gz", [True, False])
def test_salvage_skips_only_the_damaged(gz):
    parts = records(gz=gz)
    whole = b"".join(parts)
    assert idents(warc.salvage(whole)) == [str(i) for i in range(8)]
    rng = random.Random(2)
    for _ in range(60):
        k = rng.randrange(8)
        own = bytearray(parts[k])
        at = rng.randrange(len(own))
        own[at] ^= 1 << rng.randrange(8)
        data = b"".join([*parts[:k], bytes(own), *parts[k + 1:]])
        found = list(warc.salvage(data))
        assert set(idents(found)) >= {str(i) for i in range(8) if i != k}
        # all bytes are accounted for, in order and without overlap
        ends = {(a, a + n) for _, a, n, _ in found}
        flat = sorted(ends)
        assert flat[0][0] == 0 and flat[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(flat, flat[1:]))


def test_salvage_of_cuts_and_junk():
    parts = records()
    for data, want in [
        (b"junk" + b"".join(parts), range(8)),
        (b"".join(parts[:4]) + parts[4][:50] + b"".join(parts[5:]), [0, 1, 2, 3, 5, 6, 7]),
        (b"".join(parts)[:-5], range(7)),
        (b"".join(parts[:2]) + b"\x1f\x8b\x08" * 5 + b"".join(parts[2:]), range(8)),
        (b"".join(parts[:2]) + b"WARC/1.1\r\nContent-Length: 99999\r\n\r\n" + b"".join(parts[2:]), range(8)),
        (b"".join(records(gz=False)[:3]) + b"".join(parts[3:]), range(8)),
        (b"nothing", []), (b"", []),
    ]:
        found = list(warc.salvage(data))
        assert idents(found) == [str(i) for i in want]
        assert sum(n for k, _, n, _ in found if k == "gap") == len(data) - sum(
            n for a, n in {(a, n) for k, a, n, _ in found if k == "record"})


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(5, 64)).astype(np.float32)
    y = ann.rotate(x, 3)
    assert np.allclose(x @ x.T, y @ y.T, atol=1e-3)


def brute(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows])
    out = {}
    for i, q in zip(ids, x):
        if i % 50 == 0:
            s = ann.cosine(np.repeat(q[None], len(x), 0), x)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    for sf in ("sf0.01", "sf0.1"):
        d = f"/root/testdata/{sf}"
        rows = [(r.vec_id, list(map(float, r.embedding))) for r in queries.table(spark, d, "embeddings").collect()]
        want = brute(rows, 5)
        got = {}
        for r in queries.QUERIES["op9_ann"](spark, d).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        assert set(got) == set(want)
        vec = dict(rows)
        hit = 0
        for q, own in got.items():
            assert list(sorted(own)) == list(range(1, len(own) + 1))
            hit += len({v for v, _ in own.values()} & {v for v, _ in want[q]})
            for v, s in own.values():
                assert s == pytest.approx(ann.cosine(np.array([vec[q]]), np.array([vec[v]]))[0], abs=1e-12)
        assert hit / (5 * len(want)) >= 0.95


def test_ann_edge_cases(spark):
    rng = np.random.default_rng(8)
    hot = rng.normal(size=16).tolist()
    nan, inf = float("nan"), float("inf")
    rows = [(i, hot) for i in range(0, 120)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(60)]
    rows += [(150, None), (200, []), (250, [0.0] * 16), (300, [nan] * 16), (350, [inf] + [1.0] * 15),
             (400, [None] + [1.0] * 15), (None, hot), (50, hot), (450, [1.0, 2.0, 3.0]), (451, [1.0, 2.0, 3.5]), (500, [2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, query_id string, rank int")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 50, 100, 1000, 1050, 450}
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[100]] == [0, 1, 2, 3, 4]
    assert all(s == pytest.approx(1) for _, s in got[50])
    assert [v for v, _ in got[450]] == [451]
    assert ann.search(df.limit(0), F.lit(True)).collect() == []
