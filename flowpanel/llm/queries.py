"""One query per operator (``opN_<name>``) and its DuckDB SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, decontaminate, langid, merkle, ngram_join, quality, sharding, spelling, substring_dedup, suffix_dedup,
               tokencount, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Bytes of a training shard: the usual target of streaming dataset shards.
SHARD_BYTES = 64 << 20


def vocab_path(name: str) -> str:
    """Place of a public vocabulary file; FLOWPANEL_TOKENIZERS overrides the installed folder."""
    folder = os.environ.get("FLOWPANEL_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_ngram_join", rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, list_slice(w, p, p + 4) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ids AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM sh),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
  FROM ids x JOIN ids y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * i >= 80 * (p.n + q.n - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
""")
def op1(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query("op2_decontaminate", rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(win) AS n FROM win),
dwin AS (
  SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, lens)),
occ AS (SELECT d.doc_id, d.p, d.n, win.item FROM dwin d JOIN win ON d.win = win.win),
hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op2(spark, sf_dir):
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_extendible_shards", f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         ('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), chr(1), coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
buckets(depth, bucket, b, c) AS (
  SELECT 0, CAST(0 AS BIGINT), sum(n_bytes)::BIGINT, count(*) FROM rows
  UNION ALL
  SELECT k.depth + 1, r.h >> (59 - k.depth), sum(r.n_bytes)::BIGINT, count(*)
  FROM buckets k JOIN rows r ON (r.h >> (60 - k.depth)) = k.bucket
  WHERE k.b > {SHARD_BYTES} AND k.depth < 60
  GROUP BY 1, 2)
SELECT r.doc_id, r.n_bytes,
       CASE WHEN k.depth = 0 THEN '' ELSE lpad(bin(k.bucket), CAST(k.depth AS INTEGER), '0') END AS shard,
       CAST(k.depth AS INTEGER) AS depth, k.b AS shard_bytes, k.c AS shard_rows, k.b > {SHARD_BYTES} AS oversized
FROM rows r JOIN buckets k ON (r.h >> (60 - k.depth)) = k.bucket
WHERE k.b <= {SHARD_BYTES} OR k.depth = 60
""")
def op4(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query("op6_bpe")
def op6(spark, sf_dir):
    out = bpe.round_trip(table(spark, sf_dir, "documents"), vocab_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def crc_mod(col: str, n: int):
    return F.crc32(F.encode(F.col(col).cast("string"), "UTF-8")) % n


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the rows with a language that aren't held out."""
    learn = docs.where(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False)))
    return langid.train(learn, langid.public_pieces(vocab_path("piece_bpe_32k.model")))


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, language_model(docs))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op7_quality")
def op7(spark, sf_dir):
    found = quality.classify(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
        held_out=lambda c: crc_mod(c, 4) == 2, fold=lambda c: (crc_mod(c, 4) == 3).cast("int"))
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op8_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
first AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (SELECT page_id, first, html, sha1(html) AS hex FROM p JOIN first USING (html))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT)
                   >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31 AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
""")
def op8(spark, sf_dir):
    back = warc.read(warc.write(table(spark, sf_dir, "pages"), least_bytes=0), payloads=False)
    return back.where("kind = 'record'").select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


@query("op9_ann")
def op9(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op3_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
pos AS (SELECT doc_id, unnest(range(0, n)) AS p FROM d),
win AS (SELECT pos.doc_id, p, substr(h, 2 * p + 1, 100) AS w FROM pos JOIN d USING (doc_id) WHERE p + 50 <= n),
first AS (SELECT w, min(doc_id) AS first FROM win GROUP BY w),
hit AS (SELECT win.doc_id, win.p FROM win JOIN first USING (w) WHERE first.first < win.doc_id),
marked AS (
  SELECT pos.doc_id, pos.p,
         max(hit.p) OVER (PARTITION BY pos.doc_id ORDER BY pos.p) AS last
  FROM pos LEFT JOIN hit ON pos.doc_id = hit.doc_id AND pos.p = hit.p),
flags AS (SELECT doc_id, p, coalesce(last + 50 > p, false) AS gone FROM marked),
runs AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM flags),
agg AS (
  SELECT r.doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans,
         string_agg(CASE WHEN NOT gone THEN substr(d.h, 2 * p + 1, 2) END, '' ORDER BY p) AS kept
  FROM runs r JOIN d USING (doc_id) GROUP BY r.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)
""")
def op3(spark, sf_dir):
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_substring_dedup", """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p FROM d),
win AS (SELECT pos.doc_id, p, list_slice(w, p, p + 34) AS win FROM pos JOIN d USING (doc_id) WHERE p + 34 <= len(w)),
many AS (SELECT win FROM win GROUP BY win HAVING count(*) > 1),
hit AS (SELECT doc_id, p FROM win JOIN many USING (win)),
marked AS (
  SELECT pos.doc_id, pos.p, max(hit.p) OVER (PARTITION BY pos.doc_id ORDER BY pos.p) AS last
  FROM pos LEFT JOIN hit ON pos.doc_id = hit.doc_id AND pos.p = hit.p),
agg AS (
  SELECT m.doc_id, count(*) FILTER (last + 35 > p) AS n_removed,
         string_agg(CASE WHEN NOT coalesce(last + 35 > p, false) THEN d.w[p] END, ' ' ORDER BY p) AS kept
  FROM marked m JOIN d USING (doc_id) GROUP BY m.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)
""")
def op10(spark, sf_dir):
    out = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def crc_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes; needs the one-row CTE ``crc`` (its table ``t``)."""
    codes = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INTEGER), 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295)"


CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""

LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(n_chars: str) -> str:
    values = [f"CAST({n_chars if c == 'n_chars' else c} AS VARCHAR)" for c in LEAF_FIELDS]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


@query("op11_merkle", f"""
WITH RECURSIVE {CRC_TABLE},
lf AS (
  SELECT doc_id, leaf, g, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN other ELSE leaf END AS own,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n
  FROM (SELECT doc_id, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS other,
               dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM documents), crc),
tree(g, lvl, idx, dig, n) AS (
  SELECT g, 0, idx, leaf, n FROM lf
  UNION ALL
  SELECT g, lvl + 1, idx // 2, sha256(string_agg(dig, '' ORDER BY idx)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lvl, idx // 2, n),
sub AS (SELECT g, dig, count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, idx, dig, n) AS (
  SELECT 0, g, dig, n FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 2, sha256(string_agg(dig, '' ORDER BY idx)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n),
low(doc_id, leaf, g, first, lvl, idx, n, v, p) AS (
  SELECT doc_id, leaf, g, idx, 0, idx, n, own, '' FROM lf
  UNION ALL
  SELECT l.doc_id, l.leaf, l.g, l.first, l.lvl + 1, l.idx // 2, (l.n + 1) // 2,
         sha256(CASE WHEN t.dig IS NULL THEN l.v WHEN l.idx % 2 = 0 THEN l.v || t.dig ELSE t.dig || l.v END), l.p || coalesce(t.dig, '')
  FROM low l LEFT JOIN tree t ON t.g = l.g AND t.lvl = l.lvl AND t.idx = xor(l.idx, 1) WHERE l.n > 1),
high(doc_id, leaf, g, first, lvl, idx, n, v, p) AS (
  SELECT low.doc_id, leaf, low.g, first, 0, low.g, sub.n, v, p FROM low JOIN sub ON low.g = sub.g WHERE low.n = 1
  UNION ALL
  SELECT l.doc_id, l.leaf, l.g, l.first, l.lvl + 1, l.idx // 2, (l.n + 1) // 2,
         sha256(CASE WHEN t.dig IS NULL THEN l.v WHEN l.idx % 2 = 0 THEN l.v || t.dig ELSE t.dig || l.v END), l.p || coalesce(t.dig, '')
  FROM high l LEFT JOIN top t ON t.lvl = l.lvl AND t.idx = xor(l.idx, 1) WHERE l.n > 1)
SELECT h.doc_id, h.leaf, sub.dig AS subroot, r.dig AS root, sha256(h.p) AS proof_sha256, h.v AS folded_root, h.v = r.dig AS verified
FROM high h JOIN sub ON h.g = sub.g, (SELECT dig FROM top WHERE n = 1) r WHERE h.n = 1
""")
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("more", F.col("n_chars") + 1).select(
        "doc_id", "lang", merkle.field_digest(LEAF_FIELDS).alias("leaf_hex"),
        F.when(crc_mod("doc_id", 7) == 0, merkle.field_digest(["more" if c == "n_chars" else c for c in LEAF_FIELDS])).alias("changed_hex"))
    out = merkle.prove(merkle.manifest(rows, "leaf_hex", "lang", ["doc_id"]), "changed_hex", ["doc_id"])
    return out.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"),
                      (F.col("folded") == F.col("root")).alias("verified"))


SPELLING_SLIPS = 199


def _cut_sql(word: str, at: str) -> str:
    return f"substr({word}, 1, CAST({at} AS INTEGER)) || substr({word}, CAST({at} AS INTEGER) + 2)"


@query("op12_spelling", rf"""
WITH RECURSIVE {CRC_TABLE},
found AS (
  SELECT doc_id, r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents)
  WHERE length(r) >= 6 GROUP BY ALL),
crcs AS (SELECT r, n, {crc_sql("(CAST(doc_id AS VARCHAR) || ':' || r)")} AS h FROM found, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {SPELLING_SLIPS} = 0 THEN {_cut_sql("r", "h % length(r)")} ELSE r END AS word, n FROM crcs)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
  SELECT word, n, i, {_cut_sql("word", "i")} AS k FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.i = b.i AND a.k = b.k AND a.word < b.word
  UNION
  SELECT a.word, b.word FROM cuts a JOIN words b ON a.k = b.word),
near AS (SELECT a AS w, b AS o FROM pairs UNION SELECT b, a FROM pairs),
best AS (
  SELECT w, count(*) AS n_near, max(n) AS m, arg_min(o, (-n, o)) AS o FROM near JOIN words ON o = word GROUP BY w),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN o END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN best ON word = w),
walk(word, here, lvl) AS (
  SELECT word, word, 0 FROM forms
  UNION ALL
  SELECT walk.word, f.form, lvl + 1 FROM walk JOIN forms f ON f.word = walk.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, lvl) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
""")
def op12(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"), slips=SPELLING_SLIPS) \
        .select("word", "form", "root", "n", "n_near", "form_n")


#: Tokens that a training context holds.
TOKEN_LIMIT = 4096


@query("op13_token_counts")
def op13(spark, sf_dir):
    found = tokencount.count(table(spark, sf_dir, "documents"), vocab_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "n_chunks")
