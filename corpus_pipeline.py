"""Corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, decontamination, BPE.

Each stage takes the documents its predecessor kept and works on all of them.  ``run`` writes every
stage's result to the shared folder and reads it back.  Every row is a document of its own, also with a null
``doc_id`` or one that other rows have.  "First" and "smallest" mean the order of ``doc_id``, nulls last; rows of one
id follow in the order of their text's SHA-256, then of ``lang`` and ``source``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowpanel.llm import bpe, decontaminate, langid, ngram_join, queries, suffix_dedup
from flowpanel.llm.shared import TEXT_ROWS, materialize, partitions

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Posterior under which a text counts as no language's.
LEAST_SCORE = 0.5


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with a number ``row`` of their own: the id if no row lacks one or shares it, else the row's place in
    the order above (with gaps), written once."""
    docs = docs.select(*COLUMNS)
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if shared.isEmpty():
        return docs.withColumn("row", F.col("doc_id").cast("long"))
    order = [F.asc_nulls_last("doc_id"), F.sha2("text", 256), F.col("lang"), F.col("source"), F.col("place")]
    placed = docs.withColumn("place", F.monotonically_increasing_id()) \
        .repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(placed.drop("place").withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def _with(docs: DataFrame, change: DataFrame) -> DataFrame:
    """Numbered documents with the texts of ``change`` (row, text)."""
    return docs.drop("text", "n_chars").join(change, "row") \
        .withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a learned language; texts that are null, have no letter or are no language's go.
    Each row is judged by its own text, whatever its id.  Only the rows to go are written, texts stay in the JVM."""
    docs = _numbered(docs)
    found = langid.predict(docs, queries.language_model(docs), "row")
    kept = (F.col("lang_pred") != langid.UNDECIDED) & (F.col("score") >= LEAST_SCORE)
    return docs.join(materialize(found.where(~kept).select("row"), "pipeline-rejected", TEXT_ROWS), "row", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: the first."""
    docs = _numbered(docs)
    groups = ngram_join.join(docs, "row").where("component_id = row").select("row")
    return docs.join(groups, "row", "left_semi").select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has.  Characters cut in part go whole; documents with
    nothing but white space left go, unless they came so."""
    docs = _numbered(docs)
    kept = suffix_dedup.dedup(docs, "row", as_text=True).select(F.col("doc_id").alias("row"), F.col("kept").alias("text"), "n_removed")
    return _with(docs, kept.where("n_removed = 0 or trim(text) != ''").drop("n_removed"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that benchmark windows cover; documents with no word left through that go."""
    docs = _numbered(docs)
    found = decontaminate.find(docs, queries.table(spark, sf_dir, "benchmark"), id_col="row")

    left = found.where("n_hit = 0 or n_hit < n_words")
    return _with(docs, left.select("row", decontaminate.without().alias("text")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (little-endian unsigned 32-bit), their number, and digests of ids and decoded text."""
    out = bpe.round_trip(docs, queries.vocab_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("ngram_join", near_duplicates), ("suffix_dedup", passages),
          ("decontaminate", benchmarks), ("bpe", tokens)]

#: Language ID and BPE can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the last stage's."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
