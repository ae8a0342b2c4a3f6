"""Spelling variants by a relational trie frontier.

The vocabulary's trie is a table of edges (node, char, child), made level by level.  A node is the prefix that leads to
it.  States (word, position, node, edits) start at the root without an edit; each level joins them with its edges:

* without an edit a word follows its own path (``act``: the words whose prefix of this length is an inner node);
* a replacement takes an edge with a character beyond the word's own, a deletion skips the word's character and stays at
  the node; both give a state with one edit.  The other halves (a smaller character, an insertion) are the same pairs
  seen from the other word, so they are added at the end by turning each pair round;
* a state with one edit must match every further character: an equi-join on (node, char).

A child with at most ``BUCKET`` words is not divided further: its edge carries the words' remainders, so that a state
ends there with one look; pairs within one bucket are compared directly (at most ``BUCKET`` for each word).  An edge to
an inner child carries the characters that follow, so that states that would die at the next level are never written.
A deletion within a run of equal characters takes the last one, so every pair comes out once.

Levels go as deep as prefixes shared by more than ``BUCKET`` words.  Every level's tables are written to the shared
folder.  Joins are left to AQE: it broadcasts edges only while they are small and splits hot nodes otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Words under a trie node up to which it isn't divided further.
BUCKET = 32

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(id, run): the maximal runs of Latin letters of each whole text that have ``least`` characters or more, A-Z
    lower-cased; null texts have none."""
    found = F.regexp_extract_all(F.col(text_col), F.lit("(" + LETTERS + "{%d,})" % least))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run")) \
        .withColumn("run", F.translate("run", UPPER, LOWER))


def with_slips(found: DataFrame, every: int = 199) -> DataFrame:
    """Runs with one character deleted where ``every`` divides CRC-32 of ``<id>:<run>`` (place: CRC modulo length).
    A null id has no such number, its runs stay."""
    h = F.crc32(F.encode(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("run")), "UTF-8"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.withColumn("run", F.when(h % every == 0, cut).otherwise(F.col("run")))


def vocabulary(found: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): distinct runs of enough characters with enough occurrences overall."""
    return found.where(F.length("run") >= least_length).groupBy(F.col("run").alias("word")) \
        .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _first(c):
    return F.substring(c, 1, 1)


def _beyond(c, k: int):
    return F.substring(c, F.lit(k + 1), F.length(c))


def _alive(rest: str):
    """Whether an edge's child can still match the remainder ``rest``."""
    return F.when(F.col("ends").isNotNull(), F.array_contains("ends", F.col(rest))) \
        .otherwise(F.array_contains("follow", _first(F.col(rest))))


def _step(states: DataFrame) -> DataFrame:
    """States after an edge, from rows with node, char, follow, ends and the remainder after the edge."""
    return states.select("word", F.concat("node", "char").alias("node"), "rest", F.col("ends").isNotNull().alias("done"))


def neighbours(words: DataFrame, word_col: str = "word", bucket: int = BUCKET) -> DataFrame:
    """(a, b): every pair of distinct words that differ by exactly one inserted, deleted or replaced character, once.

    Null words and repeated rows count once or not at all; the empty word is a word.  An empty table gives none.
    """
    word = F.col("word")
    base = materialize(words.select(F.col(word_col).alias("word")).where(word.isNotNull()).distinct(), "trie-words")
    act, frontier, pairs = base, None, []
    level = 0
    while not act.isEmpty():
        rest, node = _beyond(word, level), F.substring(word, F.lit(1), F.lit(level))
        own = act.select("word", node.alias("node"), rest.alias("rest"), _first(rest).alias("char"))
        # the level's edges: how many words follow each, and with which characters
        size = own.groupBy("node", "char").agg(F.count(F.lit(1)).alias("n"), F.collect_set(_first(_beyond(F.col("rest"), 1))).alias("follow"))
        placed = materialize(own.join(size, ["node", "char"]), "trie-level")
        small = F.col("n") <= bucket
        leaf = placed.where(small).groupBy("node", "char").agg(F.collect_list(_beyond(F.col("rest"), 1)).alias("ends"))
        inner = placed.where(~small).groupBy("node", "char").agg(F.first("follow").alias("follow"))
        edges = materialize(leaf.unionByName(inner, allowMissingColumns=True).select("node", "char", "follow", "ends"), "trie-edges")

        # two words of one bucket
        a, b = F.col("a"), F.col("b")
        near = edges.where("ends is not null").select("node", "char", "ends", F.explode("ends").alias("a")) \
            .select("node", "char", "a", F.explode(F.filter("ends", lambda x: (x > F.col("a")) & (F.abs(F.length(x) - F.length("a")) <= 1))).alias("b")) \
            .where(F.levenshtein(a, b, 1) == 1)
        pairs.append(near.select(F.concat("node", "char", "a").alias("a"), F.concat("node", "char", "b").alias("b")))

        # states with one edit: those that came, and words that skip a character here, match the next one
        skip = own.where((F.col("rest") != "") & (F.col("char") != _first(_beyond(F.col("rest"), 1)))) \
            .select("word", "node", _beyond(F.col("rest"), 1).alias("rest"))
        one = skip if frontier is None else skip.unionByName(frontier.select("word", "node", "rest"))
        matched = one.withColumn("char", _first(F.col("rest"))).join(edges, ["node", "char"]) \
            .withColumn("rest", _beyond(F.col("rest"), 1)).where(_alive("rest"))
        # words that take another character's edge instead of their own
        edge = edges.withColumnRenamed("char", "other")
        replaced = own.where(F.col("rest") != "").withColumn("rest", _beyond(F.col("rest"), 1)) \
            .join(edge, "node").where(F.col("other") > F.col("char")).where(_alive("rest")) \
            .drop("char").withColumnRenamed("other", "char")
        states = materialize(_step(matched).unionByName(_step(replaced)), "trie-states")
        pairs.append(states.where("done").select(F.col("word").alias("a"), F.concat("node", "rest").alias("b")))

        frontier = states.where(~F.col("done"))
        act = placed.where(~small & (F.col("rest") != "")).select("word")
        level += 1
    if not pairs:
        return base.select(word.alias("a"), word.alias("b")).limit(0)
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out


def forms(words: DataFrame, ratio: int = 5, bucket: int = BUCKET) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for a vocabulary (word, n).

    ``n_near`` counts the near words; ``form`` is the near word of largest n (ties: smallest in code-point order) if its n
    is ``ratio`` times the word's or more, else null; ``root`` is reached by following forms, the word itself without
    one.  As n grows along a chain, pointer doubling ends after some rounds.  Words must be distinct.
    """
    words = materialize(words.select("word", "n"), "spelling-vocabulary")
    pairs = materialize(neighbours(words, bucket=bucket), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("bn")), "b")
    best = known.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("bn")).alias("m"), F.col("b").alias("w"))).alias("best"))
    big = -F.col("best.m") >= ratio * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(big, F.col("best.w")).alias("form"),
        F.when(big, -F.col("best.m")).alias("form_n"))
    out = materialize(out, "spelling-forms")
    links = out.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(after, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-links")
        if links.where("moved").isEmpty():
            break
        links = links.select("word", "root")
    return out.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5,
             ratio: int = 5, slips: int | None = None) -> DataFrame:
    """Spelling variants of a corpus: :func:`forms` of the words of whole texts.

    Null texts, ids and other columns: see :func:`runs` and :func:`with_slips` (used if ``slips`` is given).  Repeated
    rows count each; an empty table, or one without such words, gives no rows.
    """
    found = runs(docs, id_col, text_col, least_length)
    return forms(vocabulary(with_slips(found, slips) if slips else found, least_length, least_count), ratio)
