"""Token counts of whole texts, huge ones in overlapping chunks that are encoded apart and spliced.

A text of up to ``CHUNK`` characters is encoded at once.  A longer one is cut into chunks that overlap; each is a row of
its own, dealt over all tasks, and gives its number of tokens and every token's length, hence the token boundaries.

Splicing.  Let A B be one chunk and B C the next, B their overlap, and let both encodings have boundaries at q and at p,
q < p, both in B.  Byte-pair encoding merges the best pair (score, then leftmost place) until none is left.  Suppose that
over the whole text a merge crosses q or p, and look at the first such.  Until then the three parts before q, between q
and p and beyond p evolve on their own, in the order they have in A B (first and second part) and in B C (second and
third).  If the first crossing is at q, the encoding of A B would have crossed q at the same state; if at p, that of B C
would have crossed p.  Neither did, so q and p are boundaries of the whole text's encoding, and it is A B's up to p and B
C's from there.  A boundary at the overlap's own end counts, since one of the two chunks ends there.

A junction without two common boundaries is not proven: its overlap is widened to twice the size, and a chunk whose
overlaps would meet is joined with the one before; both are encoded again until all junctions hold.  The last resort is
the whole text in one chunk, so counts are always the tokenizer's own.

The proof needs that a text's characters are the first parts, which holds for models without user-defined pieces, and
that chunks aren't changed by normalisation; lengths that don't add up raise.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, partitions

#: Characters of a chunk, and of the overlap of two at first.
CHUNK, OVERLAP = 1 << 15, 256
#: Set before a chunk so that the model's own word mark stands apart: no piece has this character inside.
APART = "\n"


class Pieces:
    """A public sentencepiece BPE model, encoding with the characters that each token covers."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.length = np.array([len(p) for p in names], np.int64)
        for i, p in enumerate(names):
            if self.model.is_byte(i):  # a character in bytes is covered by its first one
                self.length[i] = 0 if 0x80 <= int(p[1:-1], 16) < 0xC0 else 1
            elif APART in p:
                raise ValueError("a piece has a line feed, chunks can't be set apart")
            elif self.model.is_unknown(i):
                self.length[i] = 1
        if self.length.max() > 255:
            raise ValueError("a piece has more than 255 characters")
        self.lead = len(self.model.encode(APART))

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def lengths(self, text: str, start: bool) -> np.ndarray:
        """Characters of each token of a chunk of the marked text (the text after the model's word mark)."""
        ids = self.model.encode(text[1:]) if start else self.model.encode(APART + text)[self.lead:]
        got = self.length[ids]
        if got.sum() != len(text):
            raise ValueError("the model changes texts, offsets are unknown")
        return got.astype(np.uint8)


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def splice(left: np.ndarray, left_at: int, right: np.ndarray, right_at: int) -> int | None:
    """Tokens of ``right`` from the last common boundary on, less those of ``left`` from there: what the junction adds to
    left's count.  None unless two boundaries of the overlap are common.  Arguments: token lengths and starts."""
    a, b = left_at + np.cumsum(left, dtype=np.int64), right_at + np.cumsum(right, dtype=np.int64)
    a, b = np.concatenate([[left_at], a]), np.concatenate([[right_at], b])
    common = np.intersect1d(a[a >= right_at], b[b <= a[-1]])
    if len(common) < 2:
        return None
    p = common[-1]
    return int((b > p).sum() - (a > p).sum())


def _cut(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(row, lo, hi, prev, part) of ranges (row, lo, hi, prev) of the marked texts (row, text)."""
    todo = ranges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "prev"))).alias("cuts"))

    def run(batches):
        for batch in batches:
            for row, text, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = " " + text.as_py()
                for a in range(0, len(cuts), 16):
                    some = cuts[a:a + 16]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), *[pa.array([c[x] for c in some], pa.int32()) for x in ("lo", "hi", "prev")],
                         pa.array([text[c["lo"]:c["hi"]] for c in some], pa.string())], ["row", "lo", "hi", "prev", "part"])

    own = texts.join(todo, "row").select("row", "text", "cuts")
    return own.mapInArrow(run, "row long, lo int, hi int, prev int, part string")


def _encode(chunks: DataFrame, path: str) -> DataFrame:
    """(row, lo, hi, prev, n, lengths) of chunks, dealt over all tasks."""
    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            lo, parts = batch.column(1).to_pylist(), batch.column(4)
            for a in range(0, len(lo), 64):
                got = [pieces.lengths(t.as_py(), at == 0) for t, at in zip(parts[a:a + 64], lo[a:a + 64])]
                some = batch.slice(a, len(got))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:4], pa.array([len(x) for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())],
                    ["row", "lo", "hi", "prev", "n", "lengths"])

    return chunks.repartition(partitions(chunks.sparkSession), "row", "lo") \
        .mapInArrow(run, "row long, lo int, hi int, prev int, n long, lengths binary")


def _junctions(coded: DataFrame) -> DataFrame:
    """(row, lo, adds) for each chunk that has one before it; ``adds`` is null if the junction isn't proven."""
    def run(batches):
        for batch in batches:
            row, lo, left_at, left, right = [batch.column(k).to_pylist() for k in range(5)]
            adds = [splice(np.frombuffer(a, np.uint8), x, np.frombuffer(b, np.uint8), y) for x, a, y, b in zip(left_at, left, lo, right)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(adds, pa.int64())], ["row", "lo", "adds"])

    left = coded.select("row", F.col("lo").alias("prev"), F.col("lengths").alias("before"))
    pairs = coded.where("prev >= 0").join(left, ["row", "prev"]).select("row", "lo", "prev", "before", "lengths")
    return pairs.mapInArrow(run, "row long, lo int, adds long")


def _widen(ranges: DataFrame, failed: DataFrame) -> DataFrame:
    """Ranges with the overlaps at failed junctions (row, lo) doubled, ``stale`` where a chunk must be encoded again."""
    w = Window.partitionBy("row").orderBy("lo")
    at = ranges.join(failed.withColumn("bad", F.lit(True)), ["row", "lo"], "left") \
        .withColumn("end", F.lag("hi").over(w)).withColumn("least", F.greatest(F.coalesce(F.lag("hi", 2).over(w), F.lit(0)), F.lag("lo").over(w) + 1))
    wide = F.col("end") - 2 * (F.col("end") - F.col("lo"))
    at = at.withColumn("joined", F.coalesce(F.col("bad") & (wide < F.col("least")), F.lit(False)))
    grown = F.coalesce(F.col("bad"), F.lit(False)) & ~F.col("joined")
    at = at.withColumn("from", F.when(grown, wide).otherwise(F.col("lo"))).withColumn("grown", grown) \
        .withColumn("chunk", F.sum((~F.col("joined")).cast("int")).over(w))
    out = at.groupBy("row", "chunk").agg(F.min("from").alias("lo"), F.max("hi").alias("hi"), F.max("grown").alias("grown"),
                                         F.count(F.lit(1)).alias("k"))
    return out.select("row", "lo", "hi", F.coalesce(F.lag("lo").over(w), F.lit(-1)).alias("prev"), (F.col("grown") | (F.col("k") > 1)).alias("stale"))


def count(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
          overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, n_chunks) for every row: UTF-8 length and tokens of the whole text, and how many chunks
    it was encoded in.

    Null and empty texts have 0 of both lengths and one chunk; repeated rows are counted each; an empty table gives none;
    other columns are left out.
    """
    if not 0 < 4 * overlap <= chunk:
        raise ValueError("a chunk must hold four overlaps")
    spark = docs.sparkSession
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    own = own.select(F.monotonically_increasing_id().alias("row"), "id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = own.schema["id"].dataType.simpleString()

    def small(batches):
        pieces = _pieces(model_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                texts = some.column(3).to_pylist()
                short = [len(t) < chunk for t in texts]
                got = iter(pieces.count([t for t, s in zip(texts, short) if s]))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:3], pa.array([next(got) if s else None for s in short], pa.int64()),
                     pa.array([None if s else t for t, s in zip(texts, short)], pa.string()),
                     pa.array([None if s else len(t) + 1 for t, s in zip(texts, short)], pa.int32())],
                    ["row", "id", "n_bytes", "n_tokens", "text", "length"])

    first = materialize(own.mapInArrow(small, f"row long, id {kind}, n_bytes long, n_tokens long, text string, length int"), "tokens-first")
    huge = first.where("text is not null")
    done = first.select("row", "id", "n_bytes", "n_tokens")
    if huge.isEmpty():
        return done.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", F.lit(1).cast("long").alias("n_chunks"))

    starts = F.sequence(F.lit(0), F.greatest(F.col("length") - 1 - overlap, F.lit(0)), F.lit(chunk - overlap))
    ranges = huge.select("row", "length", F.explode(starts).alias("lo"))
    ranges = ranges.select("row", "lo", F.least(F.col("lo") + chunk, F.col("length")).alias("hi"),
                           F.when(F.col("lo") > 0, F.col("lo") - (chunk - overlap)).otherwise(-1).cast("int").alias("prev"))
    texts = huge.select("row", "text")
    coded = materialize(_encode(_cut(texts, ranges), model_path), "tokens-chunks")
    while True:
        links = materialize(_junctions(coded), "tokens-junctions")
        failed = links.where("adds is null").select("row", "lo")
        if failed.isEmpty():
            break
        again = failed.select("row").distinct()
        ranges = materialize(_widen(coded.join(again, "row", "left_semi").select("row", "lo", "hi"), failed), "tokens-ranges")
        fresh = _encode(_cut(texts, ranges.where("stale").drop("stale")), model_path)
        # chunks that stay may have another one before them now
        stay = ranges.where("not stale").select("row", "lo", "hi", "prev").join(coded.drop("prev"), ["row", "lo", "hi"]) \
            .select("row", "lo", "hi", "prev", "n", "lengths")
        coded = materialize(coded.join(again, "row", "left_anti").unionByName(fresh).unionByName(stay), "tokens-chunks")
    return done.join(_totals(coded, links), "row", "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_tokens", "total").alias("n_tokens"),
        F.coalesce("k", F.lit(1)).cast("long").alias("n_chunks"))


def _totals(coded: DataFrame, links: DataFrame) -> DataFrame:
    """(row, total, k): the first chunk's tokens and what every junction adds."""
    parts = coded.select("row", F.when(F.col("prev") < 0, F.col("n")).otherwise(0).alias("n"), F.lit(1).alias("k")) \
        .unionByName(links.select("row", F.col("adds").alias("n"), F.lit(0).alias("k")))
    return parts.groupBy("row").agg(F.sum("n").alias("total"), F.sum("k").alias("k"))
