"""Extendible hashing: byte-bounded shards from hash-prefix bits (DataFrame functions only).

A directory of hash prefixes starts with one bucket; a bucket whose bytes exceed the limit splits
on one more bit, all others stay.  All depths up to ``G`` are decided from one histogram of
``G``-bit prefixes, so a round costs one narrow scan; only buckets that are still too large at
depth ``G`` take part in the next round with more bits.  The directory has a few rows for each
shard and stays a DataFrame: it is never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Bits of the hash that can be used.
MAX_BITS = 60


def hash_bits(*cols: Column) -> Column:
    """60 bits of MD5 over the key columns as text (null: empty), as a long."""
    key = F.concat_ws("\u0001", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, bits) -> Column:
    """The first ``bits`` bits of a 60-bit hash (a number or a column)."""
    if isinstance(bits, int):
        return F.shiftright(h, MAX_BITS - bits)
    return F.call_function("shiftright", h, F.lit(MAX_BITS) - bits)


def shard(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text",
          step_bits: int = 5) -> DataFrame:
    """One row per document row: (id, n_bytes, shard, depth, shard_bytes, shard_rows, oversized).

    ``shard`` is the bucket's prefix as text of ``depth`` bits (empty: one shard holds all).  The key
    is (id, text), so repeated ids spread; rows equal in both hash alike and can't be split: if they
    (or one text) exceed ``max_bytes``, their bucket stops as soon as its rows share all 60 bits
    and says ``oversized``.  A null text has 0 bytes; an empty table gives an empty result.  Other
    columns of ``docs``, whatever their names, are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n"),
        hash_bits(F.col(id_col), F.col(text_col)).alias("h"))
    rows = materialize(rows, "shard-rows")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(MAX_BITS, max(1, (total // max_bytes).bit_length() + step_bits))
    left, done, low = rows, None, 0
    while True:
        found = _round(left, low, bits, max_bytes)
        fits = found.where(f"fits or {bits} = {MAX_BITS}").drop("fits")
        done = fits if done is None else done.unionByName(fits)
        if bits == MAX_BITS:
            break
        large = materialize(found.where("not fits").select("prefix"), "shard-large")
        if large.isEmpty():
            break
        left = materialize(
            left.withColumn("prefix", _prefix(F.col("h"), bits)).join(large, "prefix", "left_semi")
            .drop("prefix"), "shard-left")
        low, bits = bits, min(MAX_BITS, bits + 2 * step_bits)
    return done.select(
        F.col("id").alias(id_col), F.col("n").alias("n_bytes"),
        F.when(F.col("depth") == 0, "").otherwise(
            F.lpad(F.conv(_prefix(F.col("h"), F.col("depth")).cast("string"), 10, 2),
                   F.col("depth"), F.lit("0"))).alias("shard"),
        F.col("depth").cast("int").alias("depth"), F.col("total").alias("shard_bytes"),
        F.col("rows").alias("shard_rows"), (F.col("total") > max_bytes).alias("oversized"))


def _round(rows: DataFrame, low: int, bits: int, max_bytes: int) -> DataFrame:
    """Rows with the shallowest depth in [low, bits] whose bucket fits (else depth ``bits``)."""
    keyed = rows.withColumn("prefix", _prefix(F.col("h"), bits))
    histogram = keyed.groupBy("prefix").agg(F.sum("n").alias("b"), F.count(F.lit(1)).alias("c"))
    # every bucket of every depth: its total, kept if it fits or can't be split here
    deep = histogram.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(bits))))
    deep = deep.withColumn("bucket", F.call_function("shiftright", F.col("prefix"), F.lit(bits) - F.col("depth")))
    totals = deep.groupBy("depth", "bucket").agg(F.sum("b").alias("total"), F.sum("c").alias("rows"))
    ends = totals.where((F.col("total") <= max_bytes) | (F.col("depth") == bits))
    # of a prefix's buckets the shallowest end holds it
    choice = deep.select("prefix", "depth", "bucket").join(ends, ["depth", "bucket"]).groupBy("prefix").agg(
        F.min(F.struct("depth", "total", "rows")).alias("end"))
    choice = choice.select("prefix", "end.*", (F.col("end.total") <= max_bytes).alias("fits"))
    return keyed.join(choice, "prefix")
