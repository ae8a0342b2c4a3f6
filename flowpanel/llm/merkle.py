"""Merkle manifest of a dataset, stored as blocks in van Emde Boas layout.

Leaves are digests of rows, ordered in their group; while a group has several nodes, each two consecutive ones (at the
end possibly one) become the digest of their concatenation.  Groups' subroots make one more tree, whose last node is the
root.

A tree is cut into aligned subtrees of ``HEIGHT`` levels, each one row of a block table.  A block keeps its nodes in van
Emde Boas order: a tree is split at half its height, the upper half is stored first, then the lower subtrees one after
the other, each laid out likewise.  :func:`address` computes a node's place; the same arithmetic serves construction and
the retrieval of siblings.  The blocks' top nodes are the next stage's leaves, until one block holds the group.

Leaves get their place in the group by a range shuffle: each partition's rows are counted, and the counts before it are
added.  No task holds more than a block.
"""

from __future__ import annotations

import binascii
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, partitions

#: Levels of a block above its leaves.
HEIGHT = 10
SIZE = 32
#: Where the sibling of a path's step stands; a node without one is hashed alone.
RIGHT, LEFT, ALONE = 0, 1, 2
STEP = SIZE + 1


def address(depth: int, i: np.ndarray, height: int) -> np.ndarray:
    """Places of the nodes ``i`` of a depth (root: 0) in a tree of ``height`` levels."""
    place = np.zeros_like(i)
    while height > 1:
        top = height // 2
        if depth < top:
            height = top
            continue
        low = height - top
        place = place + (1 << top) - 1 + (i >> (depth - top)) * ((1 << low) - 1)
        i = i & ((1 << (depth - top)) - 1)
        depth, height = depth - top, low
    return place


def h(text: bytes) -> bytes:
    """Lower-case hex digest."""
    return sha256(text).hexdigest().encode()


def widths(n: int, levels: int) -> list[int]:
    """Number of nodes at every depth over ``n`` leaves, the top first."""
    return [-(-n >> (levels - d)) for d in range(levels + 1)]


def build(leaves: list[bytes], levels: int) -> tuple[bytes, bytes]:
    """(top digest, nodes in van Emde Boas order) of raw leaf digests raised by ``levels``."""
    store = np.zeros(((2 << levels) - 1, SIZE), np.uint8)
    row = [binascii.hexlify(x) for x in leaves]
    for depth in range(levels, -1, -1):
        at = address(depth, np.arange(len(row)), levels + 1)
        store[at] = np.frombuffer(binascii.unhexlify(b"".join(row)), np.uint8).reshape(-1, SIZE)
        if depth:
            row = [h(b"".join(row[k:k + 2])) for k in range(0, len(row), 2)]
    return store[0].tobytes(), store.tobytes()


def siblings(nodes: bytes, n: int, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level from the leaves up: every leaf's side (RIGHT, LEFT, ALONE) and sibling digest."""
    store, out = np.frombuffer(nodes, np.uint8).reshape(-1, SIZE), []
    width = widths(n, levels)
    for depth in range(levels, 0, -1):
        i = np.arange(n) >> (levels - depth)
        other = i ^ 1
        side = np.where(other >= width[depth], ALONE, i & 1)
        got = store[address(depth, np.minimum(other, width[depth] - 1), levels + 1)]
        out.append((side, got))
    return out


def fold(value: bytes, path: bytes) -> bytes:
    """Digest (hex) that a hex digest leads to along a path of (side, sibling) steps."""
    for k in range(0, len(path), STEP):
        side, other = path[k], binascii.hexlify(path[k + 1:k + STEP])
        value = h(value + other if side == RIGHT else other + value if side == LEFT else value)
    return value


def proof(path: bytes) -> bytes:
    """The siblings of a path, hex, concatenated."""
    return b"".join(binascii.hexlify(path[k + 1:k + STEP]) for k in range(0, len(path), STEP) if path[k] != ALONE)


def field_digest(cols) -> "F.Column":
    """SHA-256 (hex) of the fields: UTF-8 length, ``:`` and value of each, ``-`` for null."""
    text = [F.col(c).cast("string") for c in cols]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Add ``idx`` (place in the group by ``order``, from 0; null first) and ``size`` (rows of the group)."""
    keys = [F.asc_nulls_first(c) for c in (group, *order)]
    placed = materialize(df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
                         .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), name)
    w = Window.partitionBy(group)
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("k"))
    runs = runs.withColumn("size", F.sum("k").over(w)) \
        .withColumn("before", F.sum("k").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k"))
    return placed.join(runs.drop("k"), [group, "part"]) \
        .withColumn("idx", F.col("at") - F.col("lo") + F.col("before")).drop("at", "part", "lo", "before")


def _levels(size):
    """Levels that a tree over ``size`` nodes has above its leaves."""
    return F.when(size <= 1, F.lit(0)).otherwise(F.length(F.bin(size - 1))).cast("int")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """(grp, blk, k, levels, size, top, nodes) of nodes (grp, idx, digest, size): one row for each aligned subtree."""
    own = nodes.select("grp", F.expr(f"shiftright(idx, {height})").alias("blk"), "idx", "digest",
                       F.least(_levels(F.col("size")), F.lit(height)).alias("levels"), "size")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        levels = t["levels"][0].as_py()
        top, nodes = build(t["digest"].to_pylist(), levels)
        one = t.slice(0, 1)
        return pa.table({"grp": one["grp"], "blk": one["blk"], "k": pa.array([t.num_rows], pa.int32()), "levels": one["levels"],
                         "size": one["size"], "top": pa.array([top], pa.binary()), "nodes": pa.array([nodes], pa.binary())})

    return own.groupBy("grp", "blk").applyInArrow(run, "grp string, blk long, k int, levels int, size long, top binary, nodes binary")


def forest(nodes: DataFrame, height: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """(block tables by stage, (grp, digest) of every group's last node) of nodes (grp, idx, digest, size)."""
    stages, tops = [], []
    while True:
        blocks = materialize(_blocks(nodes, height), f"merkle-blocks-{len(stages)}")
        stages.append(blocks)
        left = F.expr(f"shiftright(size + {(1 << height) - 1}, {height})")
        tops.append(blocks.where(left == 1).select("grp", F.col("top").alias("digest")))
        nodes = blocks.where(left > 1).select("grp", F.col("blk").alias("idx"), F.col("top").alias("digest"), left.alias("size"))
        if nodes.isEmpty():
            break
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return stages, out


def _climb(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, idx, path, subroot, root) of all nodes of a stage, from their blocks and the paths above them."""
    def run(batches):
        for batch in batches:
            for grp, blk, k, levels, nodes, path, subroot, root, height in zip(*[c.to_pylist() for c in batch.columns]):
                steps = siblings(nodes, k, levels)
                paths = [b"".join(bytes([s[i]]) + g[i].tobytes() for s, g in steps) + path for i in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * k, pa.string()), pa.array([(blk << height) + i for i in range(k)], pa.int64()),
                     pa.array(paths, pa.binary()), pa.array([subroot] * k, pa.binary()), pa.array([root] * k, pa.binary())],
                    ["grp", "idx", "path", "subroot", "root"])

    own = blocks.join(above, ["grp", "blk"]).select("grp", "blk", "k", "levels", "nodes", "path", "subroot", "root", "height")
    return own.mapInArrow(run, "grp string, idx long, path binary, subroot binary, root binary")


class Manifest:
    """Leaves (grp, idx, digest and the rows), block tables of the groups by stage, of the tree over the
    subroots, and the subroots."""

    def __init__(self, leaves: DataFrame, stages: list[DataFrame], upper: list[DataFrame], subroots: DataFrame, height: int):
        self.leaves, self.stages, self.upper, self.subroots, self.height = leaves, stages, upper, subroots, height

    def root(self) -> str | None:
        """The root, hex; None for an empty dataset."""
        row = self.upper[-1].where("size <= %d" % (1 << self.height)).select(F.lower(F.hex("top"))).first() if self.upper else None
        return row[0] if row else None

    def paths(self) -> DataFrame:
        """(grp, blk, path, subroot, root, height) for the blocks that hold leaves: the way from a block's top to the root."""
        height = F.lit(self.height).alias("height")
        above = None
        for stage in reversed(self.upper):
            # a block that holds its whole tree starts the paths, below that they go on
            whole = stage.where(F.col("size") <= (1 << self.height)).select(
                "grp", "blk", F.lit(b"").alias("path"), F.lit(b"").alias("subroot"), F.col("top").alias("root"), height)
            above = whole if above is None else whole.unionByName(
                above.select("grp", F.col("idx").alias("blk"), "path", "subroot", "root", height))
            above = _climb(stage, above)
        tops = self.subroots.join(above.select("idx", "path", "root"), "idx").select("grp", "digest", "path", "root")
        tops = materialize(tops, "merkle-tops")
        above = None
        for k, stage in reversed(list(enumerate(self.stages))):
            start = stage.where(F.col("size") <= (1 << self.height)).select("grp", "blk") \
                .join(tops.select("grp", "path", F.col("digest").alias("subroot"), "root"), "grp").withColumn("height", F.lit(self.height))
            own = start if above is None else start.unionByName(above.select("grp", F.col("idx").alias("blk"), "path", "subroot", "root", height))
            if k == 0:
                return own
            above = materialize(_climb(stage, own), f"merkle-paths-{k}")


def manifest(rows: DataFrame, digest: str, group: str, order: list[str], height: int = HEIGHT) -> Manifest:
    """Merkle manifest of rows by their hex digest column, a tree for each group.

    Leaves ascend by ``order`` (null first), ties by digest; equal rows are leaves each, a null digest raises.  Groups
    ascend bytewise, null first.  An empty table has no root.  Columns of ``rows`` stay with the leaves, as ``row``.
    """
    places = [f"o{k}" for k in range(len(order))]
    own = rows.select(F.struct("*").alias("row"), F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("grp"),
                      F.unhex(F.col(digest)).alias("digest"), *[F.col(c).alias(k) for c, k in zip(order, places)])
    leaves = ranked(own, "grp", [*places, "digest"], "merkle-leaves")
    stages, tops = forest(leaves.select("grp", "idx", "digest", "size"), height)
    placed = ranked(tops.withColumn("tree", F.lit("")), "tree", ["grp"], "merkle-subroots")
    upper, _ = forest(placed.select(F.col("tree").alias("grp"), "idx", "digest", "size"), height)
    return Manifest(leaves, stages, upper, placed.select("grp", "idx", "digest"), height)


def prove(m: Manifest, changed: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(kept columns, leaf, subroot, root, proof, folded), all hex but the kept ones: every leaf's inclusion proof.

    ``proof`` is the SHA-256 of the siblings on the way to the root, concatenated; ``folded`` is the root that the column
    ``changed`` (a hex digest; null: the leaf itself) leads to with these siblings.  Rows that are equal have one result
    each; an empty manifest gives none.
    """
    keep = list(keep or [])
    kept = [f"c{k}" for k in range(len(keep))]
    rows = m.leaves.select("grp", F.expr(f"shiftright(idx, {m.height})").alias("blk"), "idx", "digest",
                           (F.unhex(F.col(f"row.{changed}")) if changed else F.lit(None).cast("binary")).alias("other"),
                           *[F.col(f"row.{c}").alias(k) for c, k in zip(keep, kept)])
    blocks = m.stages[0].select("grp", "blk", "k", "levels", "nodes").join(m.paths(), ["grp", "blk"])
    types = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in kept)

    def run(mine: pa.Table, block: pa.Table) -> pa.Table:
        mine = mine.sort_by("idx")
        k, levels = block["k"][0].as_py(), block["levels"][0].as_py()
        steps = [(s.tolist(), binascii.hexlify(g.tobytes())) for s, g in siblings(block["nodes"][0].as_py(), k, levels)]
        path = block["path"][0].as_py()
        beyond, ends = proof(path), {}
        proofs, folded = [], []
        for i, (own, other) in enumerate(zip(mine["digest"].to_pylist(), mine["other"].to_pylist())):
            value, seen = binascii.hexlify(own if other is None else other), []
            for side, got in steps:
                sibling = got[64 * i:64 * i + 64]
                if side[i] == ALONE:
                    value = h(value)
                else:
                    seen.append(sibling)
                    value = h(value + sibling if side[i] == RIGHT else sibling + value)
            if value not in ends:
                ends[value] = fold(value, path).decode()
            folded.append(ends[value])
            proofs.append(h(b"".join(seen) + beyond).decode())
        hexed = [x.hex() for x in mine["digest"].to_pylist()]
        one = {c: [block[c][0].as_py().hex()] * len(hexed) for c in ("subroot", "root")}
        return pa.table({c: mine[c] for c in kept} | {
            "leaf": pa.array(hexed, pa.string()), "subroot": pa.array(one["subroot"], pa.string()), "root": pa.array(one["root"], pa.string()),
            "proof": pa.array(proofs, pa.string()), "folded": pa.array(folded, pa.string())})

    out = rows.groupBy("grp", "blk").cogroup(blocks.groupBy("grp", "blk")).applyInArrow(
        run, f"{types[2:] + ', ' if types else ''}leaf string, subroot string, root string, proof string, folded string")
    return out.withColumnsRenamed(dict(zip(kept, keep)))
