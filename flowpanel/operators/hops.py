"""Neighbourhood sizes (G3) of graphs whose sketches together are larger than their edges.

A vertex's HyperLogLog sketch is 2^lg_k registers, and each register of a union is the greatest of the two: registers don't
meet.  So a run takes a slice of all vertices' registers, as many as weigh at most 16 bytes an edge, through all
hops, and adds what the estimate needs (Σ 2^-register and the number of empty ones, for each vertex and hop).  What lies
on disk at one time has the size of the edges; the work is that of whole sketches.

Vertices are numbered within parts, edges are dealt to blocks (the many-neighboured end's part and the other end's).  State is
one row a part: the slice as a matrix.  In a hop a part sends the vertices that grew once to each block that has them;
a block sends back one union for each of its vertices.
"""

from __future__ import annotations

import gc
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import _materialize

#: Vertices of a part (on average), and the bits of a vertex's number within it.
PART, BITS = 1 << 16, 20
#: Bytes of the matrix that a block holds for one side, and of a slice of all vertices, at least.
SIDE_BYTES, LEAST = 1 << 26, 1 << 27
#: Neighbours from which on a vertex's union is taken on its own, and rows that are worked on at once.
HUB, ROWS = 256, 2048


def estimate(total: np.ndarray, empty: np.ndarray, m: int) -> np.ndarray:
    """Distinct values from Σ 2^-register of the registers that aren't empty and the number of empty ones (Ertl's estimator)."""
    x = empty / m
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        sigma, power, step = x.copy(), x.copy(), 1.0
        for _ in range(64):
            power = power * power
            sigma, step = sigma + power * step, step * 2
        return np.where(empty >= m, 0.0, m * m / (2 * np.log(2) * (m * sigma + total)))


def unions(cells: np.ndarray, layers: np.ndarray, sizes: np.ndarray, order: np.ndarray, hubs: np.ndarray, ends: np.ndarray, sent=None) -> np.ndarray:
    """Greatest registers of each vertex's neighbours.  ``layers`` holds the t-th neighbours of the ``sizes[t]`` vertices that have so
    many (first in ``order``), ``hubs`` the neighbours of the first vertices up to ``ends``.  Rows that ``sent`` doesn't mark are empty:
    where they are most of the neighbours, the others are laid out anew."""
    out = np.zeros_like(cells)
    big = len(ends)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if sent is not None and 4 * (np.count_nonzero(sent[layers]) + np.count_nonzero(sent[hubs])) < len(layers) + len(hubs):
        to = np.concatenate([np.repeat(order[:big], np.diff(ends, prepend=0)), order[big:][np.arange(len(layers)) - np.repeat(starts[:-1], sizes)]])
        of = np.concatenate([hubs, layers])
        keep = sent[of]
        return unions(cells, *_layout(to[keep].astype(np.int64), of[keep].astype(np.int64), len(cells))) if keep.any() else out
    lo = 0
    for k, hi in enumerate(ends):
        here = out[order[k]]
        for at in range(lo, hi, ROWS):
            np.maximum(here, cells[hubs[at:min(hi, at + ROWS)]].max(axis=0), out=here)
        lo = hi
    rest = order[big:]
    met = np.empty((ROWS, cells.shape[1]), np.uint8)
    for lo in range(0, int(sizes[0]) if len(sizes) else 0, ROWS):  # rows that stay in the processor's cache
        hi = min(lo + ROWS, int(sizes[0]))
        got = cells[layers[lo:hi]]
        for size, start in zip(sizes[1:], starts[1:]):
            n = min(hi, size) - lo
            if n <= 0:
                break
            np.take(cells, layers[start + lo:start + lo + n], axis=0, out=met[:n], mode="clip")
            np.maximum(got[:n], met[:n], out=got[:n])
        out[rest[lo:hi]] = got
    return out


def _layout(i: np.ndarray, j: np.ndarray, n: int):
    """(layers, sizes, order, hubs, ends) of :func:`unions` for edges that bring ``j``'s registers to ``i``."""
    degree = np.bincount(i, minlength=n)
    order = np.argsort(-degree, kind="stable")
    by = np.argsort(i, kind="stable")
    i, j, start = i[by], j[by], np.concatenate([[0], np.cumsum(degree)])
    big = int((degree > HUB).sum())
    hubs = [j[start[v]:start[v + 1]] for v in order[:big]]
    small = degree[i] <= HUB
    i, j, at = i[small], j[small], (np.arange(len(i)) - start[i])[small]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    by = np.lexsort((rank[i], at))
    return j[by], np.bincount(at), order, np.concatenate([*hubs, np.zeros(0, np.int64)]), np.cumsum([len(h) for h in hubs])


def _bytes(a, kind) -> pa.Array:
    return pa.array([np.asarray(a).astype(kind).tobytes()], pa.binary())


def _array(x, kind) -> np.ndarray:
    return np.frombuffer(x.as_py() if isinstance(x, pa.Scalar) else x, kind)


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}


def _batch(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array([v], pa.int32()) for k, v in values.items()})


def _distinct(numbers: np.ndarray, registers: np.ndarray) -> None:
    """A small sketch of numbers, raised in place."""
    with np.errstate(over="ignore"):
        z = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    low = (z >> np.uint64(10)) & np.uint64((1 << 32) - 1)
    rank = 33 - np.ceil(np.log2(low.astype(float) + 1)).astype(int)
    np.maximum.at(registers, (z >> np.uint64(54)).astype(np.int64), rank)


def _clean(spark) -> None:
    """What no frame needs any more goes from disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _numbered(edges: DataFrame, lg_k: int, n: int) -> tuple[DataFrame, DataFrame]:
    """(id, number, degree) of vertices, and a row (p, reg, rank) a part: each vertex's register and the value it gives it."""
    parts = -(-n // PART)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    x = F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1
    hashed = F.xxhash64(F.lit(lg_k), F.col("id").cast("string"))
    v = _materialize(ends.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("x", x).select(
        "id", "d", "p", "x", F.shiftrightunsigned(hashed, 64 - lg_k).cast("int").alias("reg"),
        # leading zeros of the bits behind the register's number, and one
        F.when(F.col("id").isNotNull(), 65 - lg_k - F.length(F.regexp_replace(F.bin(hashed.bitwiseAND(F.lit((1 << (64 - lg_k)) - 1))), "^0$", "")))
        .otherwise(F.lit(0)).cast("int").alias("rank")))

    def packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("x")
        return pa.Table.from_batches([_batch(p=key[0].as_py(), reg=_bytes(rows["reg"].to_numpy(), np.int32), rank=_bytes(rows["rank"].to_numpy(), np.uint8))])

    own = _materialize(v.select("p", "x", "reg", "rank").groupBy("p").applyInArrow(packed, "p int, reg binary, rank binary"))
    return v.select("id", "d", (F.shiftleft(F.col("p").cast("long"), BITS) + F.col("x")).alias("v")), own


def _blocks(edges: DataFrame, numbers: DataFrame, side: int, kind) -> DataFrame:
    """A row a block: its vertices' numbers, ascending, and the layout of its edges."""
    spark = edges.sparkSession
    ends = edges.where("src != dst").select("src", "dst")
    for end in ("src", "dst"):
        ends = ends.join(numbers.select(F.col("id").alias(end), F.col("d").alias(f"d_{end}"), F.col("v").alias(f"v_{end}")), end).drop(end)
    first = (F.col("d_src") < F.col("d_dst")) | ((F.col("d_src") == F.col("d_dst")) & (F.col("v_src") < F.col("v_dst")))
    pairs = ends.select(F.when(first, F.col("v_src")).otherwise(F.col("v_dst")).alias("few"), F.when(first, F.col("v_dst")).otherwise(F.col("v_src")).alias("many"))

    def packed(batches):
        for batch in batches:
            if batch.num_rows:
                yield _batch(few=_bytes(batch.column(0).to_numpy(), kind), many=_bytes(batch.column(1).to_numpy(), kind))

    pairs = _materialize(pairs.mapInArrow(packed, "few binary, many binary"))
    _clean(spark)

    def seen(batches):
        few, many = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        for r in _rows(batches):
            _distinct(_array(r["few"], kind), few)
            _distinct(_array(r["many"], kind), many)
        yield pa.RecordBatch.from_pydict({"s": pa.array([np.concatenate([few, many])], pa.list_(pa.int64()))})

    greatest = np.zeros(2 << 10)
    for r in pairs.mapInArrow(seen, "s array<long>").toLocalIterator():
        greatest = np.maximum(greatest, r["s"])
    few_n, many_n = (float(estimate(np.array([np.where(h, 2.0 ** -h, 0).sum()]), np.array([(h == 0).sum()]), 1 << 10)[0]) for h in np.split(greatest, 2))
    a = max(1, round(many_n / side))
    b = max(1, round(few_n / side), -(-spark.sparkContext.defaultParallelism // a))

    def dealt(batches):
        for r in _rows(batches):
            few, many = _array(r["few"], kind), _array(r["many"], kind)
            # a multiple mixes the numbers, which run within parts
            place = ((many.astype(np.int64) * 0x9E3779B1 >> 16) % a) * b + (few.astype(np.int64) * 0x9E3779B1 >> 16) % b
            order = np.argsort(place, kind="stable")
            blocks, starts = np.unique(place[order], return_index=True)
            for block, rows in zip(blocks, np.split(order, starts[1:])):
                yield _batch(block=int(block), few=_bytes(few[rows], kind), many=_bytes(many[rows], kind))

    def laid(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        few, many = (np.concatenate([_array(x, kind) for x in rows[c]]) for c in ("few", "many"))
        ids = np.unique(np.concatenate([np.unique(few), np.unique(many)]))
        i, j = np.searchsorted(ids, few), np.searchsorted(ids, many)
        pair = np.unique(np.concatenate([i * len(ids) + j, j * len(ids) + i]))
        layout = _layout(*np.divmod(pair, len(ids)), len(ids))
        return pa.Table.from_batches([_batch(block=key[0].as_py(), ids=_bytes(ids, kind), **{
            c: _bytes(x, np.int32) for c, x in zip(LAYOUT, layout)})])

    fields = "block int, ids binary, " + ", ".join(f"{c} binary" for c in LAYOUT)
    return _materialize(pairs.mapInArrow(dealt, "block int, few binary, many binary").groupBy("block").applyInArrow(laid, fields))


#: Columns of a block's layout.
LAYOUT = ("layers", "sizes", "turn", "hubs", "ends")


def _routed(blocks: DataFrame, own: DataFrame, kind) -> DataFrame:
    """Parts (p, reg, rank) with ``to``, ``sizes`` and ``xs``: the blocks that have vertices of the part, how many and which."""
    def lists(batches):
        for r in _rows(batches):
            ids = _array(r["ids"], kind)
            part = ids >> BITS
            parts, starts = np.unique(part, return_index=True)
            for p, mine in zip(parts, np.split(ids, starts[1:])):
                yield _batch(q=int(p), block=r["block"], xs=_bytes(mine & ((1 << BITS) - 1), np.int32))

    def gathered(part: pa.Table, routes: pa.Table) -> pa.Table:
        if not part.num_rows:
            return empty
        xs = [_array(x, np.int32) for x in routes["xs"]]
        return pa.Table.from_batches([_batch(p=part["p"][0].as_py(), reg=_bytes(_array(part["reg"][0], np.int32), np.int32), rank=_bytes(
            _array(part["rank"][0], np.uint8), np.uint8), to=_bytes(routes["block"].to_numpy(), np.int32), sizes=_bytes([len(x) for x in xs], np.int32),
            xs=_bytes(np.concatenate([*xs, np.zeros(0, np.int32)]), np.int32))])

    empty = pa.table({"p": pa.array([], pa.int32())} | {c: pa.array([], pa.binary()) for c in ("reg", "rank", "to", "sizes", "xs")})
    routes = blocks.mapInArrow(lists, "q int, block int, xs binary")
    return _materialize(own.groupBy("p").cogroup(routes.groupBy("q")).applyInArrow(
        gathered, "p int, reg binary, rank binary, to binary, sizes binary, xs binary"))


STATE = "p int, grew int, cells binary, grown binary, total binary, empty binary, to binary, sizes binary, xs binary"


def _started(own: DataFrame, lo: int, width: int) -> DataFrame:
    """The state at no hop of the registers from ``lo``: each vertex's own."""
    def run(batches):
        for r in _rows(batches):
            reg, rank = _array(r["reg"], np.int32), _array(r["rank"], np.uint8)
            cells = np.zeros((len(reg), width), np.uint8)
            mine = np.nonzero((reg >= lo) & (reg < lo + width) & (rank > 0))[0]
            cells[mine, reg[mine] - lo] = rank[mine]
            yield _batch(p=r["p"], grew=len(mine), cells=_bytes(cells, np.uint8), grown=_bytes(cells.any(axis=1), np.uint8), **_sums(cells, b"", b""),
                         **{c: _bytes(_array(r[c], np.int32), np.int32) for c in ("to", "sizes", "xs")})

    return _materialize(own.mapInArrow(run, STATE))


#: 2^-register, nothing for an empty one.
_SHARES = np.concatenate([[0.0], 0.5 ** np.arange(1, 256)]).astype(np.float32)


def _sums(cells: np.ndarray, total: bytes, empty: bytes) -> dict:
    """The sums of a hop behind those of the hops before."""
    n = len(cells)
    here = np.concatenate([_SHARES[cells[at:at + 4096]].sum(axis=1, dtype=np.float32) for at in range(0, n, 4096)] + [np.zeros(0, np.float32)])
    free = (cells.shape[1] - np.count_nonzero(cells, axis=1)).astype(np.uint16)
    return {"total": pa.array([total + here.tobytes()], pa.binary()), "empty": pa.array([empty + free.tobytes()], pa.binary())}


def _hop(state: DataFrame, blocks: DataFrame, width: int, kind) -> DataFrame:
    """The state one hop further."""
    mask = (1 << BITS) - 1

    def sent(batches):
        for r in _rows(batches):
            cells, grown = _array(r["cells"], np.uint8).reshape(-1, width), _array(r["grown"], np.uint8) > 0
            lo, xs = 0, _array(r["xs"], np.int32)
            for block, size in zip(_array(r["to"], np.int32), _array(r["sizes"], np.int32)):
                at = np.nonzero(grown[xs[lo:lo + size]])[0]
                if len(at):
                    yield _batch(to=int(block), p=r["p"], at=_bytes(at, np.int32), rows=_bytes(cells[xs[lo + at]], np.uint8))
                lo += size

    def united(block: pa.Table, rows: pa.Table) -> pa.Table:
        if not block.num_rows or not rows.num_rows:
            return nothing
        ids = _array(block["ids"][0], kind)
        cells = np.zeros((len(ids), width), np.uint8)
        full = np.zeros(len(ids), bool)
        for p, at, x in zip(rows["p"], rows["at"], rows["rows"]):
            place = np.searchsorted(ids, p.as_py() << BITS) + _array(at, np.int32)
            cells[place], full[place] = _array(x, np.uint8).reshape(-1, width), True
        met = unions(cells, *(_array(block[c][0], np.int32) for c in LAYOUT), full)
        full = met.any(axis=1)
        parts, starts = np.unique(ids >> BITS, return_index=True)
        out = []
        for p, lo, hi in zip(parts, starts, [*starts[1:], len(ids)]):
            at = lo + np.nonzero(full[lo:hi])[0]
            if len(at):
                out.append(_batch(q=int(p), at=_bytes(ids[at] & mask, np.int32), rows=_bytes(met[at], np.uint8)))
        return pa.Table.from_batches(out) if out else nothing

    def raised(part: pa.Table, rows: pa.Table) -> pa.Table:
        if not part.num_rows:
            return empty
        old = _array(part["cells"][0], np.uint8).reshape(-1, width)
        cells = old.copy()
        for at, x in zip(rows["at"], rows["rows"]):
            at = _array(at, np.int32)
            cells[at] = np.maximum(cells[at], _array(x, np.uint8).reshape(-1, width))
        grown = (cells != old).any(axis=1)
        return pa.Table.from_batches([_batch(
            p=part["p"][0].as_py(), grew=int(grown.sum()), cells=_bytes(cells, np.uint8), grown=_bytes(grown, np.uint8),
            **_sums(cells, part["total"][0].as_py(), part["empty"][0].as_py()),
            **{c: _bytes(_array(part[c][0], np.int32), np.int32) for c in ("to", "sizes", "xs")})])

    nothing = pa.table({"q": pa.array([], pa.int32()), "at": pa.array([], pa.binary()), "rows": pa.array([], pa.binary())})
    empty = pa.table({"p": pa.array([], pa.int32()), "grew": pa.array([], pa.int32())} | {
        c: pa.array([], pa.binary()) for c in ("cells", "grown", "total", "empty", "to", "sizes", "xs")})
    rows = state.mapInArrow(sent, "to int, p int, at binary, rows binary")
    met = blocks.groupBy("block").cogroup(rows.groupBy("to")).applyInArrow(united, "q int, at binary, rows binary")
    return _materialize(state.groupBy("p").cogroup(met.groupBy("q")).applyInArrow(raised, STATE))


def _added(past: DataFrame | None, state: DataFrame, hops: int, done: int) -> DataFrame:
    """Sums (p, hops, total, empty) of the slices so far and the first ``hops`` of the ``done`` of the state; a run's last hop holds for
    all that follow."""
    own = state.select("p", "total", "empty")

    def table(p: int, total: np.ndarray, free: np.ndarray) -> pa.Table:
        return pa.Table.from_batches([_batch(p=p, hops=len(total), total=_bytes(total, np.float32), empty=_bytes(free, np.uint16))])

    def of(row: pa.Table, n_hops: int):
        return (_array(row[c][0], k).reshape(n_hops, -1) for c, k in (("total", np.float32), ("empty", np.uint16)))

    def longer(a: np.ndarray, to: int) -> np.ndarray:
        return np.concatenate([a, np.repeat(a[-1:], to - len(a), axis=0)])

    def first(rows: pa.Table) -> pa.Table:
        total, free = of(rows, done)
        return table(rows["p"][0].as_py(), total[:hops], free[:hops])

    def both(before: pa.Table, rows: pa.Table) -> pa.Table:
        total, free = (a[:hops] for a in of(rows, done))
        t, f = of(before, before["hops"][0].as_py())
        most = max(len(t), hops)
        return table(rows["p"][0].as_py(), longer(t, most) + longer(total, most), longer(f, most) + longer(free, most))

    fields = "p int, hops int, total binary, empty binary"
    if past is None:
        return _materialize(own.groupBy("p").applyInArrow(first, fields))
    return _materialize(past.groupBy("p").cogroup(own.groupBy("p")).applyInArrow(both, fields))


def neighbourhood(edges: DataFrame, lg_k: int, max_hops: int, n: int, n_edges: int) -> list[tuple[int, float]]:
    """(hops, pairs) as :func:`.graph.neighbourhood` gives them, of ``n`` vertices."""
    spark, m = edges.sparkSession, 1 << lg_k
    kind = np.int32 if -(-n // PART) < 1 << (31 - BITS) else np.int64
    width = m
    while width > 1 and n * width > max(LEAST, 16 * n_edges):
        width //= 2
    numbers, own = _numbered(edges, lg_k, n)
    blocks = _blocks(edges, numbers, max(1, SIDE_BYTES // width), kind)
    own = _routed(blocks, own, kind)
    _clean(spark)
    past = None
    for lo in range(0, m, width):
        state, done, hops = _started(own, lo, width), 1, 1
        while hops == done:  # the state of a hop without growth is that of the hop before
            if done > max_hops:
                warnings.warn(f"neighbourhood: still growing after {max_hops} hops")
                break
            state, done = _hop(state, blocks, width, kind), done + 1
            _clean(spark)
            hops += bool(state.agg(F.sum("grew")).first()[0])
        past = _added(past, state, hops, done)

    def counted(batches):
        for r in _rows(batches):
            total, free = (_array(r[c], k).reshape(r["hops"], -1) for c, k in (("total", np.float32), ("empty", np.uint16)))
            pairs = [float(np.maximum(estimate(t.astype(float), f.astype(float), m) - 1, 0).sum()) for t, f in zip(total, free)]
            yield pa.RecordBatch.from_pydict({"h": pa.array(np.arange(len(pairs)), pa.int32()), "pairs": pa.array(pairs)})

    got = {r["h"]: r["pairs"] for r in past.mapInArrow(counted, "h int, pairs double").groupBy("h").agg(F.sum("pairs").alias("pairs")).collect()}
    return [(h, got[h] if h else 0.0) for h in sorted(got)]
