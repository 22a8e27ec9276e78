"""Multi-dimensional matrix profiles, dealt over tasks by blocks of windows.

A tile is all pairs of windows of two blocks of one series; a block has a bounded number of windows, so a task's memory does not grow with the series. All
pairs are looked at, as the exact profile must, but most only by a lower bound of their distances in whole steps of one byte: pairs that it can't rule
out for any number of dimensions are worked out in full. Blocks are first compared with themselves, and what that gives is the bound from which the
tiles of two blocks start. Each distance hangs on its two windows alone, not on where a tile begins, so tiles of any size give the same."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rutine.operators.scans import numbered
from rutine.plans.shipping import ship
from rutine.plans.tables import written

#: Numbers of a window, over all windows of a block, in each dimension.
BLOCK = 1 << 16
#: Windows of one row of a result that is merged.
PLACES = 1 << 10
#: Pairs that are looked at together, and that wait to be worked out together.
HIGH, WIDE, WAIT = 64, 128, 2048
#: Diagonals next to the exclusion zone that give the first bounds.
FIRST = 16
#: The most tasks of one step.
PARTS = 1 << 12


def block_size(m: int) -> int:
    """Windows of a block."""
    return max(256, BLOCK // (m + 2))


class Windows:
    """z-normalised windows of length m of x (places, dimensions); the first has the number `start`. A flat window is 0 from a flat one and sqrt(m) from any other."""

    def __init__(self, x: np.ndarray, m: int, start: int = 0):
        self.m, self.start, self.n = m, start, max(0, len(x) - m + 1)
        at = [x[t : t + self.n] for t in range(m)]
        mean = sum(at) / m
        sd = np.sqrt(sum((a - mean) ** 2 for a in at) / m)
        self.flat = sd < 1e-10
        sd[self.flat] = 1
        self.z = np.stack([(a - mean) / sd for a in at])

    def distances(self, i: np.ndarray, other: Windows, j: np.ndarray) -> np.ndarray:
        """(pairs, dimensions) of windows i of these and j of others."""
        total = (self.z[0][i] - other.z[0][j]) ** 2
        for t in range(1, self.m):
            total += (self.z[t][i] - other.z[t][j]) ** 2
        f, g = self.flat[i], other.flat[j]
        return np.where(f & g, 0.0, np.where(f | g, math.sqrt(self.m), np.sqrt(total)))

    def factors(self, left: bool, scale: float) -> np.ndarray:
        """(dimensions, windows, m + 3) whose products of left and right ones are squared distances times scale; 0 for what isn't a number."""
        g = self.flat.astype(float)
        z = np.where(self.flat, 0.0, self.z) / math.sqrt(self.m)
        more = [-g, (g - 1) / 2, np.ones_like(g)] if left else [g + (1 - g) / 2, g, np.ones_like(g)]
        out = np.concatenate([-z if left else z, more]) * (2 * self.m * scale if left else 1)
        out = np.where(np.isfinite(out).all(axis=0), out, 0.0)
        return np.ascontiguousarray(out.transpose(2, 1, 0), np.float32)


class Best:
    """The least means p over each number of dimensions (windows, dimensions) and the windows `at` that give them; of equal ones the nearest in place, then that on the right."""

    def __init__(self, p: np.ndarray, start: int, step: float):
        self.p, self.at, self.start, self.step = p, np.full(p.shape, -1, np.int64), start, step
        self.limit = np.empty((p.shape[1], len(p)), np.uint32 if p.shape[1] > 256 else np.uint16)
        self._bound(np.arange(len(p)))

    def _bound(self, rows: np.ndarray) -> None:
        most = np.iinfo(self.limit.dtype).max
        self.limit[:, rows] = np.minimum(self.p[rows] * np.arange(1, self.p.shape[1] + 1) * (self.step * (1 + 1e-9)), most).T

    def offer(self, rows: np.ndarray, means: np.ndarray, others: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        sorted_ = rows[order]
        first = np.flatnonzero(np.diff(sorted_, prepend=-1))
        turn = np.arange(len(rows)) - np.repeat(first, np.diff(first, append=len(rows)))
        for t in range(int(turn.max(initial=-1)) + 1):  # each row once
            some = order[turn == t]
            r, v, o = rows[some], means[some], others[some, None]
            p, at = self.p[r], self.at[r]
            less = (v < p) | ((v == p) & (places(o, r[:, None] + self.start) < places(at, r[:, None] + self.start)))
            self.p[r], self.at[r] = np.where(less, v, p), np.where(less, o, at)
        self._bound(sorted_[first])


def places(at: np.ndarray, i: np.ndarray) -> np.ndarray:
    """How equal neighbours are ordered; none is the last."""
    return np.where(at < 0, np.iinfo(np.int64).max, 2 * np.abs(at - i) + (at < i))


def _in_order(a: np.ndarray, b: np.ndarray, dims: int) -> np.ndarray:
    """Columns of a (power of two, many) in order, by a bitonic network; b is another of that shape. Both are overwritten."""
    size, k = len(a), 2
    while k <= size:
        j = k // 2
        while j:
            v, w = a.reshape(size // (2 * j), 2, j, -1), b.reshape(size // (2 * j), 2, j, -1)
            far = v[:, 1, ::-1] if 2 * j == k else v[:, 1]
            np.minimum(v[:, 0], far, out=w[:, 0])
            np.maximum(v[:, 0], far, out=w[:, 1, ::-1] if 2 * j == k else w[:, 1])
            a, b, j = b, a, j // 2
        k *= 2
    return a[:dims]


def _looked_at(a: Windows, b: Windows, best_a: Best, best_b: Best, step: float, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of windows of a and b, at least `least` places apart, that may be better for either."""
    dims = best_a.p.shape[1]
    size = 1 << (dims - 1).bit_length()
    left, right = a.factors(True, step * step), b.factors(False, step * step)
    slack = np.float32(2 * a.m * step * step * (a.m + 6) * 2.0**-21)
    for x in range(0, a.n, HIGH):
        high = min(HIGH, a.n - x)
        for y in range(0, b.n, WIDE):
            wide = min(WIDE, b.n - y)
            if b.start + y + wide - 1 - a.start - x < least:
                continue
            squared = np.matmul(left[:, x : x + high], right[:, y : y + wide].transpose(0, 2, 1))
            squared -= slack
            np.maximum(squared, 0, out=squared)
            np.sqrt(squared, out=squared)
            steps = np.full((size, high * wide), 255, np.uint8)
            steps[:dims] = squared.reshape(dims, -1)
            low = _in_order(steps, np.empty_like(steps), dims).astype(best_a.limit.dtype)
            for d in range(1, dims):
                np.add(low[d - 1], low[d], out=low[d])
            limit = np.maximum(best_a.limit[:, x : x + high, None], best_b.limit[:, None, y : y + wide])
            i, j = np.nonzero(np.logical_or.reduce(low.reshape(limit.shape) <= limit, axis=0))
            far = b.start + y + j - a.start - x - i >= least
            yield x + i[far], y + j[far]


def tile(a: Windows, b: Windows, p: np.ndarray | None, q: np.ndarray | None, zone: int) -> tuple[Best, Best]:
    """The best neighbours of windows of a among those of b, which come later, and of b among a; p and q are bounds known. With b = a, p and q are null."""
    dims, step = a.z.shape[2], 254 / math.sqrt(4 * a.m)
    best_a = Best(np.full((a.n, dims), np.inf) if p is None else p, a.start, step)
    best_b = best_a if b is a else Best(q, b.start, step)
    counts = np.arange(1, dims + 1)

    def settle(i: np.ndarray, j: np.ndarray) -> None:
        means = np.cumsum(np.sort(a.distances(i, b, j), axis=1), axis=1) / counts
        best_a.offer(i, means, j + b.start)
        best_b.offer(j, means, i + a.start)

    least = zone + 1
    if b is a:
        for d in range(least, min(a.n, least + FIRST)):
            settle(np.arange(a.n - d), np.arange(d, a.n))
        least += FIRST
    waiting, many = [], 0
    for i, j in _looked_at(a, b, best_a, best_b, step, least):
        waiting.append((i, j))
        many += len(i)
        if many >= WAIT:
            settle(*map(np.concatenate, zip(*waiting, strict=True)))
            waiting, many = [], 0
    if many:
        settle(*map(np.concatenate, zip(*waiting, strict=True)))
    return best_a, best_b


def _array(list_) -> np.ndarray:
    """An Arrow list of lists of numbers, all of one size, as an array."""
    inner = list_.values
    flat = inner.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(inner), -1)


def in_blocks(rows: DataFrame, m: int, size: int) -> DataFrame:
    """(log_id, block, x): places of the windows of each block of rows (log_id, at, v), in order."""
    first = F.greatest(F.lit(0), F.floor((F.col("at") - m + 1) / size))
    dealt = rows.select("log_id", "at", "v", F.explode(F.sequence(first.cast("int"), F.floor(F.col("at") / size).cast("int"))).alias("block"))
    x = F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda r: r["v"])
    return dealt.groupBy("log_id", "block").agg(x.alias("x")).where(F.size("x") >= m)


def _parts(df: DataFrame) -> int:
    return min(PARTS, max(1, df.count()))


def profile(blocks: DataFrame, m: int, zone: int, size: int) -> DataFrame:
    """(log_id, i, distances, neighbours) of blocks as in_blocks() gives them, a written table; an entry for each number of dimensions."""
    ship(blocks.sparkSession)
    kind = blocks.schema["log_id"].dataType.simpleString()
    pieces = f"log_id {kind}, block int, p binary, at binary, dims int"
    schema = f"log_id {kind}, i long, distances array<double>, neighbours array<long>"
    names = ["log_id", "block", "p", "at", "dims"]

    def piece(id_, block: int, best: Best) -> pa.RecordBatch:
        p = np.where(best.at < 0, np.inf, best.p)
        return pa.RecordBatch.from_arrays([pa.array([id_.as_py()], id_.type), pa.array([block], pa.int32()), pa.array([p.tobytes()], pa.binary()), pa.array([best.at.tobytes()], pa.binary()), pa.array([p.shape[1]], pa.int32())], names=names)

    def alone(batches):
        for b in batches:
            for r in range(b.num_rows):
                block = b.column(1)[r].as_py()
                w = Windows(_array(b.column(2)[r]), m, block * size)
                yield piece(b.column(0)[r], block, tile(w, w, None, None, zone)[0])

    own = written(blocks.select("log_id", "block", "x").repartition(_parts(blocks), "log_id", "block").mapInArrow(alone, pieces), "own")

    def together(group: pa.Table) -> pa.Table:
        rows = sorted(range(2), key=lambda r: group.column("block")[r].as_py())
        w = [Windows(_array(group.column("x")[r]), m, group.column("block")[r].as_py() * size) for r in rows]
        known = [np.frombuffer(group.column("p")[r].as_py(), float).reshape(x.n, -1).copy() for r, x in zip(rows, w, strict=True)]
        found = tile(*w, *known, zone)
        return pa.Table.from_batches([piece(group.column("log_id")[r], group.column("block")[r].as_py(), f) for r, f in zip(rows, found, strict=True)])

    def cut(batches):
        for b in batches:
            for r in range(b.num_rows):
                p, at = (memoryview(b.column(c)[r].as_buffer()) for c in (2, 3))
                wide = PLACES * b.column(4)[r].as_py() * 8
                for s, a in enumerate(range(0, len(p), wide)):
                    columns = [b.column(0).slice(r, 1), b.column(1).slice(r, 1), pa.array([s], pa.int32()), *(pa.array([bytes(y[a : a + wide])], pa.binary()) for y in (p, at)), b.column(4).slice(r, 1)]
                    yield pa.RecordBatch.from_arrays(columns, names=["log_id", "block", "slice", "p", "at", "dims"])

    def merge(group: pa.Table) -> pa.Table:
        dims = group.column("dims")[0].as_py()
        first = group.column("block")[0].as_py() * size + group.column("slice")[0].as_py() * PLACES
        p = at = i = None
        for x, y in zip(group.column("p"), group.column("at"), strict=True):
            d, o = np.frombuffer(x.as_buffer(), float).reshape(-1, dims), np.frombuffer(y.as_buffer(), np.int64).reshape(-1, dims)
            if p is None:
                p, at, i = d, o, first + np.arange(len(d))
                continue
            less = (d < p) | ((d == p) & (places(o, i[:, None]) < places(at, i[:, None])))
            p, at = np.where(less, d, p), np.where(less, o, at)
        ends = pa.array(np.arange(len(p) + 1) * dims, pa.int32())
        id_ = group.column("log_id")[0]
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (p, at)]
        return pa.table({"log_id": pa.array([id_.as_py()] * len(p), id_.type), "i": pa.array(i), "distances": lists[0], "neighbours": lists[1]})

    found = own
    last = own.groupBy("log_id").agg(F.max("block").alias("last")).where("last > 0").withColumnRenamed("log_id", "_log")
    if not last.isEmpty():
        known = own.select("log_id", "block", "p").withColumnsRenamed({"log_id": "_own", "block": "_block"})
        sent = blocks.join(known, blocks["log_id"].eqNullSafe(known["_own"]) & (blocks["block"] == known["_block"])).join(last, F.col("log_id").eqNullSafe(F.col("_log")))
        sent = sent.select("log_id", "block", "x", "p", F.explode(F.sequence(F.lit(0), "last")).alias("other")).where("other <> block")
        sent = sent.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
        tiles = last.agg(F.sum(F.col("last").cast("long") * (F.col("last") + 1) / 2)).first()[0]
        sent = sent.select("log_id", "one", "two", "block", "x", "p").repartition(int(min(PARTS, tiles)), "log_id", "one", "two")
        found = own.unionByName(written(sent.groupBy("log_id", "one", "two").applyInArrow(together, pieces), "tiles"))
    slices = found.mapInArrow(cut, f"log_id {kind}, block int, slice int, p binary, at binary, dims int")
    return written(slices.groupBy("log_id", "block", "slice").applyInArrow(merge, schema), "profile")


def series(log: DataFrame, vector: str) -> DataFrame:
    """(log_id, at, v): vectors by place."""
    rows = log.select("log_id", "event_index", F.col(vector).cast("array<double>").alias("v"))
    return numbered(rows, ["log_id"], ["event_index"], "at").select("log_id", "at", "v")


def _to_window(x: Windows, i: Windows, dims: list[int]) -> np.ndarray:
    """Mean distances over some dimensions, added up in their order, of the windows of x to the one of i."""
    each = x.distances(np.arange(x.n), i, np.zeros(x.n, np.int64))
    total = np.zeros(x.n)
    for d in dims:
        total += each[:, d]
    return total / len(dims)


def motifs_of(found: DataFrame, rows: DataFrame, blocks: DataFrame, m: int, most: int, zone: int, size: int) -> DataFrame:
    """(log_id, dimensions, i, j, distance, subspace, matches) of a profile; rows and blocks are those that it was made of.

    Each block tells of the windows that may be matches: no more than `most` times as many as a zone holds, since each match hides no more."""
    kind = blocks.schema["log_id"].dataType.simpleString()
    each = found.select("log_id", "i", F.posexplode(F.arrays_zip("distances", "neighbours"))).where("col.neighbours >= 0")
    best = each.groupBy("log_id", "pos").agg(F.min(F.struct("col.distances", "i", "col.neighbours")).alias("b"), F.avg("col.distances").alias("mean"), F.stddev_pop("col.distances").alias("sd"))
    best = written(best.select("log_id", (F.col("pos") + 1).alias("dimensions"), F.col("b.i").alias("i"), F.col("b.neighbours").alias("j"), F.col("b.distances").alias("distance"), (F.col("mean") - 2 * F.col("sd")).alias("least")), "best")
    places_ = best.select("log_id", "dimensions", "i", "j", "distance", "least", F.posexplode(F.concat(F.sequence("i", F.col("i") + m - 1), F.sequence("j", F.col("j") + m - 1))).alias("t", "place"))
    there = rows.withColumnRenamed("log_id", "_log")
    pairs = places_.join(there, places_["log_id"].eqNullSafe(there["_log"]) & (F.col("place") == F.col("at")))
    pairs = pairs.groupBy("log_id", "dimensions", "i", "j", "distance", "least").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda r: r["v"]).alias("pair"))
    asked = pairs.groupBy("log_id").agg(F.collect_list(F.struct("dimensions", "i", "j", "distance", "least", "pair")).alias("asked")).withColumnRenamed("log_id", "_log")
    last = blocks.groupBy("log_id").agg(F.max("block").alias("last")).withColumnRenamed("log_id", "_log2")
    asked = asked.join(last, asked["_log"].eqNullSafe(last["_log2"])).select("_log", "asked", F.explode(F.sequence(F.lit(0), "last")).alias("_block"))
    work = blocks.join(asked, blocks["log_id"].eqNullSafe(asked["_log"]) & (blocks["block"] == asked["_block"])).select("log_id", "block", "x", "asked").repartition(_parts(blocks), "log_id", "block")
    near = f"log_id {kind}, dimensions int, i long, j long, distance double, subspace array<int>, w array<long>, near array<double>"

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = Windows(_array(b.column(2)[r]), m, b.column(1)[r].as_py() * size)
                out = []
                for q in b.column(3)[r].as_py():
                    i, j = (Windows(np.array(y, float), m) for y in (q["pair"][:m], q["pair"][m:]))
                    one = np.zeros(1, np.int64)
                    space = np.sort(np.argsort(i.distances(one, j, one)[0], kind="stable")[: q["dimensions"]]).tolist()
                    limit = max(q["least"], float(_to_window(j, i, space)[0]))
                    d = _to_window(x, i, space)
                    some = np.argsort(d, kind="stable")[: most * (2 * zone + 1)]
                    some = some[d[some] <= limit]
                    if len(some):
                        out.append((q["dimensions"], q["i"], q["j"], q["distance"], space, (some + x.start).tolist(), d[some].tolist()))
                if out:
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()))
                    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r] * len(out))), *columns], names=["log_id", "dimensions", "i", "j", "distance", "subspace", "w", "near"])

    def chosen(group: pa.Table) -> pa.Table:
        i = group.column("i")[0].as_py()
        w, d = (np.concatenate([x.values.to_numpy() for x in group.column(c)]) for c in ("w", "near"))
        taken = [i]
        for x in w[np.lexsort((w, d))].tolist():
            if len(taken) < most and all(abs(x - y) > zone for y in taken):
                taken.append(x)
        return group.slice(0, 1).drop_columns(["w", "near"]).append_column("matches", pa.array([taken], pa.list_(pa.int64())))

    told = work.mapInArrow(run, near)
    return told.groupBy("log_id", "dimensions").applyInArrow(chosen, near.replace("w array<long>, near array<double>", "matches array<long>"))
