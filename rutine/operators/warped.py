"""Local alignment of a series with itself, by square tiles: similar stretches as warping paths.

Rows and columns are places of one series. A cell's worth is its similarity added to the best of three cells before it, (1,1), (1,2) or (2,1)
back, and nothing where that isn't above zero. Tiles are worked out in waves along the anti-diagonals: a tile needs the last two rows and columns of the tiles above and
to the left. A second row of waves, back from the end, tells each cell the best cell that it leads to, its head, by the first two rows and
columns of the tiles below and to the right. Cells of one head are one path: cells that other paths share stay with the better one. So a path that runs through
many tiles comes together by its head, and no task holds more than one tile."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rutine.operators.scans import numbered
from rutine.plans.shipping import ship
from rutine.plans.tables import drop, together, written

#: Places in the side of a tile.
TILE = 1024
#: Digits to which similarities are rounded before they are compared, so that machines agree, and classes of values in a quantile's first pass.
DIGITS, CLASSES = 10, 1 << 16
#: What a place loses that is not similar enough.
LOSS = -0.5


def tidy(x: float) -> float:
    """x to ten significant digits: sums may differ in their last ones by the order of adding."""
    return float(f"{x:.10g}")


def scale_of(deviation: float, dims: int) -> float:
    """What squared distances are multiplied by, for a series of vectors whose components deviate so much."""
    width = max(tidy(deviation), 1e-12) * math.sqrt(dims)
    return tidy(-1 / (2 * width * width))


def likeness(rows: np.ndarray, cols: np.ndarray, scale: float) -> np.ndarray:
    """Rounded Gaussian similarities of all vectors of rows to all of cols; equal vectors are worked out once."""
    (a, at_a), (b, at_b) = (np.unique(x, axis=0, return_inverse=True) for x in (rows, cols))
    if 4 * len(a) * len(b) < len(rows) * len(cols):
        return likeness(a, b, scale)[at_a.ravel()][:, at_b.ravel()]
    out = np.zeros((len(rows), len(cols)))
    for k in range(rows.shape[1]):
        d = rows[:, k, None] - cols[None, :, k]
        d *= d
        out += d
    out *= scale
    return np.round(np.exp(out, out=out), DIGITS)


def aligned(sim, rows: int, cols: int, i0: int, j0: int, low: int, tau: float, before: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(worths behind two rows and two columns of what lies before, steps back) of the tile at (i0, j0); sim(r) are a row's similarities.

    Only cells `low` places or more off the diagonal count. Of equal ways in, the last of the steps (1,1), (1,2), (2,1) counts."""
    w, back = np.zeros((rows + 2, cols + 2)), np.zeros((rows, cols), np.int8)
    if before is not None:
        above, left, corner = before
        w[:2, 2:], w[2:, :2], w[:2, :2] = above, left, corner
    for r in range(rows):
        c = max(0, i0 + r + low - j0)
        if c >= cols:
            break
        s = sim(r)[c:]
        way, worth = np.ones(len(s), np.int8), w[r + 1, c + 1 : cols + 1]
        for k, other in ((2, w[r + 1, c:cols]), (3, w[r, c + 1 : cols + 1])):
            better = other >= worth
            worth, way = np.where(better, other, worth), np.where(better, np.int8(k), way)
        new = worth + np.where(s >= tau, s, LOSS)
        on = new > 0
        w[r + 2, c + 2 :] = np.where(on, new, 0)
        back[r, c:] = np.where(on & (worth > 0), way, 0)
    return w, back


def headed(w: np.ndarray, back: np.ndarray, i0: int, j0: int, n: int, after: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(worth of each cell's head, its place i * n + j, steps back), with two rows and two columns of what lies behind the tile.

    Of heads of one worth the first counts; a cell without worth has none, -1."""
    rows, cols = back.shape
    best, head, way = np.zeros((rows + 2, cols + 2)), np.full((rows + 2, cols + 2), -1, np.int64), np.zeros((rows + 2, cols + 2), np.int8)
    way[:rows, :cols] = back
    if after is not None:
        for out, below, right, corner in zip((best, head, way), *after, strict=True):
            for part, at in ((below, (rows, 0)), (right, (0, cols)), (corner, (rows, cols))):
                if part is not None:
                    out[at[0] : at[0] + part.shape[0], at[1] : at[1] + part.shape[1]] = part
    for r in range(rows - 1, -1, -1):
        b = w[r + 2, 2:].copy()
        h = np.where(b > 0, (i0 + r) * np.int64(n) + j0 + np.arange(cols), -1)
        for k, dr, dc in ((1, 1, 1), (2, 1, 2), (3, 2, 1)):
            ob, oh = best[r + dr, dc : dc + cols], head[r + dr, dc : dc + cols]
            better = (way[r + dr, dc : dc + cols] == k) & ((ob > b) | ((ob == b) & (oh < h)))
            b, h = np.where(better, ob, b), np.where(better, oh, h)
        best[r, :cols], head[r, :cols] = b, h
    return best, head, way


def pieces(best: np.ndarray, head: np.ndarray, i0: int, j0: int, n: int, low: int) -> tuple[list[int], list[float], list[np.ndarray]]:
    """(heads, their worths, places of their cells in order) of the tile's cells; what is too short and can't go on in another tile is left out."""
    rows, cols = best.shape[0] - 2, best.shape[1] - 2
    r, c = np.nonzero(head[:rows, :cols] >= 0)
    if not len(r):
        return [], [], []
    heads, place = head[r, c], (i0 + r) * np.int64(n) + j0 + c
    order = np.lexsort((place, heads))
    r, c, heads, place = r[order], c[order], heads[order], place[order]
    starts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    edge = np.logical_or.reduceat((r < 2) | (c < 2) | (r >= rows - 2) | (c >= cols - 2), starts)
    ends = np.append(starts[1:], len(heads))
    kept = np.flatnonzero((ends - starts >= low) | (edge & bool(i0 or j0 or rows < n)))
    return heads[starts[kept]].tolist(), best[r, c][starts[kept]].tolist(), [place[starts[k] : ends[k]] for k in kept.tolist()]


def apart(paths: list[tuple[np.ndarray, np.ndarray]], low: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Paths (cells, similarities), best first, each cut where, from its head on, it comes within low // 2 places of a better one that stayed; those of fewer than low cells go."""
    half, out, grid = low // 2, [], {}
    side, n = half + 1, max((int(cells.max()) + 1 for cells, _ in paths), default=0)
    if n <= TILE:  # so few places that what is near is an array
        near, around = np.zeros((n, n), bool), np.arange(-half, half + 1)
        for cells, fits in paths:
            hits = np.flatnonzero(near[cells[:, 0], cells[:, 1]])
            start = int(hits[-1]) + 1 if len(hits) else 0
            if len(cells) - start >= low:
                out.append((cells[start:], fits[start:]))
                i, j = (np.clip(c[:, None] + around, 0, n - 1) for c in cells[start:].T)
                near[i[:, :, None], j[:, None, :]] = True
        return out
    for cells, fits in paths:
        start = 0
        for at in range(len(cells) - 1, -1, -1):
            i, j = int(cells[at, 0]), int(cells[at, 1])
            a, b = i // side, j // side
            if any(abs(i - x) <= half and abs(j - y) <= half for p in (a - 1, a, a + 1) for q in (b - 1, b, b + 1) for x, y in grid.get((p, q), ())):
                start = at + 1
                break
        if len(cells) - start >= low:
            out.append((cells[start:], fits[start:]))
            for i, j in cells[start:].tolist():
                grid.setdefault((i // side, j // side), []).append((i, j))
    return out


def paths_of(sim, n: int, low: int, tau: float, cell=None) -> list[tuple[np.ndarray, np.ndarray]]:
    """All paths of a series that is one tile, best first: (cells, similarities). cell(i, j), if given, are the similarities of many cells at once."""
    cell = cell or (lambda i, j: np.array([sim(a)[b] for a, b in zip(i.tolist(), j.tolist(), strict=True)]))
    w, back = aligned(sim, n, n, 0, 0, low, tau)
    best, head, _ = headed(w, back, 0, 0, n)
    return _settled(best, head, n, low, cell)


def _settled(best: np.ndarray, head: np.ndarray, n: int, low: int, cell) -> list[tuple[np.ndarray, np.ndarray]]:
    heads, worth, places = pieces(best, head, 0, 0, n, low)
    if not heads:
        return []
    places = [places[k] for k in np.lexsort((heads, -np.array(worth))).tolist()]
    at, ends = np.concatenate(places), np.cumsum([len(p) for p in places]).tolist()
    cells = np.stack([at // n, at % n], axis=1).astype(np.int32)
    fits = cell(cells[:, 0], cells[:, 1])
    return apart([(cells[a:b], fits[a:b]) for a, b in zip([0, *ends], ends, strict=False)], low)


def paths_of_several(sims: list[np.ndarray], low: list[int], tau: list[float]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """paths_of() of each of several short series, given by the similarities of all their places: a row is worked out for all of them at once.

    They are held as if each were as long as the longest."""
    size, first = np.array([len(s) for s in sims]), min(low)
    n = int(size.max())
    gain, place = np.full((len(sims), n, n), -np.inf), np.arange(n)  # what can't count is never above zero
    for s, own, lo, t in zip(sims, gain, low, tau, strict=True):
        own[: len(s), : len(s)] = np.where(place[: len(s)] >= place[: len(s), None] + lo, np.where(s >= t, s, LOSS), -np.inf)
    w, way = np.zeros((len(sims), n + 2, n + 2)), np.zeros((len(sims), n + 2, n + 2), np.int8)
    for r in range(n - first):
        c = r + first
        worth, step = w[:, r + 1, c + 1 : n + 1], np.int8(1)
        for k, other in ((2, w[:, r + 1, c:n]), (3, w[:, r, c + 1 : n + 1])):
            better = other >= worth
            worth, step = np.where(better, other, worth), np.where(better, np.int8(k), step)
        new = worth + gain[:, r, c:]
        on = new > 0
        w[:, r + 2, c + 2 :] = np.where(on, new, 0)
        way[:, r, c:n] = np.where(on & (worth > 0), step, 0)
    best, head = np.zeros((len(sims), n + 2, n + 2)), np.full((len(sims), n + 2, n + 2), -1, np.int64)
    for r in range(n - first - 1, -1, -1):
        c = r + first
        b = w[:, r + 2, c + 2 :].copy()
        h = np.where(b > 0, r * size[:, None] + place[c:], -1)
        for k, dr, dc in ((1, 1, 1), (2, 1, 2), (3, 2, 1)):
            ob, oh = best[:, r + dr, c + dc : n + dc], head[:, r + dr, c + dc : n + dc]
            better = (way[:, r + dr, c + dc : n + dc] == k) & ((ob > b) | ((ob == b) & (oh < h)))
            b, h = np.where(better, ob, b), np.where(better, oh, h)
        best[:, r, c:n], head[:, r, c:n] = b, h
    out = []
    for k, (s, lo) in enumerate(zip(sims, low, strict=True)):
        end = len(s) + 2
        out.append(_settled(best[k, :end, :end], head[k, :end, :end], len(s), lo, lambda i, j, s=s: s[i, j]))
    return out


# Long series: tiles as rows.


def _array(b: bytes | None, *shape: int, kind=np.float64) -> np.ndarray | None:
    return None if b is None else np.frombuffer(b, kind).reshape(shape)


def _blocks(rows: DataFrame, tile: int) -> DataFrame:
    """(log_id, block, x): the vectors of `tile` places each, as bytes."""
    kind = rows.schema["log_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.array(x, float).tobytes() for x in b.column(2).to_pylist()], pa.binary())], names=["log_id", "block", "x"])

    some = rows.groupBy("log_id", F.floor(F.col("at") / tile).cast("int").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("x"))
    return some.mapInArrow(run, f"log_id {kind}, block int, x binary")


def _each(tiles: DataFrame, answer, schema: str, name: str, count: int) -> DataFrame:
    """A written table of what answer(row of a tile) gives, one task for each tile."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(i)[k].as_py() for i, c in enumerate(b.schema.names)}
                out = answer(row)
                if out:
                    yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in out], schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = to_arrow_schema(StructType.fromDDL(schema))
    names = shape.names
    return written(tiles.repartition(max(1, count), "log_id", "i", "j").mapInArrow(run, schema), name)


def _sides(row: dict, tile: int) -> tuple[np.ndarray, np.ndarray]:
    return _array(row["x"], -1, row["dims"]), _array(row["y"], -1, row["dims"])


def _taus(tiles: DataFrame, rho: float, kind: str, tile: int, count: int) -> DataFrame:
    """(log_id, tau): the interpolated rho-quantile of the similarities of all pairs of places, in two passes over tiles: classes of values, then the values of two classes."""

    def values(row):
        x, y = _sides(row, tile)
        s = likeness(x, y, row["scale"])
        return s[np.triu_indices(len(x), 1)] if row["i"] == row["j"] else s.ravel()

    def classes(row):
        n = np.bincount((values(row) * CLASSES).astype(np.int64), minlength=CLASSES + 1)
        return [{"log_id": row["log_id"], "class": int(c), "n": int(n[c])} for c in np.flatnonzero(n)]

    def exact(row):
        v = values(row)
        c = (v * CLASSES).astype(np.int64)
        v, n = np.unique(v[(c == row["low_class"]) | (c == row["high_class"])], return_counts=True)
        return [{"log_id": row["log_id"], "value": float(a), "n": int(b)} for a, b in zip(v, n, strict=True)]

    pairs = F.col("size") * (F.col("size") - 1) / 2
    want = tiles.select("log_id", F.floor(rho * (pairs - 1)).cast("long").alias("lo"), (rho * (pairs - 1)).alias("exactly"), pairs.cast("long").alias("pairs")).distinct()
    want = want.withColumns({"hi": F.least(F.col("lo") + 1, F.col("pairs") - 1), "part": F.col("exactly") - F.col("lo")})
    counted = _each(tiles, classes, f"log_id {kind}, class int, n long", "classes", count).groupBy("log_id", "class").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("log_id").orderBy("class")
    counted = counted.withColumn("upto", F.sum("n").over(upto)).join(want, "log_id")
    hit = lambda rank: (F.col(rank) < F.col("upto")) & (F.col(rank) >= F.col("upto") - F.col("n"))
    spots = counted.groupBy("log_id").agg(F.max(F.when(hit("lo"), F.col("class"))).alias("low_class"), F.max(F.when(hit("hi"), F.col("class"))).alias("high_class"), F.max(F.when(hit("lo"), F.col("upto") - F.col("n"))).alias("below"))
    spots = written(spots, "spots")
    found = _each(tiles.join(spots, "log_id"), exact, f"log_id {kind}, value double, n long", "values", count).groupBy("log_id", "value").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("log_id").orderBy("value")
    found = found.withColumn("upto", F.sum("n").over(upto)).join(spots, "log_id").withColumn("upto", F.col("upto") + F.col("below")).join(want, "log_id")
    ends = found.groupBy("log_id", "part").agg(F.max(F.when(hit("lo"), F.col("value"))).alias("a"), F.max(F.when(hit("hi"), F.col("value"))).alias("b"))
    return ends.select("log_id", F.round(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"), DIGITS).alias("tau"))


def long_paths(rows: DataFrame, low: DataFrame, rho: float, tile: int = TILE) -> DataFrame:
    """(log_id, head, worth, places, fits, size) of the paths, of low cells at least, of series rows (log_id, at, v), at from 0; low has (log_id, low), and
    a place is i * size + j. A task holds one tile; the number of jobs is four times the longest log's number of tiles in a side."""
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema["log_id"].dataType.simpleString()
    total = lambda f: F.aggregate("v", F.lit(0.0), f)
    means = rows.groupBy("log_id").agg(F.count("*").alias("size"), F.max(F.size("v")).alias("dims"), (F.sum(total(lambda a, x: a + x)) / F.sum(F.size("v"))).alias("mean"))
    spread = rows.join(means, "log_id").withColumn("_s", F.aggregate("v", F.struct(F.lit(0.0).alias("s"), F.col("mean").alias("m")), lambda a, x: F.struct((a["s"] + (x - a["m"]) * (x - a["m"])).alias("s"), a["m"].alias("m")))["s"])
    facts = spread.groupBy("log_id", "size", "dims").agg((F.sum("_s") / F.sum(F.size("v"))).alias("var")).join(low, "log_id")
    scales = [(r["log_id"], scale_of(math.sqrt(r["var"]), r["dims"])) for r in facts.select("log_id", "var", "dims").collect()]  # a row for each long log
    facts = written(facts.join(spark.createDataFrame(scales, f"log_id {kind}, scale double"), "log_id").drop("var"), "facts")
    blocks = written(_blocks(rows, tile), "blocks")
    x, y = blocks.select("log_id", F.col("block").alias("i"), "x"), blocks.select("log_id", F.col("block").alias("j"), F.col("x").alias("y"))
    sides = int(facts.agg(F.max(F.ceil(F.col("size") / tile))).first()[0])
    last = (F.ceil(F.col("size") / tile) - 1).cast("int")
    grid = facts.withColumn("i", F.explode(F.sequence(F.lit(0), last))).withColumn("j", F.explode(F.sequence("i", last)))
    grid = grid.withColumn("wave", F.col("i") + F.col("j"))
    tiles = written(grid.join(x, ["log_id", "i"]).join(y, ["log_id", "j"]), "tiles", "wave")  # each block is in as many tiles as a side has
    tau = written(_taus(tiles, rho, kind, tile, sides * (sides + 1) // 2), "taus")
    tiles = tiles.join(tau, "log_id")

    def forward(row):
        x, y = _sides(row, tile)
        at = (len(x), len(y), row["i"] * tile, row["j"] * tile)
        s = likeness(x, y, row["scale"])
        above, left, corner = _array(row["above"], 2, -1), _array(row["left"], -1, 2), _array(row["corner"], 2, -1)
        before = (0 if above is None else above, 0 if left is None else left, 0 if corner is None else corner[:, -2:])
        return at, s, aligned(lambda r: s[r], *at, row["low"], row["tau"], before)

    def edges(row):
        _, _, (w, _) = forward(row)
        return [{"log_id": row["log_id"], "i": row["i"], "j": row["j"], "bottom": w[-2:, 2:].tobytes(), "right": w[2:, -2:].tobytes()}]

    def heads(row):
        (n_rows, n_cols, i0, j0), s, (w, back) = forward(row)
        n, after = row["size"], [_side(row["below"], "top"), _side(row["beside"], "left"), _side(row["behind"], "top")]
        after[2] = tuple(a if a is None else a[:, :2] for a in after[2])
        told = headed(w, back, i0, j0, n, after)
        own = {"log_id": row["log_id"], "i": row["i"], "j": row["j"], "rows": n_rows, "cols": n_cols}
        for name, a in zip(PARTS, told, strict=True):
            a = a[:n_rows, :n_cols]
            own |= {f"{name}_top": a[:2].tobytes(), f"{name}_left": a[:, :2].tobytes()}
        found = zip(*pieces(told[0], told[1], i0, j0, n, row["low"]), strict=True)
        return [own, *({"log_id": row["log_id"], "path": h, "worth": v, "places": p.tolist(), "fits": s[p // n - i0, p % n - j0].tolist()} for h, v, p in found)]

    waves = lambda w: tiles.where(F.col("wave") == w)
    done: dict[int, DataFrame] = {}
    for w in range(2 * sides - 1):
        done[w] = _each(_before(waves(w), done, w), edges, f"log_id {kind}, i int, j int, bottom binary, right binary", "edges", w // 2 + 1)
    told = ", ".join(f"{name}_{side} binary" for name in PARTS for side in ("top", "left"))
    schema = f"log_id {kind}, i int, j int, rows int, cols int, {told}, path long, worth double, places array<long>, fits array<double>"
    behind: dict[int, DataFrame] = {}
    for w in range(2 * sides - 2, -1, -1):
        behind[w] = _each(_after(_before(waves(w), done, w), behind, w), heads, schema, "heads", w // 2 + 1)
    drop(*done.values())
    found = together(list(behind.values())).where("path IS NOT NULL").groupBy("log_id", F.col("path").alias("head"))
    found = found.agg(F.max("worth").alias("worth"), F.sort_array(F.collect_list(F.struct("places", "fits"))).alias("parts"))
    found = found.select("log_id", "head", "worth", F.flatten("parts.places").alias("places"), F.flatten("parts.fits").alias("fits"))
    return found.join(facts.select("log_id", "size", "low"), "log_id").where(F.size("places") >= F.col("low")).drop("low")


#: What a tile tells of its cells, and how.
PARTS, KINDS = ("best", "head", "way"), (np.float64, np.int64, np.int8)


def _side(raw: dict | None, side: str) -> tuple:
    """(worths, heads, steps) of the first two rows or columns of a tile."""
    if raw is None or raw["rows"] is None:
        return (None, None, None)
    shape = (min(2, raw["rows"]), raw["cols"]) if side == "top" else (raw["rows"], min(2, raw["cols"]))
    return tuple(_array(raw[f"{name}_{side}"], *shape, kind=kind) for name, kind in zip(PARTS, KINDS, strict=True))


def _at(df: DataFrame, di: int, dj: int, *columns) -> DataFrame:
    """What the tile at (i - di, j - dj) tells, by i and j."""
    return df.select("log_id", (F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), *columns)


def _before(now: DataFrame, done: dict[int, DataFrame], w: int) -> DataFrame:
    """Tiles of a wave with the edges of the tiles above, to the left and at the corner, null where there is none."""
    known = [done[k] for k in (w - 2, w - 1) if k in done]
    if not known:
        return now.withColumns({c: F.lit(None).cast("binary") for c in ("above", "left", "corner")})
    e = together(known)
    for df in (_at(e, 1, 0, F.col("bottom").alias("above")), _at(e, 0, 1, F.col("right").alias("left")), _at(e, 1, 1, F.col("bottom").alias("corner"))):
        now = now.join(df, ["log_id", "i", "j"], "left")
    return now


def _after(now: DataFrame, behind: dict[int, DataFrame], w: int) -> DataFrame:
    """Tiles of a wave with what the tiles below, beside and behind tell of their first rows and columns."""
    known = [behind[k] for k in (w + 1, w + 2) if k in behind]
    fields = ["rows", "cols", *(f"{name}_{side}" for name in PARTS for side in ("top", "left"))]
    if not known:
        kind = ", ".join(f"{f}: {'int' if f in ('rows', 'cols') else 'binary'}" for f in fields)
        return now.withColumns({c: F.lit(None).cast(f"struct<{kind}>") for c in ("below", "beside", "behind")})
    e = together(known).where("i IS NOT NULL")
    for c, di, dj in (("below", -1, 0), ("beside", 0, -1), ("behind", -1, -1)):
        now = now.join(_at(e, di, dj, F.struct(*fields).alias(c)), ["log_id", "i", "j"], "left")
    return now
