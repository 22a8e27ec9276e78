"""Matrix profiles whose diagonals are dealt over tasks.

A profile of one series is a minimum over diagonals. Bands of diagonals of about equal work are rows; each gives, for each window, the nearest
neighbours that it has seen, and these are merged: of both the nearer ones, of equal ones those on the diagonal that a whole run would have
come to first. The merge is associative, so any number of bands gives the same. A short series has one band and needs no merge."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rutine.plans.shipping import ship
from rutine.plans.tables import written

#: Pairs of windows for each band, at least, and the most bands of one profile: longer series have longer bands.
BAND, BANDS = 1 << 25, 1024
#: Windows that are merged at once.
PLACES = 1 << 12
#: Rows, about, of one batch of whole profiles.
ROWS = 1 << 16


def spans(work: np.ndarray, bands: int) -> list[tuple[int, int]]:
    """Ranges (from, to) of diagonals, numbered from 0, of about equal work."""
    done = np.concatenate([[0], np.cumsum(work, dtype=np.float64)])
    cuts = np.searchsorted(done, np.linspace(0, done[-1], bands + 1)[1:-1])
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(work)], strict=True))


def _order(at: np.ndarray, i: np.ndarray, alone: bool) -> np.ndarray:
    """When a run over all diagonals comes to a neighbour; never (the largest number) to none."""
    offset = at - i
    rank = 2 * np.abs(offset) + (offset < 0) if alone else offset
    return np.where(at < 0, np.iinfo(np.int64).max, rank)


def _merged(d: np.ndarray, at: np.ndarray, i: np.ndarray, k: int, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((_order(at, i[:, None], alone), d), axis=-1)[:, :k]
    return np.take_along_axis(d, order, axis=1), np.take_along_axis(at, order, axis=1)


def _lists(x: np.ndarray, k: int, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(x.ravel(), kind))


def _batch(ids: list, kind: pa.DataType, found: list) -> pa.RecordBatch:
    """Rows of whole profiles found = [(m, k, distances, neighbours, nearest on the left and right)], one for each of ids; k is the same in all."""
    counts, k = [len(f[2]) for f in found], found[0][1]
    d, at, beside = (np.concatenate([f[c] for f in found]) for c in (2, 3, 4))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, kind).take(pa.array(np.repeat(np.arange(len(ids)), counts))), pa.array(np.repeat(np.array([f[0] for f in found], np.int32), counts)), pa.array(np.concatenate([np.arange(n) for n in counts]), pa.int64()),
         _lists(d, k, pa.float64()), _lists(at, k, pa.int64()), pa.array(np.ascontiguousarray(beside[:, 0])), pa.array(np.ascontiguousarray(beside[:, 1]))],
        names=["log_id", "m", "i", "distances", "neighbours", "left", "right"],
    )


def banded(work: DataFrame, parts: tuple[Callable, Callable], least: int = BAND, most: int = BANDS) -> DataFrame:
    """(log_id, m, i, distances, neighbours, left, right) of profiles, one for each row of work (log_id, m, k, pairs, alone, ...) and each of the lengths in its array m.

    pairs is about how many pairs of windows there are; alone says that a series is compared with itself. parts are (part, whole). A row of at most `least` pairs is settled where it lies: whole(row) gives for each
    length what part() gives, and nothing is merged. part(row, band, bands) gives distances and neighbours (windows, k) over a band of the
    row's diagonals, and the nearest distance and neighbour on the left and on the right (windows, 2); the row travels to each of its bands."""
    part, whole = parts
    ship(work.sparkSession)
    kind = work.schema["log_id"].dataType.simpleString()
    bands = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("pairs") / least))).cast("int")
    work = written(work.withColumn("bands", bands), "work")
    id_type = pa.from_numpy_dtype(np.int64)
    schema = f"log_id {kind}, m int, i long, distances array<double>, neighbours array<long>, left long, right long"

    def run_whole(batches):
        for b in batches:
            ids, found, rows = [], [], 0
            for r in range(b.num_rows):
                row = {c: b.column(x)[r] for x, c in enumerate(b.schema.names)}
                for m, (d, at, _, beside) in whole(row):
                    if len(d):
                        ids.append(row["log_id"].as_py())
                        found.append((m, row["k"].as_py(), d, at, beside))
                        rows += len(d)
                if rows >= ROWS:
                    yield _batch(ids, b.schema.field("log_id").type, found)
                    ids, found, rows = [], [], 0
            if found:
                yield _batch(ids, b.schema.field("log_id").type, found)

    settled = work.where("bands = 1").repartition("log_id").mapInArrow(run_whole, schema)
    many = work.where("bands > 1")
    if many.isEmpty():
        return settled

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(x)[r].as_py() for x, c in enumerate(b.schema.names)}
                d, at, near, beside = part(row, row["band"], row["bands"])
                for a in range(0, len(d), PLACES):
                    z = slice(a, a + PLACES)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["log_id"]], b.schema.field("log_id").type), pa.array([row["m"]], pa.int32()), pa.array([row["k"]], pa.int32()), pa.array([row["alone"]], pa.bool_()),
                         pa.array([a // PLACES], pa.int32()), *(pa.array([np.ascontiguousarray(x[z]).tobytes()], pa.binary()) for x in (d, at, near, beside))],
                        names=["log_id", "m", "k", "alone", "block", "d", "at", "near", "beside"],
                    )

    def merge(group: pa.Table) -> pa.Table:
        k, alone = group.column("k")[0].as_py(), group.column("alone")[0].as_py()
        arrays = {c: [np.frombuffer(x, kind_).reshape(-1, w) for x in group.column(c).to_pylist()] for c, kind_, w in (("d", float, k), ("at", np.int64, k), ("near", float, 2), ("beside", np.int64, 2))}
        n = len(arrays["d"][0])
        i = np.arange(n) + group.column("block")[0].as_py() * PLACES
        d, at = _merged(np.concatenate(arrays["d"], axis=1), np.concatenate(arrays["at"], axis=1), i, k, alone)
        sides = [_merged(np.stack([x[:, s] for x in arrays["near"]], axis=1), np.stack([x[:, s] for x in arrays["beside"]], axis=1), i, 1, alone)[1][:, 0] for s in (0, 1)]
        return pa.table(
            {"log_id": pa.array([group.column("log_id")[0].as_py()] * n, group.schema.field("log_id").type), "m": pa.array([group.column("m")[0].as_py()] * n, pa.int32()), "i": pa.array(i, id_type),
             "distances": _lists(d, k, pa.float64()), "neighbours": _lists(at, k, pa.int64()), "left": pa.array(sides[0], id_type), "right": pa.array(sides[1], id_type)}
        )

    dealt = many.withColumn("m", F.explode("m")).withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1))).repartition("log_id", "m", "band")
    told = dealt.mapInArrow(run, f"log_id {kind}, m int, k int, alone boolean, block int, d binary, at binary, near binary, beside binary")
    return settled.unionByName(told.groupBy("log_id", "m", "block").applyInArrow(merge, schema))


def in_order(log: DataFrame, column: str, name: str) -> DataFrame:
    """(log_id, name): a column of each log as an array, in order of event_index."""
    rows = F.array_sort(F.collect_list(F.struct("event_index", F.col(column).alias("_x"))))
    return log.groupBy("log_id").agg(F.transform(rows, lambda x: x["_x"]).alias(name))


def pairs_of(a: Column, b: Column, m: Column) -> Column:
    """Pairs of windows of length m of two series of so many places."""
    return F.greatest(F.lit(0), a - m + 1).cast("double") * F.greatest(F.lit(0), b - m + 1)
