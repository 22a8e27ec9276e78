"""Substring dedup of word windows by prefix-partitioned suffix trees.

The suffixes that take part (see repeats.py) are counted by the first bits of the fingerprint of their first words. A prefix
with more suffixes than a task should hold is made longer until its parts are small enough, and neighbours that are small are put
together: every group fits into memory, however uneven the counts. The suffix tree of a group
is the sorted order of its suffixes with their common prefixes: an internal node of depth d is a maximal run of suffixes whose neighbours share
d words or more. Deep nodes, of the window's length less what the window has on the anchor's left, are its maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rutine.llm.common import table
from rutine.llm.repeats import RUN, Shape, as_text, common_prefixes, earlier, released, remove_repeats, sorted_run, squeezed

#: Suffixes of a group; a group has about 300 bytes for each.
GROUP = 60_000
#: Bits by which a prefix grows.
BITS = 10


def _routes(rows: bytes | np.ndarray, size: int) -> np.ndarray:
    rows = (np.frombuffer(rows, np.uint8) if isinstance(rows, bytes) else rows).reshape(-1, size)
    return np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)


def prefix_starts(runs: DataFrame, size: int, most: int, share: int) -> np.ndarray:
    """Where groups start in the order of routes: variable-length prefixes, each of at most `most` suffixes.

    With few suffixes in all, groups are so small that there are `share` of them. The driver holds counts of at most 2**BITS
    prefixes for each one that is too large, that is of the order of suffixes / most."""

    def counts(bits: int, within: set[int]) -> dict[int, int]:
        def run(batches):
            for b in batches:
                for rows in b.column(0).to_pylist():
                    cells = _routes(released(rows), size) >> np.uint64(64 - bits)
                    if bits > BITS:
                        cells = cells[np.isin(cells >> np.uint64(BITS), np.array(sorted(within), np.uint64))]
                    cell, n = np.unique(cells, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])

        got = runs.select("rows").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        return {r.cell: r.n for r in got}

    level, bits, starts = counts(BITS, set()), BITS, []
    most = max(1000, min(most, sum(level.values()) // max(1, share)))
    cells = []  # (start, count) of prefixes that are small enough
    while level:
        large = {c for c, n in level.items() if n > most and bits + BITS <= 60}
        cells += [(c << (64 - bits), n) for c, n in level.items() if c not in large]
        bits += BITS
        level = counts(bits, large) if large else {}
    held = most + 1
    for start, n in sorted(cells):
        if held + n > most:
            starts.append(start)
            held = 0
        held += n
    if starts:
        starts[0] = 0
    return np.array(starts, np.uint64)


def _split(shape: Shape):
    def split(runs: DataFrame) -> DataFrame:
        share = 2 * int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        starts = prefix_starts(runs, shape.row, GROUP, share)

        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    rows, docs = sorted_run(shape, r["rows"], r["docs"])
                    routes = _routes(rows, shape.row)
                    cut = np.append(np.searchsorted(routes, starts), len(rows))
                    some = np.flatnonzero(np.diff(cut)).tolist()
                    out = [(r["uid"], i, int(cut[i]), squeezed(docs[cut[i] : cut[i + 1]].tobytes()), squeezed(rows[cut[i] : cut[i + 1]].tobytes())) for i in some]
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["uid", "bucket", "at", "docs", "rows"])

        return runs.select("uid", "docs", "rows").mapInArrow(run, RUN)

    return split


def _resolve(shape: Shape):
    def resolve(group: pa.Table) -> pa.Table:
        parts = sorted(group.to_pylist(), key=lambda r: r["uid"])
        rows = np.concatenate([np.frombuffer(released(r["rows"]), np.uint8) for r in parts]).reshape(-1, shape.row)
        ids = [np.frombuffer(released(r["docs"]), "<i8") for r in parts]
        order = np.argsort(as_text(rows), kind="stable")
        rows, docs = rows[order], np.concatenate(ids)[order]
        left = rows[:, shape.head : shape.head + (shape.width - 1) * shape.unit]
        bits = np.empty(len(order), "<u4")
        bits[order] = earlier(shape, common_prefixes(rows[:, : shape.head]), left, rows[:, -3:-1], docs)
        start = np.cumsum([0, *map(len, ids)])
        return pa.table({"uid": pa.array([r["uid"] for r in parts], pa.int64()), "at": pa.array([r["at"] for r in parts], pa.int64()), "bits": pa.array([bits[a:b].tobytes() for a, b in zip(start, start[1:], strict=False)], pa.binary())})

    return resolve


def dedup_windows(docs: DataFrame, length: int = 13, gram: int = 5, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Remove each word covered by a window of `length` words that also starts in a document with a smaller id.

    Returns (id, n_words, n_removed, n_spans, kept), one row for each row of docs; kept is the words that are left, joined by blanks, or
    with digest the hex of its SHA-256. A word is a run of anything but blank and the controls tab to carriage return; words are
    compared by hashes of 64 bits, each of a window's. Windows are judged on the input and never cross documents. A null text has no words. Rows that repeat
    an id are one document to each other. A row with a null id neither removes nor loses anything."""
    shape = Shape(words=True, length=length, gram=gram)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = remove_repeats(rows, shape, _split(shape), _resolve(shape), digest)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), "kept")


def op8_prefix_trees(spark, sf_dir: str) -> DataFrame:
    out = dedup_windows(table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_sha256"))
