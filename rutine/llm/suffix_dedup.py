"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Tasks sort the suffixes of their documents into runs and front-code them: the length of the prefix that a suffix
shares with the one before, and the rest. Runs are cut by range and exchanged as they are; each range is merged
by a loser tree that keeps, for every waiting suffix, the length of its common prefix with the last one put out. Two suffixes are
compared by those lengths alone if they differ, and from that length on if they don't: no known
prefix is read again, and the merge leaves the common prefixes of neighbours, that is the LCP array, with no further work.

Which suffixes take part, and how the result follows from the LCP array, is told in repeats.py. Suffixes
are ordered by the fingerprint of their first gram and then by their bytes, so ranges are even without sampling; there are as many
as keep one, which a task merges in memory, near RANGE suffixes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rutine.llm.common import lean_batches, table
from rutine.llm.repeats import RUN, Shape, common_prefixes, earlier, released, remove_repeats, sorted_run, squeezed


#: Suffixes of a range, of some 150 bytes each.
RANGE = 400_000


def front_coded(heads: np.ndarray) -> tuple[bytes, bytes]:
    """(common prefix lengths, rests joined) of sorted rows of fewer than 256 bytes."""
    lcp = common_prefixes(heads)
    return lcp.astype(np.uint8).tobytes(), heads[np.arange(heads.shape[1]) >= lcp[:, None]].tobytes()


class Run:
    """A front-coded run, read from its start."""

    def __init__(self, lcp: bytes, rests: bytes, size: int):
        self.lcp, self.rests, self.size = lcp, rests, size
        self.at, self.place, self.key = 0, 0, b""

    def next(self) -> int:
        """Go to the next key; its common prefix with the one before, or -1 at the end."""
        if self.at == len(self.lcp):
            return -1
        shared = self.lcp[self.at]
        end = self.place + self.size - shared
        self.key = self.key[:shared] + self.rests[self.place : end]
        self.place = end
        self.at += 1
        return shared


class LoserTree:
    """Merges runs of keys of one size. known[i] is the common prefix of run i's key with the last key put out, -1 if the run has ended."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.leaves = 1 << max(0, len(runs) - 1).bit_length()
        self.known = [0 if r.next() >= 0 else -1 for r in runs] + [-1] * (self.leaves - len(runs))
        self.losers = [-1] * self.leaves
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.leaves:
            return node - self.leaves
        win, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return win

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); keys are only read where known prefixes are equally long, and only from there on."""
        known = self.known
        x, y = known[a], known[b]
        if x > y:
            return a, b
        if y > x:
            return b, a
        if x < 0:
            return a, b
        s, t = self.runs[a].key, self.runs[b].key
        i, n = x, len(s)
        if s[i:] == t[i:]:
            known[b] = n
            return a, b
        while s[i] == t[i]:
            i += 1
        if s[i] < t[i]:
            known[b] = i
            return a, b
        known[a] = i
        return b, a

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """(run of each key, common prefix with the key before), in order."""
        order, shared = [], []
        known, losers, runs, leaves, play = self.known, self.losers, self.runs, self.leaves, self._play
        win = self.winner
        while known[win] >= 0:
            order.append(win)
            shared.append(known[win])
            known[win] = runs[win].next()
            node = (win + leaves) >> 1
            while node:
                lose = losers[node]
                x, y = known[win], known[lose]
                if y > x:
                    losers[node], win = win, lose
                elif x == y and x >= 0:
                    win, losers[node] = play(win, lose)
                node >>= 1
        return np.array(order, np.int64), np.array(shared, np.int64)


def _split(shape: Shape):
    def split(runs: DataFrame) -> DataFrame:
        n = runs.agg(F.sum("n")).first()[0] or 0
        buckets = max(8, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))

        def run(batches):
            for b in batches:
                for r in b.to_pylist():
                    rows, docs = sorted_run(shape, r["rows"], r["docs"])
                    route = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)
                    to = ((route >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                    cut = np.searchsorted(to, np.arange(buckets + 1))
                    out = []
                    for i in np.flatnonzero(np.diff(cut)).tolist():
                        part = rows[cut[i] : cut[i + 1]]
                        lcp, rests = front_coded(part[:, : shape.head])
                        out.append((r["uid"], i, int(cut[i]), squeezed(docs[cut[i] : cut[i + 1]].tobytes()), squeezed(lcp), squeezed(rests), squeezed(part[:, shape.head :].tobytes())))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["uid", "bucket", "at", "docs", "lcp", "rests", "sides"])

        return runs.select("uid", "docs", "rows").mapInArrow(lean_batches(run), RUN.replace("rows binary", "lcp binary, rests binary, sides binary"))

    return split


def _resolve(shape: Shape):
    def resolve(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["uid"])
        runs = [Run(released(r["lcp"]), released(r["rests"]), shape.head) for r in rows]
        order, lcp = LoserTree(runs).merged()
        start = np.cumsum([0, *(len(r.lcp) for r in runs)])
        place = np.empty(len(order), np.int64)
        by_run = np.argsort(order, kind="stable")  # the n-th key of a run that comes out is its n-th
        place[by_run] = np.arange(len(order))
        sides = np.frombuffer(b"".join(released(r["sides"]) for r in rows), np.uint8).reshape(-1, shape.row - shape.head)[place]
        docs = np.frombuffer(b"".join(released(r["docs"]) for r in rows), "<i8")[place]
        left = sides[:, : (shape.width - 1) * shape.unit]
        offsets = sides[:, -3:-1]
        bits = np.empty(len(order), "<u4")
        bits[place] = earlier(shape, lcp, left, offsets, docs)
        return pa.table({"uid": pa.array([r["uid"] for r in rows], pa.int64()), "at": pa.array([r["at"] for r in rows], pa.int64()), "bits": pa.array([bits[a:b].tobytes() for a, b in zip(start, start[1:], strict=False)], pa.binary())})

    return resolve


def dedup_substrings(docs: DataFrame, length: int = 50, gram: int = 24, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Remove each byte covered by a string of `length` bytes that also starts in a document with a smaller id.

    Returns (id, n_bytes, n_removed, n_spans, kept), one row for each row of docs; kept is what is left, or with digest the hex of its
    SHA-256. Strings are judged on the input and never cross documents; overlaps count. A null text is an empty one. Rows that
    repeat an id are one document to each other. A row with a null id has no place in the order: it neither removes nor loses
    anything. Texts are shuffled once, to meet the census of their grams."""
    shape = Shape(words=False, length=length, gram=gram)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = remove_repeats(rows, shape, _split(shape), _resolve(shape), digest)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), "kept")


def op2_suffix_merge(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"), digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
