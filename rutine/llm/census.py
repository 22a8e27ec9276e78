"""In how many documents each hash of a document occurs, counted over the whole corpus.

Each batch of documents sends its hashes to buckets, four bytes for each hash: the bucket is the top of the hash, and there are as many
as the input has parts of BUCKET bytes, so that their size stays. A bucket counts and answers in the order asked, so answers need no hashes; they
are put together for each document again. A hash that many documents of a batch share is sent once, with its number of documents,
so that a hash of a third of all rows is one entry for each batch. Texts are not moved. Two hashes that agree in bucket and four
bytes are counted together: a count may be too high, in about one of 5000 cases, never too low."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rutine.llm.common import arrow_batches, lean_batches, lean_group, parts

#: Bytes of input for each bucket; a bucket, which one task holds, gets about an eighth of that.
BUCKET = 256 << 20
#: The highest class of a count.
TOP = 40


def classes(counts: np.ndarray) -> np.ndarray:
    """0 for a count of 1, 1 for 2, 2 for 3 and 4, 3 for 5 to 8, and so on."""
    return np.minimum(TOP, np.ceil(np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def _folded(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which are the first of their value, the place among those of each that isn't)."""
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    new = np.zeros(len(h), bool)
    new[first] = True
    rank = np.cumsum(new)[first] - 1
    return new, rank[inverse][~new].astype("<u4")


def _owners(owner: np.ndarray, docs: int) -> bytes:
    """Whose the hashes in a bucket are: a number for each document, or, if that is shorter, the document of each hash."""
    if 2 * len(owner) < 4 * docs and docs <= 1 << 16:
        return owner.astype("<u2").tobytes()
    return np.bincount(owner, minlength=docs).astype("<u4").tobytes()


def _counts(owners: bytes, docs: int) -> np.ndarray:
    if len(owners) < 4 * docs:
        return np.bincount(np.frombuffer(owners, "<u2"), minlength=docs)
    return np.frombuffer(owners, "<u4")


def _answers(group: pa.Table) -> pa.Table:
    """Replace a bucket's hashes by the classes of their counts."""
    blobs = group.column("hashes").to_pylist()
    h = np.frombuffer(b"".join(blobs), "<u4")
    ends = np.cumsum([0, *(len(b) >> 2 for b in blobs)])
    out = np.zeros(len(h), np.uint8)
    if len(h):
        n = np.ones(len(h), np.int64)
        for at, again in zip(ends, group.column("again").to_pylist(), strict=False):
            if again:
                more = np.bincount(np.frombuffer(again, "<u4"))
                n[at : at + len(more)] += more
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        out[order] = np.repeat(classes(np.add.reduceat(n[order], first)), np.diff(np.append(first, len(h))))
    codes = pa.array([out[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
    return group.set_column(group.schema.get_field_index("hashes"), "hashes", codes)


def _together(group: pa.Table) -> pa.Table:
    """A row for each document of a batch, its classes in the order of its hashes."""
    rows = sorted(group.to_pylist(), key=lambda r: r["bucket"])
    n = rows[0]["docs"]
    ids, sigs = rows[0]["ids"], rows[0]["sigs"]
    counts = [_counts(r["counts"], n) for r in rows]
    owner = np.concatenate([np.repeat(np.arange(n, dtype=np.int32), c) for c in counts])
    codes = []
    for r, c in zip(rows, counts, strict=True):
        total, sent = int(c.sum()), np.frombuffer(r["hashes"], np.uint8)
        new = np.unpackbits(np.frombuffer(r["new"], np.uint8), count=total).astype(bool)
        all_ = np.empty(total, np.uint8)
        all_[new], all_[~new] = sent, sent[np.frombuffer(r["again"], "<u4")]
        codes.append(all_)
    codes = np.concatenate(codes)[np.argsort(owner, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.sum(counts, axis=0), dtype=np.int64)])
    out = pa.array([codes[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
    kind = group.schema.field("ids").type.value_type
    return pa.table({"id": pa.array(ids, kind), "sig": pa.array(sigs, pa.int64()), "codes": out})


def census(docs: DataFrame, hashes: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """docs (id, text) with two more columns, sig, a hash of the text, and codes, a byte for each of the text's hashes.

    hashes(texts) gives the sorted distinct 64-bit hashes of each text, one text after the other, and how many each has. codes holds classes() of the numbers of rows of docs whose
    texts have them too; it is null where a text is. Rows that repeat both id and text are counted, and answered, each."""
    spark = docs.sparkSession
    arrow_batches(spark)
    buckets = parts(docs, BUCKET)
    docs = docs.withColumn("sig", F.xxhash64("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            all_, each = hashes(b.column(1).to_pylist())
            top = ((all_ >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            owner = np.repeat(np.arange(len(each)), each)
            order = np.argsort(top, kind="stable")
            low, owner = (all_ >> np.uint64(16)).astype("<u4")[order], owner[order]
            each_bucket = np.bincount(top, minlength=buckets)
            used = np.union1d(np.flatnonzero(each_bucket), [0])
            ends = np.append(0, np.cumsum(each_bucket))[np.append(used, buckets)]
            rows = []
            for i, a, z in zip(used.tolist(), ends.tolist(), ends[1:].tolist(), strict=False):
                new, again = _folded(low[a:z])
                rows.append((i, _owners(owner[a:z], len(each)), low[a:z][new].tobytes(), np.packbits(new).tobytes(), again.tobytes()))
            top, *blobs = zip(*rows, strict=True)
            none = [None] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + k] * len(rows), pa.int64()), pa.array(top, pa.int32()), pa.array([len(each)] * len(rows), pa.int32()), *(pa.array(x, pa.binary()) for x in blobs),
                    pa.array([b.column(0).to_pylist(), *none], pa.list_(b.schema.field(0).type)), pa.array([b.column(2).to_pylist(), *none], pa.list_(pa.int64())),
                ],
                names=["uid", "bucket", "docs", "counts", "hashes", "new", "again", "ids", "sigs"],
            )

    schema = f"uid long, bucket int, docs int, counts binary, hashes binary, new binary, again binary, ids array<{kind}>, sigs array<long>"
    asked = docs.where("text IS NOT NULL").select("id", "text", "sig").mapInArrow(lean_batches(run), schema)
    answered = asked.groupBy("bucket").applyInArrow(lean_group(_answers), schema)
    each = answered.groupBy("uid").applyInArrow(lean_group(_together), f"id {kind}, sig long, codes binary")
    each = each.groupBy("id", "sig").agg(F.first("codes").alias("codes")).withColumnsRenamed({"id": "_id", "sig": "_sig"})
    return docs.join(each, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sig") == F.col("_sig")), "left").drop("_id", "_sig")
