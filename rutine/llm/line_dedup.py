"""Line dedup: first occurrences streamed from hashes sorted by range, and compressed keep bitmaps in return.

Each line's key is hashed on the scan. The hashes are dealt by ranges of (hash, document), the largest document first, and sorted by
document and position. A task streams its range: of each key it keeps the first document's lines and drops those of the others as
soon as a third document has come. What a task can't know, because a key goes on in the next range, is at most three documents of one key; such
rows are settled by counts, a row or two for each task. So no task holds a key, however common. Documents get back a
compressed bitmap of the lines that stay, which is applied where the text is."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rutine.llm.common import arrow_batches, parts, table, written

#: What is stripped from both ends of a line, and the letters that are lower-cased.
BLANKS, UPPER, LOWER = " \t\n\x0b\f\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of input for each range of hashes.
RANGE = 32 << 20


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(bare.rlike("[A-Z]"), F.translate(bare, UPPER, LOWER)).otherwise(bare)


def _lines(docs: DataFrame, key: Callable[[Column], Column], least_chars: int) -> DataFrame:
    """(h1, h2, id, sig, at) of every line whose key is long enough; 96 bits tell keys apart."""
    lines = docs.select("id", "sig", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.length("line") >= least_chars)
    keyed = lines.select("id", "sig", "at", key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "id", "sig", "at")


#: What a task says of a row: it goes; it goes if its key turns out to be in enough documents; it is the count of a key's documents in a range.
DROP, OPEN, COUNT = 0, 1, 2


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a value differs from the one before; nulls are alike."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.not_equal(a, b), pc.not_equal(pc.is_valid(a), pc.is_valid(b)))
    return np.concatenate([[True], np.asarray(pc.fill_null(differ, True))])


class _Stream:
    """A range in order of (h1, h2, document from the largest, position): says of each row what can be said.

    held are the rows of the first documents, fewer than enough, of the key that is being read; full tells that enough have come."""

    def __init__(self, least: int):
        self.least, self.held, self.full, self.first = least, None, False, True

    def add(self, batch: pa.Table, last: bool = False) -> list[pa.Table]:
        old = 0 if self.held is None else len(self.held)
        rows = pa.concat_tables([self.held, batch]) if old else batch
        if not len(rows):
            return []
        new_key = _changes(rows["h1"]) | _changes(rows["h2"])
        starts = np.flatnonzero(new_key)
        lengths = np.diff(np.append(starts, len(rows)))
        key = np.repeat(np.arange(len(starts)), lengths)
        nth = np.cumsum(new_key | _changes(rows["id"]))
        rank = nth - nth[starts][key]
        total = rank[starts + lengths - 1] + 1
        if self.full:  # what comes of this key goes, of whichever document
            rank[old : lengths[0]], total[0] = self.least, self.least
        edge = np.zeros(len(starts), bool)
        edge[0] |= self.first
        edge[-1] |= last
        ended = np.ones(len(starts), bool)
        ended[-1] = last
        sure, early = rank >= self.least - 1, rank < self.least - 1
        inner = (ended & ~edge)[key]
        out = [_told(rows, sure | (inner & (rank > 0) & (total >= self.least)[key]), DROP)]
        for k in {0, len(starts) - 1}:
            if edge[k] and ended[k]:
                mine = (key == k) & early
                out += [_told(rows, mine, OPEN), _told(rows.slice(int(starts[k]), 1), np.ones(1, bool), COUNT, min(int(total[k]), self.least))]
        self.first &= len(starts) == 1
        self.held, self.full = rows.filter(pa.array((key == len(starts) - 1) & early)), bool(total[-1] >= self.least)
        return [t for t in out if len(t)]


def _told(rows: pa.Table, which: np.ndarray, state: int, n: int = 0) -> pa.Table:
    kept = rows.filter(pa.array(which))
    return kept.append_column("state", pa.array(np.full(len(kept), state, np.int32))).append_column("n", pa.array(np.full(len(kept), n, np.int64)))


def _dropped(lines: DataFrame, least_docs: int, ranges: int) -> DataFrame:
    """(id, sig, at) of the lines that go; the rows that tasks can't settle are settled by a row or two for each task."""
    order = ["h1", "h2", F.desc("id"), "sig", "at"]
    told = lines.repartitionByRange(ranges, "h1", "h2", F.desc("id")).sortWithinPartitions(*order)

    def run(batches):
        stream, schema = _Stream(least_docs), None
        for b in batches:
            schema = b.schema
            for t in stream.add(pa.Table.from_batches([b])):
                yield from t.combine_chunks().to_batches()
        if schema is not None:
            for t in stream.add(schema.empty_table(), last=True):
                yield from t.combine_chunks().to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema.fields)
    told = written(told.mapInArrow(run, f"{fields}, state int, n long"), "told")
    counts = told.where(F.col("state") == COUNT).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("id").alias("keeper"))
    open_ = told.where(F.col("state") == OPEN).join(counts, ["h1", "h2"]).where(F.col("docs") >= least_docs)
    open_ = open_.where("keeper IS NOT NULL AND (id IS NULL OR id < keeper)")
    return told.where(F.col("state") == DROP).select("id", "sig", "at").unionByName(open_.select("id", "sig", "at"))


def pack(dropped: np.ndarray) -> bytes:
    """The keep bitmap of a document, compressed: a bit for each line up to the last that goes; lines beyond it stay."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    """Which of n_lines lines stay."""
    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)
        keep[: len(bits)] = bits
    return keep


def line_bitmaps(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, key: Callable[[Column], Column] = line_key, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sig, n_dropped, keep) of each document that loses lines; sig is a hash of its text, keep its compressed keep bitmap.

    A line goes if its key has at least least_chars code points, is in at least least_docs documents, and the document is not the
    one with the largest id among them; of that one all lines stay. A null text has no such line. Rows that repeat an id are one document, whatever their
    texts, and rows without an id are one document too, smaller than all others. Very long texts are only more lines, and an
    empty table gives an empty one. Texts are read to hash their lines and are not moved: a line is 28 bytes on its way."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("sig"), F.col(text_col).alias("text"))
    lines = written(_lines(rows, key, least_chars), "lines")  # the bounds of ranges are found by a look at all of them
    gone = _dropped(lines, least_docs, parts(docs, RANGE))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            at = b.column(2).to_pylist()
            keep = pa.array([pack(np.asarray(x)) for x in at], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in at], pa.int64()), keep], names=["id", "sig", "n_dropped", "keep"])

    each = gone.groupBy("id", "sig").agg(F.collect_set("at").alias("at"))
    return each.mapInArrow(run, f"id {kind}, sig long, n_dropped long, keep binary").withColumnRenamed("id", id_col)


def drop_lines(docs: DataFrame, least_docs: int = 3, least_chars: int = 20, key: Callable[[Column], Column] = line_key, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, text) of every row of docs, text being what line_bitmaps() leaves of it, lines joined by newlines.

    A null text is one empty line, and stays null. Other columns are ignored. Each text moves once, to its bitmap."""
    bitmaps = line_bitmaps(docs, least_docs, least_chars, key, id_col, text_col).toDF("_id", "_sig", "n_dropped", "keep")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("sig"), F.col(text_col).alias("text"))
    rows = rows.join(bitmaps.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("sig") == F.col("_sig")), "left").select("id", "text", "n_dropped", "keep")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            counts, texts = [], []
            for text, bitmap in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                counts.append(len(lines))
                texts.append(text if bitmap is None else "\n".join([x for x, stays in zip(lines, unpack(bitmap, len(lines)).tolist(), strict=True) if stays]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pc.fill_null(b.column(2), 0), pa.array(texts, pa.string())], names=["id", "n_lines", "n_dropped", "text"])

    return rows.mapInArrow(run, f"id {kind}, n_lines long, n_dropped long, text string").withColumnsRenamed({"id": id_col, "text": text_col})


def op12_line_bitmaps(spark, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = {
    "op12_line_bitmaps": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.*, coalesce(k.doc_id < c.keeper, false) AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
