"""Passages that also start in an earlier document: what both substring operators share.

Any window of `length` symbols holds windows of `gram` symbols; the leftmost of smallest hash is its anchor, chosen by content alone. All
windows with one anchor form a family: the anchor at p, window starts from low to high. Equal windows have equal anchors, so it
is enough to compare families whose anchors are equal grams: window p - o of one equals window p' - o of another
if their next length - o symbols and their last o symbols before the anchor agree. Families
whose gram occurs in one document only are dropped (census). Of the others the suffix at the anchor is exchanged, truncated to
`length` symbols, with the few symbols before it; once sorted, with common prefixes known, the windows at
offset o that agree are those of a run of suffixes with common prefixes of length - o or more and equal symbols on the left.

Families with the same symbols in a batch of documents go once, for the smallest document among them. Families of grams in
very many documents are exchanged window by window instead, each by all of its symbols, so that a passage of a third of all
rows is spread, and what is equal has been folded before."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rutine.llm.census import census, classes
from rutine.llm.common import arrow_batches, drop, lean_batches, lean_group, written
from rutine.llm.symbols import BYTES, SLICE, anchors, mix, rolled, words_of_all

#: A gram in more documents than this has its windows exchanged one by one.
COMMON = 1024
#: Symbols, and families, that are worked on at once: few enough for a processor's cache, whatever a text's length.
PART = 1 << 15


@dataclass(frozen=True)
class Shape:
    """What a symbol is, and the numbers of symbols in a window and in a gram."""

    words: bool
    length: int
    gram: int

    @property
    def width(self) -> int:
        """Offsets at which an anchor may stand in its window."""
        return self.length - self.gram + 1

    @property
    def unit(self) -> int:
        """Bytes of a symbol in a key. Words are told apart by their whole 64-bit hashes: for a false match, two windows would have to
        agree in all other words too."""
        return 8 if self.words else 1

    def groups(self, raws: Iterable[bytes]) -> Iterator[tuple[int, list[bytes]]]:
        """(first text, texts) of neighbours that are worked on together, about a slice of them."""
        at, size, some = 0, 0, []
        for i, raw in enumerate(raws):
            if some and size + len(raw) > SLICE:
                yield at, some
                at, size, some = i, 0, []
            some.append(raw)
            size += len(raw)
        if some:
            yield at, some

    def symbols(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts, number of each)."""
        if self.words:
            return words_of_all(raws)
        return np.frombuffer(b"".join(raws), np.uint8), np.array([len(r) for r in raws], np.int64)

    def hashed(self, symbols: np.ndarray) -> np.ndarray:
        return symbols if self.words else BYTES[symbols]

    def families(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, anchor, lowest and highest window start, hash of the gram) of every family. Places are among all symbols."""
        ends, out = np.cumsum(counts), []
        for at in range(0, max(0, len(symbols) - self.length + 1), PART):  # a long text is many parts
            h = rolled(self.hashed(symbols[at : at + PART + self.length - 1]), self.gram)
            a = anchors(h, self.width)
            first, last = np.searchsorted(ends, [at, at + len(a) - 1], side="right")
            stop = ends[first : last + 1] - at  # a window may start up to length before a text's end
            fits = np.zeros(len(a) + 1, np.int8)
            np.add.at(fits, np.clip(np.concatenate([[0], stop[:-1]]), 0, len(a)), 1)
            np.add.at(fits, np.clip(np.maximum(stop - self.length + 1, np.concatenate([[0], stop[:-1]])), 0, len(a)), -1)
            fits = np.cumsum(fits[:-1], dtype=np.int8) > 0
            cut = np.ones(len(a) + 1, bool)
            cut[1:-1] = (a[1:] != a[:-1]) | (fits[1:] != fits[:-1])
            low = np.flatnonzero(cut[:-1] & fits)
            if len(low):
                high = np.flatnonzero(cut[1:] & fits)
                p = a[low]
                out.append((first + np.searchsorted(stop, low, side="right"), p + at, low + at, high + at, h[p]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What the census counts: the gram hashes of each text's families."""
        got = []
        for _, raws in self.groups([x.encode() for x in texts]):
            owner, _, _, _, h = self.families(*self.symbols(raws))
            own = np.sort(owned(owner, h))
            own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
            got.append((own << np.uint64(16), np.bincount((own >> np.uint64(48)).astype(np.int64), minlength=len(raws)).astype(np.int64)))
        return np.concatenate([h for h, _ in got]), np.concatenate([n for _, n in got])

    def suspects(self, symbols: np.ndarray, counts: np.ndarray, codes: bytes) -> tuple[np.ndarray, ...]:
        """Families (text, anchor, low, high, route) that another text may share; single windows for very common grams."""
        owner, p, low, high, h = self.families(symbols, counts)
        own = owned(owner, h)
        order = np.argsort(own)
        new = np.ones(len(own), bool)
        new[1:] = own[order][1:] != own[order][:-1]
        code = np.empty(len(own), np.uint8)
        code[order] = np.frombuffer(codes, np.uint8)[np.cumsum(new) - 1] if len(own) else code
        some = (code > 0) & (code <= _COMMON_CLASS)
        common = np.flatnonzero(code > _COMMON_CLASS)
        if not len(common):
            return owner[some], p[some], low[some], high[some], mix(h[some])
        n = high[common] - low[common] + 1
        starts = np.repeat(low[common] - np.cumsum(n) + n, n) + np.arange(n.sum())
        route = np.concatenate([mix(h[some]), self.window_hashes(symbols, starts)])
        owner = np.concatenate([owner[some], np.repeat(owner[common], n)])
        order = np.argsort(owner, kind="stable")
        return tuple(x[order] for x in (owner, np.concatenate([p[some], starts]), np.concatenate([low[some], starts]), np.concatenate([high[some], starts]), route))

    def window_hashes(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A hash of the window at each of starts, which ascend."""
        h = np.empty(len(starts), np.uint64)
        for at in range(0, len(symbols), PART):
            a, b = np.searchsorted(starts, [at, at + PART])
            if b > a:
                h[a:b] = rolled(self.hashed(symbols[at : at + PART + self.length - 1]), self.length)[starts[a:b] - at]
        return h

    def keys(self, symbols: np.ndarray, ends: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, route: np.ndarray) -> np.ndarray:
        """A row of bytes for each family: route, suffix, symbols on the left from the anchor outwards, the two offsets, and a mark.

        Symbols beyond the text's end, or on the left of the lowest window, are zero."""
        out = [self._keys(symbols, *(x[at : at + PART] for x in (ends, p, low, high, route))) for at in range(0, max(1, len(p)), PART)]
        return np.concatenate(out) if len(out) > 1 else out[0]

    def _keys(self, symbols: np.ndarray, ends: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, route: np.ndarray) -> np.ndarray:
        n, left = self.length, self.width - 1
        start = max(0, int(low.min(initial=len(symbols))) - left)
        near = symbols[start : int(p.max(initial=0)) + n]
        p, low, high, ends = p - start, low - start, high - start, ends - start
        padded = np.concatenate([np.zeros(left, symbols.dtype), near, np.zeros(n, symbols.dtype)])
        right = np.where(np.arange(n) < (ends - p)[:, None], padded[p[:, None] + left + np.arange(n)], 0)
        before = np.where(np.arange(left) < (p - low)[:, None], padded[p[:, None] + left - 1 - np.arange(left)], 0)
        tail = np.stack([p - high, p - low, np.ones_like(p)], axis=1).astype(np.uint8)
        return np.concatenate([route.astype(">u8").view(np.uint8).reshape(len(p), 8), self.packed(right), self.packed(before), tail], axis=1)

    def packed(self, x: np.ndarray) -> np.ndarray:
        return x.astype(">u8").view(np.uint8).reshape(len(x), -1) if self.words else x.astype(np.uint8, copy=False)

    def ranks(self, rows: np.ndarray) -> np.ndarray:
        """Symbols of packed rows, as small numbers that are equal where symbols are."""
        if not self.words:
            return rows
        x = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
        return np.unique(x, return_inverse=True)[1].reshape(x.shape).astype(np.uint32)

    @property
    def head(self) -> int:
        """Bytes of a key that are sorted: the route and the suffix."""
        return 8 + self.length * self.unit

    @property
    def row(self) -> int:
        return self.head + (self.width - 1) * self.unit + 3


_COMMON_CLASS = int(classes(np.array([COMMON]))[0])


def as_text(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings that compare as they do; the mark at their end keeps zeros before it."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{rows.shape[1]}").ravel() if len(rows) else np.zeros(0, f"S{rows.shape[1]}")


def common_prefixes(heads: np.ndarray) -> np.ndarray:
    """Bytes that each row of sorted rows has in common with the one before; 0 for the first."""
    out = np.zeros(len(heads), np.int64)
    if len(heads) > 1:
        differ = heads[1:] != heads[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), heads.shape[1])
    return out


def owned(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """48 bits of each hash behind its owner, of whom there are fewer than 65536."""
    return owner.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16)


def earlier(shape: Shape, lcp: np.ndarray, left: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """A bit for each offset at which a family's window also starts in a document with a smaller id.

    Families are sorted by suffix, and lcp has the bytes of common prefix with the one before (of route and suffix). At each offset the
    families are numbered by what they have on the left, so that symbols are compared, and no hash stands for them."""
    bits, shared = np.zeros(len(docs), np.uint32), np.maximum(lcp - 8, 0) // shape.unit
    shared = np.where(lcp < 8, -1, shared)
    alone = shared < shape.gram  # no window is shared without the whole gram
    on = np.flatnonzero(~alone | ~np.concatenate([alone[1:], [True]])[: len(alone)])
    if not len(on):
        return bits
    symbols, past, low, high = shape.ranks(left[on]), np.zeros(len(on), np.int64), offsets[on, 0], offsets[on, 1]
    many = int(symbols.max(initial=0)) + 1
    for o in range(shape.width):
        stay = high >= o
        if not stay.all():
            on, symbols, past, low, high = on[stay], symbols[stay], past[stay], low[stay], high[stay]
        if not len(on):
            break
        if o:
            past = np.unique(past * many + symbols[:, o - 1], return_inverse=True)[1]
        run = np.cumsum(shared < shape.length - o)[on]
        at = np.flatnonzero(low <= o)
        key = run[at] * (int(past.max()) + 1) + past[at]
        order = np.argsort(key, kind="stable")
        key, doc = key[order], docs[on[at]][order]
        if not len(key):
            continue
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(key))))
        bits[on[at[order[doc > least]]]] |= np.uint32(1 << o)
    return bits


def covered(n: int, shape: Shape, p: np.ndarray, low: np.ndarray, high: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of n symbols lie in a window that is marked in bits. A window's start belongs to one family only."""
    ends = np.zeros(n + shape.length + 1, np.int16)
    for o in range(shape.width):
        ends[p[(bits >> np.uint32(o) & np.uint32(1)).astype(bool) & (p - high <= o) & (o <= p - low)] - o] = 1
    ends[shape.length :] -= ends[: n + 1].copy()
    return np.cumsum(ends[:n], dtype=np.int16) > 0


def result(shape: Shape, symbols: bytes | list[bytes], cover: np.ndarray | None, digest: bool) -> tuple[int, int, int, bytes]:
    """(symbols, removed, maximal removed runs, what is left or the hex of its hash) of a text, given as its bytes or words."""
    if shape.words:
        kept = b" ".join(symbols if cover is None else compress(symbols, (~cover).tolist()))
    else:
        kept = symbols if cover is None else np.frombuffer(symbols, np.uint8)[~cover].tobytes()
    removed, spans = (0, 0) if cover is None else (int(np.count_nonzero(cover)), int(cover[:1].sum()) + int(np.count_nonzero(cover[1:] > cover[:-1])))
    return len(symbols), removed, spans, hashlib.sha256(kept).hexdigest().encode() if digest else kept


ENTRY = np.dtype([("doc", "<u4"), ("p", "<i8"), ("low", "u1"), ("high", "u1"), ("own", "<u4")])
WRITTEN = "kind int, uid long, id long, n long, removed long, spans long, kept binary, ids array<long>, bodies array<binary>, entries binary, docs binary, rows binary"
RUN = "uid long, bucket int, at long, docs binary, rows binary"


def squeezed(x) -> bytes:
    return zstandard.compress(bytes(x) if isinstance(x, np.ndarray) else x, 3)


def released(x: bytes) -> bytes:
    return zstandard.decompress(x)


def sorted_run(shape: Shape, rows: bytes, docs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, documents) of a batch, in order."""
    keys = np.frombuffer(released(rows), np.uint8).reshape(-1, shape.row)
    order = np.argsort(as_text(keys), kind="stable")
    return keys[order], np.frombuffer(released(docs), "<i8")[order]


def _gather(shape: Shape, digest: bool) -> Callable:
    """Rows of WRITTEN of batches (id, text, codes): kind 0, a finished document; kind 1, texts and families of a batch; kind 2, its n keys."""
    schema = pa.schema([("kind", pa.int32()), ("uid", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("kept", pa.binary()), ("ids", pa.list_(pa.int64())), ("bodies", pa.list_(pa.binary())), ("entries", pa.binary()), ("docs", pa.binary()), ("rows", pa.binary())])

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            batch = sorted(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True), key=lambda r: (r[0] is None, r[0] or 0))
            raws = [(r[1] or "").encode() for r in batch]
            done, ids, bodies, keys, entries = [], [], [], [], []
            for at, some in shape.groups(raws):
                symbols, counts = shape.symbols(some)
                owner, p, low, high, route = shape.suspects(symbols, counts, b"".join(batch[at + i][2] or b"" for i in range(len(some))))
                with_id = np.array([batch[at + i][0] is not None for i in range(len(some))], bool)[owner]
                owner, p, low, high, route = (x[with_id] for x in (owner, p, low, high, route))
                ends = np.cumsum(counts)
                has = np.bincount(owner, minlength=len(some)) > 0
                number = np.cumsum(has) - 1 + len(ids)
                if len(p):
                    e = np.zeros(len(p), ENTRY)
                    e["doc"], e["p"], e["low"], e["high"] = number[owner], p - (ends - counts)[owner], p - low, p - high
                    entries.append(e)
                    keys.append(shape.keys(symbols, ends[owner], p, low, high, route))
                for i, raw in enumerate(some):
                    if has[i]:
                        ids.append(batch[at + i][0])
                        bodies.append(raw)
                    else:
                        done.append((batch[at + i][0], *result(shape, raw.split() if shape.words else raw, None, digest)))
            rows = [{"kind": 0, **dict(zip(("id", "n", "removed", "spans", "kept"), r, strict=True))} for r in done]
            if ids:
                e, keys = np.concatenate(entries), np.concatenate(keys)
                _, first, e["own"] = np.unique(as_text(keys), return_index=True, return_inverse=True)  # first: of the smallest id, as documents are in order
                docs = np.array(ids, "<i8")[e["doc"]]
                uid = (part << 32) + k
                rows.append({"kind": 1, "uid": uid, "ids": ids, "bodies": [squeezed(x) for x in bodies], "entries": squeezed(e.tobytes()), "docs": squeezed(docs[first].tobytes())})
                first.sort()  # in the order of the texts neighbours overlap, and compress well; split() sorts them
                rows.append({"kind": 2, "uid": uid, "n": len(first), "docs": squeezed(docs[first].tobytes()), "rows": squeezed(keys[first].tobytes())})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _finish(shape: Shape, digest: bool) -> Callable:
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                e, docs = np.frombuffer(released(r["entries"]), ENTRY), np.frombuffer(released(r["docs"]), "<i8")
                bits = np.zeros(len(docs), np.uint32)
                for x in r["answers"] or []:
                    got = np.frombuffer(x["bits"], "<u4")
                    bits[x["at"] : x["at"] + len(got)] = got
                ids = np.array(r["ids"], "<i8")
                mine = np.where(ids[e["doc"]] > docs[e["own"]], np.uint32(2**shape.width - 1), bits[e["own"]])
                cut, out = np.searchsorted(e["doc"], np.arange(len(ids) + 1)), []
                for at, raws in shape.groups(released(x) for x in r["bodies"]):
                    texts = [x.split() if shape.words else x for x in raws]
                    ends = np.cumsum([0, *map(len, texts)])
                    one, m = e[cut[at] : cut[at + len(raws)]], mine[cut[at] : cut[at + len(raws)]]
                    p = one["p"] + ends[one["doc"].astype(np.int64) - at]
                    cover = covered(int(ends[-1]), shape, p, p - one["low"].astype(np.int64), p - one["high"].astype(np.int64), m)
                    out += [(r["ids"][at + i], *result(shape, x, cover[ends[i] : ends[i + 1]], digest)) for i, x in enumerate(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["id", "n", "removed", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, shape: Shape, split: Callable, resolve: Callable, digest: bool) -> DataFrame:
    """docs (id long, text) without what also starts in an earlier document: (id, n, removed, spans, kept).

    split(runs) gives rows of RUN of a table (uid, n, docs, rows); resolve(table) answers a bucket of those with (uid, at, bits)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    found = census(docs, shape.hashes).select("id", "text", "codes").mapInArrow(lean_batches(_gather(shape, digest)), WRITTEN)
    found = written(found, "runs", "kind")
    answers = split(found.where("kind = 2").select("uid", "n", "docs", "rows")).groupBy("bucket").applyInArrow(lean_group(resolve), "uid long, at long, bits binary")
    answers = written(answers.groupBy("uid").agg(F.collect_list(F.struct("at", "bits")).alias("answers")), "answers")
    drop(found, part="kind=2")
    homes = found.where("kind = 1").select("uid", "ids", "bodies", "entries", "docs").join(answers, "uid", "left").drop("uid")
    fixed = "id long, n long, removed long, spans long, kept binary"
    return found.where("kind = 0").select("id", "n", "removed", "spans", "kept").unionByName(homes.mapInArrow(lean_batches(_finish(shape, digest)), fixed))
