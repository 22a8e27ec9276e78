"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every rank has a bucket of linked-list positions at which the pair of that rank starts. A two-level
bitmap marks the buckets that hold anything; find-first-set on the upper word and then on the lower
one gives the smallest waiting rank without comparing entries. Merges leave old entries in their
buckets; they are skipped when they come up and their position no longer has that rank. A piece
of n bytes costs O(n log n) at worst, so a pre-token of a megabyte is no different from a short one.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rutine.llm.common import arrow_batches, keep, lean_batches, small_batches

#: Pieces above this many characters are encoded anew each time.
CACHED_CHARS = 64
#: A worker's cache is emptied at this many pieces; it bounds memory, results do not depend on it.
CACHED_PIECES = 600_000
#: Pieces of a text that are held at once.
PIECES_AT_ONCE = 200_000

#: White_Space of Unicode.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class RankQueue:
    """Waiting positions by rank. slots[rank] is None, one position, or a heap of positions."""

    def __init__(self, ranks: int):
        self.slots: list[None | int | list[int]] = [None] * (ranks + 1)
        self.low = [0] * ((ranks >> 8) + 1)  # a bit for each rank of 256 whose slot holds anything
        self.top = 0  # a bit for each word of low that isn't 0

    def push(self, rank: int, position: int) -> None:
        there = self.slots[rank]
        if there is None:
            self.slots[rank] = position
            word = rank >> 8
            self.low[word] |= 1 << (rank & 255)
            self.top |= 1 << word
        elif type(there) is int:
            self.slots[rank] = [there, position] if there < position else [position, there]
        else:
            heappush(there, position)

    def pop(self) -> tuple[int, int]:
        """The smallest rank and its smallest position; (-1, -1) if nothing waits."""
        if not self.top:
            return -1, -1
        word = (self.top & -self.top).bit_length() - 1
        x = self.low[word]
        rank = (word << 8) + (x & -x).bit_length() - 1
        there = self.slots[rank]
        if type(there) is list:
            position = heappop(there)
            if there:
                return rank, position
        else:
            position = there
        self.slots[rank] = None
        self.low[word] = x = x & (x - 1)  # the lowest bit goes
        if not x:
            self.top &= self.top - 1
        return rank, position


NO_RANK = 1 << 30


def merged(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The token ids of one pre-token; queue is empty before and after.

    Only pairs that beat both neighbours wait in the queue: the smallest of all always does, so nothing is missed."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))  # start of the part on the left
    rank_of, push, pop = ranks.get, queue.push, queue.pop
    rank_at = [rank_of(piece[i : i + 2], NO_RANK) for i in range(n)]  # of the pair whose left part starts here
    rank_at[-1] = NO_RANK
    rank_at.append(NO_RANK)  # what stands at n, and at -1
    left = NO_RANK
    for i in range(n - 1):
        rank = rank_at[i]
        if rank < left and rank <= rank_at[i + 1] and rank != NO_RANK:
            push(rank, i)
        left = rank
    while True:
        rank, i = pop()
        if rank < 0:
            break
        if rank_at[i] != rank:
            continue  # stale
        j = end[i]
        k = end[i] = end[j]
        rank_at[j] = NO_RANK
        h = before[i]
        if k < n:
            before[k] = i
            mid = rank_at[i] = rank_of(piece[i : end[k]], NO_RANK)
            right = rank_at[k]
            if right < mid:
                if k + 1 == n or right <= rank_at[end[k]]:
                    push(right, k)
        else:
            mid = rank_at[i] = right = NO_RANK
        if h >= 0:
            low = rank_at[h] = rank_of(piece[h:k], NO_RANK)
            g = before[h]
            far = rank_at[g] if g >= 0 else NO_RANK
            if low < far:
                if low <= mid:
                    push(low, h)
            elif far != NO_RANK and (before[g] < 0 or far < rank_at[before[g]]):
                push(far, g)
            if mid < low and mid <= right:
                push(mid, i)
        elif mid != NO_RANK and mid <= right:
            push(mid, i)
    out, i = [], 0
    while i < n:
        k = end[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


def _ranges(kind: str, below: int) -> str:
    """A character class body of the code points below a bound whose general category starts with kind."""
    found = [c for c in range(below) if unicodedata.category(chr(c))[0] == kind]
    out, i = "", 0
    while i < len(found):
        j = i
        while j + 1 < len(found) and found[j + 1] == found[j] + 1:
            j += 1
        out += f"\\u{found[i]:04x}-\\u{found[j]:04x}"
        i = j + 1
    return out


class Splitter:
    """Pre-tokens of a text. Texts of Latin letters and general punctuation go to the standard library's
    engine, with the same classes spelled out; it is twice as fast. All others go to the pattern itself."""

    #: A pattern for which the spelled-out form below holds.
    KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, pattern: str):
        self.general = regex.compile(pattern)
        self.plain = self.beyond = None
        if pattern == self.KNOWN:
            a, d, s = _ranges("L", 0x250), _ranges("N", 0x250), SPACES
            self.plain = re.compile(f" ?[{a}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{d}]+| ?[^{s}{a}{d}]+|[{s}]+(?![^{s}])|[{s}]+")
            self.beyond = re.compile("[^\x00-ɏ -⁯]").search

    def runs(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens, as lists of bounded length."""
        pattern = self.plain if self.plain and not self.beyond(text) else self.general
        if len(text) < 2 * PIECES_AT_ONCE:
            yield [m for m in pattern.findall(text)]
            return
        found = (m[0] for m in pattern.finditer(text))
        while some := list(islice(found, PIECES_AT_ONCE)):
            yield some


class Codec:
    """Encodes and decodes with one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.splitter = Splitter(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.queue = RankQueue(max(ranks.values(), default=0))
        self.cache: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        """Ids of a pre-token as packed int32."""
        raw = piece.encode()
        one = self.ranks.get(raw)
        out = array("i", (one,) if one is not None else merged(raw, self.ranks, self.queue)).tobytes()
        if len(piece) <= CACHED_CHARS:
            if len(self.cache) >= CACHED_PIECES:
                self.cache.clear()
            self.cache[piece] = out
        return out

    def packed(self, text: str) -> bytes:
        out = []
        for some in self.splitter.runs(text):
            try:
                out.append(b"".join(map(self.cache.__getitem__, some)))
            except KeyError:
                get, piece = self.cache.get, self.piece
                out.append(b"".join([get(x) or piece(x) for x in some]))
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<i4")

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker and vocabulary, with a cache that lives until the worker gets a task of another operator."""
    keep("tokens", codec.cache_clear)
    return Codec(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text, and the bytes that they decode to.

    Returns (id, ids array<int>, decoded binary), one row for each row of docs. A null text is an empty
    one: no ids and no bytes. Ids may be null or repeated; rows do not meet. No shuffle: each
    task reads its split once, and a lost task is redone alone. vocabulary is a path that every worker can open."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        c = codec(vocabulary, pattern)
        for batch in small_batches(batches):
            packed = [c.packed(x) if x else b"" for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) >> 2 for x in packed)], dtype=np.int64)
            flat = np.frombuffer(b"".join(packed), "<i4")
            decoded = [c.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    return rows.mapInArrow(lean_batches(run, keeps="tokens"), f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)
