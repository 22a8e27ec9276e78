"""Hashes of bytes, words and runs of either, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
#: Blank and the controls tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
PLAIN = np.arange(256, dtype=np.uint8)
#: Bytes or symbols that are worked on at once.
SLICE = 1 << 20
#: Bytes that are cut into words at once, unless one is longer: few enough for a processor's cache.
PIECE = 1 << 15
#: Words are hashed as polynomials modulo this prime, 2**31 - 1, at two points.
PRIME = U(0x7FFFFFFF)
POINTS = (1183186591, 742938285)


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    y = x >> U(30)
    y ^= x
    y *= U(0xBF58476D1CE4E5B9)
    y ^= y >> U(27)
    y *= U(0x94D049BB133111EB)
    y ^= y >> U(31)
    return y


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k hashes; len(h) - k + 1 of them. Runs of powers of two are joined up to k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, at, size, power = None, 0, 1, h
    while True:
        if k & size:
            part = power[at : at + n]
            out = part.copy() if out is None else out * ODD + (part ^ (part >> U(29)))
            at += size
        if size * 2 > k:
            return mix(out)
        left = power[: len(power) - size]
        right = power[size:]
        power = left * ODD + (right ^ (right >> U(31)))
        size *= 2


_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """Powers of base modulo 2**64, from the 0th."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        got = _powers[int(base)] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, SLICE) - 1, base)]), dtype=np.uint64)
    return got[:n]


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k of up to some SLICEs of hashes, by sums of prefixes. It guides what is compared, and decides nothing."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(ODD, len(h)), out=c[1:])
    return mix((c[k:] - c[:n]) * _power(INVERSE, n))


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost smallest value, by its first 44 bits, among each width neighbours. h is no longer than SLICE."""
    n, size = len(h) - width + 1, 1
    if n <= 0:
        return np.zeros(0, np.int64)
    v = (h & ~U(SLICE - 1)) | np.arange(len(h), dtype=np.uint64)
    while size * 2 <= width:
        v = np.minimum(v[size:], v[:-size])
        size *= 2
    if size < width:
        v = np.minimum(v[width - size : width - size + n], v[:n])
    return (v[:n] & U(SLICE - 1)).astype(np.int64)


_points: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62."""
    x = (x & PRIME) + (x >> U(31))
    x = (x & PRIME) + (x >> U(31))
    return np.where(x >= PRIME, x - PRIME, x)


def _at_point(point: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a point modulo PRIME and of its inverse, from the 0th, n or more. A worker keeps them, so there are no more than a piece needs."""
    got = _points.get(point)
    if got is None or len(got[0]) < n:
        out = []
        for base in (point, pow(point, -1, int(PRIME))):
            power = np.ones(1, np.uint64)
            while len(power) < max(n, PIECE):
                power = np.concatenate([power, _reduced(power * U(pow(base, len(power), int(PRIME))))])
            out.append(power)
        got = _points[point] = tuple(out)
    return got


def words(raw: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of a text, a word being a run of anything but blank and the controls tab to carriage return.

    A word's hash is its polynomial's value at two points of the field of 2**31 - 1 elements, with two bits of its length."""
    out, starts, start, size = [], [], 0, PIECE
    while start < len(raw):
        piece = np.frombuffer(raw, np.uint8, min(size, len(raw) - start), start)
        space = IS_SPACE[piece]
        if start + len(piece) < len(raw):  # end at a separator, or look further
            last = len(piece) - int(np.argmax(space[::-1])) if space.any() else 0
            if not last:
                size *= 2
                continue
            piece, space = piece[:last], space[:last]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        a, b = edge[::2], edge[1::2]
        if len(a):
            values = ((LOWER if lower else PLAIN)[piece]).astype(np.uint64) + U(1)
            h = (b - a).astype(np.uint64) << U(62)
            for shift, point in zip((0, 31), POINTS, strict=True):
                power, inverse = _at_point(point, len(piece))
                c = np.zeros(len(piece) + 1, np.uint64)
                terms = values * power[: len(piece)]  # below 2**39
                np.cumsum(terms if len(piece) < 1 << 22 else _reduced(terms), out=c[1:])
                h |= _reduced(_reduced(c[b] - c[a]) * inverse[a]) << U(shift)
            out.append(mix(h))
            starts.append(a + start)
        start, size = start + len(piece), PIECE
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(starts)


def word_hashes(raw: bytes, lower: bool = False) -> np.ndarray:
    return words(raw, lower)[0]


def words_of_all(raws: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each)."""
    h, starts = words(b"\n".join(raws), lower)
    ends = np.cumsum([len(r) + 1 for r in raws])
    return h, np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(raws)).astype(np.int64)


def distinct_by_owner(owner: np.ndarray, h: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each owner, one after the other; how many each has; the place of every given one among them)."""
    order = np.lexsort((h, owner))
    o, s = owner[order], h[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[new], np.bincount(o[new], minlength=owners).astype(np.int64), place
