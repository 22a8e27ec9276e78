"""Motif search in the series of one log: matrix profiles, pan-profiles, time-warped motif sets. Long logs are many tasks."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rutine.operators import vectors
from rutine.operators.bands import banded, in_order, pairs_of, spans
from rutine.operators.scans import numbered
from rutine.operators.warped import DIGITS, TILE, apart, long_paths, paths_of, paths_of_several, scale_of
from rutine.plans.shipping import ship
from rutine.plans.tables import written


def exclusion(m: int, denominator: int = 4) -> int:
    return math.ceil(m / denominator)


def symbol_costs(levels: np.ndarray, weights: list[float]) -> np.ndarray:
    """Hierarchy distances of all pairs of rows of levels (symbols, n)."""
    n = levels.shape[1]
    same = (levels[:, None, :] == levels[None, :, :]).astype(float)
    below = np.concatenate([np.cumsum(same[:, :, ::-1], axis=2)[:, :, ::-1][:, :, 1:], np.zeros((*same.shape[:2], 1))], axis=2)
    return ((1 - same) * np.array(weights) * (1 - below / (n - np.arange(n) + 1))).sum(axis=2)


def diagonal_means(ids_a: np.ndarray, ids_b: np.ndarray, costs: np.ndarray, m: int, diagonals):
    """(first place in a, first place in b, mean cost of each window) of each diagonal: offset d pairs a[i] with b[i + d]."""
    for d in diagonals:
        i, j = max(0, -d), max(0, d)
        n = min(len(ids_a) - i, len(ids_b) - j)
        if n < m:
            continue
        s = np.concatenate([[0.0], np.cumsum(costs[ids_a[i : i + n], ids_b[j : j + n]])])
        yield i, j, (s[m:] - s[:-m]) / m


def symbol_profile(ids: np.ndarray, costs: np.ndarray, m: int, k: int = 1, other: np.ndarray | None = None, denominator: int = 4):
    """(distances, neighbours, nearest on the left, on the right) of each window of length m; k columns, nearest first.

    Within one series, windows closer than the exclusion zone are no neighbours. inf and -1 stand for none."""
    p, at, _, beside = band_profile(ids, costs, m, k, other, denominator)
    return p, at, beside[:, 0], beside[:, 1]


def band_profile(ids: np.ndarray, costs: np.ndarray, m: int, k: int = 1, other: np.ndarray | None = None, denominator: int = 4, band: int = 0, of: int = 1, share: int = 0, shares: int = 1, seed: int = 7):
    """(distances, neighbours, nearest distance and neighbour on the left and on the right) over one of `of` bands of diagonals: of all
    of them, or of one of `shares` seeded shares, in which diagonals of the whole matrix lie scattered."""
    b = ids if other is None else other
    n = max(0, len(ids) - m + 1)
    p, at = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
    side = np.full((n, 2), np.inf), np.full((n, 2), -1, np.int64)

    def offer(rows, d, place):
        less = np.zeros(len(d), bool)
        for c in range(k):
            less |= d < p[rows, c]  # what has made room goes before all that is no nearer
            if not less.any():
                continue
            old_d, old_at = p[rows, c].copy(), at[rows, c].copy()
            p[rows, c], at[rows, c] = np.where(less, d, old_d), np.where(less, place, old_at)
            d, place = np.where(less, old_d, d), np.where(less, old_at, place)

    def beside(rows, d, place, s):
        less = d < side[0][rows, s]
        side[0][rows, s], side[1][rows, s] = np.where(less, d, side[0][rows, s]), np.where(less, place, side[1][rows, s])

    first = exclusion(m, denominator) + 1
    span = range(first, len(b) - m + 1) if other is None else range(-(len(ids) - m), len(b) - m + 1)
    if shares > 1:
        span = np.sort(np.random.default_rng(seed).permutation(np.array(span, np.int64))[share::shares]).tolist()
    if of > 1:
        d = np.array(span, np.int64)
        start, stop = spans(np.minimum(len(ids) - np.maximum(0, -d), len(b) - np.maximum(0, d)) - m + 1, of)[band]
        span = span[start:stop]
    for i, j, d in diagonal_means(ids, b, costs, m, span):
        left, right = np.arange(i, i + len(d)), np.arange(j, j + len(d))
        offer(left, d, right)
        beside(left, d, right, 1)
        if other is None:
            offer(right, d, left)
            beside(right, d, left, 0)
    return p, at, *side


#: Places of a series whose diagonals are one array.
SHORT = 512


def short_profiles(ids: np.ndarray, costs: np.ndarray, lengths: list[int], k: int = 1, denominator: int = 4):
    """(length, what band_profile() gives) of a short series within itself, for each length: all diagonals at once, with the same sums in the same order."""
    n, low = len(ids), min(lengths)
    first = min(exclusion(m, denominator) for m in lengths) + 1
    d = np.arange(first, max(first, n - low + 1))[:, None]
    if len(d):
        j = np.arange(n)[None, :] + d
        cells = np.where(j < n, costs[ids[None, :], ids[np.minimum(j, n - 1)]], 0.0)
        sums = np.concatenate([np.zeros((len(d), 1)), np.cumsum(cells, axis=1)], axis=1)
    for m in lengths:
        w = max(0, n - m + 1)
        skip = exclusion(m, denominator) + 1 - first
        some = d[skip : max(skip, n - m + 1 - first)]
        if not len(some):
            yield m, (np.full((w, k), np.inf), np.full((w, k), -1, np.int64), np.full((w, 2), np.inf), np.full((w, 2), -1, np.int64))
            continue
        s, i = sums[skip : skip + len(some)], np.arange(w)[None, :]
        ahead = np.where(i + some < w, (s[:, m:] - s[:, :-m]) / m, np.inf)
        behind = np.where(i >= some, np.take_along_axis(ahead, np.maximum(i - some, 0), axis=1), np.inf)
        best = [x.argmin(axis=0) for x in (behind, ahead)]
        near = np.stack([x[b, i[0]] for x, b in zip((behind, ahead), best, strict=True)], axis=1)
        step = some[:, 0]
        beside = np.where(np.isfinite(near), np.stack([i[0] - step[best[0]], i[0] + step[best[1]]], axis=1), -1)
        if k == 1:  # of equal ones the smaller step, then the one ahead
            left = (near[:, 0] < near[:, 1]) | ((near[:, 0] == near[:, 1]) & (best[0] < best[1]))
            yield m, (np.where(left, near[:, 0], near[:, 1])[:, None], np.where(left, beside[:, 0], beside[:, 1])[:, None], near, beside)
            continue
        both = np.stack([ahead, behind], axis=1).reshape(-1, w)
        order = np.argsort(both, axis=0, kind="stable")[:k]
        p, at = np.full((k, w), np.inf), np.full((k, w), -1, np.int64)
        p[: len(order)] = np.take_along_axis(both, order, axis=0)
        at[: len(order)] = i + np.where(order % 2 == 0, 1, -1) * step[order // 2]
        yield m, (p.T, np.where(np.isfinite(p), at, -1).T, near, beside)


def series_profile(x: np.ndarray, m: int, denominator: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distances and neighbours by the k-dimensional matrix profile of one series: x is (places, dimensions), both results (dimensions, windows).

    Row k has the best mean over the k + 1 best dimensions of z-normalised Euclidean distances."""
    w = vectors.Windows(np.asarray(x, float), m)
    best, _ = vectors.tile(w, w, None, None, exclusion(m, denominator))
    return best.p.T, best.at.T


def window_distances(x: np.ndarray, m: int, i: int) -> np.ndarray:
    """z-normalised distances of the window at i to all windows: (dimensions, windows). A flat window is 0 from a flat one and sqrt(m) from any other."""
    w = np.lib.stride_tricks.sliding_window_view(x, m, axis=0).transpose(1, 0, 2)
    sd = w.std(axis=2, keepdims=True)
    flat = sd[:, :, 0] < 1e-10
    z = (w - w.mean(axis=2, keepdims=True)) / np.where(sd < 1e-10, 1, sd)
    out = np.sqrt(((z - z[:, i, None]) ** 2).sum(axis=2))
    return np.where(flat & flat[:, i, None], 0.0, np.where(flat | flat[:, i, None], math.sqrt(m), out))


def top_motifs(p: np.ndarray, at: np.ndarray, k: int, window: int) -> list[tuple[int, int, float]]:
    """The k best (place, neighbour, distance); after each, half a window around both is taken out."""
    p, out = p.astype(float).copy(), []
    for _ in range(k):
        if not len(p) or not np.isfinite(p).any():
            break
        i = int(np.argmin(p))
        j = int(at[i])
        out.append((i, j, float(p[i])))
        for x in (i, j):
            p[max(0, x - window // 2) : min(len(p), x + window // 2) + 1] = np.inf
    return out


def balanced_lengths(low: int, high: int, step: int = 1) -> list[int]:
    """Lengths low, low + step, ... up to high, by halving: the middle first, then the middles of both halves, and so on."""
    lengths, out, queue = list(range(low, high + 1, step)), [], [(0, (high - low) // step)] if high >= low else []
    while queue:
        a, b = queue.pop(0)
        if a <= b:
            mid = (a + b) // 2
            out.append(lengths[mid])
            queue += [(a, mid - 1), (mid + 1, b)]
    return out


def distinct_motifs(found: list[dict], least: int) -> list[dict]:
    """The best of motifs (m, i, j, score) that are near each other at either end, over all lengths."""
    out: list[dict] = []
    for c in sorted(found, key=lambda c: (-c["score"], c["m"], c["i"])):
        if all(abs(c["i"] - o["i"]) >= max(least, o["m"] // 2) and abs(c["j"] - o["j"]) >= max(least, o["m"] // 2) for o in out):
            out.append(c)
    return out


def time_warped_sets(x: np.ndarray, low: int, high: int, rho: float, most: int | None = None, overlap: float = 0.0) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Motif sets of variable length in a series (places, dimensions): [(representative, members)], half-open, best first.

    Similarities of places are kept where they exceed the rho-quantile. Warping paths are grown along the similarity matrix by
    local alignment: steps (1,1), (1,2) and (2,1), gains above the threshold and losses below it; each path pairs two segments. Of paths that meet, or run
    side by side, the better one stays whole. Representatives are
    all segments of low to high places; the members of one are read off the sub-paths within it. A set's worth is the harmonic mean of its
    coverage and of its mean similarity. Sets are taken greedily, without overlap beyond the given share: all of them, or the first `most`."""
    n = len(x)
    if n < 2 * low:
        return []
    alike = Similarities(x)
    return sets_of_paths(paths_of(alike.row, n, low, alike.quantile(rho), alike.cells), n, low, high, most, overlap)


#: Cells of similarities that several series may hold at once.
CELLS = 1 << 19


def several_sets(series: list[tuple[np.ndarray, int, int]], rho: float, most: int | None = None):
    """(number, time_warped_sets()) of each of many series (places, low, high): those of about one length are searched at once."""
    order, at = sorted(range(len(series)), key=lambda k: -len(series[k][0])), 0
    while at < len(order):
        some = order[at : at + max(1, CELLS // max(1, len(series[order[at]][0]) ** 2))]
        at += len(some)
        long = [k for k in some if len(series[k][0]) >= 2 * series[k][1]]
        if len(long) == 1:
            yield long[0], time_warped_sets(*series[long[0]], rho, most)
        elif long:
            alike = [Similarities(series[k][0]) for k in long]
            paths = paths_of_several([a.all() for a in alike], [series[k][1] for k in long], [a.quantile(rho) for a in alike])
            for k, found in zip(long, paths, strict=True):
                x, low, high = series[k]
                yield k, sets_of_paths(found, len(x), low, high, most)


def sets_of_paths(paths: list[tuple[np.ndarray, np.ndarray]], n: int, low: int, high: int, most: int | None = None, overlap: float = 0.0) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Motif sets of a series of n places from its paths (cells, similarities)."""
    if not paths:
        return []
    return _taken_sets(*_all_covered(paths, low, high), n, most, overlap)


class Similarities:
    """Gaussian similarities of all pairs of places of a series, worked out by rows: no array of places by places is held.

    Equal vectors are one, and where few differ, as with series of symbols, a table of them is looked up."""

    TABLE = 4096

    def __init__(self, x: np.ndarray):
        self.distinct, self.at, self.count = np.unique(x, axis=0, return_inverse=True, return_counts=True)
        self.at = self.at.ravel()
        self.scale = scale_of(float(x.std()), x.shape[1])
        self.table = np.concatenate(list(self._blocks())) if len(self.distinct) <= self.TABLE else None

    def _blocks(self, rows: int = 256):
        for a in range(0, len(self.distinct), rows):
            yield self._between(self.distinct[a : a + rows])

    def _between(self, some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), len(self.distinct)))
        for k in range(some.shape[1]):
            d = some[:, k, None] - self.distinct[None, :, k]
            d *= d
            out += d
        out *= self.scale
        return np.round(np.exp(out, out=out), DIGITS)

    def row(self, i: int) -> np.ndarray:
        """Similarities of place i to all places."""
        one = self.table[self.at[i]] if self.table is not None else self._between(self.distinct[self.at[i]][None])[0]
        return one[self.at]

    def all(self) -> np.ndarray:
        """Similarities of all pairs of places of a short series."""
        table = self.table if self.table is not None else np.concatenate(list(self._blocks()))
        return table[self.at[:, None], self.at[None, :]]

    def cells(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Similarities of the places i to the places j, one by one."""
        if self.table is not None:
            return self.table[self.at[i], self.at[j]]
        return np.array([self.row(a)[b] for a, b in zip(i.tolist(), j.tolist(), strict=True)])

    def quantile(self, q: float) -> float:
        """The quantile, interpolated, of the similarities of all pairs of different places: two passes, the second over one narrow range of values."""
        n = len(self.at)
        ends = [min(int(q * (n * (n - 1) // 2 - 1)) + i, n * (n - 1) // 2 - 1) for i in (0, 1)]
        bins = 1 << 16
        hist = np.zeros(bins + 1)
        for _, value, times in self._weighted():
            hist += np.bincount((value * bins).astype(np.int64).ravel(), weights=times.ravel(), minlength=bins + 1)
        below = np.cumsum(hist)
        low, high = (int(np.searchsorted(below, e, side="right")) for e in ends)
        values, weights = [], []
        for _, value, times in self._weighted():
            place = (value * bins).astype(np.int64)
            here = (place >= low) & (place <= high) & (times > 0)
            values.append(value[here])
            weights.append(times[here])
        values, weights = np.concatenate(values), np.concatenate(weights)
        order = np.argsort(values)
        rank = np.cumsum(weights[order]) + (below[low - 1] if low else 0)
        a, b = (float(values[order[np.searchsorted(rank, e, side="right")]]) for e in ends)
        part = q * (n * (n - 1) // 2 - 1) - ends[0]
        return round(a + (b - a) * part, DIGITS)

    def _weighted(self):
        """(first row, similarities of some distinct vectors to all, how many pairs of places have each): each pair of vectors once."""
        at = 0
        for value in self._blocks():
            times = self.count[at : at + len(value), None] * self.count[None, :].astype(float)
            places = np.arange(at, at + len(value))
            times[np.arange(len(value)), places] = self.count[places] * (self.count[places] - 1) / 2
            times[np.arange(len(self.distinct))[None, :] < places[:, None]] = 0
            yield at, value, times
            at += len(value)


#: Places of paths that are looked up at once.
COVERED = 1 << 20


def _covered(path: np.ndarray, fits: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(start, end, member start, member end, mean similarity) of all representatives of low to high places that a path relates to a member.

    A member is read off the sub-path within the representative, which the path spans. Both segments of the path count."""
    return _all_covered([(path, fits)], low, high)


def _all_covered(paths: list[tuple[np.ndarray, np.ndarray]], low: int, high: int) -> tuple[np.ndarray, ...]:
    """What _covered() gives of all paths (cells, similarities), looked up together."""
    out, sides, held = [(np.empty(0, np.int32),) * 4 + (np.empty(0),)], [], 0
    for path, fits in paths:
        sums = np.concatenate([[0.0], np.cumsum(fits)])  # of the similarities along the path
        for a, b in (path.T, path.T[::-1]):
            size = int(a[-1] - a[0]) + 1
            if size < low:
                continue
            at = np.searchsorted(a, np.arange(a[0], a[-1] + 2, dtype=path.dtype))  # where the path reaches a place
            sides.append((a, b, at, sums))
            held += size
            if held >= COVERED:
                out, sides, held = out + _looked_up(sides, low, high), [], 0
    return tuple(np.concatenate(x) for x in zip(*(out + _looked_up(sides, low, high))))


def _looked_up(sides: list[tuple[np.ndarray, ...]], low: int, high: int) -> list[tuple[np.ndarray, ...]]:
    """What _covered() gives of sides of paths, for each length: (places, those of the other side, where the path reaches each place, sums of similarities)."""
    if not sides:
        return []
    spans, steps = np.array([len(at) - 1 for _, _, at, _ in sides]), np.array([len(a) for a, _, _, _ in sides])
    ahead = np.repeat(np.cumsum(steps + 1) - steps - 1, spans + 1)  # each side's sums are one longer than its path, and so are, here, its other places
    at = np.concatenate([at for _, _, at, _ in sides]) + ahead
    b = np.concatenate([np.append(b, b[:1]) for _, b, _, _ in sides])
    sums = np.concatenate([s for _, _, _, s in sides])
    start = np.concatenate([np.arange(a[0], a[-1] + 2, dtype=a.dtype) for a, _, _, _ in sides])
    left = np.concatenate([np.arange(n, -1, -1) for n in spans])  # places from here to the end of the side
    out = []
    for m in range(low, min(high, int(spans.max())) + 1):
        u = np.flatnonzero(left >= m)
        i, j = at[u], at[u + m] - 1
        fine = i <= j
        u, i, j = start[u[fine]], i[fine], j[fine]
        out.append((u, u + u.dtype.type(m), b[i], b[j] + 1, (sums[j + 1] - sums[i]) / (j + 1 - i)))
    return out


def _bounds(group: np.ndarray, first: np.ndarray, last: np.ndarray, mean: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """No less than the worth of each group (numbered from 0, ascending): its members' union and its own length, at its best similarity."""
    order = np.lexsort((first, group))
    g, a, b = group[order].astype(np.int64), first[order].astype(np.int64), last[order].astype(np.int64)
    reach = np.maximum.accumulate(b + g * 2 * n) - g * 2 * n  # groups lie apart, so that none reaches into the next
    before = np.concatenate([[0], reach[:-1]])
    before[np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))] = 0
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    cover = np.minimum(n, np.add.reduceat(np.maximum(0, b - np.maximum(a, before)), heads) + length) / n
    fit = np.maximum.reduceat(mean, heads)
    return 2 * cover * fit / (cover + fit) + 1e-12


def _taken_sets(start, end, first, last, mean, n: int, most: int | None, overlap: float) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
    """Motif sets taken greedily from what _covered() gives. A representative is looked at only while the bound of its worth is not below the best
    that is known; after each set, only those that it touches are looked at anew."""
    order = np.lexsort((first * np.int64(n + 1) + last, -mean, start * np.int64(n + 1) + end))
    start, end, first, last, mean = (x[order] for x in (start, end, first, last, mean))
    number = np.cumsum(np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)])) - 1 if len(start) else np.zeros(0, np.int64)
    taken, known, out = np.zeros(n, bool), {}, []  # known: worth and members of a representative, for as long as nothing touches it
    while len(start) and (most is None or len(out) < most):
        heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        tails = np.append(heads[1:], len(start))
        names, group = number[heads], np.repeat(np.arange(len(heads)), tails - heads)
        bound = _bounds(group, first, last, mean, end[heads] - start[heads], n)
        best = (-1.0, 0, -1)
        for g in np.argsort(-bound, kind="stable").tolist():
            if bound[g] < best[0]:
                break
            name = int(names[g])
            if name not in known:
                u = (int(start[heads[g]]), int(end[heads[g]]))
                members, fits, busy = [u], [], ((1 << (u[1] - u[0])) - 1) << u[0]
                span = slice(heads[g], tails[g])
                for p, q, fit in zip(first[span].tolist(), last[span].tolist(), mean[span].tolist(), strict=True):
                    mask = ((1 << (q - p)) - 1) << p
                    if not busy & mask:
                        busy |= mask
                        members.append((p, q))
                        fits.append(fit)
                cover, fit = sum(b - a for a, b in members) / n, sum(fits) / len(fits) if fits else 0.0
                known[name] = (2 * cover * fit / (cover + fit) if fits else -1.0, members)
            best = max(best, (known[name][0], -name, g))
        if best[0] < 0:
            break
        g = best[2]
        out.append(((int(start[heads[g]]), int(end[heads[g]])), sorted(known[-best[1]][1])))
        for a, b in out[-1][1]:
            taken[a:b] = True
        busy = np.concatenate([[0], np.cumsum(taken)])
        open_ = (busy[end] - busy[start]) / (end - start) <= overlap
        stay = open_ & ((busy[last] - busy[first]) / (last - first) <= overlap)
        for name in np.unique(number[~stay]).tolist():
            known.pop(name, None)
        start, end, first, last, mean, number = (x[stay] for x in (start, end, first, last, mean, number))
    return out


def _kind(df: DataFrame) -> str:
    ship(df.sparkSession)
    return df.schema["log_id"].dataType.simpleString()


def _rows(p: pa.Table, kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    """Rows of one log as a table, with the log's id in front."""
    ids = p.column("log_id").combine_chunks()
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table({"log_id": ids.take(pa.array([0] * len(rows), pa.int64())), **{n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)}})


def _symbols(p: pd.DataFrame, weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    return _coded(p.sort_values("event_index")["levels"].tolist(), weights)


def _coded(levels: list, weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    levels, ids = np.unique(np.array(levels), axis=0, return_inverse=True)
    return ids.ravel(), symbol_costs(levels, weights)


def _levels_of(list_) -> np.ndarray:
    """An Arrow list of lists of equal size as an array (places, levels)."""
    inner = list_.values
    flat = inner.flatten()
    plain = len(inner) and not flat.null_count and (pa.types.is_integer(flat.type) or pa.types.is_floating(flat.type))
    return flat.to_numpy().reshape(len(inner), -1) if plain else np.array(list_.as_py())


def _profiles(work: DataFrame, weights: list[float], share: int = 0, shares: int = 1, seed: int = 7) -> DataFrame:
    """Profiles of work (log_id, a, b, m, k): windows of the lengths in the array m of the levels a among those of b, or, where b is null, of a itself."""

    def part(row, band, bands):
        a, b = row["a"], row["b"]
        ids, costs = _coded(a + (b or []), weights)
        return band_profile(ids[: len(a)], costs, row["m"], row["k"], None if b is None else ids[len(a) :], band=band, of=bands, share=share, shares=shares, seed=seed)

    def whole(row):
        a, b, k, lengths = _levels_of(row["a"]), row["b"], row["k"].as_py(), row["m"].as_py()
        if not len(a) or (b.is_valid and not len(b)):
            return
        ids, costs = _coded(np.concatenate([a, _levels_of(b)]) if b.is_valid else a, weights)
        if not b.is_valid and shares == 1 and len(ids) <= SHORT:
            yield from short_profiles(ids, costs, lengths, k)
            return
        for m in lengths:
            yield m, band_profile(ids[: len(a)], costs, m, k, ids[len(a) :] if b.is_valid else None, share=share, shares=shares, seed=seed)

    alone, n = F.col("b").isNull(), F.size("a")
    return banded(work.withColumn("alone", alone).withColumn("pairs", pairs_of(n, F.when(alone, n).otherwise(F.size("b")), F.array_min("m")) / F.when(alone, 2 * shares).otherwise(shares)), (part, whole))


def _of_itself(log: DataFrame, lengths: list[int], k: int) -> DataFrame:
    """Work of profiles of logs among themselves, for some lengths."""
    none = F.lit(None).cast(log.select(F.array("levels")).schema[0].dataType)
    return in_order(log, "levels", "a").select("log_id", "a", none.alias("b"), F.array(*map(F.lit, lengths)).alias("m"), F.lit(k).alias("k"))


def anytime_profile(log: DataFrame, weights: list[float], m: int, k: int = 1, shares: int = 16, seed: int = 7, most: int | None = None, seconds: float | None = None, state: DataFrame | None = None, done: int = 0) -> tuple[DataFrame, int]:
    """(profile, shares done): (log_id, i, distances, neighbours) as matrix_profile() has them, by shares of the diagonals, until `most` more are done or the time is up.

    Diagonals are dealt to shares in a seeded order. What is known is a written table: give it and the number of shares back to go on, in this session or a later one. Before all shares are
    done the distances are upper bounds, which only fall; after the last one the profile is exact. At least one share is done in each call."""
    began, work, ended = time.monotonic(), _of_itself(log, [m], k), shares if most is None else min(shares, done + most)
    while done < ended:
        new = _profiles(work, weights, done, shares, seed).select("log_id", "i", "distances", "neighbours")
        if state is not None:
            offset = lambda at: at - F.col("i")
            entry = lambda d, at: F.struct(d.alias("d"), F.when(at < 0, F.lit(1 << 62)).otherwise(2 * F.abs(offset(at)) + (offset(at) < 0).cast("long")).alias("order"), at.alias("at"))
            new = new.unionByName(state).withColumn("_all", F.zip_with("distances", "neighbours", entry)).groupBy("log_id", "i").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_all"))), 1, k).alias("_all"))
            new = new.select("log_id", "i", F.col("_all.d").alias("distances"), F.col("_all.at").alias("neighbours"))
        state, done = written(new, "anytime"), done + 1
        if seconds is not None and time.monotonic() - began > seconds:
            break
    return state, done


def matrix_profile(log: DataFrame, weights: list[float], m: int, k: int = 1) -> DataFrame:
    """(log_id, i, distances, neighbours, left, right) of each window of length m of logs with `levels`. A long log's diagonals are dealt over tasks."""
    return _profiles(_of_itself(log, [m], k), weights).drop("m")


def smallest(profile: DataFrame, n: int = 10) -> DataFrame:
    """The n smallest distances of each log: (log_id, rank, i, distance, neighbour)."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("log_id").orderBy("distance", "i")
    rows = profile.select("log_id", "i", F.get("distances", F.lit(0)).alias("distance"), F.get("neighbours", F.lit(0)).alias("neighbour")).where("neighbour >= 0")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def profile_motifs(log: DataFrame, weights: list[float], m: int, top: int = 5) -> DataFrame:
    """The best motifs of each log by its profile, with exclusion zones: (log_id, rank, i, j, distance)."""

    def run(p: pa.Table) -> pa.Table:
        i, d, at = (p.column(c).to_numpy() for c in ("i", "distance", "neighbour"))
        order = np.argsort(i)
        found = top_motifs(d[order], at[order], top, m)
        return _rows(p, {"rank": pa.int32(), "i": pa.int64(), "j": pa.int64(), "distance": pa.float64()}, [(r + 1, *x) for r, x in enumerate(found)])

    profile = matrix_profile(log, weights, m).select("log_id", "i", F.get("distances", F.lit(0)).alias("distance"), F.get("neighbours", F.lit(0)).alias("neighbour"))
    return profile.groupBy("log_id").applyInArrow(run, f"log_id {_kind(profile)}, rank int, i long, j long, distance double")


def pan_profile(log: DataFrame, weights: list[float], low: int, high: int, step: int = 1, k: int = 1, most: int | None = None) -> DataFrame:
    """(log_id, m, i, distance, neighbour, distances, neighbours) for every length from low to high, k neighbours each. Each (log, length) is a task of its own, or several.

    `most` is a budget: so many lengths, in an order that halves what lies between; all if it is null."""
    lengths = balanced_lengths(low, high, step)[:most]
    return _pan(_profiles(_of_itself(log, lengths, k), weights))


def _pan(profiles: DataFrame) -> DataFrame:
    return profiles.select("log_id", "m", "i", F.get("distances", F.lit(0)).alias("distance"), F.get("neighbours", F.lit(0)).alias("neighbour"), "distances", "neighbours")


def anytime_pan(log: DataFrame, weights: list[float], low: int, high: int, step: int = 1, k: int = 1, most: int | None = None, seconds: float | None = None, done: dict[int, DataFrame] | None = None) -> dict[int, DataFrame]:
    """{length: rows as pan_profile() has them}, each a written table, in the order of balanced_lengths(), until `most` more lengths are done or the time is up.

    Give the result back as `done` to go on. together(list(result.values())) reads all of it; at least one length is done in each call, if one is left."""
    began, out = time.monotonic(), dict(done or {})
    for m in [m for m in balanced_lengths(low, high, step) if m not in out][:most]:
        out[m] = written(_pan(_profiles(_of_itself(log, [m], k), weights)), "pan")
        if seconds is not None and time.monotonic() - began > seconds:
            break
    return out


def refined(found: DataFrame, pan: DataFrame, delta: int = 2) -> DataFrame:
    """Motifs (log_id, m, i, j, distance, score) moved to the best of the starts within delta places of their own: the nearest pair there by the
    pan-profile, ties to the smaller move, then to the left. rho is 1 - distance² / (2 m)."""
    near = found.withColumn("_i", F.explode(F.sequence(F.col("i") - delta, F.col("i") + delta)))
    rows = pan.select("log_id", "m", F.col("i").alias("_i"), F.col("neighbour").alias("_j"), F.col("distance").alias("_d")).where("neighbour >= 0")
    best = near.join(rows, ["log_id", "m", "_i"]).groupBy("log_id", "m", "i", "j", "score").agg(F.min(F.struct("_d", F.abs(F.col("_i") - F.col("i")).alias("_move"), "_i", "_j")).alias("b"))
    return best.select("log_id", "m", F.col("b._i").alias("i"), F.col("b._j").alias("j"), F.col("b._d").alias("distance"), "score", (1 - F.col("b._d") * F.col("b._d") / (2 * F.col("m"))).alias("rho"))


def join_profile(log: DataFrame, other: DataFrame, weights: list[float], m: int, k: int = 1) -> DataFrame:
    """(log_id, i, distances, neighbours) of each window of log among all windows of the log of that id in other, k of them, nearest first."""
    work = in_order(log, "levels", "a").join(in_order(other, "levels", "b"), "log_id").withColumns({"m": F.array(F.lit(m)), "k": F.lit(k)})
    return _profiles(work, weights).select("log_id", "i", "distances", "neighbours")


def pan_motifs(pan: DataFrame, top: int = 10, separation: int = 5) -> DataFrame:
    """The best motifs over all lengths of a pan-profile: (log_id, m, i, j, distance, score), scores standardised within a length."""

    def run(p: pa.Table) -> pa.Table:
        lengths, i, dist, near = (p.column(c).to_numpy() for c in ("m", "i", "distance", "neighbour"))
        order = np.lexsort((i, lengths))
        lengths, dist, near = lengths[order], dist[order], near[order]
        cuts = np.flatnonzero(np.diff(lengths, prepend=lengths[0] - 1))
        found = []
        for a, b in zip(cuts, [*cuts[1:], len(lengths)], strict=True):
            m, d, at = int(lengths[a]), dist[a:b], near[a:b]
            fine = np.isfinite(d)
            if not fine.any():
                continue
            rank = np.empty(len(d))
            rank[np.argsort(d, kind="stable")] = np.arange(len(d))
            score = 1 - rank / max(1, len(d) - 1)
            z = (score - score[fine].mean()) / (score[fine].std() or 1)
            found += [{"m": m, "i": i, "j": j, "distance": x, "score": float(z[i])} for i, j, x in top_motifs(d, at, top, max(10, m))]
        rows = [(c["m"], c["i"], c["j"], c["distance"], c["score"]) for c in distinct_motifs(found, separation)[:top]]
        return _rows(p, {"m": pa.int32(), "i": pa.int64(), "j": pa.int64(), "distance": pa.float64(), "score": pa.float64()}, rows)

    pan = pan.select("log_id", "m", "i", "distance", "neighbour")
    return pan.groupBy("log_id").applyInArrow(run, f"log_id {_kind(pan)}, m int, i long, j long, distance double, score double")


def vector_profile(log: DataFrame, m: int, vector: str = "vector", size: int | None = None) -> DataFrame:
    """(log_id, i, distances, neighbours): the multi-dimensional matrix profile, an entry for each number of dimensions.

    Windows are dealt in blocks of `size`; any size gives the same."""
    size = size or vectors.block_size(m)
    return vectors.profile(written(vectors.in_blocks(vectors.series(log, vector), m, size), "blocks"), m, exclusion(m), size)


def motif_sets(log: DataFrame, low: int | str, high: int | str, rho: float = 0.8, most: int | None = None, vector: str = "vector", tile: int = TILE) -> DataFrame:
    """(log_id, cluster_id, start, end) of variable-length, time-warped motif sets; half-open, cluster_id numbers sets from the best.

    low and high are lengths, or columns that hold those of each log. Logs of at most `tile` places are searched whole, many by one task; the similarities of a longer one are worked out by tiles
    of that size, dealt over tasks, and only its paths come together. Both give the same."""
    low, high = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (low, high))
    rows = log.select("log_id", "event_index", F.col(vector).cast("array<double>").alias("v"), low.cast("int").alias("low"), high.cast("int").alias("high"))
    rows = written(rows, "series")
    kind = rows.schema["log_id"].dataType.simpleString()
    schema, columns = "cluster_id int, start long, end long", ["log_id", "cluster_id", "start", "end"]
    ship(log.sparkSession)

    def whole(batches):
        for b in batches:
            series = [(np.asarray(_levels_of(x), float), low.as_py(), high.as_py()) for x, low, high in zip(*(b.column(c) for c in ("v", "low", "high")), strict=True)]
            for k, found in several_sets(series, rho, most):
                rows = [(c, *span) for c, (_, members) in enumerate(found) for span in members]
                if rows:
                    c, start, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("log_id").take(pa.array([k] * len(rows), pa.int64())), pa.array(c, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=columns)

    def tiled(p: pd.DataFrame) -> pd.DataFrame:
        n, low, high = (int(p[c].iloc[0]) for c in ("size", "low", "high"))
        paths = []
        for r in p.sort_values(["worth", "head"], ascending=[False, True]).itertuples():
            at = np.array(r.places, np.int64)
            paths.append((np.stack([at // n, at % n], axis=1).astype(np.int32), np.array(r.fits)))
        found = sets_of_paths(apart(paths, low), n, low, high, most)
        return pd.DataFrame([(p["log_id"].iloc[0], c, a, b) for c, (_, members) in enumerate(found) for a, b in members], columns=columns)

    facts = rows.groupBy("log_id").agg(F.count("*").alias("_n"), F.min("low").alias("low"), F.min("high").alias("high"))
    facts = written(facts, "lengths")
    long = facts.where(F.col("_n") > tile).drop("_n")
    short = rows.join(facts.where(F.col("_n") <= tile).select("log_id"), "log_id", "left_semi")
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # little data, much work: small partitions stay apart
    short = in_order(short.repartition(parts, "log_id"), "v", "v").join(facts.select("log_id", "low", "high"), "log_id")
    out = short.mapInArrow(whole, f"log_id {kind}, {schema}")
    if long.isEmpty():
        return out
    series = numbered(rows.join(long.select("log_id"), "log_id", "left_semi").select("log_id", "event_index", "v"), ["log_id"], ["event_index"], "at")
    paths = long_paths(written(series.select("log_id", "at", "v"), "series"), long.select("log_id", "low"), rho, tile)
    return out.unionByName(paths.join(long, "log_id").groupBy("log_id").applyInPandas(tiled, f"log_id {kind}, {schema}"))


def vector_motifs(log: DataFrame, m: int, most: int = 10, denominator: int = 1, vector: str = "vector", size: int | None = None) -> DataFrame:
    """Motifs of the multi-dimensional profile: (log_id, dimensions, i, j, distance, subspace, matches), one row for each number of dimensions.

    i and j are the best pair of windows over so many dimensions, subspace those in which they are closest, and matches the windows nearest to
    i in that subspace, i itself first, at most `most`, each outside the exclusion zones of the ones before and no further than the mean of the
    row's profile less two deviations, or than j."""

    size = size or vectors.block_size(m)
    rows = written(vectors.series(log, vector), "series")
    blocks = written(vectors.in_blocks(rows, m, size), "blocks")
    zone = exclusion(m, denominator)
    return vectors.motifs_of(vectors.profile(blocks, m, zone, size), rows, blocks, m, most, zone, size)
