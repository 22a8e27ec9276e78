"""Warped self-alignment: tiles against the whole, heads against a plain walk."""

import random

import numpy as np
import pytest

from rutine.operators import motifs, warped


def series(r, n, kinds=6):
    routine = [r.randrange(kinds) for _ in range(9)]
    out = []
    while len(out) < n:
        out += routine if r.random() < 0.4 else [r.randrange(kinds) for _ in range(r.randrange(1, 8))]
    return [[float(c), float(c * c % 5)] for c in out[:n]]


def plain_paths(s, low, tau):
    """Each cell goes with the best cell that it leads to; cells of one head, of low or more, make a path. {head: cells}."""
    n = len(s)
    worth, back = {}, {}
    for i in range(n):
        for j in range(i + low, n):
            way, best = 1, worth.get((i - 1, j - 1), 0.0)
            for k, p in ((2, (i - 1, j - 2)), (3, (i - 2, j - 1))):
                if worth.get(p, 0.0) >= best:
                    way, best = k, worth.get(p, 0.0)
            new = best + (s[i, j] if s[i, j] >= tau else -0.5)
            if new > 0:
                worth[(i, j)], back[(i, j)] = new, way if best > 0 else 0
    used, out = set(), {}
    for top in sorted(worth, key=lambda c: (-worth[c], c)):
        path, c = [], top
        while c not in used:
            path.append(c)
            if not back[c]:
                break
            a, b = ((1, 1), (1, 2), (2, 1))[back[c] - 1]
            c = (c[0] - a, c[1] - b)
        used |= set(path)
        if len(path) >= low:
            out[top] = path[::-1]
    return out


def test_heads_are_a_plain_walk():
    r = random.Random(5)
    for n, low, rho in ((40, 3, 0.8), (60, 4, 0.6), (30, 2, 0.9)):
        x = np.array(series(r, n))
        alike = motifs.Similarities(x)
        s, tau = np.array([alike.row(i) for i in range(n)]), alike.quantile(rho)
        want = plain_paths(s, low, tau)
        best, head, _ = warped.headed(*warped.aligned(alike.row, n, n, 0, 0, low, tau), 0, 0, n)
        heads, _, places = warped.pieces(best, head, 0, 0, n, low)
        assert {divmod(h, n): [divmod(p, n) for p in ps.tolist()] for h, ps in zip(heads, places, strict=True)} == want
        paths = warped.paths_of(alike.row, n, low, tau)
        cells = [{tuple(c) for c in p.tolist()} for p, _ in paths]
        for k, mine in enumerate(cells):  # none comes near a better one
            assert not any(abs(i - a) <= low // 2 and abs(j - b) <= low // 2 for other in cells[:k] for i, j in mine for a, b in other)


def test_quantile_of_tiles():
    x = np.array(series(random.Random(2), 90))
    alike = motifs.Similarities(x)
    s = warped.likeness(x, x, alike.scale)
    assert np.array_equal(s, np.array([alike.row(i) for i in range(90)]))
    for rho in (0.0, 0.5, 0.83, 1.0):
        assert alike.quantile(rho) == pytest.approx(np.quantile(s[np.triu_indices(90, 1)], rho), abs=1e-9)


@pytest.mark.parametrize("tile", [16, 37])
def test_tiles_give_what_the_whole_gives(spark, tile):
    r = random.Random(tile)
    logs = {0: series(r, 100), 1: series(r, 75), 2: series(r, 10), 3: series(r, 33)}
    rows = [(i, k * 2, v) for i, x in logs.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "log_id long, event_index long, vector array<double>").repartition(3)
    for low, high, rho in ((3, 9, 0.85),):
        whole = sorted(tuple(x) for x in motifs.motif_sets(df, low, high, rho).collect())
        tiled = sorted(tuple(x) for x in motifs.motif_sets(df, low, high, rho, tile=tile).collect())
        assert whole == tiled and {0, 1, 3} <= {x[0] for x in whole}


def test_several_series_are_searched_as_each_alone():
    """Those of about one length share each step of their rows; before, every log took all steps by itself."""
    rng = np.random.default_rng(5)
    series = [(rng.integers(0, 4, (n, 2)).astype(float), low, high) for n, low, high in ((40, 3, 9), (64, 5, 12), (5, 3, 4), (63, 2, 30), (90, 4, 4), (1, 2, 2), (720, 6, 9))]
    series += [(np.zeros((30, 3)), 3, 6), (rng.normal(size=(50, 1)), 2, 8)]
    found = dict(motifs.several_sets(series, 0.7))
    for k, (x, low, high) in enumerate(series):
        assert found.get(k, []) == motifs.time_warped_sets(x, low, high, 0.7)
    assert len(found) > 5 and sum(map(len, found.values())) > len(found)


def test_many_short_logs_are_dealt_and_keep_their_own_lengths(spark):
    rng = np.random.default_rng(6)
    logs = {g: (rng.integers(0, 3, (20 + 7 * (g % 5), 2)).astype(float), 3 + g % 3, 8 + g % 4) for g in range(25)}
    rows = [(g, i, v, low, high) for g, (x, low, high) in logs.items() for i, v in reversed(list(enumerate(x.tolist())))]
    log = spark.createDataFrame(rows, "log_id long, event_index long, vector array<double>, lo int, hi int")
    got = sorted(map(tuple, motifs.motif_sets(log, "lo", "hi", 0.7).collect()))
    want = [(g, c, a, b) for g, (x, low, high) in logs.items() for c, (_, members) in enumerate(motifs.time_warped_sets(x, low, high, 0.7)) for a, b in members]
    assert got == sorted(want) and got
