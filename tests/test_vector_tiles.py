"""Multi-dimensional profiles by tiles: the same rows for any size of block, and no task that holds a whole series."""

import numpy as np
import pytest

from rutine.operators import motifs, vectors


def series(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(90, 5)).round(1)
    x[60:75] = x[20:35]  # copies, whose distance is 0
    x[40:52, 1] = 3.0  # flat windows
    y = r.normal(size=(7, 5))
    rows = [(log, i, v) for log, s in ((1, x), (None, x[::-1]), (2, y), (3, y[:4])) for i, v in enumerate(s.tolist())]
    return x, spark.createDataFrame(rows, "log_id long, event_index long, vector array<double>")


def brute(x, m, zone):
    w = np.lib.stride_tricks.sliding_window_view(x, m, axis=0)
    sd = w.std(axis=2, keepdims=True)
    flat = sd[:, :, 0] < 1e-10
    z = (w - w.mean(axis=2, keepdims=True)) / np.where(sd < 1e-10, 1, sd)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=3))
    f, g = flat[:, None], flat[None]
    d = np.where(f & g, 0.0, np.where(f | g, np.sqrt(m), d))
    means = np.cumsum(np.sort(d, axis=2), axis=2) / np.arange(1, x.shape[1] + 1)
    n = np.arange(len(w))
    means[np.abs(np.subtract.outer(n, n)) <= zone] = np.inf
    return means


@pytest.mark.parametrize("size", [16, 40])
def test_profiles_by_tiles_are_brute_force(spark, size):
    x, log = series(spark)
    out = motifs.vector_profile(log, 6, size=size)
    assert out.where("log_id = 3").isEmpty() and out.where("log_id = 2").count() == 2
    for rows, s in ((out.where("log_id = 1"), x), (out.where("log_id IS NULL"), x[::-1])):
        rows = rows.orderBy("i").collect()
        means = brute(s, 6, 2)
        assert [r.i for r in rows] == list(range(85))
        assert np.allclose([r.distances for r in rows], means.min(axis=1), atol=1e-9)
        for r in rows:
            assert np.allclose([means[r.i, j, k] for k, j in enumerate(r.neighbours)], r.distances, atol=1e-9)
    whole = {(r.log_id, r.i): (r.distances, r.neighbours) for r in motifs.vector_profile(log, 6).collect()}
    assert {(r.log_id, r.i): (r.distances, r.neighbours) for r in out.collect()} == whole


def test_motifs_by_tiles_are_those_of_whole_series(spark):
    _, log = series(spark)
    rows = lambda size: {(r.log_id, r.dimensions): (r.i, r.j, r.distance, r.subspace, r.matches) for r in motifs.vector_motifs(log, 6, size=size).collect()}
    got = rows(16)
    assert got == rows(None) and len(got) == 10
    assert got[1, 5][:3] == (20, 60, 0.0) and got[1, 5][4][:2] == [20, 60]


def test_a_series_is_no_group(spark):
    _, log = series(spark)
    blocks = vectors.in_blocks(vectors.series(log, "vector"), 6, 16)
    assert max(len(r.x) for r in blocks.collect()) == 16 + 5
