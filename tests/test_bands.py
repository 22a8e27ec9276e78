"""Profiles by bands of diagonals are those of one run."""

import random

import numpy as np
import pytest

from rutine.operators import bands, motifs


@pytest.mark.parametrize("count", [1, 2, 5, 40])
def test_bands_give_what_one_run_gives(count):
    r = np.random.default_rng(count)
    ids, other, costs = r.integers(0, 4, 61), r.integers(0, 4, 33), np.abs(np.subtract.outer(np.arange(4.0), np.arange(4.0)))
    for b, k in ((None, 1), (None, 3), (other, 2)):
        want = motifs.band_profile(ids, costs, 5, k, b)
        parts = [motifs.band_profile(ids, costs, 5, k, b, band=x, of=count) for x in range(count)]
        i = np.arange(len(want[0]))
        got = bands._merged(np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts], axis=1), i, k, b is None)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
        for s in (0, 1):
            got = bands._merged(np.stack([p[2][:, s] for p in parts], axis=1), np.stack([p[3][:, s] for p in parts], axis=1), i, 1, b is None)
            assert np.array_equal(got[1][:, 0], want[3][:, s])


def test_spans():
    for n, k in ((10, 3), (3, 7), (0, 2), (1000, 16)):
        got = bands.spans(np.arange(n, 0, -1), k)
        assert len(got) == k and [d for a, b in got for d in range(a, b)] == list(range(n))
    work = [sum(range(1000 - b, 1000 - a)) for a, b in bands.spans(np.arange(1000, 0, -1), 16)]
    assert max(work) < 2 * min(work)


def test_profiles_of_many_bands(spark, monkeypatch):
    r = random.Random(4)
    rows = [(log, t, [r.randrange(3), r.randrange(2)]) for log, n in ((0, 90), (1, 12), (2, 3)) for t in range(n)]
    df = spark.createDataFrame(rows, "log_id long, event_index long, levels array<int>").repartition(3)
    as_rows = lambda out: sorted(tuple(x) for x in out.collect())
    whole = [as_rows(motifs.matrix_profile(df, [2.0, 1.0], 5, 2)), as_rows(motifs.join_profile(df, df.where("event_index < 40"), [2.0, 1.0], 4, 2)), as_rows(motifs.pan_profile(df, [2.0, 1.0], 3, 6))]
    monkeypatch.setattr(motifs, "banded", lambda work, part: bands.banded(work, part, least=300))
    monkeypatch.setattr(bands, "PLACES", 16)
    assert [as_rows(motifs.matrix_profile(df, [2.0, 1.0], 5, 2)), as_rows(motifs.join_profile(df, df.where("event_index < 40"), [2.0, 1.0], 4, 2)), as_rows(motifs.pan_profile(df, [2.0, 1.0], 3, 6))] == whole
    assert {x[0] for x in whole[0]} == {0, 1}


def test_anytime_profiles(spark):
    r = random.Random(6)
    rows = [(log, t, [r.randrange(3), r.randrange(2)]) for log in (0, 1) for t in range(50)]
    df = spark.createDataFrame(rows, "log_id long, event_index long, levels array<int>")
    exact = {(x.log_id, x.i): (x.distances, x.neighbours) for x in motifs.matrix_profile(df, [2.0, 1.0], 5, 2).collect()}
    state, done, last = None, 0, None
    while done < 4:
        state, done = motifs.anytime_profile(df, [2.0, 1.0], 5, 2, shares=4, most=1 if done < 2 else None, seconds=0 if done == 2 else None, state=state, done=done)
        now = {(x.log_id, x.i): (x.distances, x.neighbours) for x in state.collect()}
        assert set(now) == set(exact) and all(a >= b for key, (d, _) in now.items() for a, b in zip(d, exact[key][0], strict=True))
        assert last is None or all(a <= b for key, (d, _) in now.items() for a, b in zip(d, last[key][0], strict=True))
        last = now
    assert last == exact
    whole = sorted(tuple(x) for x in motifs.pan_profile(df, [2.0, 1.0], 3, 7).collect())
    some = motifs.anytime_pan(df, [2.0, 1.0], 3, 7, most=2)
    assert list(some) == [5, 3]
    some = motifs.anytime_pan(df, [2.0, 1.0], 3, 7, seconds=0, done=some)
    assert list(some) == [5, 3, 6]
    some = motifs.anytime_pan(df, [2.0, 1.0], 3, 7, done=some)
    assert sorted(tuple(x) for d in some.values() for x in d.collect()) == whole


def test_refined_motifs(spark):
    pan = spark.createDataFrame([(0, 4, i, 20 + i, d) for i, d in enumerate([3.0, 1.0, 2.0, 1.0, 5.0, 0.5])], "log_id long, m int, i long, neighbour long, distance double")
    found = spark.createDataFrame([(0, 4, 2, 22, 2.0, 1.5), (0, 4, 0, 20, 3.0, 1.0)], "log_id long, m int, i long, j long, distance double, score double")
    assert sorted((x.i, x.j, x.distance, x.rho) for x in motifs.refined(found, pan).collect()) == [(1, 21, 1.0, 1 - 1 / 8), (1, 21, 1.0, 1 - 1 / 8)]
