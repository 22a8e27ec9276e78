"""Density clusters by cells, and switches and walks of dealt logs, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rutine.operators import clusters, grammar, sequence


def plain_clusters(x: np.ndarray, eps: float) -> list[int]:
    """All distances of one log's means, and a walk over them."""
    dev = x.std(axis=0)
    z = np.where(dev > 0, (x - x.mean(axis=0)) / np.where(dev > 0, dev, 1), 0.0)
    near = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)) <= eps
    label, number = [-1] * len(x), 0
    for i in range(len(x)):
        if label[i] < 0 and near[i].sum() > 1:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = number
                    todo += np.flatnonzero(near[j]).tolist()
            number += 1
    return label


@pytest.mark.parametrize(("size", "eps"), [(1, 0.05), (6, 1.2)])
def test_clusters_are_those_of_all_distances(spark, size, eps):
    rng = np.random.default_rng(size)
    logs = {0: rng.normal(size=(60, size)), 1: np.repeat(rng.normal(size=(5, size)) * 4, 9, axis=0), 2: np.full((3, size), 0.1), 3: rng.normal(size=(1, size))}
    logs[1][::2] += rng.normal(size=logs[1][::2].shape) * 0.05
    rows = [(g, 7 * i, v) for g, x in logs.items() for i, v in enumerate(x.tolist())]
    means = spark.createDataFrame(rows, "log_id long, window_start long, mean array<double>")
    got = {(r.log_id, r.window_start): r.cluster for r in clusters.cluster_windows(means, eps).collect()}
    assert got == {(g, 7 * i): c for g, x in logs.items() for i, c in enumerate(plain_clusters(x, eps))}
    assert len({c for (g, _), c in got.items() if g == 1}) > 1 and got[3, 0] == -1


def test_clusters_of_odd_means(spark):
    rows = [(0, 0, [1.0, None]), (0, 1, [1.0, float("nan")]), (0, 2, [1.0, 2.0]), (0, 3, [1.0, 2.0])]
    means = spark.createDataFrame(rows, "log_id long, window_start long, mean array<double>")
    assert {r.window_start: r.cluster for r in clusters.cluster_windows(means).collect()} == {0: -1, 1: -1, 2: 0, 3: 0}
    assert clusters.cluster_windows(means.limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.6])
def test_dealt_walks_are_plain_walks(spark, share):
    rng = np.random.default_rng(int(share * 100))
    rows, places = [], []
    for g in range(8):
        text = "".join(rng.choice(list("ab" if g % 2 else "abc"), 40 + g)) if g else "abcd" * 12
        if g > 3:
            text = text[:7] + "abcabcab" * 4 + text[7:]
        rows += [(g, i, c) for i, c in enumerate(text)]
        for k in range(1 if g == 2 else 3 + g):
            lo = int(rng.integers(0, len(text) - 4)) if g <= 3 else 8 + 8 * (k % 4) - int(rng.integers(0, 2)) * (k == 2)
            places.append((g, k, lo, lo + int(rng.integers(0, 3))))
    log = spark.createDataFrame(rows, "log_id long, event_index long, app string")
    core = spark.createDataFrame(places, "log_id long, core_id int, start_index long, end_index long")
    names = ["log_id", "core_id", "lower_pattern_switch", "upper_pattern_switch"]
    want = sorted(map(tuple, grammar.path_walk(log, core, ["app"], share).select(*names).collect()))
    got = sorted(map(tuple, grammar.path_walk(log, core, ["app"], share, long=True).select(*names).collect()))
    assert got == want and len(got) == len(places)
    assert any(w[2] < p[2] for w, p in zip(want, sorted(places), strict=True))


def test_dealt_switches_and_symbols(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, str(c) if c else None) for g in range(2) for i, c in enumerate(np.repeat(rng.integers(0, 3, 60), rng.integers(1, 5, 60)).tolist())]
    log = spark.createDataFrame(rows, "log_id long, event_index long, app string")
    core = log.select("log_id", F.col("event_index").cast("int").alias("core_id"), F.col("event_index").alias("start_index"), F.col("event_index").alias("end_index"))
    for f in (lambda long: grammar.app_switches(log, core, ["app"], long), lambda long: sequence.symbolize(log, ["app"], long)):
        one, dealt = f(False), f(True)
        assert sorted(map(str, one.select(*dealt.columns).collect())) == sorted(map(str, dealt.collect()))


def test_means_exactly_at_the_radius_are_near(spark):
    """Deviations of the first dimension are 5/2 of its unit, so that means 3 units apart are 1.2 apart; the last digits hang on the order of adding."""
    parts = [(0, 0), (3, 0), (4, 1), (-3, 0), (-2, 1), (1, 1)]
    rows = [(g, 7 * i, [(x + g) / 10, float(y)]) for g in range(40) for i, (x, y) in enumerate(parts)]
    means = spark.createDataFrame(rows, "log_id long, window_start long, mean array<double>")
    got = {(r.log_id, r.window_start): r.cluster for r in clusters.cluster_windows(means, 1.2).collect()}
    assert got == {(g, 7 * i): y for g in range(40) for i, (_, y) in enumerate(parts)}
