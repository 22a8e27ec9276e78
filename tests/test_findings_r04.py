"""What the findings of the fourth round named: steps that grew faster than their input."""

import numpy as np
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from rutine.operators import grammar, intervals, motifs, warped
from rutine.plans import tables
from rutine.sources import logs


def most_joined(df):
    """Rows that the largest join of df makes."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        plan = todo.pop()
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "Join" in plan.nodeName():
            most = max(most, plan.metrics().get("numOutputRows").get().value())
    return most


def test_band_match_is_not_a_product_of_equal_numbers(spark):
    a = spark.range(400).selectExpr("id AS pos", "id % 2 AS num")
    b = spark.range(300).selectExpr("300 - id AS pos", "id % 3 + 4 AS num")
    out = intervals.band_first(a, b, 3)
    assert most_joined(out) <= 400
    got = {(x.a_pos, x.a_num, x.b_num, x.accuracy) for x in out.collect()}
    want = {(i, i % 2, *min((p, n, abs(n - i % 2)) for p, n in ((300 - j, j % 3 + 4) for j in range(300)) if abs(n - i % 2) <= 3)[1:]) for i in range(400) if i % 2}
    assert got == want


@pytest.mark.parametrize("k", [1, 3])
def test_short_profiles_are_those_by_diagonals(k):
    r = np.random.default_rng(k)
    for n in (0, 1, 5, 6, 7, 20, 61):
        ids, costs = r.integers(0, 4, n), np.abs(np.subtract.outer(np.arange(4.0), np.arange(4.0))) / 3
        got = dict(motifs.short_profiles(ids, costs, [7, 5, 6], k))
        for m in (5, 6, 7):
            assert all(np.array_equal(a, b) for a, b in zip(got[m], motifs.band_profile(ids, costs, m, k), strict=True))


def test_short_logs_are_settled_without_a_merge(spark):
    rows = [(log, t, [(t * log) % 3, t % 2]) for log in (1, 2) for t in range(40)]
    df = spark.createDataFrame(rows, "log_id long, event_index long, levels array<int>")
    out = motifs.pan_profile(df, [2.0, 1.0], 3, 6)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert out.where("m = 4").count() == 2 * 37


def test_written_tables_broadcast_little(spark, monkeypatch):
    seen, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (seen.append(spark.conf.get(tables.BROADCAST)), write(self, path))[1])
    before = spark.conf.get(tables.BROADCAST)
    tables.written(spark.range(3), "some")
    spark.conf.set(tables.BROADCAST, "-1")
    tables.written(spark.range(3), "some")
    assert spark.conf.get(tables.BROADCAST) == "-1"
    spark.conf.set(tables.BROADCAST, before)
    assert seen == [str(tables.MOST), "-1"]
    assert [tables._bytes(x) for x in ("10485760b", "256k", "10MB", "-1", "7")] == [10 << 20, 256 << 10, 10 << 20, -1, 7]


def test_rows_of_a_large_folder_are_numbered_in_parts(spark, tmp_path, monkeypatch):
    for name, rows in (("a", 7), ("b", 9)):
        (tmp_path / f"{name}.csv").write_text("x\n" + "".join(f"{name}{i}\n" for i in range(rows)))
    want = [(i, f"a{i}") for i in range(7)] + [(7 + i, f"b{i}") for i in range(9)]
    for least in (16, 17):
        monkeypatch.setattr(logs, "LONG", least)
        out = logs.read_folder(spark, str(tmp_path))
        assert ("Window" in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]) == (least == 17)
        assert sorted((r.event_index, r.x) for r in out.collect()) == want


def test_walks_of_many_logs_are_batches(spark):
    log = spark.createDataFrame([(g, i, "ab"[(i // (g + 1)) % 2]) for g in range(4) for i in range(30)], "log_id long, event_index long, app string")
    core = spark.createDataFrame([(g, c, 5 + 8 * c, 7 + 8 * c) for g in range(3) for c in range(3)], "log_id long, core_id int, start_index long, end_index long")
    out = grammar.path_walk(log, core, ["app"], 0.3)
    assert "CoGroups" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        keys = ["ab"[(i // (r.log_id + 1)) % 2] for i in range(30)]
        assert r.lower_pattern_switch == r.start_index - grammar._walk(keys, [5, 13, 21], -1, 0.9)[r.core_id]
        assert r.upper_pattern_switch == r.end_index + grammar._walk(keys, [7, 15, 23], 1, 0.9)[r.core_id]


def test_paths_of_short_logs_are_parted_by_an_array(monkeypatch):
    x = np.random.default_rng(3).integers(0, 3, (70, 2)).astype(float)
    alike = motifs.Similarities(x)
    i, j = np.arange(69), np.arange(1, 70)
    assert alike.cells(i, j).tolist() == [alike.row(a)[a + 1] for a in range(69)]
    some = motifs.time_warped_sets(x, 4, 12, 0.7)
    monkeypatch.setattr(warped, "TILE", 0)
    assert some and motifs.time_warped_sets(x, 4, 12, 0.7) == some
